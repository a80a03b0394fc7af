import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session
    wh = tempfile.mkdtemp(prefix="tessera-wh-")
    s = get_session("local[4]", app="tessera-tests", shuffle_partitions=4,
                    **{"spark_sql_warehouse_dir": wh})
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir(spark):
    from tessera.session import scratch_path
    return scratch_path(spark, "test")


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()),
                  key=lambda t: tuple((x is None, str(x)) for x in t))
