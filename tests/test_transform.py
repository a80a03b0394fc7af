from pyspark.sql import functions as F

from tessera.operators import transform as T
from tests.conftest import rows


def _df(spark):
    return spark.createDataFrame([(i, None if i % 5 == 0 else i % 3) for i in range(40)], "id int, v int")


def test_router_exclusive_partitions_input(spark):
    df = _df(spark)
    links = {"zero": F.col("v") == 0, "one": F.col("v") == 1}
    outs = T.route(df, links, exclusive=True)
    got = sorted(r.id for d in outs.values() for r in d.collect())
    assert got == list(range(40))
    # null predicates go to the otherwise link
    assert {r.id for r in outs["otherwise"].collect()} >= {0, 5, 10}


def test_route_union_matches_route(spark):
    df = _df(spark)
    links = {"small": F.col("v") < 2, "odd": F.col("id") % 2 == 1}
    u = T.route_union(df, links)
    for name, part in T.route(df, links).items():
        assert rows(u.filter(F.col("link") == name), "id") == rows(part, "id")


def test_derive_staged_drops_variables(spark):
    df = _df(spark)
    out = T.derive_staged(df, {"a": F.col("id") * 2, "b": F.col("a") + 1}, outputs={"c": F.col("b") * 10})
    assert out.columns == ["id", "v", "c"]
    assert out.filter(F.col("id") == 3).first().c == 70


def test_classify_default(spark):
    out = T.classify(_df(spark), "cls", [(F.col("v") == 0, "Z")], "OTHER")
    assert {r.cls for r in out.collect()} == {"Z", "OTHER"}


def test_params_resolve():
    p = T.Params({"RUN_DATE": "", "PATH": "/in"})
    r = p.resolve({"PATH": "/x"})
    assert r["PATH"] == "/x" and len(r["RUN_DATE"]) == 10
    assert T.Params.substitute("#PATH#/f.csv", r) == "/x/f.csv"


def test_route_without_otherwise_and_pivot_without_values(spark):
    from tessera.operators import aggregate
    df = _df(spark)
    outs = T.route(df, {"zero": F.col("v") == 0}, otherwise=None)
    assert list(outs) == ["zero"] and outs["zero"].count() == df.filter("v = 0").count()
    p = aggregate.pivot(df.withColumn("one", F.lit(1)), ["v"], "v", F.sum("one"))
    assert set(p.columns) >= {"v", "0", "1", "2"}


def test_params_reject_unknown_names():
    import pytest
    with pytest.raises(KeyError):
        T.Params({"A": 1}).resolve({"B": 2})
