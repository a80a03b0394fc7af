"""Session construction and the shared checkpoint/scratch location.

On a cluster the shared folder is the one the cluster names in
``spark.checkpoint.dir``; it is only invented here when the master is local
(tests, the bench) and the setting is unset.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "tessera",
                shuffle_partitions: int | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoint files of the numbering operators are removed once unreferenced
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        base["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    base.update({k.replace("_", "."): str(v) for k, v in conf.items()})
    for k, v in base.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, reading it from the session.

    If the cluster names none, a folder is created only for a local master;
    on a cluster a machine-local folder would be wrong, so this raises.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
    own = tempfile.mkdtemp(prefix="tessera-ckpt-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)  # one process, one folder: nobody else reads it
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


_cleaned: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location.

    Spark's checkpoint location has a folder per application, so what lies here is this application's own;
    it is removed when the driver's process ends, as later frames may read it until then.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if base not in _cleaned:
        _cleaned.add(base)
        atexit.register(_clean_at_exit, spark)
    return f"{base}/tessera-scratch/{name}-{uuid.uuid4().hex[:12]}"


def _clean_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session, or its gateway, is gone already
        clean_scratch(spark)


def clean_scratch(spark: SparkSession) -> None:
    """Remove this application's scratch folders; call it when their frames have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-scratch")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
