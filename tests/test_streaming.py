from pyspark.sql import functions as F

from tessera.streaming import stages
from tests.conftest import rows


def test_stream_funnel_and_replayable_upsert(spark, tmp_dir):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    b = spark.createDataFrame([(2, "B", 2), (3, "c", 1)], "k int, v string, seq int")
    a.write.parquet(f"{tmp_dir}/in_a")
    b.write.parquet(f"{tmp_dir}/in_b")
    s = stages.stream_funnel(spark, [f"{tmp_dir}/in_a", f"{tmp_dir}/in_b"], a.schema)
    assert s.isStreaming
    stages.run_available_now(s, f"{tmp_dir}/out", f"{tmp_dir}/ck1")
    assert rows(spark.read.parquet(f"{tmp_dir}/out")) == rows(a.union(b))
    # upsert stream: newest seq wins whatever the file order; a replay changes nothing
    b.write.parquet(f"{tmp_dir}/up")
    a.write.mode("append").parquet(f"{tmp_dir}/up")
    for ck in ("ck2", "ck3"):
        stages.stream_upsert(spark, f"{tmp_dir}/up", a.schema, f"{tmp_dir}/target", ["k"], "seq",
                             f"{tmp_dir}/{ck}", max_files_per_trigger=1)
        assert rows(spark.read.parquet(f"{tmp_dir}/target")) == [(1, "a", 1), (2, "B", 2), (3, "c", 1)]


def test_partitioned_stream_upsert_touches_only_batch_partitions(spark, tmp_dir):
    import glob
    import os
    schema = "k int, p int, v string, seq int"
    base = spark.createDataFrame([(i, i % 3, "old", 1) for i in range(9)], schema)
    stages.merge_latest(spark, f"{tmp_dir}/t", base, ["k"], "seq", ["p"])
    root = tmp_dir.replace("file:", "") + "/t"
    before = {f: os.path.getmtime(f) for f in glob.glob(root + "/p=2/*.parquet")}
    upd = spark.createDataFrame([(0, 0, "new", 2), (9, 0, "ins", 1), (4, 1, "stale", 0)], schema)
    stages.merge_latest(spark, f"{tmp_dir}/t", upd, ["k"], "seq", ["p"])
    got = rows(spark.read.parquet(f"{tmp_dir}/t"), "k", "v", "p")
    assert got == [(0, "new", 0), (1, "old", 1), (2, "old", 2), (3, "old", 0), (4, "old", 1), (5, "old", 2),
                   (6, "old", 0), (7, "old", 1), (8, "old", 2), (9, "ins", 0)]
    after = {f: os.path.getmtime(f) for f in glob.glob(root + "/p=2/*.parquet")}
    assert before == after                                   # untouched partition kept as is
    assert not glob.glob(root + ".__*")


def test_continuous_funnel_picks_up_new_files(spark, tmp_dir):
    a = spark.createDataFrame([(1, "a", 1)], "k int, v string, seq int")
    a.write.parquet(f"{tmp_dir}/in_a/f1")
    spark.createDataFrame([(2, "b", 1)], a.schema).write.parquet(f"{tmp_dir}/in_b/f1")
    s = stages.stream_funnel(spark, [f"{tmp_dir}/in_a/*", f"{tmp_dir}/in_b/*"], a.schema)
    q = stages.start_continuous(s, f"{tmp_dir}/out", f"{tmp_dir}/ck", "1 second")
    try:
        q.processAllAvailable()
        spark.createDataFrame([(3, "c", 1)], a.schema).write.parquet(f"{tmp_dir}/in_a/f2")
        q.processAllAvailable()
    finally:
        q.stop()
    assert rows(spark.read.parquet(f"{tmp_dir}/out"), "k") == [(1,), (2,), (3,)]
