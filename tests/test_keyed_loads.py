"""Keyed loads: swaps that stop half way, keys that move, null and repeated keys, buckets, watermarks."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import dimension, merge
from tessera.sinks import files as sinks
from tessera.streaming import stages
from tests.conftest import rows


def _local(path):
    return path.replace("file:", "")


def _three(spark, path):
    t = spark.createDataFrame([(1, "A", "a"), (2, "B", "b"), (3, "C", "c"), (4, None, "d")], "k int, p string, v string")
    merge.load(spark, path, t, ["k"], "FULL", ["p"])
    return t


class Lost(Exception):
    pass


@pytest.mark.parametrize("moves", range(9))
def test_a_stopped_partition_swap_is_never_visible_and_is_finished(spark, tmp_dir, monkeypatch, moves):
    _three(spark, tmp_dir)
    real, left = sinks._move, [moves]

    def stops(fs, a, b):
        if not left[0]:
            raise Lost
        left[0] -= 1
        real(fs, a, b)
    monkeypatch.setattr(sinks, "_move", stops)
    new = spark.createDataFrame([(1, "A", "a2"), (2, "B", "b2"), (4, None, "d2"), (9, "D", "new")], "k int, p string, v string")
    done = True
    try:
        sinks.replace_partitions(new, tmp_dir, ["p"], touched=["p=C"])
    except Lost:
        done = False
    # a reader at this moment sees old or new rows under the partitions' own names, and no third value
    seen = rows(spark.read.schema("k int, v string, p string").parquet(tmp_dir), "k", "p", "v")
    allowed = {(1, "A"): {"a", "a2"}, (2, "B"): {"b", "b2"}, (3, "C"): {"c"}, (4, None): {"d", "d2"}, (9, "D"): {"new"}}
    assert all(v in allowed[k, p] for k, p, v in seen)
    monkeypatch.setattr(sinks, "_move", real)
    assert sinks.recover(spark, tmp_dir) is (not done and moves > 0)
    want = [(1, "A", "a2"), (2, "B", "b2"), (4, None, "d2"), (9, "D", "new")] if done or moves else \
        [(1, "A", "a"), (2, "B", "b"), (3, "C", "c"), (4, None, "d")]
    assert rows(spark.read.parquet(tmp_dir), "k", "p", "v") == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert not glob.glob(_local(tmp_dir) + ".__*") and not sinks.recover(spark, tmp_dir)


@pytest.mark.parametrize("moves", range(4))
def test_a_stopped_overwrite_is_finished(spark, tmp_dir, monkeypatch, moves):
    sinks.write_dataset(spark.range(3), tmp_dir)
    real, left = sinks._move, [moves]

    def stops(fs, a, b):
        if not left[0]:
            raise Lost
        left[0] -= 1
        real(fs, a, b)
    monkeypatch.setattr(sinks, "_move", stops)
    try:
        sinks.write_dataset(spark.range(10, 12), tmp_dir)
    except Lost:
        assert moves < 3
    monkeypatch.setattr(sinks, "_move", real)
    sinks.recover(spark, tmp_dir)
    assert rows(spark.read.parquet(tmp_dir)) == ([(10,), (11,)] if moves else [(0,), (1,), (2,)])
    assert not glob.glob(_local(tmp_dir) + ".__*")


def test_the_next_load_finishes_a_stopped_one(spark, tmp_dir, monkeypatch):
    t = _three(spark, tmp_dir)
    real = sinks._move
    calls = []

    def stops(fs, a, b):
        calls.append(1)
        if len(calls) == 3:
            raise Lost
        real(fs, a, b)
    monkeypatch.setattr(sinks, "_move", stops)
    with pytest.raises(Lost):
        merge.load(spark, tmp_dir, spark.createDataFrame([(1, "B", "moved")], t.schema), ["k"], partition_by=["p"])
    monkeypatch.setattr(sinks, "_move", real)
    merge.load(spark, tmp_dir, spark.createDataFrame([(5, "E", "e")], t.schema), ["k"], partition_by=["p"])
    assert rows(spark.read.parquet(tmp_dir), "k", "p", "v") == [
        (1, "B", "moved"), (2, "B", "b"), (3, "C", "c"), (4, None, "d"), (5, "E", "e")]


def test_a_moved_key_leaves_its_partition(spark, tmp_dir):
    t = _three(spark, tmp_dir)
    untouched = {f: os.path.getmtime(f) for f in glob.glob(_local(tmp_dir) + "/p=C/*.parquet")}
    merge.load(spark, tmp_dir, spark.createDataFrame([(1, "B", "x"), (4, "B", "y")], t.schema), ["k"], partition_by=["p"])
    assert rows(spark.read.parquet(tmp_dir), "k", "p", "v") == [(1, "B", "x"), (2, "B", "b"), (3, "C", "c"), (4, "B", "y")]
    assert not os.path.exists(_local(tmp_dir) + "/p=A") and len(untouched) == 1
    assert untouched == {f: os.path.getmtime(f) for f in glob.glob(_local(tmp_dir) + "/p=C/*.parquet")}


def test_a_moved_key_of_a_stream_keeps_its_latest_row(spark, tmp_dir):
    schema = "k int, p string, seq int"
    stages.merge_latest(spark, tmp_dir, spark.createDataFrame([(1, "A", 5), (2, "A", 1)], schema), ["k"], "seq", ["p"])
    stages.merge_latest(spark, tmp_dir, spark.createDataFrame([(1, "B", 4), (2, "B", 2)], schema), ["k"], "seq", ["p"])
    assert rows(spark.read.parquet(tmp_dir), "k", "p", "seq") == [(1, "A", 5), (2, "B", 2)]


def test_partition_names_with_odd_characters(spark, tmp_dir):
    odd = ["a b", "a/b", "a=b", "é", "100%", "x:y", "{z}", "[q]*", ""]
    t = spark.createDataFrame([(i, p, 1) for i, p in enumerate(odd)], "k int, p string, seq int")
    stages.merge_latest(spark, tmp_dir, t, ["k"], "seq", ["p"])
    stages.merge_latest(spark, tmp_dir, t.withColumn("seq", F.lit(2)), ["k"], "seq", ["p"])
    stages.merge_latest(spark, tmp_dir, t.withColumns({"seq": F.lit(3), "p": F.lit("one")}), ["k"], "seq", ["p"])
    assert rows(spark.read.parquet(tmp_dir), "k", "p", "seq") == [(i, "one", 3) for i in range(len(odd))]


def test_null_keys_follow_one_rule(spark):
    t = spark.createDataFrame([(None, "old"), (1, "old")], "k int, v string")
    u = spark.createDataFrame([(None, "new"), (1, "new"), (2, "new")], "k int, v string")
    assert rows(merge.upsert(t, u, ["k"])) == [(1, "new"), (2, "new"), (None, "new")]
    assert rows(merge.scd1(t, u, ["k"])) == [(1, "new"), (2, "new"), (None, "new")]
    assert rows(merge.update_by_keys(t, u, ["k"], ["v"])) == [(1, "new"), (None, "new")]
    assert rows(merge.delete_by_keys(t, u.limit(1), ["k"])) == [(1, "old")]
    two = spark.createDataFrame([(1, None, "a"), (1, 2, "b")], "k int, j int, v string")
    assert rows(merge.delete_by_keys(two, two.limit(1), ["k", "j"])) == [(1, 2, "b")]


def test_loads_of_null_keys_do_not_add_up(spark, tmp_dir):
    t = spark.createDataFrame([(None, "A", "a"), (1, "A", "b")], "k int, p string, v string")
    for n, part in enumerate("AABB"):
        change = t.withColumns({"p": F.lit(part), "v": F.lit(str(n))})
        merge.load(spark, tmp_dir, change, ["k"], partition_by=["p"])
        assert rows(spark.read.parquet(tmp_dir), "k", "p", "v") == [(1, part, str(n)), (None, part, str(n))]


def test_full_and_first_loads_have_one_row_per_key(spark, tmp_dir):
    twice = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, ts int")
    assert merge.incremental_load(spark, f"{tmp_dir}/a", twice, "ts", None, ["k"], "FULL") == 2
    assert merge.incremental_load(spark, f"{tmp_dir}/b", twice, "ts", None, ["k"]) == 2
    merge.load(spark, f"{tmp_dir}/c", twice, ["k"], latest_by="ts")
    for x in "abc":
        assert rows(spark.read.parquet(f"{tmp_dir}/{x}")) == [(1, 2), (2, 1)]
    for kind in ("FULL", "INCREMENTAL"):
        with pytest.raises(Exception, match="repeated key: 1"):
            merge.load(spark, f"{tmp_dir}/d", twice, ["k"], kind)
    merge.load(spark, f"{tmp_dir}/e", twice, load_type="FULL")
    assert spark.read.parquet(f"{tmp_dir}/e").count() == 3


def test_watermark_is_observed_and_the_target_not_read(spark, tmp_dir, monkeypatch):
    merge.load(spark, tmp_dir, spark.createDataFrame([(8, 100)], "k int, ts int"), ["k"])
    source = spark.createDataFrame([(1, 15), (2, 25), (3, 5), (4, None)], "k int, ts int")
    assert merge.incremental_load(spark, tmp_dir, source, "ts", 10, ["k"]) == 25
    assert merge.incremental_load(spark, tmp_dir, source, "ts", 25, ["k"]) == 25
    assert rows(spark.read.parquet(tmp_dir)) == [(1, 15), (2, 25), (8, 100)]
    before = glob.glob(_local(tmp_dir) + "/*.parquet")
    assert merge.incremental_load(spark, tmp_dir, source.limit(0), "ts", 7, ["k"]) == 7
    assert before == glob.glob(_local(tmp_dir) + "/*.parquet")  # nothing new: nothing written
    assert merge.incremental_load(spark, f"{tmp_dir}-empty", source.limit(0), "ts", None, ["k"]) is None


def test_rows_that_arrive_during_the_load_come_with_the_next(spark, tmp_dir, monkeypatch):
    base = f"{tmp_dir}/source"
    schema = "k int, ts int, p int"
    spark.createDataFrame([(1, 10, 0)], schema).write.parquet(base)
    merge.incremental_load(spark, f"{tmp_dir}/t", spark.read.parquet(base), "ts", None, ["k"], partition_by=["p"])
    spark.createDataFrame([(2, 20, 1)], schema).write.mode("append").parquet(base)
    real = merge.merge_into

    def late(*args, **kw):
        spark.createDataFrame([(3, 30, 2)], schema).write.mode("append").parquet(base)
        real(*args, **kw)
    monkeypatch.setattr(merge, "merge_into", late)
    wm = merge.incremental_load(spark, f"{tmp_dir}/t", spark.read.parquet(base), "ts", 10, ["k"], partition_by=["p"])
    monkeypatch.setattr(merge, "merge_into", real)
    assert wm == 20 and rows(spark.read.parquet(f"{tmp_dir}/t"), "k") == [(1,), (2,)]
    assert merge.incremental_load(spark, f"{tmp_dir}/t", spark.read.parquet(base), "ts", wm, ["k"], partition_by=["p"]) == 30
    assert rows(spark.read.parquet(f"{tmp_dir}/t"), "k", "ts", "p") == [(1, 10, 0), (2, 20, 1), (3, 30, 2)]


def test_bucketed_target_keeps_the_files_of_untouched_buckets(spark, tmp_dir):
    t = spark.range(400).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("seq"))
    stages.merge_latest(spark, tmp_dir, t, ["k"], "seq", buckets=16)
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(_local(tmp_dir) + "/*/*.parquet")}
    before = files()
    batch = spark.createDataFrame([(5, "new", 2), (5000, "new", 1), (None, "none", 1), (7, "stale", 0)], "k int, v string, seq int")
    touched = {r[0] for r in stages.with_bucket(batch, ["k"], 16).select("bucket_of_16").collect()}
    stages.merge_latest(spark, tmp_dir, batch, ["k"], "seq", buckets=16)
    kept = {f for f in before if int(f.split("bucket_of_16=")[1].split("/")[0]) not in touched}
    assert len(touched) < 5 and len(kept) > 10 and all(files().get(f) == before[f] for f in kept)
    got = {r.k: r.v for r in stages.read_bucketed(spark, tmp_dir).select("k", "v").collect()}
    assert len(got) == 402 and got[5] == "new" and got[5000] == "new" and got[None] == "none" and got[7] == "old"
    stages.merge_latest(spark, tmp_dir, batch, ["k"], "seq", buckets=16)  # a replay changes nothing
    assert stages.read_bucketed(spark, tmp_dir).count() == 402
    with pytest.raises(ValueError, match="32 buckets"):
        stages.merge_latest(spark, tmp_dir, batch, ["k"], "seq", buckets=32)
    with pytest.raises(ValueError, match="not both"):
        stages.merge_latest(spark, tmp_dir, batch, ["k"], "seq", ["v"], buckets=16)


def test_dimension_rows_with_a_null_key_pass_through(spark):
    dim = spark.createDataFrame([(1, None, "x", None, None, 1, 1), (2, 5, "y", None, None, 1, 1)],
                                "DimensionKey int, k int, v string, EffectiveDate timestamp_ntz, EndDate timestamp_ntz, IsCurrent int, RecordVersion int")
    src = spark.createDataFrame([(None, "z"), (5, "y")], "k int, v string")
    out = dimension.scd2(dim, src, ["k"], ["v"], "2024-01-01 00:00:00")
    assert rows(out["dimension"], "DimensionKey", "k", "IsCurrent") == [(1, None, 1), (2, 5, 1)]
    assert rows(out["rejects"]) == [(None, "z")]
