"""Repeated keys, null partitions, shifted nulls, header-like lines, z-order of long prefixes."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import dimension, layout, matching, merge, ordering, reconcile
from tessera.sinks import files as sinks
from tessera.sources import files as sources
from tests.conftest import SF, rows


def test_load_keeps_rows_of_the_null_partition(spark, tmp_dir):
    first = spark.createDataFrame([(1, None, "a"), (2, "p", "b")], "k int, part string, v string")
    merge.load(spark, tmp_dir, first, ["k"], "FULL", ["part"])
    merge.load(spark, tmp_dir, spark.createDataFrame([(3, None, "c")], first.schema), ["k"], "INCREMENTAL", ["part"])
    assert rows(spark.read.parquet(tmp_dir), "k", "part", "v") == [(1, None, "a"), (2, "p", "b"), (3, None, "c")]


def test_merge_latest_keeps_rows_of_the_null_partition(spark, tmp_dir):
    from tessera.streaming.stages import merge_latest
    first = spark.createDataFrame([(1, None, 1), (2, "p", 1)], "k int, part string, seq int")
    merge_latest(spark, tmp_dir, first, ["k"], "seq", ["part"])
    merge_latest(spark, tmp_dir, spark.createDataFrame([(3, None, 2)], first.schema), ["k"], "seq", ["part"])
    assert rows(spark.read.parquet(tmp_dir), "k", "seq") == [(1, 1), (2, 1), (3, 2)]


def test_repeated_keys_fail_or_reduce(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "n", 1)], "k int, v string, seq int")
    assert rows(merge.upsert(target, twice, ["k"], "seq")) == [(1, "a"), (2, "y"), (3, "n")]
    assert rows(merge.update_by_keys(target, twice, ["k"], ["v"], "seq")) == [(1, "a"), (2, "y")]
    for bad in (merge.upsert(target, twice, ["k"]), merge.update_by_keys(target, twice, ["k"], ["v"])):
        with pytest.raises(Exception, match="repeated key: 2"):
            bad.collect()


def test_scd2_null_current_flag_and_repeated_source(spark):
    dim = spark.createDataFrame(
        [(1, 7, "old", None, 1), (2, 8, "x", 1, 1)], "DimensionKey int, k int, v string, IsCurrent int, RecordVersion int")
    dim = dim.withColumns({"EffectiveDate": F.lit(None).cast("timestamp_ntz"), "EndDate": F.lit(None).cast("timestamp_ntz")})
    src = spark.createDataFrame([(7, "new", 1), (8, "x", 1), (8, "z", 2)], "k int, v string, seq int")
    out = dimension.scd2(dim, src, ["k"], ["v"], "2024-01-01 00:00:00", latest_by="seq")["dimension"]
    assert rows(out, "k", "v", "IsCurrent", "RecordVersion") == [
        (7, "new", 1, 2), (7, "old", None, 1), (8, "x", 0, 1), (8, "z", 1, 2)]
    with pytest.raises(Exception, match="repeated key: 8"):
        dimension.scd2(dim, src, ["k"], ["v"], "2024-01-01 00:00:00")["dimension"].collect()


@pytest.mark.parametrize("algo", ["md5", "xxhash64"])
def test_checksum_sees_a_null_that_moved(spark, algo):
    schema = "a string, b string"
    sums = {reconcile.dataset_checksum(spark.createDataFrame([r], schema), algo=algo).first().checksum
            for r in [("a", None), (None, "a"), ("a", ""), ("", "a"), ("1:a", None), (None, None)]}
    assert len(sums) == 6


def test_dedup_null_order_is_one_rule(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", 5, 2)], "k string, o int, id int")
    for order in ([("o", "desc")], [("o", "desc"), ("id", "asc")]):
        assert ordering.dedup(df, ["k"], order, "first").first().id == 2
        assert ordering.dedup(df, ["k"], order, "last").first().id == 1


def test_key_change_with_column_keys(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (3,)], "x int")
    got = ordering.sort_stage(df, [(F.col("x") * 2, "desc")], key_change="c")
    assert got.columns == ["x", "c"] and rows(got) == [(1, 1), (2, 1), (3, 0), (3, 1)]
    with pytest.raises(ValueError, match="direction"):
        ordering.sort_stage(df, [F.col("x").desc()], key_change="c")


def test_reject_scan_headers_and_line_breaks(spark, tmp_dir):
    text = 'id,note\n1,"two\nlines"\nid,note\nx,bad\n'
    for _ in range(2):
        spark.createDataFrame([(text.rstrip("\n"),)], "value string").write.mode("append").text(tmp_dir)
    schema = spark.createDataFrame([], "id long, note string").schema
    good, bad = sources.read_with_rejects(spark, tmp_dir, schema, multi_line=True)
    assert rows(good) == [(1, "two\nlines")] * 2
    assert [r.raw_record for r in bad.select("raw_record").orderBy("raw_record").collect()] == ["id,note"] * 2 + ["x,bad"] * 2


def test_reject_scan_query_writes_a_file_per_partition(spark, tmp_dir, monkeypatch):
    from tessera.plans import queries_more
    orders = spark.read.parquet(f"{SF}/orders.parquet").repartition(5)
    monkeypatch.setattr(queries_more, "TB", lambda *_: orders)
    monkeypatch.setattr(queries_more, "scratch_path", lambda *_: tmp_dir)
    got = queries_more._scan_two_files(spark, SF).collect()
    assert spark.read.text(tmp_dir).select("_metadata.file_path").distinct().count() == 6
    want = [("reject", r.o_orderkey, None) if r.o_orderkey % 97 == 0 else ("good", r.o_orderkey, f"first line\n{r.o_orderstatus}, second")
            for r in orders.collect()] + [("reject", None, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)



def test_reject_scan_of_one_unread_column(spark, tmp_dir):
    spark.createDataFrame([("1,2",), ("3,oops",)], "value string").write.text(tmp_dir)
    schema = spark.createDataFrame([], "a long, b long").schema
    good, bad = sources.read_with_rejects(spark, tmp_dir, schema, header=False)
    assert rows(good.select("a")) == [(1,)] and bad.count() == 1


def test_zorder_of_long_prefixes_and_many_columns(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"))
    z = df.select("id", layout.z_value(df, ["name"]).alias("z")).orderBy("id").collect()
    assert [r.z for r in z] == sorted(r.z for r in z) and len({r.z for r in z}) > 100
    wide = df.select("name", *[(F.col("id") * (i + 1) % 101).alias(f"c{i}") for i in range(9)])
    assert wide.select(F.min(layout.z_value(wide, wide.columns))).first()[0] >= 0
    with pytest.raises(ValueError):
        layout.z_value(df, ["id"] * 64)


def test_full_load_watermark_is_of_the_written_rows(spark, tmp_dir):
    source = f"{tmp_dir}/source"
    spark.createDataFrame([(1, 10), (2, 20)], "k int, ts int").write.parquet(source)
    frame = spark.read.parquet(source)
    wm = merge.incremental_load(spark, f"{tmp_dir}/t", frame, "ts", None, ["k"], "FULL")
    spark.createDataFrame([(3, 30), (4, None)], "k int, ts int").write.mode("append").parquet(source)
    late = spark.read.parquet(source)
    assert wm == 20
    assert merge.incremental_load(spark, f"{tmp_dir}/t", late, "ts", wm, ["k"]) == 30
    assert rows(spark.read.parquet(f"{tmp_dir}/t"), "k") == [(1,), (2,), (3,)]
    assert rows(merge.without_watermark(late, "ts"), "k") == [(4,)]


def test_recover_a_half_done_swap(spark, tmp_dir):
    spark.range(3).write.parquet(f"{tmp_dir}.__old-1234abcd")
    assert sinks.recover(spark, tmp_dir) and not sinks.recover(spark, tmp_dir)
    assert spark.read.parquet(tmp_dir).count() == 3


def test_fuzzy_pairs_of_short_and_shared_words(spark):
    words = ["a", "b", "ab", "abc", "", "xyz", "abcdefghijklm", "abcdefghijkl", "bcdefghijklmn", "aab"]
    df = spark.createDataFrame([(w,) for w in words for _ in range(50)], "w string")
    got = {(r[0], r[1], r[2]) for r in matching.fuzzy_pairs(df, "w", max_dist=2).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(prev, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(prev[j] + 1, out[-1] + 1, prev[j - 1] + (x != y)))
        return out
    want = {(a, b, lev(a, b)) for a in words for b in words if a < b and lev(a, b) <= 2}
    assert got == want


def test_null_keys_are_one_key(spark):
    a = spark.createDataFrame([(None, "x"), (1, "y")], "k int, v string")
    assert dimension.change_capture(a, a, ["k"], ["v"], emit=("I", "U", "D")).count() == 0
    assert dimension.change_feed(a, a, ["k"], ["v"]).count() == 0
    assert reconcile.compare_rows(a, a, ["k"]).count() == 0


def test_incremental_load_keeps_the_newest_of_repeated_keys(spark, tmp_dir):
    first = spark.createDataFrame([(1, 10, "a")], "k int, ts int, v string")
    wm = merge.incremental_load(spark, tmp_dir, first, "ts", None, ["k"], "FULL")
    more = spark.createDataFrame([(1, 20, "b"), (1, 30, "c"), (2, 25, "d")], first.schema)
    assert merge.incremental_load(spark, tmp_dir, more, "ts", wm, ["k"]) == 30
    assert rows(spark.read.parquet(tmp_dir), "k", "ts", "v") == [(1, 30, "c"), (2, 25, "d")]
