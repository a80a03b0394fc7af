from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import numbering, ordering
from tests.conftest import rows


def _skewed(spark, n=2000):
    # one key holds most rows, ties in the order column
    data = [(0 if i % 10 < 7 else i % 13, i % 17, i) for i in range(n)]
    return spark.createDataFrame(data, "k int, t int, id int")


def test_global_numbering_is_1_to_n(spark):
    df = _skewed(spark)
    out = numbering.global_row_number(df, ["t", "id"], "rn", num_partitions=7)
    w = Window.orderBy("t", "id")
    assert rows(out, "id", "rn") == rows(df.withColumn("rn", F.row_number().over(w)), "id", "rn")


def test_group_numbering_equals_window_under_skew(spark):
    df = _skewed(spark)
    got = numbering.group_row_number(df, ["k"], ["t", "id"], "seq", num_partitions=6)
    w = Window.partitionBy("k").orderBy("t", "id")
    assert rows(got, "id", "seq") == rows(df.withColumn("seq", F.row_number().over(w)), "id", "seq")


def test_running_sum_and_shift_equal_window(spark):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    rs = numbering.running_sum(df, ["k"], ["t", "id"], "t", "rs", num_partitions=5)
    exp = df.withColumn("rs", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert rows(rs, "id", "rs") == rows(exp, "id", "rs")
    for direction, fn in (("lag", F.lag), ("lead", F.lead)):
        got = numbering.shifted(df, ["k"], ["t", "id"], "id", "o", direction, num_partitions=5)
        assert rows(got, "id", "o") == rows(df.withColumn("o", fn("id", 1).over(w)), "id", "o")


def test_change_flag_global(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "t int, v string")
    got = numbering.change_flag(df, ["t"], "v")
    assert rows(got, "t", "changed") == [(1, True), (2, False), (3, True), (4, False), (5, True)]


def test_surrogate_keys_continue(spark):
    df = spark.createDataFrame([(c,) for c in "edcba"], "c string")
    got = numbering.assign_keys(df, "sk", ["c"], start=101)
    assert rows(got) == [("a", 101), ("b", 102), ("c", 103), ("d", 104), ("e", 105)]
    gapped = numbering.assign_keys(df, "sk", [], start=1, contiguous=False)
    assert gapped.select("sk").distinct().count() == 5


def test_dedup_keep_first_last_deterministic(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 5, "a"), (1, 3, "z"), (2, 1, "q")], "k int, t int, p string")
    assert rows(ordering.dedup(df, ["k"], ["t"], "first")) == [(1, 3, "z"), (2, 1, "q")]
    assert rows(ordering.dedup(df, ["k"], ["t"], "last")) == [(1, 5, "x"), (2, 1, "q")]
    mixed = ordering.dedup(df, ["k"], [("t", "desc"), ("p", "asc")], "first")
    assert rows(mixed) == [(1, 5, "a"), (2, 1, "q")]


def test_key_change_column(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "k int, t int")
    out = ordering.sort_stage(df, [("k", "asc"), ("t", "asc")], key_change="kc", change_keys=["k"])
    assert rows(out) == [(1, 1, 1), (1, 2, 0), (2, 5, 1)]


def test_numbering_plan_uses_checkpoint_and_broadcast_carry(spark):
    df = _skewed(spark)
    plan = numbering.global_row_number(df, ["t", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan          # rows read back from the checkpoint
    assert "BroadcastHashJoin" in plan    # offsets: one row per partition, broadcast


def test_exact_percentile_matches_percentile_under_skew(spark):
    from tessera.operators.aggregate import exact_percentile
    df = _skewed(spark).withColumn("x", (F.col("id") * 7 % 101).cast("double"))
    for p in (0.5, 0.1, 0.95):
        got = {r.k: r.q for r in exact_percentile(df, ["k"], "x", p, "q").collect()}
        exp = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("x", F.lit(p)).alias("q")).collect()}
        assert got.keys() == exp.keys() and all(abs(got[k] - exp[k]) < 1e-9 for k in exp)
    g = exact_percentile(df, [], "x", 0.5, "q").first().q
    assert g == df.agg(F.median("x")).first()[0]


def test_null_keys_and_null_order_values(spark):
    data = [(None if i % 4 == 0 else i % 3, None if i % 5 == 0 else i % 7, i, None if i % 6 == 0 else i)
            for i in range(300)]
    df = spark.createDataFrame(data, "k int, t int, id int, x int")
    w = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_first(), "id")
    got = numbering.group_row_number(df, ["k"], ["t", "id"], "seq", num_partitions=5)
    assert rows(got, "id", "seq") == rows(df.withColumn("seq", F.row_number().over(w)), "id", "seq")
    rs = numbering.running_sum(df, ["k"], ["t", "id"], "x", "rs", num_partitions=5)
    exp = df.withColumn("rs", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert rows(rs, "id", "rs") == rows(exp, "id", "rs")
    lg = numbering.shifted(df, ["k"], ["t", "id"], "x", "p", "lag", num_partitions=5)
    assert rows(lg, "id", "p") == rows(df.withColumn("p", F.lag("x").over(w)), "id", "p")


def test_exact_percentile_null_key_and_all_null_group(spark):
    from tessera.operators.aggregate import exact_percentile
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0)], "k string, x double")
    got = {r.k: r.q for r in exact_percentile(df, ["k"], "x", 0.5, "q").collect()}
    exp = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("x", F.lit(0.5)).alias("q")).collect()}
    assert got == exp == {None: 2.0, "a": None, "b": 2.0}


def test_exact_percentile_of_skewed_groups(spark):
    from tessera.operators.aggregate import exact_percentile
    df = _skewed(spark).withColumn("x", (F.col("id") * 13 % 997).cast("double"))
    small = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("x", F.lit(0.5)).alias("q")).collect()}
    dist = {r.k: r.q for r in exact_percentile(df, ["k"], "x", 0.5, "q").collect()}
    assert small == dist


def test_change_flag_per_group_equals_window(spark):
    df = _skewed(spark).withColumn("v", (F.col("id") % 4 == 0).cast("string"))
    got = numbering.change_flag(df, ["t", "id"], "v", keys=["k"])
    w = Window.partitionBy("k").orderBy("t", "id")
    prev = F.lag("v").over(w)
    exp = df.withColumn("prev_value", prev).withColumn(
        "changed", F.row_number().over(w).__eq__(1) | ~F.col("v").eqNullSafe(prev))
    assert rows(got, "id", "prev_value", "changed") == rows(exp, "id", "prev_value", "changed")
