"""Ranges with explicit bounds, and what is built on them: numbering, z-order buckets, differences, medians, flatten."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import aggregate, layout, numbering, ordering, ranges, reconcile, transform
from tests.conftest import rows


def _skewed(spark, n=3000):
    r = random.Random(4)
    data = [(None if i % 3 == 0 else r.randrange(5), None if i % 11 == 0 else r.randrange(40), r.choice(["a", "b", None, "é"]), i) for i in range(n)]
    return spark.createDataFrame(data, "k int, t int, s string, id int")


def test_ranges_follow_the_order(spark):
    df = _skewed(spark)
    orders = [["t", "id"], [F.col("t").desc(), F.col("s").asc_nulls_last(), "id"], [F.col("s").desc_nulls_first(), F.col("id").desc()],
              [(F.col("t") % 7).desc_nulls_last(), "id"]]
    for order in orders:
        got = ranges.with_range(df, order, 8, "part")
        assert got.columns == [*df.columns, "part"]
        w = Window.orderBy(*order)
        parts = [r.part for r in got.withColumn("n", F.row_number().over(w)).orderBy("n").collect()]
        assert parts == sorted(parts) and set(parts) == set(range(8))
        assert max(parts.count(p) for p in set(parts)) < 2.5 * len(parts) / 8


def test_ranges_of_few_equal_or_no_rows(spark):
    same = spark.createDataFrame([(1, None)] * 50, "a int, b string")
    assert len({r.part for r in ranges.with_range(same, ["a", "b"], 6, "part").collect()}) == 1
    assert {r.part for r in ranges.with_range(same.limit(1), ["a"], 6, "part").collect()} <= set(range(6))
    assert ranges.with_range(same.limit(0), ["a"], 6, "part").collect() == []
    assert {r.part for r in ranges.with_range(same, ["a"], 1, "part").collect()} == {0}


def test_count_reached_halves(spark):
    for n in (0, 1, 2, 3, 7, 8, 255):
        arr = F.array(*[F.lit(2 * i) for i in range(n)]).cast("array<int>")
        got = spark.range(-3, 2 * n + 3).select("id", ranges.count_reached(arr, n, lambda x: x <= F.col("id").cast("int")).alias("c")).collect()
        assert all(r.c == sum(2 * i <= r.id for i in range(n)) for r in got)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.strip() for x in plan.splitlines() if "Exchange " in x and "Reused" not in x and "Broadcast" not in x]


def test_grouped_numbering_exchanges_full_rows_once(spark):
    df = spark.range(3000).select((F.col("id") % 5).alias("k"), (F.col("id") % 40).alias("t"), "id", F.repeat(F.lit("x"), 50).alias("wide"))
    made = {"seq": numbering.group_row_number(df, ["k"], ["t"], "o"), "first": numbering.is_first(df, ["k"], ["t"], "o"),
            "sum": numbering.running_sum(df, ["k"], ["t"], "id", "o"), "lag": numbering.shifted(df, ["k"], ["t"], "id", "o")}
    for name, out in made.items():
        found = _exchanges(out)
        # rows by range; the rest are one row per range and group
        assert sum("shufflepartitionidpassthrough" in x for x in found) <= (2 if name == "lag" else 1), name
        assert not any("rangepartitioning" in x for x in found), name
        assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString(), name
        assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_hot_group_is_spread(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), "id")
    out = numbering.group_row_number(df, ["k"], ["id"], "seq", num_partitions=8)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1500
    assert rows(out, "id", "seq") == sorted(((i, i + 1) for i in range(4000)), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("keys", [["k"], [], ["k", "s"]])
def test_mixed_directions_equal_windows(spark, keys):
    df = _skewed(spark)
    order = [F.col("t").desc_nulls_last(), F.col("id").asc()]
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    want = df.select("*", F.row_number().over(w).alias("n"), F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("r"),
                     F.lag("id").over(w).alias("b"), F.lead("id").over(w).alias("a"))
    got = numbering.group_row_number(df, keys, order, "n", num_partitions=7)
    got = numbering.running_sum(got, keys, order, "t", "r", num_partitions=7)
    got = numbering.shifted(got, keys, order, "id", "b", "lag", num_partitions=7)
    got = numbering.shifted(got, keys, order, "id", "a", "lead", num_partitions=7)
    assert rows(got, *want.columns) == rows(want)


def test_numbering_of_unique_order_carries_other_columns(spark):
    df = _skewed(spark, 500).select("id", F.struct("k", "s").alias("m"), F.create_map(F.lit("a"), F.col("t")).alias("p"))
    out = numbering.global_row_number(df, ["id"], "n", unique=True)
    assert [(r.id, r.n) for r in out.orderBy("id").collect()] == [(i, i + 1) for i in range(500)]


def test_zorder_plans_stay_small_and_columns_share_a_job(spark):
    df = spark.range(2000).select("id", *[F.concat(F.lit("p"), (F.col("id") * (i + 3) % 1009).cast("string")).alias(f"s{i}") for i in range(4)],
                                  (F.col("id") % 2 == 0).alias("b"), F.encode(F.col("id").cast("string"), "utf-8").alias("y"))
    z = layout.z_value(df, ["s0", "s1", "s2", "s3", "b", "y"])
    plan = df.select(z)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 400_000
    bounds = layout._ranked_bounds(df, ["s0", "s1", "s2", "s3"], 16)
    for c in ("s0", "s3"):
        values = sorted(r[0] for r in df.select(c).collect())
        assert bounds[c] == sorted({values[q * 2000 // 16] for q in range(1, 16)})


def _plain_difference(a, b):
    b = list(b)
    out = []
    for x in a:
        if x in b:
            b.remove(x)
        else:
            out.append(x)
    return out


def test_signed_difference_equals_except_all(spark):
    r = random.Random(3)
    some = lambda n: [(r.choice([1, None, 2]), r.choice(["a|b", "", None, "a"]), r.choice([0.0, None, float("inf")])) for _ in range(n)]
    schema = "a int, b string, c double"
    for n, m in ((60, 50), (0, 5), (5, 0), (0, 0), (40, 40)):
        x, y = some(n), some(m)
        a, b = spark.createDataFrame(x, schema), spark.createDataFrame(y, schema)
        got = ordering.difference(a, b, keep_duplicates=True)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, _plain_difference(x, y)))
        both = reconcile.compare_rows(a, b)
        assert both.columns == ["a", "b", "c", "side"]
        want = [(*t, "source_only") for t in _plain_difference(x, y)] + [(*t, "target_only") for t in _plain_difference(y, x)]
        assert sorted(map(str, map(tuple, both.collect()))) == sorted(map(str, want))


def test_signed_difference_of_nested_rows_and_many_repeats(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "REPEATS", 7)
    schema = "a struct<x:int,y:string>, b array<int>"
    a = spark.createDataFrame([((1, None), [None, 1])] * 30 + [((None, "1"), [1, None])] * 2, schema)
    b = spark.createDataFrame([((1, None), [None, 1])] * 3 + [((None, "1"), [1, None])] * 2 + [((1, None), [1, None])], schema)
    d = reconcile.signed_difference(a, b).collect()
    assert sorted((r.balance, r.b) for r in d) == [(-1, [1, None]), (27, [None, 1])]
    assert ordering.difference(a, b, keep_duplicates=True).count() == 27


def test_difference_shuffles_digests(spark, monkeypatch):
    taken = []
    real = reconcile.maybe_broadcast
    monkeypatch.setattr(reconcile, "maybe_broadcast", lambda df, *a: taken.append(df) or real(df, *a))
    a = spark.range(500).select("id", F.repeat(F.lit("wide"), 100).alias("w"))
    out = ordering.difference(a, a.filter("id <> 7"), keep_duplicates=True)
    assert len(taken) == 1 and out.count() == 1
    found = _exchanges(out)
    assert len(found) == 1 and "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_medians_of_several_measures(spark):
    df = spark.createDataFrame([("a", 1.0, 5, None), ("a", 2.0, None, None), ("a", 4.0, 7, None), (None, 3.0, 1, 2.5), ("b", None, 2, 1.0)],
                               "g string, x double, y int, z double")
    got = aggregate.aggregate(df, ["g"], {"n": ("count", None), "x": ("median", "x"), "y2": ("median", F.col("y") * 2), "z": ("median", "z")}, order=True)
    assert rows(got) == [("a", 3, 2.0, 12.0, None), ("b", 1, None, 4.0, 1.0), (None, 1, 3.0, 2.0, 2.5)]
    assert rows(aggregate.aggregate(df, [], {"x": ("median", "x"), "most": ("max", "y")})) == [(2.5, 7)]
    assert rows(aggregate.aggregate(df, [], {"x": ("median", "x"), "z": ("median", "z")})) == [(2.5, 1.75)]
    assert rows(aggregate.aggregate(df, [F.upper("g").alias("u")], {"x": ("median", "x")}, having=F.col("x") > 2.5)) == [(None, 3.0)]
    assert rows(aggregate.aggregate(df, ["g"], {"x": ("median", "x", True)}).filter("g = 'a'")) == [("a", 2.0)]
    empty = aggregate.aggregate(df.limit(0), [], {"x": ("median", "x"), "n": ("count", None)})
    assert rows(empty) == [(None, 0)]
    quart = aggregate.exact_percentiles(df, ["g"], {"q": "x"}, 0.25)
    assert rows(quart.filter("g = 'a'")) == [("a", 1.5)]


def test_percentiles_rank_only_the_values_near_them(spark, monkeypatch):
    ranked = []
    real = numbering.running_sum
    monkeypatch.setattr(numbering, "running_sum", lambda df, *a, **k: ranked.append(df.count()) or real(df, *a, **k))
    df = spark.range(20000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 20000 + 100.25).alias("x"), F.lit(2).alias("y"))
    got = aggregate.exact_percentiles(df, ["k"], {"x": "x", "y": "y"}, 0.3)
    exp = df.groupBy("k").agg(F.percentile("x", F.lit(0.3)).alias("x"), F.percentile("y", F.lit(0.3)).alias("y"))
    assert [[round(v, 6) for v in r] for r in rows(got)] == [[round(v, 6) for v in r] for r in rows(exp)]
    assert len(ranked) == 1 and ranked[0] < 2000


@pytest.mark.parametrize("limit", ["1", "10000000"])  # sought cells joined, or broadcast
def test_percentiles_of_odd_numbers(spark, limit):
    inf, nan = float("inf"), float("nan")
    some = [-inf, -1e300, -5.5, -5.5, -1e-300, -0.0, 0.0, 5e-324, 1e-9, 3.25, 1e15 + 1, 1e15 + 2, 1e300, inf, nan, nan, None]
    df = spark.createDataFrame([(k, v) for k in (None, "a") for v in some] + [("b", None), ("c", -7.0), ("c", 9.0)], "k string, x double")
    spark.conf.set("tessera.broadcast.maxBytes", limit)
    try:
        for p in (0.0, 1 / 15, 0.2, 0.4, 0.6, 11 / 15, 0.8, 1.0):
            got = rows(aggregate.exact_percentiles(df, ["k"], {"q": "x"}, p))
            exp = rows(df.groupBy("k").agg(F.percentile("x", F.lit(p)).alias("q")))
            assert str(got) == str(exp).replace("-0.0)", "0.0)"), p
    finally:
        spark.conf.unset("tessera.broadcast.maxBytes")


def test_percentiles_of_values_drawn_at_random(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.rand().alias("x"))  # other numbers at each reading
    assert all(0.4 < r.q < 0.6 for r in aggregate.exact_percentiles(df, ["k"], {"q": "x"}).collect())


def test_flatten_three_levels(spark):
    df = spark.sql("""
        SELECT 1 AS id, named_struct('a', named_struct('b', 'x', 'c', array(named_struct('d', 1), named_struct('d', 2))), 'e', 5) AS r, 'top' AS R_A_b, map('k', 1) AS m
        UNION ALL SELECT 2, named_struct('a', named_struct('b', 'y', 'c', array()), 'e', NULL), 'top', map()
        UNION ALL SELECT 3, named_struct('a', NULL, 'e', 6), 'top', NULL
        UNION ALL SELECT 4, NULL, NULL, map('k', NULL, 'l', 2)""")
    got = transform.flatten(df)
    assert got.columns == ["id", "r_a_b_2", "r_a_c_d", "r_e", "R_A_b", "m_key", "m_value"]
    assert rows(got) == [(1, "x", 1, 5, "top", "k", 1), (1, "x", 2, 5, "top", "k", 1), (2, "y", None, None, "top", None, None),
                         (3, None, None, 6, "top", None, None), (4, None, None, None, None, "k", None), (4, None, None, None, None, "l", 2)]
    odd = spark.sql("SELECT named_struct('x.y', 1, 'z`w', array(array(1, 2), array())) AS `a b`, 7 AS plain")
    flat = transform.flatten(odd, ".")
    assert flat.columns == ["a b.x.y", "a b.z`w", "plain"] and sorted(map(str, map(tuple, flat.collect()))) == sorted(["(1, 1, 7)", "(1, 2, 7)", "(1, None, 7)"])
    assert transform.flatten(spark.range(2)).columns == ["id"]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_row_hash_is_unambiguous(spark):
    from tessera import functions as fx
    pairs = [("a|b", "c"), ("a", "b|c"), ("\\N", "x"), (None, "x"), ("", "x"), ("-", "x"), ("1:a", "b"), ("1", ":ab"), ("é", "x"), ("é́", "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.select(fx.row_hash("a", "b").alias("h")).distinct().count() == len(pairs)


def test_a_chain_of_one_order_is_laid_out_once(spark):
    """No checkpoint and no second layout between steps on the same keys and order; a result as input begins anew."""
    df = _skewed(spark, 400)
    order = [F.col("t").desc(), "id"]
    got = numbering.running_sum(numbering.group_row_number(df, ["k"], order, "n", num_partitions=5), ["k"], order, "id", "r", num_partitions=5)
    got = numbering.shifted(got, ["k"], order, "id", "a", "lead", num_partitions=5)
    plan = got._jdf.queryExecution().executedPlan().toString().lower()
    assert "scan existingrdd" in plan and plan.count("shufflepartitionidpassthrough") == 2  # the rows, and the edges of lead
    again = numbering.running_sum(got, ["k"], order, "n", "rn", num_partitions=5)
    w = Window.partitionBy("k").orderBy(F.col("t").desc(), "id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.row_number().over(w).alias("n"), F.sum("id").over(run).alias("r"), F.lead("id").over(w).alias("a"))
    assert rows(again) == rows(want.withColumn("rn", F.sum("n").over(run)))


def test_ranges_of_falling_values(spark):
    """Falling numbers with nulls, NaN, infinities and extremes lie like a sort puts them, found by compiled columns."""
    import datetime as dt
    from decimal import Decimal
    r = random.Random(7)
    data = [(r.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1.5, -2.5]), r.choice([None, -2**63, 2**63 - 1, 0, 5]),
             r.choice([None, Decimal("1.20"), Decimal("-3.00")]), r.choice([None, dt.date(1960, 1, 1), dt.date(2020, 2, 2)]),
             r.choice([None, True, False]), i) for i in range(600)]
    df = spark.createDataFrame(data, "x double, l long, d decimal(5,2), y date, b boolean, id int")
    for c in ("x", "l", "d", "y", "b"):
        for way in (F.col(c).desc(), F.col(c).desc_nulls_first(), F.col(c).asc_nulls_last()):
            got = ranges.with_range(df, [way, F.col("id").desc()], 6, "part")
            w = Window.orderBy(way, F.col("id").desc())
            parts = [q.part for q in got.withColumn("n", F.row_number().over(w)).orderBy("n").collect()]
            assert parts == sorted(parts) and len(set(parts)) == 6
    text = ranges.with_range(df, [F.col("x").desc()], 6, "part")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(CASE WHEN ((namedlambdavariable" not in text and "aggregate(" not in text


def test_equal_rows_of_a_chain_are_told_apart_by_earlier_results(spark):
    """Of two equal rows the one with the smaller earlier result comes first in the next step, as in a step of its own."""
    df = spark.createDataFrame([(1, 1, 9), (1, 2, 5), (1, 2, 5), (1, 3, 7)], "k int, t int, v int")
    got = numbering.shifted(df, ["k"], ["t"], "v", "before", "lag", num_partitions=3)
    got = numbering.shifted(got, ["k"], ["t"], "v", "after", "lead", num_partitions=3)
    assert rows(got, "t", "before", "after") == [(1, None, 5), (2, 5, 5), (2, 9, 7), (3, 5, None)]
