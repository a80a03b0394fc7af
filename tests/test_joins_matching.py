import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import joins, matching
from tessera.util import plan_text
from tests.conftest import rows


def test_lookup_default_only_on_no_match(spark):
    # A null stored in a matched reference row stays null
    main = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    ref = spark.createDataFrame([(1, "a"), (2, None)], "k int, name string")
    out = joins.lookup(main, ref, ["k"], ["name"], defaults={"name": "UNKNOWN"}, match_col="hit")
    assert rows(out) == [(1, "a", True), (2, None, True), (3, "UNKNOWN", False)]


def test_lookup_reject_link(spark):
    main = spark.createDataFrame([(1,), (3,)], "k int")
    ref = spark.createDataFrame([(1, "a")], "k int, name string")
    good, bad = joins.lookup(main, ref, ["k"], ["name"], failure="reject")
    assert rows(good) == [(1, "a")] and rows(bad) == [(3,)]


def test_lookup_broadcast_only_when_small(spark):
    main = spark.range(1000).withColumnRenamed("id", "k")
    ref = spark.range(100).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    assert "BroadcastHashJoin" in plan_text(joins.lookup(main, ref, ["k"], ["v"]))
    spark.conf.set("tessera.broadcast.maxBytes", "1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan_text(joins.lookup(main, ref, ["k"], ["v"]))
    finally:
        spark.conf.unset("tessera.broadcast.maxBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_join_rejects_and_named_keys(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "lk int, a string")
    right = spark.createDataFrame([(1, "p"), (5, "q")], "rk int, b string")
    res = joins.join_stage(left, right, [("lk", "rk")], "inner", rejects=("left", "right"))
    assert rows(res["out"]) == [(1, "x", "p")]
    assert rows(res["left_rejects"]) == [(2, "y")]
    assert rows(res["right_rejects"]) == [(5, "q")]


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i % 3, i) for i in range(300)], "k int, v int")  # key 0..2 hot
    right = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k int, name string")
    hot = joins.hot_keys(left, ["k"], 0.3)
    assert sorted(r.k for r in hot.collect()) == [0, 1, 2]
    for how in ("inner", "left"):
        assert rows(joins.salted_join(left, right, ["k"], how, salts=5)) == rows(left.join(right, "k", how))
        only_hot = joins.salted_join(left, right, ["k"], how, salts=5, hot=joins.hot_keys(left, ["k"], 0.34))
        assert rows(only_hot) == rows(left.join(right, "k", how))


def _brute(words, k):
    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            cur = [i]
            for j, cb in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
            prev = cur
        return prev[-1]
    ws = sorted(set(words))
    return sorted((a, b, lev(a, b)) for i, a in enumerate(ws) for b in ws[i + 1:] if lev(a, b) <= k)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=0, max_size=9), min_size=2, max_size=40), st.integers(1, 2),
       st.sampled_from([None, 0, 3, 5]))
def test_fuzzy_pairs_equal_all_pairs(spark, words, k, cutoff):
    # cut-off 0 forces the segment method for all cuttable strings, 3/5 mix both methods
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = sorted(tuple(r) for r in matching.fuzzy_pairs(df, "w", max_dist=k, cutoff=cutoff).collect())
    assert got == _brute(words, k)


def test_fuzzy_two_sided(spark):
    rnd = random.Random(3)
    a = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    b = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    da = spark.createDataFrame([(w,) for w in a], "w string")
    db = spark.createDataFrame([(w,) for w in b], "w string")
    exp = sorted({(x, y, d) for x in set(a) for y in set(b)
                  for d in [_brute([x, y], 99)[0][2] if x != y else 0] if d <= 2})
    for cutoff in (None, 2, 4):
        got = sorted(tuple(r) for r in matching.fuzzy_pairs(da, "w", db, "w", 2, cutoff=cutoff).collect())
        assert got == exp


def test_fuzzy_plan_has_no_cartesian(spark):
    df = spark.createDataFrame([("abcdef",), ("abcdxf",)], "w string")
    p = plan_text(matching.fuzzy_pairs(df, "w", max_dist=2))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_lookup_reference_uniqueness(spark):
    import pytest
    main = spark.createDataFrame([(1,), (2,)], "k int")
    ref = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, name string")
    with pytest.raises(joins.DuplicateReferenceKey):
        joins.lookup(main, ref, ["k"], ["name"], check_unique=True)
    out = joins.lookup(main, ref, ["k"], ["name"], dedup_ref=True)
    assert rows(out) == [(1, "a"), (2, "c")]


def test_salting_only_the_hot_key(spark):
    left = spark.createDataFrame([(0, i) for i in range(200)] + [(k, k) for k in range(1, 101)], "k int, v int")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(0, 120, 2)], "k int, name string")
    hot = joins.hot_keys(left, ["k"], 0.5)
    assert [r.k for r in hot.collect()] == [0]
    for how in ("inner", "left"):
        got = joins.salted_join(left, right, ["k"], how, salts=8, hot=hot)
        assert rows(got) == rows(left.join(right, "k", how))


def test_outer_joins_with_named_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "lk int, a string")
    right = spark.createDataFrame([(1, "x"), (3, "y")], "rk int, b string")
    assert rows(joins.join_stage(left, right, [("lk", "rk")], "right")) == [(1, "a", 1, "x"), (None, None, 3, "y")]
    full = rows(joins.join_stage(left, right, [("lk", "rk")], "full"))
    assert full == [(1, "a", 1, "x"), (2, "b", None, None), (None, "n", None, None), (None, None, 3, "y")]
    assert rows(joins.join_stage(left, right, [("lk", "rk")], "left_semi")) == [(1, "a")]


def test_lookup_drop_mode(spark):
    main = spark.createDataFrame([(1,), (3,)], "k int")
    ref = spark.createDataFrame([(1, "a")], "k int, name string")
    assert rows(joins.lookup(main, ref, ["k"], ["name"], failure="drop")) == [(1, "a")]
