import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import dimension, merge
from tests.conftest import rows

DIM = ("DimensionKey int, CustomerID int, Seg string, EffectiveDate timestamp_ntz, EndDate timestamp_ntz, "
       "IsCurrent int, RecordVersion int")
T0 = dt.datetime(2020, 1, 1)
T1 = dt.datetime(2022, 1, 1)
RUN = "2024-01-15 14:30:00"
RUN_DT = dt.datetime(2024, 1, 15, 14, 30)


def _dim(spark):
    return spark.createDataFrame([
        (1, 10, "A", T0, None, 1, 1),          # unchanged
        (2, 11, "B", T0, None, 1, 1),          # changes to C
        (3, 12, None, T0, None, 1, 1),         # null -> value (T1)
        (4, 13, "D", T0, None, 1, 1),          # deleted
        (5, 14, "E", T0, T1, 0, 1),            # deleted earlier, returns
    ], DIM)


def _src(spark):
    return spark.createDataFrame([(10, "A"), (11, "C"), (12, "X"), (14, "E2"), (15, "N"), (None, "bad")],
                                 "CustomerID int, Seg string")


def test_scd2_types_versions_and_keys(spark):
    res = dimension.scd2(_dim(spark), _src(spark), ["CustomerID"], ["Seg"], RUN)
    assert rows(res["changes"]) == [(10, "C"), (11, "U"), (12, "U"), (13, "D"), (14, "I"), (15, "I")]
    assert res["rejects"].count() == 1
    d = {(r.CustomerID, r.RecordVersion): r for r in res["dimension"].collect()}
    assert d[(11, 1)].IsCurrent == 0 and d[(11, 1)].EndDate == RUN_DT and d[(11, 1)].DimensionKey == 2
    assert d[(11, 2)].IsCurrent == 1 and d[(11, 2)].Seg == "C" and d[(11, 2)].EffectiveDate == RUN_DT
    assert d[(14, 2)].IsCurrent == 1 and d[(14, 2)].Seg == "E2"       # return after delete: version max+1
    assert d[(13, 1)].IsCurrent == 0
    new_keys = sorted(r.DimensionKey for r in res["dimension"].collect() if r.EffectiveDate == RUN_DT)
    assert new_keys == [6, 7, 8, 9]                                     # contiguous from max+1, ordered by key


def test_scd2_is_idempotent_and_single_current(spark):
    src = _src(spark)
    once = dimension.scd2(_dim(spark), src, ["CustomerID"], ["Seg"], RUN)["dimension"]
    once = spark.createDataFrame(once.collect(), once.schema)
    twice = dimension.scd2(once, src, ["CustomerID"], ["Seg"], "2024-02-01 00:00:00")
    assert rows(twice["dimension"]) == rows(once)
    assert dimension.current_violations(twice["dimension"], ["CustomerID"]).count() == 0
    dimension.assert_single_current(twice["dimension"], ["CustomerID"])


def test_change_capture_direction_and_null_safe(spark):
    before = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    after = spark.createDataFrame([(1, None), (3, "c")], "k int, v string")
    out = dimension.change_capture(before, after, ["k"], ["v"])
    assert rows(out) == [(1, None, "C"), (2, "b", "D"), (3, "c", "I")]


def test_change_feed_images(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "z"), (3, "c")], "k int, v string")
    out = dimension.change_feed(old, new, ["k"], ["v"])
    assert rows(out) == [(1, "a", "update_preimage"), (1, "z", "update_postimage"), (2, "b", "delete"),
                         (3, "c", "insert")]


def test_as_of_and_incremental(spark):
    d = _dim(spark)
    assert {r.CustomerID for r in dimension.dimension_as_of(d, "2023-01-01 00:00:00").collect()} == {10, 11, 12, 13}
    ev = spark.createDataFrame([(1,), (5,), (9,)], "ts int")
    new, wm = dimension.incremental(ev, "ts", 4)
    assert rows(new) == [(5,), (9,)] and wm.first()[0] == 9
    _, wm2 = dimension.incremental(ev, "ts", 20)
    assert wm2.first()[0] == 20


def test_merges(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    u = spark.createDataFrame([(2, "B"), (4, "D")], "k int, v string")
    assert rows(merge.upsert(t, u, ["k"])) == [(1, "a"), (2, "B"), (3, "c"), (4, "D")]
    assert rows(merge.update_by_keys(t, u, ["k"], ["v"])) == [(1, "a"), (2, "B"), (3, "c")]
    assert rows(merge.delete_by_keys(t, u, ["k"])) == [(1, "a"), (3, "c")]


def test_load_first_then_incremental(spark, tmp_dir):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    merge.load(spark, tmp_dir, t, ["k"])
    merge.load(spark, tmp_dir, spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), ["k"])
    assert rows(spark.read.parquet(tmp_dir)) == [(1, "a"), (2, "B"), (3, "c")]


def test_first_load_columns_and_incremental_load(spark, tmp_dir):
    src = spark.createDataFrame([(20, "x"), (10, "y")], "CustomerID int, Seg string")
    first = dimension.with_scd_columns(src, RUN, order=["CustomerID"], start_key=1)
    assert rows(first, "DimensionKey", "CustomerID", "IsCurrent", "RecordVersion") == [(1, 10, 1, 1), (2, 20, 1, 1)]
    assert first.first().EffectiveDate == RUN_DT and first.first().EndDate is None
    ev = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, ts int, v string")
    wm = merge.incremental_load(spark, tmp_dir, ev, "ts", None, ["k"])
    assert wm == 5
    ev2 = spark.createDataFrame([(2, 7, "B"), (3, 2, "old")], "k int, ts int, v string")
    assert merge.incremental_load(spark, tmp_dir, ev2, "ts", wm, ["k"]) == 7
    assert rows(spark.read.parquet(tmp_dir)) == [(1, 1, "a"), (2, 7, "B")]


def test_partitioned_incremental_load(spark, tmp_dir):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 1)], "k int, v string, p int")
    merge.load(spark, tmp_dir, t, ["k"], partition_by=["p"])
    merge.load(spark, tmp_dir, spark.createDataFrame([(1, "A", 1), (4, "d", 1)], "k int, v string, p int"),
               ["k"], partition_by=["p"])
    assert rows(spark.read.parquet(tmp_dir), "k", "v", "p") == [(1, "A", 1), (2, "b", 2), (3, "c", 1), (4, "d", 1)]


def test_scd2_reduces_duplicate_source_keys(spark):
    src = spark.createDataFrame([(11, "old", 1), (11, "C", 5), (16, "Z", 2)], "CustomerID int, Seg string, ts int")
    res = dimension.scd2(_dim(spark), src, ["CustomerID"], ["Seg"], RUN, latest_by="ts")
    cur = {r.CustomerID: r.Seg for r in res["dimension"].filter("IsCurrent = 1").collect()}
    assert cur[11] == "C" and cur[16] == "Z"
    assert dimension.current_violations(res["dimension"], ["CustomerID"]).count() == 0


def test_scd2_new_versions_carry_all_attributes(spark):
    dim = spark.createDataFrame([(1, 10, "A", "a@x", T0, None, 1, 1)],
                                "DimensionKey int, CustomerID int, Seg string, Email string, EffectiveDate timestamp_ntz, "
                                "EndDate timestamp_ntz, IsCurrent int, RecordVersion int")
    src = spark.createDataFrame([(10, "B", "b@x"), (11, "C", "c@x")], "CustomerID int, Seg string, Email string")
    res = dimension.scd2(dim, src, ["CustomerID"], ["Seg"], RUN)
    cur = {r.CustomerID: (r.Seg, r.Email) for r in res["dimension"].filter("IsCurrent = 1").collect()}
    assert cur == {10: ("B", "b@x"), 11: ("C", "c@x")}


def test_change_capture_emit_subset(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    after = spark.createDataFrame([(1, "z"), (3, "c")], "k int, v string")
    out = dimension.change_capture(before, after, ["k"], ["v"], emit=("I", "U"))
    assert rows(out) == [(1, "z", "U"), (3, "c", "I")]


def test_scd2_without_delete_tracking_keeps_missing_keys_current(spark):
    res = dimension.scd2(_dim(spark), _src(spark), ["CustomerID"], ["Seg"], RUN, track_deletes=False)
    cur = {r.CustomerID for r in res["dimension"].filter("IsCurrent = 1").collect()}
    assert 13 in cur                                     # absent from the source, not expired
    assert dict((r.CustomerID, r.change_type) for r in res["changes"].collect())[13] == "C"


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.text("abc", max_size=3), max_size=15),
       st.dictionaries(st.integers(0, 30), st.text("xyz", max_size=3), max_size=15))
def test_upsert_equals_dictionary_merge(spark, target, updates):
    t = spark.createDataFrame(list(target.items()) or [(0, "")], "k int, v string")
    if not target:
        t = t.limit(0)
    u = spark.createDataFrame(list(updates.items()) or [(0, "")], "k int, v string")
    if not updates:
        u = u.limit(0)
    expected = sorted({**target, **updates}.items())
    assert sorted(tuple(r) for r in merge.upsert(t, u, ["k"]).collect()) == expected
    assert sorted(tuple(r) for r in merge.delete_by_keys(t, u, ["k"]).collect()) == \
        sorted((k, v) for k, v in target.items() if k not in updates)


def test_sets_of_changes_may_share_keys(spark):
    """A key changed by two sets comes out with the row of each; a key repeated inside one set still fails."""
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    u = spark.createDataFrame([(2, "B", "x"), (2, "N", "y"), (3, "C", "x"), (4, "D", "y")], "k int, v string, s string")
    assert rows(merge.upsert(t, u, ["k"], within=["s"])) == [(1, "a"), (2, "B"), (2, "N"), (3, "C"), (4, "D")]
    assert rows(merge.update_by_keys(t, u, ["k"], ["v"], within=["s"])) == [(1, "a"), (2, "B"), (2, "N"), (3, "C")]
    for again in (merge.upsert(t, u.union(u), ["k"], within=["s"]), merge.update_by_keys(t, u, ["k"], ["v"])):
        with pytest.raises(Exception, match="repeated key"):
            again.collect()


def test_part_updates_whose_new_keys_are_old_ones(spark, tmp_dir):
    """Parts on both sides of 1,000,000, as in a table of more than a million of them."""
    from tessera.plans import catalog
    keys = [5, 13, 65, 1000000, 1000001, 1000013, 1000065]
    spark.createDataFrame([(k, f"n{k}", float(k)) for k in keys], "p_partkey long, p_name string, p_retailprice double") \
        .write.parquet(f"{tmp_dir}/part.parquet")
    names = lambda q: sorted((r.p_partkey, r.p_name, int(r.price)) for r in catalog.queries()[q](spark, tmp_dir).collect())
    twice = [(1000065, "n1000065", 1000066), (1000065, "n65", 65)]
    assert names("b15_h4_upsert_scd1") == [(5, "n5", 6), (13, "n13", 13), (65, "n65", 66), (1000000, "n1000000", 1000001),
                                           (1000001, "n1000001", 1000001), (1000013, "n13", 13), *twice]
    assert names("b14_update_by_keys") == [(5, "n5", 6), (13, "n13", 13), (65, "n65", 66), (1000000, "n1000000", 1000001),
                                           (1000001, "n1000001", 1000001), (1000013, "n1000013", 13),
                                           (1000065, "n1000065", 65), (1000065, "n1000065", 1000066)]
