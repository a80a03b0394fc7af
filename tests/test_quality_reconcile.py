from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.operators import quality, reconcile
from tests.conftest import rows


def _df(spark):
    return spark.createDataFrame([(1, "a", 5), (None, "b", -1), (3, None, 2), (4, "d", None)],
                                 "id int, name string, amt int")


def _rules():
    return {"id": F.col("id").isNotNull(), "amt": F.col("amt") > 0}


def test_flags_split_and_summary(spark):
    df = _df(spark)
    flagged = quality.flag_rules(df, _rules())
    assert [r.is_valid for r in flagged.orderBy("name").collect()] == [True, True, False, False]
    good, bad = quality.split_rejects(df, _rules())
    assert rows(good, "id") == [(1,), (3,)]
    assert rows(bad, "name", "failed_rules") == [("b", ["id", "amt"]), ("d", ["amt"])]
    s = quality.rejection_summary(df, _rules()).first()
    assert (s.records_input, s.records_valid, s.failed_id, s.failed_amt, s.first_id, s.first_amt) == (4, 2, 1, 2, 1, 1)
    assert s.rejection_rate_pct == 50.0


def test_rejection_summary_empty_input_has_null_rate(spark):
    s = quality.rejection_summary(_df(spark).limit(0), _rules()).first()
    assert s.records_input == 0 and s.rejection_rate_pct is None


def test_error_code_first_failure_wins(spark):
    code, desc = quality.error_code([("E1", "no id", F.col("id").isNull()), ("E2", "bad amt", F.col("amt") <= 0)])
    got = _df(spark).select("name", code.alias("c"), desc.alias("d"))
    assert rows(got) == [("a", "", ""), ("b", "E1", "no id"), ("d", "", ""), (None, "", "")]


def test_profiles_and_expectations(spark):
    df = _df(spark)
    np = {r.column_name: r.null_count for r in quality.null_profile(df).collect()}
    assert np == {"id": 1, "name": 1, "amt": 1}
    assert quality.duplicate_keys(df.union(df.limit(1)), ["id"]).count() == 1
    prof = {r.column_name: r for r in quality.column_profile(df, ["amt"]).collect()}
    assert prof["amt"].min_value == -1 and prof["amt"].median_value == 2.0
    with pytest.raises(quality.ExpectationFailed):
        quality.expect(df, not_null=["id"])
    assert quality.expect(df, min_rows=1)["rows"] == 4


def test_alert(spark):
    s = quality.rejection_summary(_df(spark), _rules())
    assert quality.reject_alert(s, 5.0, 100).count() == 1
    assert quality.reject_alert(s, 90.0, 100).count() == 0


def test_checksum_order_independent_duplicate_sensitive(spark):
    df = spark.range(100).withColumn("s", F.col("id").cast("string"))
    a = reconcile.dataset_checksum(df).first()
    b = reconcile.dataset_checksum(df.orderBy(F.desc("id")).repartition(3)).first()
    c = reconcile.dataset_checksum(df.union(df.limit(1))).first()
    assert a == b and a != c
    assert reconcile.dataset_checksum(df, algo="md5").first() == reconcile.dataset_checksum(
        df.repartition(5), algo="md5").first()


def test_compare_counts_sums_schemas_rows(spark):
    a = spark.createDataFrame([(1, 1.25), (2, 2.5)], "k int, x double")
    b = spark.createDataFrame([(1, 1.25), (3, 9.0)], "k int, x double")
    c = reconcile.compare_counts(a, b).first()
    assert (c.source_count, c.target_count, c.counts_match) == (2, 2, True)
    s = reconcile.compare_sums(a, b, ["x"]).first()
    assert s.source_sum == Decimal("3.75") and s.target_sum == Decimal("10.25") and not s.sums_match
    third = spark.createDataFrame([(1, 0.004)] * 3, "k int, x double")  # not rounded before adding
    assert reconcile.compare_sums(third, third, ["x"]).first().source_sum == Decimal("0.012")
    assert reconcile.compare_schemas(a, b.withColumnRenamed("x", "y")) == [("x", "double", None),
                                                                           ("y", None, "double")]
    keyed = rows(reconcile.compare_rows(a, b, ["k"]))
    assert keyed == [(2, None, "present", None), (3, None, None, "present")]
    assert rows(reconcile.compare_rows(a, b), "k", "side") == [(2, "source_only"), (3, "target_only")]


def test_observed_counts_during_an_action(spark):
    df = _df(spark)
    observed, obs = quality.observed_counts(df, _rules())
    assert observed.filter(F.col("id").isNotNull()).count() == 3       # any action fills the observation
    c = obs.get
    assert (c["records_input"], c["records_valid"], c["records_rejected"], c["failed_amt"]) == (4, 2, 2, 2)
