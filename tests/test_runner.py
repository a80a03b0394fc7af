from tessera.plans import runner
from tests.conftest import SF


def test_customer_job_writes_outputs_and_metrics(spark, tmp_dir):
    params = {"OUTPUT_DIR": tmp_dir, "RUN_DATE": "2024-01-15", "RUN_TS": "2024-01-15 14:30:00"}
    counts = runner.run_customer_job(spark, SF, params)
    good = spark.read.parquet(f"{tmp_dir}/customers_clean")
    rej = spark.read.parquet(f"{tmp_dir}/customers_rejects")
    n_good = good.count()
    assert n_good == counts["records_valid"] and rej.count() == counts["records_rejected"]
    assert counts["records_input"] == counts["records_valid"] + counts["records_rejected"]
    runner.run_customer_job(spark, SF, params)            # a re-run replaces outputs, appends one metrics row
    m = spark.read.parquet(f"{tmp_dir}/run_metrics")
    assert m.count() == 2 and spark.read.parquet(f"{tmp_dir}/customers_clean").count() == n_good
    assert {r.status for r in m.collect()} == {"SUCCESS_WITH_REJECTS"}
