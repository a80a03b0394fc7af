"""Run a job end to end and write its outputs.

``run_customer_job`` is the deployable form of job 01: the derived rows are
observed (rule counts gathered during the write, no extra pass), good and
reject outputs are written as staged dataset swaps, and one run-metrics row is
appended to a metrics dataset.  Paths may contain ``#PARAM#`` markers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import quality
from tessera.operators.transform import Params
from tessera.plans import customers, fixtures
from tessera.sinks.files import conform, write_dataset

CUSTOMER_JOB_PARAMS = Params({"OUTPUT_DIR": "", "RUN_DATE": "", "RUN_TS": "", "JOB_NAME": "customer_clean"})


def run_customer_job(spark: SparkSession, sf_dir: str, overrides: Mapping[str, object]) -> dict[str, object]:
    p = CUSTOMER_JOB_PARAMS.resolve(overrides)
    run_date, run_ts = str(p["RUN_DATE"]), str(p["RUN_TS"] or f"{p['RUN_DATE']} 00:00:00")
    out = Params.substitute("#OUTPUT_DIR#", p).rstrip("/")
    derived = customers.derived(fixtures.customers_raw(spark, sf_dir), run_date)
    rules = customers.rules()
    tagged = derived.withColumn("failed_rules", quality.failed_rules(rules))
    observed, obs = quality.observed_counts(tagged, rules, "customer_rules")
    # both outputs come from one observed plan: persist it so the input is read once
    observed = observed.persist()
    try:
        good = conform(observed.filter(F.size("failed_rules") == 0), customers.OUTPUT_SCHEMA)
        write_dataset(good, f"{out}/customers_clean")
        rej = observed.filter(F.size("failed_rules") > 0).select("CustomerID", "Email", "Status", "failed_rules")
        write_dataset(rej, f"{out}/customers_rejects")
        counts = obs.get
    finally:
        observed.unpersist()
    rate = (100.0 * counts["records_rejected"] / counts["records_input"]) if counts["records_input"] else None
    metrics = spark.createDataFrame(
        [(str(p["JOB_NAME"]), run_date, run_ts, sf_dir, out, counts["records_input"], counts["records_valid"],
          counts["records_rejected"], None if rate is None else round(rate, 4),
          "SUCCESS" if counts["records_rejected"] == 0 else "SUCCESS_WITH_REJECTS")],
        "job_name string, run_date string, execution_timestamp string, input_path string, output_path string, "
        "records_input long, records_output long, records_rejected long, rejection_rate_pct double, status string")
    metrics = metrics.withColumns({"run_date": F.to_date("run_date"),
                                   "execution_timestamp": F.to_timestamp_ntz("execution_timestamp")})
    write_dataset(metrics, f"{out}/run_metrics", mode="append")
    return dict(counts)
