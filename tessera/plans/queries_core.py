"""Checked queries: jobs and stage operators over the driver tables."""

from __future__ import annotations

from tessera.plans import orders
from tessera.plans.catalog import register

register("job02_order_summary", orders.ORACLE_SQL)(lambda spark, d: orders.run(spark, d))

from tessera.plans import customers, transactions  # noqa: E402

register("job01_customer_clean", customers.ORACLE_GOOD)(lambda s, d: customers.run(s, d)["good"])
register("job01_rejects", customers.ORACLE_REJECTS)(lambda s, d: customers.run(s, d)["rejects"])
register("job01_summary", customers.ORACLE_SUMMARY)(lambda s, d: customers.run(s, d)["summary"])
register("job04_good", transactions.ORACLE_GOOD)(lambda s, d: transactions.good(s, d))
register("job04_rejects", transactions.ORACLE_REJECTS)(lambda s, d: transactions.rejects(s, d))
register("job04_error_counts", transactions.ORACLE_ERROR_COUNTS)(lambda s, d: transactions.error_counts(s, d))

from tessera.plans import dim_customer  # noqa: E402

register("job03_scd2_dimension", dim_customer.ORACLE_DIMENSION)(lambda s, d: dim_customer.run(s, d)["dimension"])
register("job03_change_counts", dim_customer.ORACLE_CHANGE_COUNTS)(lambda s, d: dim_customer.change_counts(s, d))
register("h1_change_capture", dim_customer.ORACLE_CAPTURE)(lambda s, d: dim_customer.capture(s, d))
