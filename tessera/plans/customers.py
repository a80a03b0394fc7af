"""Job 01: simple customer cleaning.

Derivations (full name, cleaned e-mail, age, status, days since registration,
process date), three constraints, a typed output projection, and a rejection
summary from one aggregate.  The status rule is applied to the derived value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import functions as fx
from tessera.functions import rules as R
from tessera.operators import quality
from tessera.operators.transform import derive
from tessera.plans import fixtures
from tessera.sinks.files import conform

OUTPUT_SCHEMA = T.StructType([
    T.StructField("CustomerID", T.IntegerType()),
    T.StructField("FullName", T.StringType()),
    T.StructField("EmailClean", T.StringType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("Status", T.StringType()),
    T.StructField("DaysSinceRegistration", T.IntegerType()),
    T.StructField("ProcessDate", T.DateType()),
])

STATUSES = ("ACTIVE", "INACTIVE", "UNKNOWN")


def derived(raw: DataFrame, run_date: str = fixtures.RUN_DATE) -> DataFrame:
    return derive(raw, {
        "FullName": fx.cat(fx.trim(fx.upcase("FirstName")), F.lit(" "), fx.trim(fx.upcase("LastName"))),
        "EmailClean": fx.downcase(fx.trim("Email")),
        "Age": fx.years_from_date("BirthDate", run_date),
        "Status": fx.if_then_else((fx.is_null("Status"), "UNKNOWN"), otherwise=fx.upcase(fx.trim("Status"))),
        "DaysSinceRegistration": fx.days_since("RegistrationDate", run_date),
        "ProcessDate": fx.current_date(run_date),
    })


def rules() -> dict[str, F.Column]:
    return {
        "customer_id": R.not_null("CustomerID"),
        "email": R.not_null("Email"),
        "status": R.in_set("Status", STATUSES),
    }


def run(spark: SparkSession, sf_dir: str, run_date: str = fixtures.RUN_DATE) -> dict[str, DataFrame]:
    d = derived(fixtures.customers_raw(spark, sf_dir), run_date)
    good, bad = quality.split_rejects(d, rules())
    return {
        "good": conform(good, OUTPUT_SCHEMA),
        "rejects": bad.select("CustomerID", "FirstName", "LastName", "Email", "Status", "failed_rules"),
        "summary": quality.rejection_summary(d, rules()),
    }


ORACLE_INPUT = """
WITH raw AS (
  SELECT CAST(c_custkey AS INTEGER) AS CustomerID,
         '  ' || split_part(c_name, '#', 1) AS FirstName,
         split_part(c_name, '#', 2) AS LastName,
         CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE ' ' || c_name || '@Example.COM ' END AS Email,
         CASE WHEN c_custkey % 97 = 0 THEN DATE '2000-02-29'
              ELSE CAST(DATE '1950-01-01' + CAST((c_custkey * 37) % 20000 AS INTEGER) AS DATE) END AS BirthDate,
         CASE c_custkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'INACTIVE' WHEN 2 THEN NULL
              WHEN 3 THEN 'blocked' ELSE ' Active ' END AS Status,
         CAST(DATE '2015-01-01' + CAST(c_custkey % 3000 AS INTEGER) AS DATE) AS RegistrationDate
  FROM customer),
d AS (
  SELECT CustomerID, FirstName, LastName, Email,
         trim(upper(FirstName)) || ' ' || trim(upper(LastName)) AS FullName,
         lower(trim(Email)) AS EmailClean,
         CAST(date_sub('year', BirthDate, DATE '2024-01-15') AS INTEGER) AS Age,
         CASE WHEN Status IS NULL THEN 'UNKNOWN' ELSE upper(trim(Status)) END AS Status,
         CAST(date_diff('day', RegistrationDate, DATE '2024-01-15') AS INTEGER) AS DaysSinceRegistration,
         DATE '2024-01-15' AS ProcessDate
  FROM raw)
"""

ORACLE_GOOD = ORACLE_INPUT + """
SELECT CustomerID, FullName, EmailClean, Age, Status, DaysSinceRegistration, ProcessDate
FROM d
WHERE CustomerID IS NOT NULL AND Email IS NOT NULL AND Status IN ('ACTIVE', 'INACTIVE', 'UNKNOWN')
"""

ORACLE_REJECTS = ORACLE_INPUT + """
SELECT CustomerID, FirstName, LastName, Email, Status,
       list_filter([CASE WHEN CustomerID IS NULL THEN 'customer_id' END,
                    CASE WHEN Email IS NULL THEN 'email' END,
                    CASE WHEN NOT coalesce(Status IN ('ACTIVE', 'INACTIVE', 'UNKNOWN'), false) THEN 'status' END],
                   lambda x: x IS NOT NULL) AS failed_rules
FROM d
WHERE NOT (CustomerID IS NOT NULL AND Email IS NOT NULL
           AND coalesce(Status IN ('ACTIVE', 'INACTIVE', 'UNKNOWN'), false))
"""

ORACLE_SUMMARY = ORACLE_INPUT + """,
f AS (SELECT CustomerID IS NOT NULL AS a, Email IS NOT NULL AS b,
             coalesce(Status IN ('ACTIVE', 'INACTIVE', 'UNKNOWN'), false) AS c FROM d)
SELECT CAST(count(*) AS BIGINT) AS records_input,
       CAST(count(*) FILTER (WHERE a AND b AND c) AS BIGINT) AS records_valid,
       CAST(count(*) FILTER (WHERE NOT (a AND b AND c)) AS BIGINT) AS records_rejected,
       CAST(count(*) FILTER (WHERE NOT a) AS BIGINT) AS failed_customer_id,
       CAST(count(*) FILTER (WHERE NOT b) AS BIGINT) AS failed_email,
       CAST(count(*) FILTER (WHERE NOT c) AS BIGINT) AS failed_status,
       CAST(count(*) FILTER (WHERE NOT a) AS BIGINT) AS first_customer_id,
       CAST(count(*) FILTER (WHERE a AND NOT b) AS BIGINT) AS first_email,
       CAST(count(*) FILTER (WHERE a AND b AND NOT c) AS BIGINT) AS first_status,
       CAST(round(CAST(count(*) FILTER (WHERE NOT (a AND b AND c)) AS DOUBLE) * 100.0 / count(*), 4) AS DOUBLE) AS rejection_rate_pct
FROM f
"""
