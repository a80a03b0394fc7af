"""Job 03: customer dimension, slowly changing type 2.

Change capture of today's source against the current dimension (before =
dimension, after = source, so a new source key is an insert), then the type-2
load: expire updated/deleted current rows with the run clock, add new versions
with contiguous surrogate keys, keep history.  The invariant "one current row
per key" is checked on the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dimension
from tessera.plans import fixtures

KEYS = ["CustomerID"]
COMPARE = fixtures.DIM_ATTRS


def run(spark: SparkSession, sf_dir: str, run_ts: str = fixtures.RUN_TS) -> dict[str, DataFrame]:
    dim = fixtures.dim_customer(spark, sf_dir)
    src = fixtures.source_customers(spark, sf_dir)
    res = dimension.scd2(dim, src, KEYS, COMPARE, run_ts)
    return res | {"change_counts": change_counts(spark, sf_dir), "capture": capture(spark, sf_dir)}


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows against the source, by key; no numbering."""
    current = fixtures.dim_customer(spark, sf_dir).filter(F.col("IsCurrent") == 1)
    return dimension.change_capture(current, fixtures.source_customers(spark, sf_dir), KEYS, COMPARE)


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per change type; one join and one aggregate."""
    return capture(spark, sf_dir).groupBy("change_type").agg(F.count(F.lit(1)).alias("records"))


_ATTRS_SQL = """
    c_name AS CustomerName,
    lower(replace(c_name, '#', '.')) || '@example.org' AS Email,
    '+' || CAST(c_nationkey AS VARCHAR) || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS Phone,
    'Street ' || CAST(c_custkey AS VARCHAR) AS Address,
    'City' || CAST(c_nationkey AS VARCHAR) AS City,
    'S' || CAST(c_nationkey % 5 AS VARCHAR) AS State,
    'N' || CAST(c_nationkey AS VARCHAR) AS Country"""

ORACLE_INPUTS = f"""
WITH src AS (
  SELECT CAST(c_custkey AS INTEGER) AS CustomerID, {_ATTRS_SQL},
    CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN c_mktsegment || '-X'
         ELSE c_mktsegment END AS CustomerSegment
  FROM customer WHERE c_custkey % 17 <> 0),
dim AS (
  SELECT CAST(c_custkey * 2 + v AS INTEGER) AS DimensionKey, CAST(c_custkey AS INTEGER) AS CustomerID, {_ATTRS_SQL},
    CASE WHEN c_custkey % 31 <> 0 AND c_custkey % 29 = 0 AND v = 1 THEN 'OLD' ELSE c_mktsegment END AS CustomerSegment,
    CASE WHEN v = 2 THEN TIMESTAMP '2022-06-01 00:00:00' ELSE TIMESTAMP '2020-01-01 00:00:00' END AS EffectiveDate,
    CASE WHEN c_custkey % 31 = 0 THEN TIMESTAMP '2023-01-01 00:00:00'
         WHEN c_custkey % 29 = 0 AND v = 1 THEN TIMESTAMP '2022-06-01 00:00:00' END AS EndDate,
    CASE WHEN c_custkey % 31 = 0 OR (c_custkey % 29 = 0 AND v = 1) THEN 0 ELSE 1 END AS IsCurrent,
    CAST(v AS INTEGER) AS RecordVersion
  FROM customer,
       unnest(CASE WHEN c_custkey % 31 <> 0 AND c_custkey % 29 = 0 THEN [1, 2] ELSE [1] END) AS t(v)
  WHERE c_custkey % 23 <> 0),
cur AS (SELECT * FROM dim WHERE IsCurrent = 1),
keys AS (SELECT CustomerID FROM dim UNION SELECT CustomerID FROM src),
j AS (
  SELECT k.CustomerID, c.CustomerID AS c_id, s.CustomerID AS s_id, mv.maxver,
    CASE WHEN s.CustomerID IS NOT NULL AND c.CustomerID IS NULL THEN 'I'
         WHEN c.CustomerID IS NOT NULL AND s.CustomerID IS NULL THEN 'D'
         WHEN c.CustomerID IS NOT NULL AND (
              c.CustomerName IS DISTINCT FROM s.CustomerName OR c.Email IS DISTINCT FROM s.Email OR
              c.Phone IS DISTINCT FROM s.Phone OR c.Address IS DISTINCT FROM s.Address OR
              c.City IS DISTINCT FROM s.City OR c.State IS DISTINCT FROM s.State OR
              c.Country IS DISTINCT FROM s.Country OR c.CustomerSegment IS DISTINCT FROM s.CustomerSegment) THEN 'U'
         WHEN c.CustomerID IS NOT NULL THEN 'C' END AS ct
  FROM keys k LEFT JOIN cur c ON c.CustomerID = k.CustomerID
              LEFT JOIN src s ON s.CustomerID = k.CustomerID
              LEFT JOIN (SELECT CustomerID, max(RecordVersion) AS maxver FROM dim GROUP BY CustomerID) mv
                     ON mv.CustomerID = k.CustomerID)
"""

ORACLE_DIMENSION = ORACLE_INPUTS + """
SELECT * FROM dim WHERE IsCurrent <> 1
UNION ALL
SELECT c.DimensionKey, c.CustomerID, c.CustomerName, c.Email, c.Phone, c.Address, c.City, c.State, c.Country,
       c.CustomerSegment, c.EffectiveDate,
       CASE WHEN j.ct IN ('U', 'D') THEN TIMESTAMP '2024-01-15 14:30:00' ELSE c.EndDate END AS EndDate,
       CASE WHEN j.ct IN ('U', 'D') THEN 0 ELSE c.IsCurrent END AS IsCurrent, c.RecordVersion
FROM cur c JOIN j ON j.CustomerID = c.CustomerID
UNION ALL
SELECT CAST((SELECT max(DimensionKey) FROM dim) + row_number() OVER (ORDER BY s.CustomerID) AS INTEGER) AS DimensionKey,
       s.CustomerID, s.CustomerName, s.Email, s.Phone, s.Address, s.City, s.State, s.Country, s.CustomerSegment,
       TIMESTAMP '2024-01-15 14:30:00' AS EffectiveDate, CAST(NULL AS TIMESTAMP) AS EndDate, 1 AS IsCurrent,
       CAST(coalesce(j.maxver, 0) + 1 AS INTEGER) AS RecordVersion
FROM src s JOIN j ON j.CustomerID = s.CustomerID WHERE j.ct IN ('I', 'U')
"""

ORACLE_CHANGE_COUNTS = ORACLE_INPUTS + """
SELECT ct AS change_type, CAST(count(*) AS BIGINT) AS records FROM j WHERE ct IS NOT NULL GROUP BY ct
"""

ORACLE_CAPTURE = ORACLE_INPUTS + """
SELECT coalesce(s.CustomerID, c.CustomerID) AS CustomerID,
       CASE WHEN s.CustomerID IS NULL THEN c.CustomerName ELSE s.CustomerName END AS CustomerName,
       CASE WHEN s.CustomerID IS NULL THEN c.Email ELSE s.Email END AS Email,
       CASE WHEN s.CustomerID IS NULL THEN c.Phone ELSE s.Phone END AS Phone,
       CASE WHEN s.CustomerID IS NULL THEN c.Address ELSE s.Address END AS Address,
       CASE WHEN s.CustomerID IS NULL THEN c.City ELSE s.City END AS City,
       CASE WHEN s.CustomerID IS NULL THEN c.State ELSE s.State END AS State,
       CASE WHEN s.CustomerID IS NULL THEN c.Country ELSE s.Country END AS Country,
       CASE WHEN s.CustomerID IS NULL THEN c.CustomerSegment ELSE s.CustomerSegment END AS CustomerSegment,
       CASE WHEN c.CustomerID IS NULL THEN 'I' WHEN s.CustomerID IS NULL THEN 'D'
            WHEN c.CustomerName IS DISTINCT FROM s.CustomerName OR c.Email IS DISTINCT FROM s.Email OR
                 c.Phone IS DISTINCT FROM s.Phone OR c.Address IS DISTINCT FROM s.Address OR
                 c.City IS DISTINCT FROM s.City OR c.State IS DISTINCT FROM s.State OR
                 c.Country IS DISTINCT FROM s.Country OR c.CustomerSegment IS DISTINCT FROM s.CustomerSegment
            THEN 'U' ELSE 'C' END AS change_type
FROM cur c FULL OUTER JOIN src s ON c.CustomerID = s.CustomerID
"""
