"""Job 04: transaction validation with error codes, a reject link and enrichment.

Stage variables convert amount (decimal at scale 4, so the minimum-amount test
sees the unrounded value) and date; the first failing check (E001-E008) gives
the error code.  Good rows are cleaned and enriched (calendar parts, day name,
weekend flag, amount band, record hash) and guarded by ``Amount > 0``; reject
rows keep the raw text plus code, description, run clock, source and the input
row number (numbered over the whole input in its stated order, distributed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import functions as fx
from tessera.operators import quality
from tessera.operators.transform import derive_staged
from tessera.plans import fixtures

MIN_AMOUNT = "0.01"
MAX_AMOUNT = "1000000"
PROCESSED_BY = "transaction_validation"
TYPES = ("PURCHASE", "REFUND", "WITHDRAWAL", "DEPOSIT")
RAW_COLS = ["TransactionID", "CustomerID", "TransactionDate", "Amount", "Currency", "MerchantID",
            "TransactionType", "Status"]

# Fixed values of the job: error codes and their texts, in priority order.
ERROR_TEXTS = {
    "E001": "Missing TransactionID",
    "E002": "Missing CustomerID",
    "E003": "Invalid Date Format",
    "E004": "Invalid Amount (not numeric)",
    "E005": "Amount below minimum threshold",
    "E006": "Amount exceeds maximum threshold",
    "E007": "Invalid Currency Code",
    "E008": "Invalid Transaction Type",
}


def checks(min_amount: str = MIN_AMOUNT, max_amount: str = MAX_AMOUNT):
    amt = F.col("svAmountNumeric")
    lo, hi = F.lit(min_amount).cast("decimal(18,4)"), F.lit(max_amount).cast("decimal(18,4)")
    conds = {
        "E001": F.col("TransactionID").isNull() | (F.trim("TransactionID") == ""),
        "E002": F.col("CustomerID").isNull() | (F.trim("CustomerID") == ""),
        "E003": F.col("svDateParsed").isNull(),
        "E004": amt.isNull(),
        "E005": amt < lo,
        "E006": amt > hi,
        "E007": F.col("Currency").isNotNull() & (F.length(F.trim("Currency")) != 3),
        "E008": F.col("TransactionType").isNull() | ~F.col("TransactionType").isin(*TYPES),
    }
    return [(code, ERROR_TEXTS[code], conds[code]) for code in ERROR_TEXTS]


def validated(raw: DataFrame, min_amount: str = MIN_AMOUNT, max_amount: str = MAX_AMOUNT) -> DataFrame:
    code, desc = quality.error_code(checks(min_amount, max_amount), none="")
    return derive_staged(raw, {
        "svAmountNumeric": fx.convert_to_numeric(fx.trim("Amount"), 18, 4),
        "svDateParsed": fx.string_to_date(fx.trim("TransactionDate"), "%yyyy-%mm-%dd"),
        "svErrorCode": code,
        "svErrorDescription": desc,
    }, drop=False)


def good_output(v: DataFrame, run_ts: str = fixtures.RUN_TS) -> DataFrame:
    g = v.filter(F.col("svErrorCode") == "")
    cleaned = g.select(
        "TransactionID", "CustomerID",
        F.col("svDateParsed").alias("TransactionDate"),
        F.col("svAmountNumeric").alias("Amount"),
        fx.if_then_else((fx.is_null("Currency"), "USD"), otherwise=fx.trim(fx.upcase("Currency"))).alias("Currency"),
        fx.trim("MerchantID").alias("MerchantID"),
        fx.trim(fx.upcase("TransactionType")).alias("TransactionType"),
        fx.if_then_else((fx.is_null("Status"), "PENDING"), otherwise=fx.trim(fx.upcase("Status"))).alias("Status"),
    )
    amt = F.col("Amount")
    enriched = cleaned.withColumns({
        "TransactionYear": fx.year("TransactionDate"),
        "TransactionMonth": fx.month("TransactionDate"),
        "TransactionDay": fx.day("TransactionDate"),
        "DayOfWeek": fx.day_name("TransactionDate"),
    }).withColumns({
        "IsWeekend": F.when(F.col("DayOfWeek").isin("Saturday", "Sunday"), 1).otherwise(0),
        "AmountCategory": fx.if_then_else((amt < 10, "MICRO"), (amt < 100, "SMALL"), (amt < 1000, "MEDIUM"),
                                          (amt < 10000, "LARGE"), otherwise="VERY_LARGE"),
        "ProcessedTimestamp": fx.current_timestamp(run_ts),
        "ProcessedBy": F.lit(PROCESSED_BY),
        "RecordHash": F.md5(fx.cat(F.col("TransactionID"), F.col("CustomerID"), fx.to_string(amt),
                                   fx.to_string(F.col("TransactionDate")))),
    })
    return enriched.filter(amt > 0).withColumn("Amount", amt.cast("decimal(18,2)"))


def reject_output(v: DataFrame, run_ts: str = fixtures.RUN_TS, source_file: str = "transactions.csv") -> DataFrame:
    b = v.filter(F.col("svErrorCode") != "")
    b = b.select(*RAW_COLS, F.col("svErrorCode").alias("ErrorCode"),
                 F.col("svErrorDescription").alias("ErrorDescription"), "RowNumber")
    return quality.with_reject_info(b, run_ts, PROCESSED_BY, source_file).select(
        *RAW_COLS, "ErrorCode", "ErrorDescription", "RejectedTimestamp", "RejectedBy", "SourceFile", "RowNumber")


def run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"good": good(spark, sf_dir), "rejects": rejects(spark, sf_dir), "error_counts": error_counts(spark, sf_dir)}


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean transactions: one scan, no numbering."""
    return good_output(validated(fixtures.transactions_raw(spark, sf_dir)))


def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per error code: one scan and one aggregate."""
    v = validated(fixtures.transactions_raw(spark, sf_dir))
    return v.groupBy(F.col("svErrorCode").alias("ErrorCode")).agg(F.count(F.lit(1)).alias("records"))


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected records with their input row number.

    One numbering pass over (order key, the reject or null): all rows are
    counted, and only rejects carry their columns through it.
    """
    v = validated(fixtures.transactions_raw(spark, sf_dir))
    cols = [*RAW_COLS, "svErrorCode", "svErrorDescription"]
    slim = v.select("_event_id", F.when(F.col("svErrorCode") != "", F.struct(*cols)).alias("reject"))
    numbered = quality.number_input(slim, ["_event_id"], "RowNumber", unique=True).filter(F.col("reject").isNotNull())
    return reject_output(numbered.select("reject.*", "RowNumber"))


ORACLE_INPUT = """
WITH raw AS (
  SELECT CASE WHEN event_id % 41 = 0 THEN '  ' ELSE CAST(event_id AS VARCHAR) END AS TransactionID,
         CASE WHEN event_id % 43 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS CustomerID,
         CASE WHEN event_id % 37 = 0 THEN '2024-13-45' ELSE strftime(ts, '%Y-%m-%d') END AS TransactionDate,
         CASE WHEN event_id % 31 = 0 THEN 'abc' WHEN event_id % 29 = 0 THEN '0.001'
              WHEN event_id % 23 = 0 THEN '2000000' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS Amount,
         CASE event_id % 19 WHEN 0 THEN NULL WHEN 1 THEN 'usd' WHEN 2 THEN '' WHEN 3 THEN 'EURO'
              ELSE 'USD' END AS Currency,
         ' M' || CAST(event_id % 97 AS VARCHAR) || ' ' AS MerchantID,
         CASE event_type WHEN 'purchase' THEN 'PURCHASE' WHEN 'click' THEN 'purchase'
              WHEN 'view' THEN 'REFUND' WHEN 'signup' THEN 'DEPOSIT' ELSE NULL END AS TransactionType,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'completed ' END AS Status,
         CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS RowNumber
  FROM events),
v AS (
  SELECT *, TRY_CAST(trim(Amount) AS DECIMAL(18,4)) AS amt,
         CAST(try_strptime(trim(TransactionDate), '%Y-%m-%d') AS DATE) AS dte
  FROM raw),
c AS (
  SELECT *, CASE
      WHEN TransactionID IS NULL OR trim(TransactionID) = '' THEN 'E001'
      WHEN CustomerID IS NULL OR trim(CustomerID) = '' THEN 'E002'
      WHEN dte IS NULL THEN 'E003'
      WHEN amt IS NULL THEN 'E004'
      WHEN amt < 0.01 THEN 'E005'
      WHEN amt > 1000000 THEN 'E006'
      WHEN Currency IS NOT NULL AND length(trim(Currency)) <> 3 THEN 'E007'
      WHEN TransactionType IS NULL OR TransactionType NOT IN ('PURCHASE','REFUND','WITHDRAWAL','DEPOSIT') THEN 'E008'
      ELSE '' END AS code
  FROM v)
"""

ORACLE_ERROR_COUNTS = ORACLE_INPUT + """
SELECT code AS ErrorCode, CAST(count(*) AS BIGINT) AS records FROM c GROUP BY code
"""

ORACLE_REJECTS = ORACLE_INPUT + """
SELECT TransactionID, CustomerID, TransactionDate, Amount, Currency, MerchantID, TransactionType, Status,
       code AS ErrorCode,
       CASE code WHEN 'E001' THEN 'Missing TransactionID' WHEN 'E002' THEN 'Missing CustomerID'
                 WHEN 'E003' THEN 'Invalid Date Format' WHEN 'E004' THEN 'Invalid Amount (not numeric)'
                 WHEN 'E005' THEN 'Amount below minimum threshold' WHEN 'E006' THEN 'Amount exceeds maximum threshold'
                 WHEN 'E007' THEN 'Invalid Currency Code' ELSE 'Invalid Transaction Type' END AS ErrorDescription,
       TIMESTAMP '2024-01-15 14:30:00' AS RejectedTimestamp, 'transaction_validation' AS RejectedBy,
       'transactions.csv' AS SourceFile, RowNumber
FROM c WHERE code <> ''
"""

ORACLE_GOOD = ORACLE_INPUT + """,
g AS (
  SELECT TransactionID, CustomerID, dte AS TransactionDate, amt AS Amount,
         CASE WHEN Currency IS NULL THEN 'USD' ELSE trim(upper(Currency)) END AS Currency,
         trim(MerchantID) AS MerchantID, trim(upper(TransactionType)) AS TransactionType,
         CASE WHEN Status IS NULL THEN 'PENDING' ELSE trim(upper(Status)) END AS Status
  FROM c WHERE code = '')
SELECT TransactionID, CustomerID, TransactionDate, CAST(Amount AS DECIMAL(18,2)) AS Amount, Currency, MerchantID,
       TransactionType, Status,
       CAST(year(TransactionDate) AS INTEGER) AS TransactionYear,
       CAST(month(TransactionDate) AS INTEGER) AS TransactionMonth,
       CAST(day(TransactionDate) AS INTEGER) AS TransactionDay,
       dayname(TransactionDate) AS DayOfWeek,
       CASE WHEN dayname(TransactionDate) IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END AS IsWeekend,
       CASE WHEN Amount < 10 THEN 'MICRO' WHEN Amount < 100 THEN 'SMALL' WHEN Amount < 1000 THEN 'MEDIUM'
            WHEN Amount < 10000 THEN 'LARGE' ELSE 'VERY_LARGE' END AS AmountCategory,
       TIMESTAMP '2024-01-15 14:30:00' AS ProcessedTimestamp,
       'transaction_validation' AS ProcessedBy,
       md5(TransactionID || CustomerID || CAST(Amount AS VARCHAR) || CAST(TransactionDate AS VARCHAR)) AS RecordHash
FROM g WHERE Amount > 0
"""
