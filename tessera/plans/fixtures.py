"""Job inputs derived from the driver tables.

The four example jobs read files with their own schemas; here those inputs are
derived, with Spark, from the TPC-H-like tables so that every job's work grows
with the tables.  Null, bad-value and no-match cases are introduced by fixed
modulo rules on the keys (the tables themselves have no nulls or orphans).
The same rules are written in SQL in ``tessera.plans.oracle`` for the checks.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.util import maybe_broadcast

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

RUN_DATE = "2024-01-15"
RUN_TS = "2024-01-15 14:30:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- job 02 inputs

def orders_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: one row per order line (lineitem joined to its order)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    qty = F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 50 == 0), F.lit(0)) \
        .otherwise(F.col("l_quantity").cast("int"))
    return j.select(
        F.col("l_orderkey").alias("OrderID"),
        F.col("o_custkey").alias("CustomerID"),
        F.col("l_partkey").alias("ProductID"),
        qty.alias("Quantity"),
        F.to_date("o_orderdate").alias("OrderDate"),
        F.when(F.col("o_orderstatus") == "F", F.lit("COMPLETED")).otherwise(F.col("o_orderstatus")).alias("OrderStatus"),
    )


def customers_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with segment and region name (nation and region are broadcast
    after the size check; both are fixed-size tables)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (c.join(maybe_broadcast(n), c.c_nationkey == n.n_nationkey)
         .join(maybe_broadcast(r), F.col("n_regionkey") == r.r_regionkey))
    return j.select(F.col("c_custkey").alias("CustomerID"), F.col("c_name").alias("CustomerName"),
                    F.col("c_mktsegment").alias("CustomerSegment"), F.col("r_name").alias("Region"))


def products_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products reference with every 7th part missing and some null categories."""
    p = table(spark, sf_dir, "part")
    return (p.filter(F.col("p_partkey") % 7 != 0)
            .select(F.col("p_partkey").alias("ProductID"), F.col("p_name").alias("ProductName"),
                    F.when(F.col("p_partkey") % 11 == 0, F.lit(None).cast("string"))
                    .otherwise(F.col("p_type")).alias("Category"),
                    F.col("p_retailprice").cast("decimal(10,2)").alias("UnitPrice")))


# ---------------------------------------------------------------- job 01 input

def customers_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw customer file of job 01 (names with spaces, mixed-case status, nulls)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    status = (F.when(k % 5 == 0, "active").when(k % 5 == 1, "INACTIVE").when(k % 5 == 2, F.lit(None))
              .when(k % 5 == 3, "blocked").otherwise(" Active "))
    birth = F.when(k % 97 == 0, F.lit(_dt.date(2000, 2, 29))) \
        .otherwise(F.date_add(F.lit(_dt.date(1950, 1, 1)), ((k * 37) % 20000).cast("int")))
    return c.select(
        k.cast("int").alias("CustomerID"),
        F.concat(F.lit("  "), F.split_part(F.col("c_name"), F.lit("#"), F.lit(1))).alias("FirstName"),
        F.split_part(F.col("c_name"), F.lit("#"), F.lit(2)).alias("LastName"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit("@Example.COM "))).alias("Email"),
        birth.alias("BirthDate"),
        status.alias("Status"),
        F.date_add(F.lit(_dt.date(2015, 1, 1)), (k % 3000).cast("int")).alias("RegistrationDate"),
    )


# ---------------------------------------------------------------- job 03 inputs

def _dim_attrs(k, name, nation, segment):
    return [
        F.col(name).alias("CustomerName"),
        F.concat(F.lower(F.replace(F.col(name), F.lit("#"), F.lit("."))), F.lit("@example.org")).alias("Email"),
        F.concat(F.lit("+"), F.col(nation).cast("string"), F.lit("-"),
                 F.lpad((k % 10000).cast("string"), 4, "0")).alias("Phone"),
        F.concat(F.lit("Street "), k.cast("string")).alias("Address"),
        F.concat(F.lit("City"), F.col(nation).cast("string")).alias("City"),
        F.concat(F.lit("S"), (F.col(nation) % 5).cast("string")).alias("State"),
        F.concat(F.lit("N"), F.col(nation).cast("string")).alias("Country"),
        segment.alias("CustomerSegment"),
    ]


DIM_ATTRS = ["CustomerName", "Email", "Phone", "Address", "City", "State", "Country", "CustomerSegment"]


def source_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's customer snapshot: some keys gone, some segments changed or null."""
    c = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 17 != 0)
    k = F.col("c_custkey")
    seg = (F.when(k % 19 == 0, F.lit(None).cast("string"))
           .when(k % 10 == 0, F.concat(F.col("c_mktsegment"), F.lit("-X")))
           .otherwise(F.col("c_mktsegment")))
    return c.select(k.cast("int").alias("CustomerID"), *_dim_attrs(k, "c_name", "c_nationkey", seg))


def dim_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing type-2 dimension: current rows, closed history, deleted keys."""
    c = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 23 != 0)
    k = F.col("c_custkey")
    # each customer row yields 1 or 2 versions: explode an array of version numbers
    versions = F.when((k % 31 != 0) & (k % 29 == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    v = c.withColumn("RecordVersion", F.explode(versions))
    ver = F.col("RecordVersion")
    deleted = k % 31 == 0
    two = (k % 31 != 0) & (k % 29 == 0)
    seg = F.when(two & (ver == 1), F.lit("OLD")).otherwise(F.col("c_mktsegment"))
    eff = F.when(ver == 2, F.lit("2022-06-01 00:00:00")).otherwise(F.lit("2020-01-01 00:00:00"))
    end = (F.when(deleted, F.lit("2023-01-01 00:00:00")).when(two & (ver == 1), F.lit("2022-06-01 00:00:00"))
           .otherwise(F.lit(None).cast("string")))
    return v.select(
        (k * 2 + ver).cast("int").alias("DimensionKey"),
        k.cast("int").alias("CustomerID"),
        *_dim_attrs(k, "c_name", "c_nationkey", seg),
        F.to_timestamp_ntz(eff).alias("EffectiveDate"),
        F.to_timestamp_ntz(end).alias("EndDate"),
        F.when(end.isNull(), 1).otherwise(0).alias("IsCurrent"),
        ver.cast("int").alias("RecordVersion"),
    )


# ---------------------------------------------------------------- job 04 input

def transactions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text transaction file with every error class of job 04 present."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    amount_txt = F.col("value").cast("decimal(18,2)").cast("string")
    amount = (F.when(k % 31 == 0, F.lit("abc")).when(k % 29 == 0, F.lit("0.001"))
              .when(k % 23 == 0, F.lit("2000000")).otherwise(amount_txt))
    cur = (F.when(k % 19 == 0, F.lit(None).cast("string")).when(k % 19 == 1, F.lit("usd"))
           .when(k % 19 == 2, F.lit("")).when(k % 19 == 3, F.lit("EURO")).otherwise(F.lit("USD")))
    ttype = (F.when(F.col("event_type") == "purchase", F.lit("PURCHASE"))
             .when(F.col("event_type") == "click", F.lit("purchase"))
             .when(F.col("event_type") == "view", F.lit("REFUND"))
             .when(F.col("event_type") == "signup", F.lit("DEPOSIT"))
             .otherwise(F.lit(None).cast("string")))
    return e.select(
        F.when(k % 41 == 0, F.lit("  ")).otherwise(k.cast("string")).alias("TransactionID"),
        F.when(k % 43 == 0, F.lit(None).cast("string")).otherwise(F.col("user_id").cast("string")).alias("CustomerID"),
        F.when(k % 37 == 0, F.lit("2024-13-45")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("TransactionDate"),
        amount.alias("Amount"),
        cur.alias("Currency"),
        F.concat(F.lit(" M"), (k % 97).cast("string"), F.lit(" ")).alias("MerchantID"),
        ttype.alias("TransactionType"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.lit("completed ")).alias("Status"),
        k.alias("_event_id"),
    )
