"""Job 02: order processing with a join, a product lookup with defaults,
derivations, constraints, a six-key aggregate and a sort.

Plan shape.  The aggregate's keys CustomerName/CustomerSegment/Region depend
only on CustomerID, so the order lines are aggregated by (CustomerID, year,
month) *before* the customer join (eager aggregation): the customer join then
sees one row per customer-month instead of one per order line.  To stay exact
when the customer input repeats a key, customers are grouped by all their
attributes with a row count ``dup`` and the additive measures are multiplied by
it (min/max/avg are unchanged by duplication) -- the same numbers the
join-then-aggregate order gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import functions as fx
from tessera.operators.joins import lookup
from tessera.operators.ordering import sort_stage
from tessera.operators.transform import constrain, derive
from tessera.plans import fixtures

PRODUCT_DEFAULTS = {"ProductName": "UNKNOWN", "Category": "UNCATEGORIZED", "UnitPrice": 0}
GROUP_KEYS = ["CustomerID", "CustomerName", "CustomerSegment", "Region", "OrderYear", "OrderMonth"]


def priced_lines(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Lookup + transformer: LineTotal, year, month, completed flag; constraints."""
    looked = lookup(orders, products, ["ProductID"], ["ProductName", "Category", "UnitPrice"],
                    defaults=PRODUCT_DEFAULTS)
    derived = derive(looked, {
        "LineTotal": (F.col("Quantity") * F.col("UnitPrice")).cast("decimal(18,2)"),
        "OrderYear": fx.year("OrderDate"),
        "OrderMonth": fx.month("OrderDate"),
        "CompletedFlag": fx.if_then_else((F.col("OrderStatus") == "COMPLETED", 1), otherwise=0),
    })
    return constrain(derived, [F.col("Quantity") > 0, F.col("UnitPrice") >= 0])


def order_summary(orders: DataFrame, customers: DataFrame, products: DataFrame,
                  sort: bool = True) -> DataFrame:
    lines = priced_lines(orders, products)
    per_cust = lines.groupBy("CustomerID", "OrderYear", "OrderMonth").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("LineTotal").alias("_rev"),
        F.min("LineTotal").alias("MinOrderValue"),
        F.max("LineTotal").alias("MaxOrderValue"),
        F.sum("CompletedFlag").alias("_done"),
        F.sum("Quantity").alias("_qty"),
    )
    cust = customers.groupBy("CustomerID", "CustomerName", "CustomerSegment", "Region") \
        .agg(F.count(F.lit(1)).alias("dup"))
    j = per_cust.join(cust, "CustomerID", "inner")
    out = j.select(
        *GROUP_KEYS,
        (F.col("_n") * F.col("dup")).cast("long").alias("TotalOrders"),
        (F.col("_rev") * F.col("dup")).cast("decimal(18,2)").alias("TotalRevenue"),
        F.round(F.col("_rev").cast("double") / F.col("_n"), 6).alias("AvgOrderValue"),
        F.col("MinOrderValue").cast("decimal(18,2)").alias("MinOrderValue"),
        F.col("MaxOrderValue").cast("decimal(18,2)").alias("MaxOrderValue"),
        (F.col("_done") * F.col("dup")).cast("long").alias("CompletedOrders"),
        (F.col("_qty") * F.col("dup")).cast("long").alias("TotalQuantity"),
    )
    if sort:
        out = sort_stage(out, [("TotalRevenue", "desc"), ("CustomerName", "asc")], nulls="last")
    return out


def run(spark: SparkSession, sf_dir: str, sort: bool = True) -> DataFrame:
    return order_summary(fixtures.orders_input(spark, sf_dir), fixtures.customers_input(spark, sf_dir),
                         fixtures.products_input(spark, sf_dir), sort=sort)


ORACLE_INPUTS = """
WITH orders_in AS (
  SELECT l.l_orderkey AS OrderID, o.o_custkey AS CustomerID, l.l_partkey AS ProductID,
         CASE WHEN l.l_linenumber = 1 AND l.l_orderkey % 50 = 0 THEN 0
              ELSE CAST(l.l_quantity AS INTEGER) END AS Quantity,
         CAST(o.o_orderdate AS DATE) AS OrderDate,
         CASE WHEN o.o_orderstatus = 'F' THEN 'COMPLETED' ELSE o.o_orderstatus END AS OrderStatus
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
customers_in AS (
  SELECT c.c_custkey AS CustomerID, c.c_name AS CustomerName, c.c_mktsegment AS CustomerSegment,
         r.r_name AS Region
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey),
products_in AS (
  SELECT p_partkey AS ProductID, p_name AS ProductName,
         CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS Category,
         CAST(p_retailprice AS DECIMAL(10,2)) AS UnitPrice
  FROM part WHERE p_partkey % 7 <> 0)
"""

ORACLE_SQL = ORACLE_INPUTS + """,
lines AS (
  SELECT oc.*, CASE WHEN p.ProductID IS NULL THEN CAST(0 AS DECIMAL(10,2)) ELSE p.UnitPrice END AS UnitPrice,
         CAST(oc.Quantity * (CASE WHEN p.ProductID IS NULL THEN CAST(0 AS DECIMAL(10,2)) ELSE p.UnitPrice END)
              AS DECIMAL(18,2)) AS LineTotal,
         CAST(year(oc.OrderDate) AS INTEGER) AS OrderYear, CAST(month(oc.OrderDate) AS INTEGER) AS OrderMonth,
         CASE WHEN oc.OrderStatus = 'COMPLETED' THEN 1 ELSE 0 END AS CompletedFlag
  FROM (SELECT o.*, c.CustomerName, c.CustomerSegment, c.Region
        FROM orders_in o JOIN customers_in c ON o.CustomerID = c.CustomerID) oc
  LEFT JOIN products_in p ON oc.ProductID = p.ProductID)
SELECT CustomerID, CustomerName, CustomerSegment, Region, OrderYear, OrderMonth,
       CAST(count(*) AS BIGINT) AS TotalOrders,
       CAST(sum(LineTotal) AS DECIMAL(18,2)) AS TotalRevenue,
       CAST(round(CAST(sum(LineTotal) AS DOUBLE) / count(*), 6) AS DOUBLE) AS AvgOrderValue,
       CAST(min(LineTotal) AS DECIMAL(18,2)) AS MinOrderValue,
       CAST(max(LineTotal) AS DECIMAL(18,2)) AS MaxOrderValue,
       CAST(sum(CompletedFlag) AS BIGINT) AS CompletedOrders,
       CAST(sum(Quantity) AS BIGINT) AS TotalQuantity
FROM lines
WHERE Quantity > 0 AND UnitPrice >= 0
GROUP BY CustomerID, CustomerName, CustomerSegment, Region, OrderYear, OrderMonth
"""
