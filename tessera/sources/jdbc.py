"""JDBC sources (A6, A7): partitioned reads, pushed predicates and queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, table: str | None = None,
              props: Mapping[str, str] | None = None, *, query: str | None = None,
              predicate: str | None = None, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None, fetch_size: int | None = None) -> DataFrame:
    """Read a table or query over JDBC.

    ``partition_column``/``lower``/``upper``/``num_partitions`` split the scan
    into parallel range queries (one per task) instead of one connection.
    ``predicate`` is a WHERE clause pushed into the database query.
    """
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table / query")
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (props or {}).items():
        r = r.option(k, v)
    if fetch_size:
        r = r.option("fetchsize", str(fetch_size))
    if query is not None:
        if partition_column:
            raise ValueError("partitioned reads need a table (or a subquery as table)")
        r = r.option("query", query)
    else:
        src = f"(SELECT * FROM {table} WHERE {predicate}) t" if predicate else table
        r = r.option("dbtable", src)
        if partition_column:
            if lower is None or upper is None or not num_partitions:
                raise ValueError("partitioned read needs lower, upper and num_partitions")
            r = (r.option("partitionColumn", partition_column).option("lowerBound", str(lower))
                 .option("upperBound", str(upper)).option("numPartitions", str(num_partitions)))
    return r.load()
