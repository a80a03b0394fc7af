"""JDBC target (B13): batched inserts from every task in parallel."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append",
               props: Mapping[str, str] | None = None, batchsize: int = 1000,
               num_partitions: int | None = None) -> None:
    """Insert rows over JDBC; ``batchsize`` is the array size per round trip.

    ``num_partitions`` caps concurrent connections (Spark coalesces to it).
    """
    w = (df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table)
         .option("batchsize", str(batchsize)))
    if num_partitions:
        w = w.option("numPartitions", str(num_partitions))
    for k, v in (props or {}).items():
        w = w.option(k, v)
    w.save()
