"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, scratch_path

# ASCII white space of the contracts, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_PER_BATCH = "1000"


def text_rows(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The named columns of a table of texts, on their way to Python.

    Spark's default of 10,000 rows in an Arrow batch is meant for narrow rows;
    with whole texts one batch would take tens of MB in the JVM and again in
    each Python worker.  Where the session names no batch size, 1,000 is set.
    """
    spark = docs.sparkSession
    if spark.conf.get(ARROW_ROWS, None) is None:
        spark.conf.set(ARROW_ROWS, TEXTS_PER_BATCH)
    return docs.select(*columns)


def task_count(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session names."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back (cuts lineage, survives lost executors)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
