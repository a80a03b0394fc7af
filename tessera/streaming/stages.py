"""Streaming stages.

* ``stream_funnel``: the continuous funnel -- a union of streaming inputs
  (file sources here; any source works), written with ``run_available_now``.
* ``stream_upsert``: incremental load as a stream.  Each micro-batch is merged
  into a Parquet target by key, "latest wins" on an order column, so a
  replayed batch (after a failure) or batches arriving out of order give the
  same table.  The merge is an aggregate per key over target + batch, staged and
  swapped in; a swap that a lost driver left half done is finished by the next batch.

A target without partitions is rewritten by every batch.  With ``buckets`` it is
laid out by a hash of the key (one folder per bucket), and a batch reads and
rewrites only the buckets that its keys fall into; with ``partition_by`` the
same holds for partitions by value.

Both use a checkpoint location under the shared checkpoint folder, so a
restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.merge import batch_of, merge_into
from tessera.operators.ordering import funnel
from tessera.sinks.files import path_exists, recover, remove, write_dataset

_BUCKET = "bucket_of_"


def stream_funnel(spark: SparkSession, paths: Sequence[str], schema: T.StructType, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Union of file streams with one schema."""
    streams = []
    for p in paths:
        r = spark.readStream.format(fmt).schema(schema)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
        streams.append(r.load(p))
    return funnel(streams, mode="continuous")


def run_available_now(sdf: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
                      timeout_s: float | None = None) -> None:
    """Process everything available now into an append-only file sink, then stop."""
    q = (sdf.writeStream.format(fmt).option("path", sink_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    if q.exception():
        raise q.exception()


def start_continuous(sdf: DataFrame, sink_path: str, checkpoint: str, processing_time: str = "10 seconds",
                     fmt: str = "parquet"):
    """Start an append-only file sink with a processing-time trigger and return
    the StreamingQuery (the caller stops it); restarts resume from ``checkpoint``."""
    return (sdf.writeStream.format(fmt).option("path", sink_path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(processingTime=processing_time).start())


def latest_by_key(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """One row per key: the one with the greatest ``order_col`` (ties: greatest row)."""
    rest = [c for c in df.columns if c not in keys and c != order_col]
    s = F.struct(F.col(order_col), *[F.col(c) for c in rest])
    return (df.groupBy(*keys).agg(F.max(s).alias("_r"))
            .select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns]))


def with_bucket(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Adds the key's bucket; the column's name says how many buckets there are.

    The hash is of each key's text and of whether it is null, so the same key
    falls into the same bucket whatever its integer width.
    """
    h = F.xxhash64(*[x for k in keys for x in (F.col(k).isNull(), F.col(k).cast("string"))])
    return df.withColumn(f"{_BUCKET}{buckets}", F.pmod(h, F.lit(buckets)).cast("int"))


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A bucketed target without its bucket column."""
    t = spark.read.parquet(path)
    return t.drop(*[c for c in t.columns if c.startswith(_BUCKET)])


def merge_latest(spark: SparkSession, target_path: str, batch: DataFrame, keys: Sequence[str],
                 order_col: str, partition_by: Sequence[str] | None = None, buckets: int | None = None) -> None:
    """Merge one batch into the target: latest ``order_col`` wins per key.

    With ``partition_by`` or ``buckets`` only the partitions or buckets that the
    batch touches are read, merged and replaced (see ``merge.merge_into``; a
    key that moves leaves its old partition); the rest of the table is not rewritten.
    """
    if buckets and partition_by:
        raise ValueError("a target has partitions by value or buckets, not both")
    recover(spark, target_path)
    if buckets:
        batch, partition_by = with_bucket(batch, keys, buckets), [f"{_BUCKET}{buckets}"]
    if not path_exists(spark, target_path):
        write_dataset(latest_by_key(batch, keys, order_col), target_path, partition_by=partition_by)
        return
    columns = spark.read.parquet(target_path).columns
    if buckets and partition_by[0] not in columns:
        raise ValueError(f"{target_path} is not laid out in {buckets} buckets")
    stored, folder = batch_of(batch.select(*columns))
    try:
        merge_into(spark, target_path, stored, keys, lambda old, new: latest_by_key(old.unionByName(new), keys, order_col),
                   partition_by, moving_keys=not buckets)
    finally:
        remove(spark, folder)


def stream_upsert(spark: SparkSession, source_dir: str, schema: T.StructType, target_path: str,
                  keys: Sequence[str], order_col: str, checkpoint: str, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None, timeout_s: float | None = None,
                  partition_by: Sequence[str] | None = None, buckets: int | None = None) -> None:
    """Incremental upsert of a file stream into a Parquet table (W2); see ``merge_latest``."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    src = r.load(source_dir)

    def _batch(df: DataFrame, batch_id: int) -> None:
        merge_latest(df.sparkSession, target_path, df, keys, order_col, partition_by, buckets)

    q = (src.writeStream.foreachBatch(_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    if q.exception():
        raise q.exception()
