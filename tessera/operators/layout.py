"""File layout jobs and reuse caching.

``compact`` and ``cluster`` rewrite a dataset into fewer / better-ordered
files (the Parquet counterparts of OPTIMIZE and ZORDER BY); both stage the new
files and swap them in.  ``reused`` persists a frame that several actions read.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ranges import count_reached
from tessera.session import ensure_checkpoint_dir, scratch_path
from tessera.sinks.files import write_dataset


MAX_FILE_BYTES = 128 * 1024 * 1024


def compact(spark: SparkSession, path: str, target_files: int,
            partition_by: Sequence[str] | None = None, max_file_bytes: int = MAX_FILE_BYTES) -> str:
    """Rewrite a Parquet dataset into ``target_files`` files per output.

    A file is written by one task, so a dataset that is larger than
    ``target_files`` files of ``max_file_bytes`` goes into as many of that size
    as it needs.
    """
    df = spark.read.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return write_dataset(df, path, partition_by=partition_by, files=max(target_files, -(-size // max_file_bytes)))


def _bucket(c: Column, bounds: Sequence, dtype: T.DataType) -> Column:
    """Rank of a value among fixed rising bounds (0..len(bounds)), found by halving; nulls rank lowest."""
    if not bounds:
        return F.lit(0).cast("long")
    arr = F.array(*[F.lit(b).cast(dtype) for b in bounds])
    return count_reached(arr, len(bounds), lambda x: x <= c).cast("long")


_MEASURED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _ranked_bounds(df: DataFrame, cols: Sequence[str], n: int) -> dict[str, list]:
    """Exact quantile bounds of columns of one ordered type, all in one pass.

    Their distinct values are counted by (column, value), laid out in range
    partitions, and meet the quantiles by a running count.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "zorder-values")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(cols)]))
    counts = df.select(pairs.alias("p")).select("p.*").filter("v IS NOT NULL").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange(parts, "i", "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    counts = spark.read.parquet(path)
    starts, total = [], dict.fromkeys(range(len(cols)), 0)
    for r in counts.groupBy("part", "i").agg(F.sum("n").alias("n")).orderBy("part", "i").collect():  # partitions + columns at most
        starts.append((r["part"], r["i"], total[r["i"]]))
        total[r["i"]] += r["n"]
    starts = spark.createDataFrame([(*s, total[s[1]]) for s in starts], "part int, i int, start bigint, total bigint")
    end = F.col("start") + F.sum("n").over(Window.partitionBy("part", "i").orderBy("v"))
    ranked = counts.join(F.broadcast(starts), ["part", "i"]).withColumn("end", end)
    # the first quantile whose row is not before the value's rows is inside them
    q = F.expr(f"greatest(1L, ((end - n) * {n}L + total - 1L) div total)")
    hit = (F.col("q") < n) & (F.expr(f"total * q div {n}L") < F.col("end"))
    found: dict[str, list] = {c: [] for c in cols}
    for r in ranked.withColumn("q", q).filter(hit).select("i", "v").collect():  # n - 1 a column at most
        found[cols[r["i"]]].append(r["v"])
    return {c: sorted(v) for c, v in found.items()}


def _bounds(df: DataFrame, cols: Sequence[str], n: int) -> list[list]:
    """n - 1 quantile bounds per column from all rows: approximate for numbers and dates, exact for other types."""
    types = {f.name: f.dataType for f in df.schema.fields}
    measured = [c for c in dict.fromkeys(cols) if isinstance(types[c], _MEASURED)]
    found: dict[str, list] = {}
    if measured:
        share = [q / n for q in range(1, n)]
        whole = {c: F.nanvl(F.col(c), F.lit(None)) if isinstance(types[c], (T.FloatType, T.DoubleType)) else F.col(c) for c in measured}
        row = df.agg(*[F.percentile_approx(whole[c], share).alias(f"b{i}") for i, c in enumerate(measured)]).first()
        found = {c: sorted(set(row[i] or [])) for i, c in enumerate(measured)}
    rest = [c for c in dict.fromkeys(cols) if c not in found]
    for kind in dict.fromkeys(types[c].simpleString() for c in rest):
        found |= _ranked_bounds(df, [c for c in rest if types[c].simpleString() == kind], n)
    return [found[c] for c in cols]


def z_value(df: DataFrame, cols: Sequence[str], bits: int = 8) -> Column:
    """Z-order value: interleaved bits of each column's quantile bucket.

    The bounds (2**bits - 1 values per column at most) are quantiles of the
    whole values over all rows, so they order strings with a long common prefix,
    dates, timestamps and numbers alike.  All columns share 63
    bits: ``bits`` is lowered to fit, and more than 63 columns are refused.
    """
    if not cols or len(cols) > 63:
        raise ValueError("z-order takes 1 to 63 columns")
    bits = min(bits, 63 // len(cols))
    bounds = _bounds(df, cols, 2 ** bits)
    types = {f.name: f.dataType for f in df.schema.fields}
    buckets = [_bucket(F.col(c), b, types[c]) for c, b in zip(cols, bounds)]
    m = len(buckets)
    # a bucket's bits, m places apart: one look-up per column
    spread = F.array(*[F.lit(sum((v >> b & 1) << (b * m) for b in range(bits))).cast("long") for v in range(2 ** bits)])
    z = F.lit(0).cast("long")
    for j, bucket in enumerate(buckets):
        z = z + F.shiftleft(F.get(spread, bucket.cast("int")), j)
    return z


def cluster(df: DataFrame, cols: Sequence[str], n: int, zorder: bool | None = None) -> DataFrame:
    """Lay rows out so files hold narrow ranges of ``cols``.

    One column: range-partition on it.  Several: range-partition on their
    z-value so every column gets narrow per-file min/max.
    """
    use_z = (len(cols) > 1) if zorder is None else zorder
    if not use_z:
        return df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    z = z_value(df, cols)
    return (df.withColumn("_z", z).repartitionByRange(n, "_z").sortWithinPartitions("_z", *cols).drop("_z"))


@contextlib.contextmanager
def reused(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Persist a frame read by several actions, and release it afterwards."""
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()
