"""File and catalog sources (sequential files, datasets, tables, generated rows).

Every reader takes an explicit schema where the job declares one; inference is
only used when the caller passes none (it costs an extra pass over the input).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT_COL = "_corrupt_record"
FILE_ROW_BYTES = 64  # a file's row in a broadcast, beside its path
BLOCK_ROWS = 1_000_000


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   delimiter: str = ",", quote: str = '"', escape: str = "\\",
                   header: bool = True, null_value: str = "", date_format: str = "yyyy-MM-dd",
                   timestamp_format: str | None = None, mode: str = "PERMISSIVE",
                   encoding: str = "UTF-8") -> DataFrame:
    """Sequential-file scan of delimited text (A1)."""
    r = (spark.read.option("sep", delimiter).option("quote", quote).option("escape", escape)
         .option("header", str(header).lower()).option("nullValue", null_value)
         .option("dateFormat", date_format).option("mode", mode).option("encoding", encoding))
    if timestamp_format:
        r = r.option("timestampFormat", timestamp_format)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", "true")
    return r.csv(path)


def read_fixed_width(spark: SparkSession, path: str,
                     layout: Sequence[tuple[str, int, int, str]], trim: bool = True) -> DataFrame:
    """Fixed-width scan (A2): layout is (name, 1-based start, length, type).

    Values that do not convert to the declared type become null (try_cast).
    """
    line = F.col("value")
    cols = []
    for name, start, n, dtype in layout:
        raw = F.substring(line, start, n)
        if trim:
            raw = F.trim(raw)
        raw = F.when(raw == "", F.lit(None)).otherwise(raw)
        cols.append((raw if dtype in ("string", "str") else raw.try_cast(dtype)).alias(name))
    return spark.read.text(path).select(*cols)


def read_with_rejects(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ",",
                      quote: str = '"', escape: str = "\\", header: bool = True, null_value: str = "",
                      date_format: str = "yyyy-MM-dd", multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scan keeping malformed rows on a reject output (A3).

    Spark's CSV scan in PERMISSIVE mode with a corrupt-record column.  Both
    outputs refer to every column, so every field is parsed, and the
    malformed-row test exact, whatever columns a consumer selects.  ``header`` drops the first line of each
    file and no other.  ``multi_line`` reads quoted records that span lines; such
    files cannot be split, one task reads each.  Returns (good rows in
    ``schema``, rejects with the raw record in ``raw_record``).
    """
    fields = [f for f in schema.fields if f.name != CORRUPT_COL]
    full = T.StructType(fields + [T.StructField(CORRUPT_COL, T.StringType(), True)])
    parsed = (spark.read.schema(full).option("sep", delimiter).option("quote", quote).option("escape", escape)
              .option("nullValue", null_value).option("dateFormat", date_format).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT_COL).option("header", str(header).lower())
              .option("multiLine", str(multi_line).lower()).csv(path))
    # always true, but the scan cannot leave out the columns of an expression
    every = F.length(F.substring(F.concat_ws("", *[F.col(f.name).cast("string") for f in fields]), 1, 0)) == 0
    good = parsed.filter(F.col(CORRUPT_COL).isNull() & every).drop(CORRUPT_COL)
    bad = parsed.filter(F.col(CORRUPT_COL).isNotNull() & every).withColumnRenamed(CORRUPT_COL, "raw_record")
    return good, bad


class RejectLimitExceeded(RuntimeError):
    pass


def enforce_reject_limit(rejects: DataFrame, limit: int) -> int:
    """Fail the run when rejects exceed ``limit`` (A4).

    Counts at most limit+1 rows, so the check costs no more than the limit.
    """
    n = rejects.limit(limit + 1).count()
    if n > limit:
        raise RejectLimitExceeded(f"reject limit {limit} exceeded")
    return n


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 merge_schema: bool = False) -> DataFrame:
    """Intermediate dataset scan (A5): Parquet, partition pruning and pushdown kept."""
    r = spark.read.option("mergeSchema", str(merge_schema).lower())
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table scan."""
    return spark.read.table(name)


def generate_rows(spark: SparkSession, n: int, columns: Mapping[str, Column] | None = None,
                  start: int = 1, step: int = 1, num_partitions: int | None = None) -> DataFrame:
    """Row generator (A9): n rows with ``row_id`` start, start+step, ...

    Column expressions may refer to ``row_id``; generation is distributed.
    """
    df = spark.range(start, start + n * step, step, numPartitions=num_partitions).withColumnRenamed("id", "row_id")
    if columns:
        df = df.select("row_id", *[c.alias(k) for k, c in columns.items()])
    return df


def rows(spark: SparkSession, data: Iterable, schema: T.StructType | str) -> DataFrame:
    """In-memory literal rows (A10), for tests and small reference lists."""
    return spark.createDataFrame(list(data), schema)


def with_source_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    """Source file path column (A13), from the file-source metadata column."""
    return df.withColumn(name, F.col("_metadata.file_path"))


def file_row_number(df: DataFrame, out: str = "row_number") -> DataFrame:
    """1-based row number in input order for a Parquet scan (@INROWNUM, C11).

    Input order = files by path, rows in file order.  Uses the scan's
    ``_metadata.row_index`` plus the row count of earlier files: the only
    shuffle is a count per file, and the per-file offsets (one row per file)
    are broadcast unless the scan has more files than a broadcast allows.  They
    are then joined by file and block of rows, so that a large file's rows do
    not meet in one task.  No range partitioning and no checkpoint: the numbers
    are a pure function of the files, so a recomputed task gets the same ones.
    """
    from pyspark.sql import Window

    from tessera.util import broadcast_limit
    # the driver has listed the files for the scan
    few = sum(len(x) + FILE_ROW_BYTES for x in df.inputFiles()) <= broadcast_limit(df)
    meta = df.withColumns({"_fp": F.col("_metadata.file_path"), "_ri": F.col("_metadata.row_index")})
    counts = meta.groupBy("_fp").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_fp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_fp", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    if few:
        joined = meta.join(F.broadcast(offsets), "_fp")
    else:
        meta = meta.withColumn("_rb", F.floor(F.col("_ri") / BLOCK_ROWS))
        joined = meta.join(meta.select("_fp", "_rb").distinct().join(offsets, "_fp"), ["_fp", "_rb"]).drop("_rb")
    return joined.withColumn(out, F.col("_off") + F.col("_ri") + 1).drop("_fp", "_ri", "_off")


def read_whole_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """One row per file: (path, body).  Each file is read by one task."""
    return (spark.read.text(path_glob, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")))


def attach_file_body(cases: DataFrame, text_col: str, files: DataFrame,
                     path_regex: str, out: str = "attached") -> DataFrame:
    """Attach the body of a file to each row whose text names it.

    The file name is pulled out of the text with ``path_regex`` (group 1) and
    equi-joined to the file table on its base name, so the files are not
    broadcast unless the optimizer finds them small.
    """
    named = cases.withColumn("_fname", F.regexp_extract(F.col(text_col), path_regex, 1))
    fbase = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("_fname"),
                         F.col("body").alias(out))
    return (named.join(fbase, "_fname", "left")
            .withColumn(text_col, F.when(F.col(out).isNotNull(),
                                         F.concat(F.col(text_col), F.lit("\n\n"), F.col(out)))
                        .otherwise(F.col(text_col)))
            .drop("_fname"))


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Schema gate (A12): metadata check only, no Spark job."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {missing}")
    return df
