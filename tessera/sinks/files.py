"""File and catalog sinks.

Overwrites of a dataset, or of some of its partitions, are staged beside it:

* ``<target>.__staging-<id>`` gets the new content;
* ``<target>.__swap-<id>`` then says what is to be moved (the journal);
* each folder named there is moved aside to ``<target>.__old-<id>`` and its new
  content moved in; old content, staging and, last, the journal are removed.

So a job never reads and overwrites the same path, a failed write leaves the old
content in place, and no folder of a swap ever lies inside the dataset: readers see
old or new partitions under their own names only.

Limit: plain folders cannot be replaced atomically.  Between its two moves a
partition (or the whole target) is missing, and during a swap of several
partitions a reader can see some old and some new.  A driver lost in between
leaves the journal; ``recover`` then finishes the swap, each partition of it, and
removes what a lost write left.  One writer at a time; on an object store a
move is a copy.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _beside(spark: SparkSession, target: str, kind: str) -> dict[str, str]:
    """Folders and journals of swaps beside a target: id -> path."""
    fs, t = _fs(spark, target)
    prefix = f"{t.getName()}.__{kind}-"
    if t.getParent() is None or not fs.exists(t.getParent()):
        return {}
    return {str(st.getPath().getName())[len(prefix):]: str(st.getPath().toString())
            for st in fs.listStatus(t.getParent()) if str(st.getPath().getName()).startswith(prefix)}


def _move(fs, source, dest) -> None:
    fs.mkdirs(dest.getParent())
    if not fs.rename(source, dest):
        raise OSError(f"cannot move {source.toString()} to {dest.toString()}")


def _finish_swap(spark: SparkSession, target: str, ident: str) -> None:
    """Carry out a swap's journal; whatever was already moved stays so."""
    target = target.rstrip("/")
    fs, journal = _fs(spark, f"{target}.__swap-{ident}")
    at = lambda kind, rel: spark._jvm.org.apache.hadoop.fs.Path(f"{target}{kind}" + (f"/{rel}" if rel else ""))
    stream = fs.open(journal)
    try:
        plan = json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()
    for rel in plan["replace"]:
        new, live, old = at(f".__staging-{ident}", rel), at("", rel), at(f".__old-{ident}", rel)
        if not fs.exists(new):
            continue  # moved in before
        if fs.exists(live):
            if fs.exists(old):
                fs.delete(live, True)  # a move by copying that was cut short
            else:
                _move(fs, live, old)
        _move(fs, new, live)
    for rel in plan["drop"]:
        live, old = at("", rel), at(f".__old-{ident}", rel)
        if fs.exists(live):
            _move(fs, live, old)
    fs.delete(at(f".__old-{ident}", ""), True)
    fs.delete(at(f".__staging-{ident}", ""), True)
    fs.delete(journal, False)


def _swap(spark: SparkSession, target: str, ident: str, replace: Sequence[str], drop: Sequence[str] = ()) -> None:
    """Write the journal of a finished staging folder and carry it out; "" is the whole target."""
    fs, part = _fs(spark, f"{target.rstrip('/')}.__part-{ident}")
    stream = fs.create(part, True)
    stream.write(bytearray(json.dumps({"replace": list(replace), "drop": list(drop)}).encode("utf-8")))
    stream.close()
    _, journal = _fs(spark, f"{target.rstrip('/')}.__swap-{ident}")
    _move(fs, part, journal)  # a journal is whole or not there
    _finish_swap(spark, target, ident)


def recover(spark: SparkSession, target: str) -> bool:
    """Put right what a lost driver left beside a dataset; run it before reading, with no writer at work.

    Swaps with a journal are finished, partition by partition; staging folders
    without one hold an unfinished write and are removed; old content without
    one goes back if the target is missing.  Returns whether the dataset changed.
    """
    target = target.rstrip("/")
    found = _beside(spark, target, "swap")
    for ident in found:
        _finish_swap(spark, target, ident)
    changed = bool(found)
    fs, t = _fs(spark, target)
    old = list(_beside(spark, target, "old").values())
    if not fs.exists(t) and len(old) == 1:
        _move(fs, spark._jvm.org.apache.hadoop.fs.Path(old[0]), t)
        changed = True
    for kind in ("staging", "touched", "part"):
        for path in _beside(spark, target, kind).values():
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    return changed


def _folders(spark: SparkSession, root: str, depth: int) -> list[str]:
    """Relative paths of the partition folders ``depth`` levels below a root."""
    fs, r = _fs(spark, root)
    if not fs.exists(r):
        return []
    level = [("", r)]
    for _ in range(depth):
        level = [(f"{rel}/{st.getPath().getName()}".lstrip("/"), st.getPath()) for rel, p in level
                 for st in fs.listStatus(p) if st.isDirectory() and "=" in str(st.getPath().getName())]
    return sorted(rel for rel, _ in level)


def partition_folders(df: DataFrame, path: str, partition_by: Sequence[str]) -> list[str]:
    """Relative folders, as the writer names them, of the partitions that a frame's rows lie in.

    One distinct of the partition columns; the driver gets one name per partition.
    """
    tmp = f"{path.rstrip('/')}.__touched-{uuid.uuid4().hex[:8]}"
    values = df.select(*partition_by).distinct().withColumn("_row", F.lit(1))
    values.write.partitionBy(*partition_by).parquet(tmp)
    try:
        return _folders(df.sparkSession, tmp, len(partition_by))
    finally:
        remove(df.sparkSession, tmp)


def read_partitions(spark: SparkSession, path: str, folders: Sequence[str], schema: T.StructType) -> DataFrame:
    """The rows of some partition folders of a dataset; no other folder is listed or read."""
    there = [f"{path.rstrip('/')}/{rel}" for rel in folders if path_exists(spark, f"{path.rstrip('/')}/{rel}")]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*there)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str], files: int | None = None,
                       touched: Sequence[str] = ()) -> list[str]:
    """Replace exactly the partitions present in ``df`` under a partitioned dataset.

    The new partitions are staged, then swapped in under a journal (see the
    module's text); partitions not in ``df`` are untouched, but those named in
    ``touched`` (relative folders) that have no rows any more are removed.  The
    driver only lists and moves folders -- one per touched partition.  Returns
    the replaced partition folders (relative).
    """
    spark = df.sparkSession
    ident = uuid.uuid4().hex[:8]
    staging = f"{path.rstrip('/')}.__staging-{ident}"
    _writer(df, "errorifexists", partition_by, files).parquet(staging)
    new = _folders(spark, staging, len(partition_by))
    _swap(spark, path, ident, new, sorted(set(touched) - set(new)))
    return new


def _writer(df: DataFrame, mode: str, partition_by: Sequence[str] | None, files: int | None):
    if files:
        # repartition keeps upstream parallelism; coalesce would narrow the stage.
        df = df.repartition(files, *partition_by) if partition_by else df.repartition(files)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    return w


def write_delimited(df: DataFrame, path: str, mode: str = "overwrite", delimiter: str = ",",
                    header: bool = True, quote: str = '"', null_value: str = "",
                    date_format: str = "yyyy-MM-dd", files: int | None = None) -> str:
    """Sequential-file target (B1/B2): delimited text, header, overwrite/append."""
    (_writer(df, mode, None, files).option("sep", delimiter).option("header", str(header).lower())
     .option("quote", quote).option("nullValue", null_value).option("dateFormat", date_format)
     .csv(path))
    return path


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] | None = None, files: int | None = None,
                  staged: bool = True, dynamic_partitions: bool = False) -> str:
    """Dataset target (B3/B4/B6): Parquet, optional partition columns and file count.

    ``overwrite`` is staged and swapped unless ``dynamic_partitions`` is set, in
    which case only the partitions present in ``df`` are replaced.
    """
    spark = df.sparkSession
    if mode == "overwrite" and dynamic_partitions:
        if not partition_by:
            raise ValueError("dynamic partition overwrite needs partition columns")
        (_writer(df, mode, partition_by, files)
         .option("partitionOverwriteMode", "dynamic").parquet(path))
        return path
    if mode == "overwrite" and staged:
        ident = uuid.uuid4().hex[:8]
        _writer(df, "errorifexists", partition_by, files).parquet(f"{path.rstrip('/')}.__staging-{ident}")
        _swap(spark, path, ident, [""])
        return path
    _writer(df, mode, partition_by, files).parquet(path)
    return path


def export_single(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> str:
    """Single-file export (B5). One task writes it, after the upstream ran in parallel: meant for small results."""
    write_delimited(df.repartition(1), path, delimiter=delimiter, header=header)
    return path


def save_table(df: DataFrame, name: str, mode: str = "overwrite",
               partition_by: Sequence[str] | None = None,
               bucket_by: tuple[int, Sequence[str]] | None = None, fmt: str = "parquet") -> str:
    """Catalog save (B7); bucketing co-locates later joins on the bucket key."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        n, cols = bucket_by
        w = w.bucketBy(n, *cols).sortBy(*cols)
    w.saveAsTable(name)
    return name


def conform(df: DataFrame, schema: T.StructType, safe: bool = True) -> DataFrame:
    """Typed output projection in declared order.

    With ``safe`` a value that does not fit the type becomes null (try_cast)
    instead of failing the task under ANSI mode.
    """
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        cols.append((c.try_cast(f.dataType) if safe else c.cast(f.dataType)).alias(f.name))
    return df.select(*cols)


def create_table(spark: SparkSession, name: str, schema: T.StructType,
                 partition_by: Sequence[str] | None = None, fmt: str = "parquet",
                 location: str | None = None) -> str:
    """DDL for a (partitioned) table."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    ddl = f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING {fmt}"
    if partition_by:
        ddl += " PARTITIONED BY (" + ", ".join(partition_by) + ")"
    if location:
        ddl += f" LOCATION '{location}'"
    spark.sql(ddl)
    return name


def analyze(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> None:
    """Table statistics for the cost-based optimizer."""
    if columns:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {', '.join(columns)}")
    else:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
