"""Keyed table changes on immutable files: upsert, update, delete, load branch.

Parquet tables cannot be changed in place (and MERGE INTO is refused for
them), so each operator returns the *new* table content as a DataFrame built
from one plan; ``sinks.files.write_dataset`` stages it and swaps it in.

Keys follow the rule of change capture everywhere: a null matches a null, so a row
with a null key is updated, deleted and reduced like any other.

``merge_into`` changes a stored table.  A partitioned table is read and rewritten only where
the changes touch it: the partitions of the changed rows, and those where the changed keys
live now (a semi join on keys alone), so a key that moves leaves its old partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path
from tessera.sinks.files import (
    partition_folders, path_exists, read_partitions, recover, remove, replace_partitions, write_dataset)


def one_per_key(df: DataFrame, keys: Sequence[str], latest_by: str | None = None) -> DataFrame:
    """One row per key, in one map-side combined aggregate.

    With ``latest_by`` the row with its greatest value stays (nulls smallest,
    ties by the other columns).  Without it a repeated key fails the job: which
    of its rows should win is not known.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if latest_by:
        first = [latest_by] if latest_by in rest else []
        order = first + [c for c in rest if c not in first]
        out = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in order])).alias("_row"))
        return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
    if not rest:
        return df.distinct()
    out = df.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_row"), F.count(F.lit(1)).alias("_rows"))
    shown = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    row = F.when(F.col("_rows") > 1, F.raise_error(F.concat(F.lit("repeated key: "), shown))
                 .cast(out.schema["_row"].dataType)).otherwise(F.col("_row"))
    out = out.withColumn("_row", row)
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys where null matches null; the right side's keys do not come out."""
    r = right.select(*[F.col(c).alias(f"_m_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda x, y: x & y, [left[k].eqNullSafe(r[f"_m_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"_m_{k}" for k in keys])


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], latest_by: str | None = None,
           within: Sequence[str] = ()) -> DataFrame:
    """Update matched keys, insert new ones (B15, H4 type 1).

    New table = target rows whose key is not in ``updates`` + all updates,
    reduced to one row per key (see ``one_per_key``; a repeated key without
    ``latest_by`` fails).  One anti join; the key-only projection of ``updates``
    is what gets shuffled or broadcast against target.

    ``within`` names columns of ``updates`` that tell several sets of changes
    apart: a key is then reduced (or refused) in each set, and a key that
    several sets change comes out with the row of each.
    """
    updates = one_per_key(updates, [*keys, *within], latest_by)
    keep = matched(target, updates.select(*keys), keys, "left_anti")
    return keep.unionByName(_as_target(updates, target))


def _as_target(updates: DataFrame, target: DataFrame) -> DataFrame:
    """Updates projected and cast to the target's columns and types."""
    return updates.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields])


def update_by_keys(target: DataFrame, updates: DataFrame, keys: Sequence[str],
                   cols: Sequence[str], latest_by: str | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Update ``cols`` of rows whose key matches; no inserts.

    ``updates`` is reduced to one row per key first (see ``one_per_key``), or
    one per key and set of changes (``within``, see ``upsert``): a row whose
    key several sets change comes out once for each.
    """
    types = {f.name: f.dataType for f in target.schema.fields}
    wanted = list(dict.fromkeys([*keys, *within, *cols, *([latest_by] if latest_by else [])]))
    updates = one_per_key(updates.select(*wanted), [*keys, *within], latest_by)
    u = updates.select(*keys, *[F.col(c).cast(types[c]).alias(f"_u_{c}") for c in cols]).withColumn("_hit", F.lit(True))
    j = matched(target, u, keys, "left")
    return j.select(*[F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in cols
                      else F.col(c) for c in target.columns])


def delete_by_keys(target: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete rows whose key appears in ``keys_df``."""
    return matched(target, keys_df.select(*keys), keys, "left_anti")


def scd1(dim: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Type-1 dimension: overwrite attributes in place (H4)."""
    return upsert(dim, source, keys)


def merge_into(spark: SparkSession, path: str, changed: DataFrame, keys: Sequence[str],
               combine: Callable[[DataFrame, DataFrame], DataFrame], partition_by: Sequence[str] | None = None,
               moving_keys: bool = True) -> None:
    """Write ``combine(current rows, changed)`` over the stored table at ``path``.

    With ``partition_by`` only the touched partitions are read and replaced.
    ``moving_keys=False`` saves the lookup of where the changed keys live now;
    it is right only where the partition columns are functions of the key.
    ``changed`` is read more than once: pass a stored frame (see ``batch_of``).
    """
    table = spark.read.parquet(path)
    if not partition_by:
        write_dataset(combine(table, changed), path)
        return
    named = list(dict.fromkeys([*keys, *partition_by]))
    types = {f.name: f.dataType for f in table.schema.fields}
    moved = changed.select(*[F.col(c).cast(types[c]).alias(c) for c in named])
    parts = moved.select(*partition_by)
    if moving_keys:
        parts = parts.union(matched(table.select(*named), moved.select(*keys), keys, "left_semi").select(*partition_by))
    folders = partition_folders(parts, path, partition_by)
    if folders:
        current = read_partitions(spark, path, folders, table.schema)
        replace_partitions(combine(current, changed), path, partition_by, touched=folders)


def batch_of(changed: DataFrame, observation: Observation | None = None, *measures) -> tuple[DataFrame, str]:
    """The changes of one load, written once to the shared folder: (frame, folder to remove)."""
    spark = changed.sparkSession
    path = scratch_path(spark, "load-batch")
    (changed.observe(observation, *measures) if observation else changed).write.parquet(path)
    return spark.read.schema(changed.schema).parquet(path), path


def load(spark: SparkSession, path: str, df: DataFrame, keys: Sequence[str] | None = None,
         load_type: str = "INCREMENTAL", partition_by: Sequence[str] | None = None,
         latest_by: str | None = None, moving_keys: bool = True) -> str:
    """First load vs incremental branch.

    FULL, or a target that does not exist yet: overwrite.  INCREMENTAL: upsert
    into the existing content, written to a staging folder and swapped in.
    On each way a key has one row: a repeated key in ``df`` fails unless
    ``latest_by`` says which row wins (a FULL load without keys takes all
    rows).  With ``partition_by`` an incremental load reads, merges and
    replaces only the partitions that it touches (see ``merge_into``).  What a
    lost driver left of an earlier load is put right first.
    """
    _write(spark, path, df, keys, load_type, partition_by, latest_by, moving_keys)
    return path


def _write(spark, path, df, keys, load_type, partition_by, latest_by, moving_keys, watermark_col=None) -> tuple[int, object]:
    """Load; returns rows read and their greatest watermark, as observed by the write (0 and None if not asked for)."""
    seen = Observation() if watermark_col else None
    measures = (F.count(F.lit(1)).alias("rows"), F.max(watermark_col).alias("high")) if watermark_col else ()
    recover(spark, path)
    if load_type.upper() == "FULL" or not path_exists(spark, path):
        rows = one_per_key(df, keys, latest_by) if keys else df
        write_dataset(rows.observe(seen, *measures) if seen else rows, path, partition_by=partition_by)
    else:
        if not keys:
            raise ValueError("incremental load needs keys")
        batch, folder = batch_of(df, seen, *measures)
        try:
            if not seen or seen.get["rows"]:
                merge_into(spark, path, batch, keys, lambda old, new: upsert(old, new, keys, latest_by), partition_by, moving_keys)
        finally:
            remove(spark, folder)
    return (seen.get["rows"], seen.get["high"]) if seen else (0, None)


def incremental_load(spark: SparkSession, path: str, source: DataFrame, watermark_col: str, last,
                     keys: Sequence[str], load_type: str = "INCREMENTAL",
                     partition_by: Sequence[str] | None = None, moving_keys: bool = True):
    """Incremental load (H10): rows of ``source`` above the last watermark are
    upserted into the table at ``path`` (FULL reloads everything).  Returns the
    new watermark value; the old one when nothing is new.

    The watermark is observed on the rows while they are written, so the table
    is not read again, and rows that reach the source while the load runs are
    above it and come with the next load.  Of a key's several rows the one
    with the greatest watermark wins, in a FULL and a first load too.  An
    incremental load cannot place rows without a watermark value: they are
    what ``without_watermark`` returns, for a reject output.
    """
    from tessera.operators.dimension import incremental
    full = load_type.upper() == "FULL"
    rows = source if full else incremental(source, watermark_col, last)[0]
    _, high = _write(spark, path, rows, keys, load_type, partition_by, watermark_col, moving_keys, watermark_col)
    return last if high is None else high


def without_watermark(source: DataFrame, watermark_col: str) -> DataFrame:
    """Rows that no incremental load can place, as their watermark is null (H10 rejects)."""
    return source.filter(F.col(watermark_col).isNull())
