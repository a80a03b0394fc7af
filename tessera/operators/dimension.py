"""Change capture, slowly changing dimensions, surrogate keys, incremental loads.

SCD type 2 plan (``scd2``):

* closed history rows (IsCurrent = 0) pass through with a filter only;
* only current rows (one per key) are full-outer-joined to the source
  snapshot (one row per key); every key yields at most two rows: the old
  current row (kept or expired) and a new version (I/U).  Only what changed is
  written to the checkpoint folder; unchanged rows pass from the dimension by
  an anti join on the changed keys.  An update's version
  is the current row's plus one; an insert of a key that only has closed
  history (a return after delete) takes the highest closed version plus one,
  from a hash aggregate of an integer over history rows -- history rows are
  never shuffled as whole rows;
* new versions get contiguous surrogate keys continuing from max(key) through
  the distributed numbering (no single-task window).

Comparisons are null-safe (a change to or from null is a change).  The run
clock is a parameter, so re-running with the same source is a no-op.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.basic import row_hash  # noqa: F401  (re-exported, H13)
from tessera.operators import numbering
from tessera.operators.merge import one_per_key
from tessera.session import ensure_checkpoint_dir


def _differs(a: str, b: str, cols: Sequence[str]) -> Column:
    if not cols:
        return F.lit(False)
    return reduce(lambda x, y: x | y, [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])


def change_capture(before: DataFrame, after: DataFrame, keys: Sequence[str], compare: Sequence[str],
                   emit: Sequence[str] = ("I", "U", "D", "C"), change_col: str = "change_type") -> DataFrame:
    """Compare two snapshots by key (H1): I (only after), D (only before),
    U (a compare column differs, null-safe), C (unchanged).

    Output: keys, the compare columns (after image; before image for D) and
    the change type.  One full outer join; both sides one row per key.
    """
    b = before.select(*keys, *compare).withColumn("_b", F.lit(True)).alias("b")
    a = after.select(*keys, *compare).withColumn("_a", F.lit(True)).alias("a")
    cond = reduce(lambda x, y: x & y, [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys])
    j = b.join(a, cond, "full_outer")
    ct = (F.when(F.col("b._b").isNull(), "I").when(F.col("a._a").isNull(), "D")
          .when(_differs("b", "a", compare), "U").otherwise("C"))
    out = j.select(
        *[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
        *[F.when(F.col("a._a").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in compare],
        ct.alias(change_col))
    if set(emit) != {"I", "U", "D", "C"}:
        out = out.filter(F.col(change_col).isin(*emit))
    return out


def scd2(dim: DataFrame, source: DataFrame, keys: Sequence[str], compare: Sequence[str],
         run_ts: str | _dt.datetime, key_col: str = "DimensionKey", track_deletes: bool = True,
         start_key: int | None = None, eff_col: str = "EffectiveDate", end_col: str = "EndDate",
         current_col: str = "IsCurrent", version_col: str = "RecordVersion",
         latest_by: str | None = None) -> dict[str, DataFrame]:
    """Type-2 load (H2, H3, G6, H11).  Returns {"dimension", "changes", "rejects"}.

    With ``latest_by`` (an ordering column such as a change timestamp) the
    source is first reduced to the latest row per key (a map-side combined
    aggregate); without it a repeated source key fails the job.  Rows with a
    null key go to ``rejects``, and dimension rows with one pass through
    unchanged.  Dimension rows whose current flag is not 1, null included, are
    history and pass through.  ``start_key`` defaults to max(existing key) + 1 (one scalar
    read).
    """
    ts = F.to_timestamp_ntz(F.lit(str(run_ts)))
    dim_cols = dim.columns
    null_key = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    rejects = source.filter(null_key)
    # new versions take every dimension attribute from the source; ``compare``
    # only decides whether a key changed
    meta = {key_col, eff_col, end_col, current_col, version_col, *keys}
    attrs = [c for c in dim_cols if c not in meta]
    missing = [c for c in compare if c not in source.columns]
    if missing:
        raise ValueError(f"compare columns missing from the source: {missing}")
    src = source.filter(~null_key)
    keep_cols = [c for c in attrs if c in source.columns]
    wanted = list(dict.fromkeys([*keys, *keep_cols, *([latest_by] if latest_by else [])]))
    src = one_per_key(src.select(*wanted), keys, latest_by)
    src = src.select(*keys, *[F.col(c) if c in source.columns else F.lit(None).alias(c) for c in attrs])

    # rows that no source row can meet pass through: closed ones, and those with a null key
    live = F.col(current_col).eqNullSafe(F.lit(1)) & ~null_key
    history = dim.filter(~live)
    # current rows (one per key by the dimension's invariant) carry their own
    # version; only keys without a current row need the highest closed
    # version -- a hash aggregate of an integer over history rows.
    cur = dim.filter(live).select(F.struct(*[F.col(c) for c in dim_cols]).alias("_cur"),
                                                     *[F.col(k).alias(f"_ck_{k}") for k in keys])
    s2 = src.withColumn("_s", F.lit(True))
    cond = reduce(lambda x, y: x & y, [F.col(f"_ck_{k}") == F.col(k) for k in keys])
    j = cur.join(s2, cond, "full_outer")
    j = j.select(*[F.coalesce(F.col(k), F.col(f"_ck_{k}")).alias(k) for k in keys], "_cur", "_s",
                 *[F.col(c).alias(f"_src_{c}") for c in attrs])
    has_cur, has_src = F.col("_cur").isNotNull(), F.col("_s").isNotNull()
    changed = reduce(lambda x, y: x | y,
                     [~F.col(f"_cur.{c}").eqNullSafe(F.col(f"_src_{c}")) for c in compare]) if compare else F.lit(False)
    ctype = (F.when(has_src & ~has_cur, "I")
             .when(has_cur & ~has_src, F.lit("D") if track_deletes else F.lit("C"))
             .when(has_cur & has_src & changed, "U")
             .when(has_cur & has_src, "C"))
    # what changed is written once; expired rows, new versions and change types all read it.
    # Unchanged rows come from the dimension itself, less the keys that changed.
    ensure_checkpoint_dir(dim.sparkSession)
    j = j.withColumn("_ct", ctype).filter(F.col("_ct").isin("I", "U", "D")).checkpoint(eager=True)
    ended = j.filter(F.col("_ct") != "I")
    same = dim.filter(live).join(ended.select(*keys), list(keys), "left_anti").select(*dim_cols)
    old = same.unionByName(ended.select(
        *[(ts if c == end_col else F.lit(0) if c == current_col else F.col(f"_cur.{c}")).alias(c) for c in dim_cols]))

    hist_max = history.groupBy(*keys).agg(F.max(version_col).alias("_hmax"))
    inserts = j.filter(F.col("_ct") == "I").join(hist_max, list(keys), "left") \
        .withColumn("_maxver", F.col("_hmax"))
    updates = j.filter(F.col("_ct") == "U").withColumn("_maxver", F.col(f"_cur.{version_col}"))
    j_new = inserts.drop("_hmax").unionByName(updates)
    new = j_new.select(
        *keys, *[F.col(f"_src_{c}").alias(c) for c in attrs],
        (F.coalesce(F.col("_maxver"), F.lit(0)) + 1).cast("int").alias(version_col))
    if start_key is None:
        start_key = numbering.next_key(dim, key_col)
    new = numbering.assign_keys(new, "_newkey", list(keys), start=start_key)
    types = {f.name: f.dataType for f in dim.schema.fields}
    new = new.select(*[
        (F.col("_newkey").cast(types[c]) if c == key_col else
         ts.cast(types[c]) if c == eff_col else
         F.lit(None).cast(types[c]) if c == end_col else
         F.lit(1).cast(types[c]) if c == current_col else
         F.col(c).cast(types[c])).alias(c) for c in dim_cols])

    changes = j.select(*keys, F.col("_ct").alias("change_type")).unionByName(
        same.select(*keys, F.lit("C").alias("change_type")))
    return {"dimension": history.unionByName(old).unionByName(new), "changes": changes, "rejects": rejects}


def with_scd_columns(df: DataFrame, run_ts, key_col: str | None = "DimensionKey",
                     order: Sequence[str] | None = None, start_key: int = 1) -> DataFrame:
    """Type-2 audit columns for a first load (H3): EffectiveDate = run clock,
    EndDate null, IsCurrent 1, RecordVersion 1, and contiguous surrogate keys
    over ``order`` (distributed numbering) when ``key_col`` is given."""
    ts = F.to_timestamp_ntz(F.lit(str(run_ts)))
    out = df.withColumns({"EffectiveDate": ts, "EndDate": F.lit(None).cast("timestamp_ntz"),
                          "IsCurrent": F.lit(1), "RecordVersion": F.lit(1)})
    if key_col:
        out = numbering.assign_keys(out, key_col, list(order or df.columns[:1]), start=start_key)
        out = out.select(F.col(key_col).cast("int").alias(key_col), *[c for c in out.columns if c != key_col])
    return out


class DimensionInvariantBroken(AssertionError):
    pass


def current_violations(dim: DataFrame, keys: Sequence[str], current_col: str = "IsCurrent") -> DataFrame:
    """Keys with more than one current row (H5)."""
    return (dim.filter(F.col(current_col) == 1).groupBy(*keys).agg(F.count(F.lit(1)).alias("current_rows"))
            .filter(F.col("current_rows") > 1))


def assert_single_current(dim: DataFrame, keys: Sequence[str], current_col: str = "IsCurrent") -> None:
    """Abort when a key is current more than once (H5); reads one row at most."""
    bad = current_violations(dim, keys, current_col).limit(1).collect()
    if bad:
        raise DimensionInvariantBroken(f"key current more than once: {bad[0].asDict()}")


def dimension_as_of(dim: DataFrame, ts, eff_col: str = "EffectiveDate", end_col: str = "EndDate") -> DataFrame:
    """The version valid at a point in time (H7)."""
    t = F.to_timestamp_ntz(F.lit(str(ts))) if not isinstance(ts, Column) else ts
    return dim.filter((F.col(eff_col) <= t) & (F.col(end_col).isNull() | (t < F.col(end_col))))


def change_feed(old: DataFrame, new: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Row-level change feed between two snapshots (H8).

    One row per insert/delete, two per update (pre- and post-image), with
    ``change_kind`` in insert, delete, update_preimage, update_postimage.
    """
    b = old.select(*keys, *compare).withColumn("_b", F.lit(True)).alias("b")
    a = new.select(*keys, *compare).withColumn("_a", F.lit(True)).alias("a")
    cond = reduce(lambda x, y: x & y, [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys])
    j = b.join(a, cond, "full_outer")
    kind = (F.when(F.col("b._b").isNull(), "I").when(F.col("a._a").isNull(), "D")
            .when(_differs("b", "a", compare), "U"))
    j = j.withColumn("_k", kind).filter(F.col("_k").isNotNull())
    before_img = F.struct(F.lit("before").alias("_img"), *[F.col(f"b.{c}").alias(c) for c in [*keys, *compare]])
    after_img = F.struct(F.lit("after").alias("_img"), *[F.col(f"a.{c}").alias(c) for c in [*keys, *compare]])
    imgs = (F.when(F.col("_k") == "I", F.array(after_img))
            .when(F.col("_k") == "D", F.array(before_img))
            .otherwise(F.array(before_img, after_img)))
    e = j.select(F.col("_k"), F.explode(imgs).alias("img"))
    label = (F.when(F.col("_k") == "I", "insert").when(F.col("_k") == "D", "delete")
             .when(F.col("img._img") == "before", "update_preimage").otherwise("update_postimage"))
    return e.select(*[F.col(f"img.{c}").alias(c) for c in [*keys, *compare]], label.alias("change_kind"))


def incremental(df: DataFrame, col: str, last) -> tuple[DataFrame, DataFrame]:
    """Rows above a watermark value and the new watermark (H9).

    Returns (new rows, one-row frame with ``new_watermark``; the old value is
    kept when no row is newer).
    """
    rows = df.filter(F.col(col) > F.lit(last)) if last is not None else df
    wm = rows.agg(F.max(col).alias("_m")).select(
        F.coalesce(F.col("_m"), F.lit(last).cast(df.schema[col].dataType)).alias("new_watermark"))
    return rows, wm
