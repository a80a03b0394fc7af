"""Join and lookup stages.

Strategy is left to Catalyst + AQE except where a side has a checked size
bound: ``lookup`` hints a broadcast only when the optimizer's estimate of the
reference (after projection to key + looked-up columns) is under the limit,
otherwise it is an ordinary shuffle join that AQE may still convert at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.util import fits_broadcast

KeySpec = Sequence[str | tuple[str, str]]

_HINTS = {"broadcast", "merge", "shuffle_merge", "shuffle_hash", "shuffle_replicate_nl"}


def _pairs(keys: KeySpec) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else (k[0], k[1]) for k in keys]


def _hinted(df: DataFrame, hint: str | None) -> DataFrame:
    if hint is None:
        return df
    if hint not in _HINTS:
        raise ValueError(f"unknown join hint {hint}")
    if hint == "broadcast":  # only below the checked size; Spark chooses beyond it
        return F.broadcast(df) if fits_broadcast(df) else df
    return df.hint("merge" if hint == "shuffle_merge" else hint)


def join_stage(left: DataFrame, right: DataFrame, keys: KeySpec, how: str = "inner",
               out_cols: Sequence[str | Column] | None = None, rejects: Sequence[str] = (),
               hint: str | None = None, null_safe: bool = False):
    """Join stage.

    ``keys`` are names present on both sides or (left, right) pairs.  With
    same-named keys the output carries one key column (coalesced for outer
    joins); with differently named keys the right key is dropped for inner and
    left joins.  ``rejects`` may contain "left"/"right": unmatched rows of that
    side are returned as extra outputs (anti joins), and the result is then a
    dict {"out", "left_rejects", "right_rejects"}.
    """
    pairs = _pairs(keys)
    same = all(lk == rk for lk, rk in pairs)
    r = _hinted(right, hint)
    if same and not null_safe:
        out = left.join(r, [lk for lk, _ in pairs], how)
    else:
        L, R = left.alias("_l"), r.alias("_r")
        cond = [(F.col(f"_l.{lk}").eqNullSafe(F.col(f"_r.{rk}")) if null_safe
                 else F.col(f"_l.{lk}") == F.col(f"_r.{rk}")) for lk, rk in pairs]
        out = L.join(R, reduce(lambda a, b: a & b, cond), how)
        if how in ("inner", "left", "left_outer", "cross"):
            drop_right = [rk for lk, rk in pairs]
            keep = [F.col(f"_l.{c}") for c in left.columns] + \
                   [F.col(f"_r.{c}") for c in right.columns if c not in drop_right and c not in left.columns]
            out = out.select(*keep)
        elif how in ("left_semi", "semi", "left_anti", "anti"):
            pass
        else:
            keep = [F.col(f"_l.{c}") for c in left.columns] + \
                   [F.col(f"_r.{c}") for c in right.columns if c not in left.columns]
            out = out.select(*keep)
    if out_cols is not None:
        out = out.select(*out_cols)
    if not rejects:
        return out
    res = {"out": out}
    lk = [lk for lk, _ in pairs]
    rk = [rk for _, rk in pairs]
    if "left" in rejects:
        res["left_rejects"] = left.join(right.select(*[F.col(b).alias(a) for a, b in zip(lk, rk)]),
                                        lk, "left_anti")
    if "right" in rejects:
        res["right_rejects"] = right.join(left.select(*[F.col(a).alias(b) for a, b in zip(lk, rk)]),
                                          rk, "left_anti")
    return res


def join_many(base: DataFrame, steps: Sequence[tuple[DataFrame, KeySpec, str]]) -> DataFrame:
    """Multi-input join chain (D5), folded left to right."""
    out = base
    for df, keys, how in steps:
        out = join_stage(out, df, keys, how)
    return out


class DuplicateReferenceKey(ValueError):
    pass


def lookup(main: DataFrame, ref: DataFrame, keys: KeySpec, cols: Sequence[str] | None = None,
           defaults: Mapping[str, object] | None = None, failure: str = "continue",
           broadcast: str | bool = "auto", match_col: str | None = None,
           dedup_ref: bool = False, check_unique: bool = False):
    """Lookup stage.

    Left join of ``main`` on the reference; ``defaults`` fill the looked-up
    columns **only for rows with no match** (a null stored in a matched
    reference row stays null).  ``failure``: "continue" keeps unmatched rows,
    "drop" removes them, "reject" returns ``(out, rejects)``.

    ``broadcast``: True forces the hint, False never hints, "auto" hints when
    the reference's estimated size is under ``tessera.broadcast.maxBytes``.
    ``dedup_ref`` keeps one deterministic row per key (smallest values) so the
    lookup cannot multiply main rows; ``check_unique`` instead raises
    ``DuplicateReferenceKey`` when a key repeats (one aggregate over the
    reference, at most one offending key read back).
    """
    pairs = _pairs(keys)
    ref_keys = [rk for _, rk in pairs]
    cols = [c for c in (cols or ref.columns) if c not in ref_keys]
    flag = match_col or "_lookup_hit"
    if check_unique:
        dup = (ref.groupBy(*ref_keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
               .limit(1).collect())
        if dup:
            raise DuplicateReferenceKey(f"reference key repeats: {dup[0].asDict()}")
    r = ref.select(*[F.col(rk).alias(lk) for lk, rk in pairs], *cols)
    if dedup_ref:
        main_keys = [lk for lk, _ in pairs]
        r = (r.groupBy(*main_keys).agg(F.min(F.struct(*cols)).alias("_v"))
             .select(*main_keys, *[F.col(f"_v.{c}").alias(c) for c in cols]))
    r = r.withColumn(flag, F.lit(True))
    use_bc = broadcast in (True, "auto") and fits_broadcast(r)
    if use_bc:
        r = F.broadcast(r)
    main_keys = [lk for lk, _ in pairs]
    clash = [c for c in cols if c in main.columns]
    m = main.drop(*clash) if clash else main
    how = "inner" if failure == "drop" else "left"
    out = m.join(r, main_keys, how)
    if defaults:
        out = out.withColumns({
            c: F.when(F.col(flag).isNull(), F.lit(v).cast(out.schema[c].dataType)).otherwise(F.col(c))
            for c, v in defaults.items()})
    out = out.select(*main.columns, *[c for c in cols if c not in main.columns], flag)
    if failure == "reject":
        good = out.filter(F.col(flag).isNotNull())
        bad = out.filter(F.col(flag).isNull()).select(*main.columns)
        return (good if match_col else good.drop(flag)), bad
    if match_col is None:
        out = out.drop(flag)
    else:
        out = out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return out


def hot_keys(df: DataFrame, keys: Sequence[str], min_share: float = 0.01) -> DataFrame:
    """Keys holding at least ``min_share`` of the rows.

    At most 1/min_share keys can qualify, so the result has a proven size
    bound and may be broadcast.  Costs one aggregate and one row count, both
    inside the plan.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be in (0, 1]")
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= F.greatest(F.lit(1), F.floor(total * F.lit(min_share)))).select(*keys))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                salts: int = 16, salt_keys: Sequence[str] | None = None,
                hot: DataFrame | None = None) -> DataFrame:
    """Join with a salted hot side.

    Rows of hot keys on the left (skewed) side get a salt from a hash of
    ``salt_keys`` (default: all columns; a row's place in the input would spread
    equal rows as well, but a task that is run again could place them
    differently and lose or repeat rows) and the right rows of those keys are replicated over the salts; join on
    key + salt, so a hot key is spread over ``salts`` tasks.  Every other key
    keeps salt 0 and is joined once.  ``hot`` is a frame of key values; by
    default the keys with at least 1/(4 * salts) of the left rows, at most
    4 * salts of them.  It is broadcast below the checked size, joined beyond
    it.  Exact for inner and left joins (left is the preserved side).
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError("salting is exact only when the salted side is the preserved side")
    spread = F.xxhash64(*[F.col(c) for c in (salt_keys or left.columns)])
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    bounded = hot is None
    h = (hot_keys(left, keys, 1.0 / (4 * salts)) if bounded else hot.select(*keys).distinct()).withColumn("_hot", F.lit(True))
    if bounded or fits_broadcast(h):
        h = F.broadcast(h)
    l2 = (left.withColumn("_spread", F.pmod(spread, F.lit(salts)).cast("int")).join(h, list(keys), "left")
          .withColumn("_salt", F.when(F.col("_hot"), F.col("_spread")).otherwise(F.lit(0))).drop("_hot", "_spread"))
    r2 = right.join(h, list(keys), "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    return l2.join(r2, [*keys, "_salt"], how).drop("_salt")
