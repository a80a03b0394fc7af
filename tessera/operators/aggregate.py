"""Aggregator-stage operators.

Grouped aggregates run as partial (map-side) + final aggregation, so a hot
key is combined on every mapper before the shuffle; no operator here collects
a group into one buffer.  Exact medians and percentiles, of one or several
measures, come from counts by cell and one ranked pass over the values of the
cells that hold them (use ``approx=True`` for a bounded sketch).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir
from tessera.util import broadcast_limit

_SOUGHT_BYTES = 100  # a row of group, measure and cell in a broadcast


def agg_expr(fn: str, col: str | Column | None = None, approx: bool = False) -> Column:
    """Aggregate function by name."""
    c = F.col(col) if isinstance(col, str) else col
    fn = fn.lower()
    if fn == "count":
        return F.count(F.lit(1)) if c is None else F.count(c)
    if fn == "sum":
        return F.sum(c)
    if fn in ("avg", "mean"):
        return F.avg(c)
    if fn == "min":
        return F.min(c)
    if fn == "max":
        return F.max(c)
    if fn in ("count_if", "countif"):
        return F.count_if(c)
    if fn in ("stddev", "stddev_samp"):
        return F.stddev_samp(c)
    if fn == "stddev_pop":
        return F.stddev_pop(c)
    if fn == "median":
        if not approx:
            raise ValueError("an exact median is not one expression: use aggregate or exact_percentiles")
        return F.percentile_approx(c, 0.5, 10000)
    if fn in ("count_distinct", "distinct"):
        return F.approx_count_distinct(c) if approx else F.count_distinct(c)
    if fn == "first":
        raise ValueError("first needs an order: use min, max or ordering.dedup")
    raise ValueError(f"unknown aggregate {fn}")


def aggregate(df: DataFrame, keys: Sequence[str | Column],
              measures: Mapping[str, tuple[str, str | Column | None] | Column],
              having: Column | None = None, order: bool = False) -> DataFrame:
    """Grouped (or, with no keys, global) aggregation.

    ``measures`` maps output name to (function, column) or to a Column.
    ``having`` filters groups; ``order`` sorts the output by the keys.  Exact
    medians are taken of all their measures in one pass and joined to the other
    measures by the keys.
    """
    medians = {n: m[1] for n, m in measures.items()
               if not isinstance(m, Column) and m[0].lower() == "median" and not (len(m) > 2 and m[2])}
    exprs = [(m if isinstance(m, Column) else agg_expr(*m)).alias(name) for name, m in measures.items() if name not in medians]
    if medians:
        out = _with_medians(df, keys, exprs, medians, list(measures))
    else:
        out = df.groupBy(*keys).agg(*exprs) if keys else df.agg(*exprs)
    if having is not None:
        out = out.filter(having)
    if order and keys:
        out = out.orderBy(*keys)
    return out


def frequencies(df: DataFrame, col: str, name: str = "count", descending: bool = True) -> DataFrame:
    """Frequency table of a column (E13, H6), most frequent first."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    return out.orderBy(F.col(name).desc(), F.col(col).asc_nulls_last()) if descending else out


def distinct_count(df: DataFrame, cols: Sequence[str], approx: bool = False, name: str = "distinct_count") -> DataFrame:
    """Distinct values of a column set."""
    if approx:
        return df.agg(F.approx_count_distinct(F.struct(*cols)).alias(name))
    return df.select(*cols).distinct().agg(F.count(F.lit(1)).alias(name))


def pivot(df: DataFrame, group: Sequence[str], pivot_col: str, measure: Column,
          values: Sequence | None = None) -> DataFrame:
    """Rows to columns.

    Pass ``values`` for a fixed output schema; without it Spark runs one extra
    job to find the distinct pivot values.
    """
    g = df.groupBy(*group)
    p = g.pivot(pivot_col, list(values)) if values is not None else g.pivot(pivot_col)
    return p.agg(measure)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            name: str = "name", value: str = "value") -> DataFrame:
    """Columns to rows (E15); value columns must share a type."""
    return df.unpivot(list(ids), list(values), name, value)


def _with_medians(df: DataFrame, keys: Sequence[str | Column], exprs: Sequence[Column],
                  medians: Mapping[str, str | Column], names: Sequence[str]) -> DataFrame:
    key_names = df.select(*keys).columns
    by_name = {n: k for n, k in zip(key_names, keys) if isinstance(k, Column)}
    if keys:
        rest = df.withColumns(by_name).groupBy(*key_names)
        rest = rest.agg(*exprs) if exprs else rest.agg(F.count(F.lit(1))).select(*key_names)
    else:
        rest = df.agg(*(exprs or [F.count(F.lit(1)).alias("_rows")]))
    values = {f"_median_{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(medians.values())}
    long = df.select(*[by_name.get(n, F.col(n)).alias(n) for n in key_names], *[c.alias(n) for n, c in values.items()])
    found = exact_percentiles(long, key_names, dict(zip(medians, values)))
    if keys:
        return _null_safe_join(rest, found, key_names, "left").select(*key_names, *names)
    return rest.withColumns({n: found.select(n).scalar() for n in medians}).select(*names)


def exact_percentile(df: DataFrame, keys: Sequence[str], col: str, p: float = 0.5,
                     out: str = "percentile") -> DataFrame:
    """Exact continuous percentile of one measure per group (E8); see ``exact_percentiles``."""
    return exact_percentiles(df, keys, {out: col}, p)


_CELL = 64 * 128  # cells of about 1 in 128 of a value's size, narrower for small numbers and wider for huge ones


def _cell(v: Column) -> Column:
    """A whole number that never falls as a double rises (NaN last): its cell in a fixed division of all numbers.

    Only square roots, products and ``floor`` are taken, each of which keeps the order of numbers.
    """
    x = F.abs(v)
    for _ in range(6):  # the 64th root: at most 65,536
        x = F.sqrt(x)
    size = F.floor(F.least(x, F.lit(1e5)) * F.lit(float(_CELL))).cast("bigint")
    return F.when(F.isnan(v), F.lit(1 << 40)).when(v < 0, -size).otherwise(size)


def exact_percentiles(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str], p: float = 0.5) -> DataFrame:
    """Exact continuous percentiles of several measures per group (E8) without a per-group buffer.

    ``percentile``/``median`` keep every distinct value of a group in one
    aggregation buffer, which a hot group (or a global median) cannot afford.
    Here the values of all measures are counted per (group, measure, cell), a
    cell being a fixed interval of numbers; the counts tell in which one or two
    cells the values around rank p * (n - 1) lie.  Only the values of these
    cells are counted one by one -- combined map-side --, cumulated by one
    distributed running sum (cut into ranges, so a hot cell spans many tasks),
    and the two values are picked and interpolated:
    ``(hi_pos - pos) * v_lo + (pos - lo_pos) * v_hi``.  Nulls are ignored; a
    group without values has a null, as with ``percentile``.

    The rows are read twice; an input that is more than a scan is checkpointed first.
    """
    from tessera.operators import numbering
    keys, names = list(keys), list(measures)
    group = [*keys, "_m"]
    ensure_checkpoint_dir(df.sparkSession)
    pairs = F.array(*[F.struct(F.lit(i).alias("_m"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(measures.values())])
    values = (numbering.settled(df).select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p._m", "_p._v")
              .withColumn("_cell", _cell(F.col("_v"))))
    cells = values.groupBy(*group, "_cell").agg(F.count("_v").alias("_c")).checkpoint(eager=True)
    whole = Window.partitionBy(*group)
    upto = F.sum("_c").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    prev, cum = F.col("_cum") - F.col("_c"), F.col("_cum")
    lo, hi = F.floor("_pos"), F.ceil("_pos")
    sought = (cells.filter(F.col("_c") > 0).withColumns({"_cum": upto, "_pos": (F.sum("_c").over(whole) - 1) * F.lit(float(p))})
              .filter(((prev <= lo) & (lo < cum)) | ((prev <= hi) & (hi < cum)))
              .select(*group, "_cell", F.min(prev).over(whole).alias("_before"), "_pos").checkpoint(eager=True))
    counted = [*group, "_cell", "_v"]
    if sought.count() * _SOUGHT_BYTES <= broadcast_limit(df):
        near = values.join(F.broadcast(sought.select("_cell").distinct()), "_cell", "left_semi")  # one number: most rows end here
        picked = (_null_safe_join(near, F.broadcast(sought), [*group, "_cell"], "inner")
                  .groupBy(*counted, "_before", "_pos").agg(F.count(F.lit(1)).alias("_c")))
    else:
        picked = _null_safe_join(values.groupBy(*counted).agg(F.count("_v").alias("_c")), sought, [*group, "_cell"], "inner")
    picked = picked.select(*group, "_v", "_before", "_pos", "_c")
    j = numbering.running_sum(picked, group, ["_v"], "_c", "_cum").withColumn("_cum", F.col("_before") + F.col("_cum"))
    j = j.withColumns({"_lo": F.when((prev <= lo) & (lo < cum), F.col("_v")),
                       "_hi": F.when((prev <= hi) & (hi < cum), F.col("_v"))})
    r = j.groupBy(*group).agg(F.max("_lo").alias("_vlo"), F.max("_hi").alias("_vhi"), F.max("_pos").alias("_pos"))
    val = F.when(lo == hi, F.col("_vlo")).otherwise((hi - F.col("_pos")) * F.col("_vlo") +
                                                     (F.col("_pos") - lo) * F.col("_vhi"))
    r = r.withColumn("_val", val)
    wide = [F.max(F.when(F.col("_m") == i, F.col("_val"))).alias(n) for i, n in enumerate(names)]
    if not keys:
        return r.agg(*wide)
    r = r.groupBy(*keys).agg(*wide)
    # groups whose values are all null get null percentiles
    return _null_safe_join(cells.select(*keys).distinct(), r, keys, "left")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys where null matches null (a null group is a group)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])
