"""Ranges with explicit bounds: which range a row lies in, as an expression.

The bounds come from a bounded sample and stay in the JVM as a scalar subquery, so
they keep their types and every reader of a query uses the same ones.  A row
finds its range by halving (one comparison per step), so the expression does
not grow with the number of ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_PER_RANGE = 32


def halvings(most: int) -> list[int]:
    """The steps of a search by halving among ``most`` bounds."""
    return [1 << i for i in range(max(most, 1).bit_length() - 1, -1, -1)]


def count_reached(bounds: Column, most: int, reached: Callable[[Column], Column]) -> Column:
    """How many of an array's leading bounds (at most ``most``) are ``reached``.

    ``reached`` must hold for a leading part of the bounds only; a null counts as not reached.
    """
    steps = halvings(most)
    size = F.size(bounds)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when((at + step <= size) & reached(F.get(bounds, at + step - F.lit(1))), at + step).otherwise(at))


def directed(c: str | Column) -> tuple[Column, bool, bool]:
    """(value, ascending, nulls first) of a sort expression; a plain column ascends."""
    if isinstance(c, str):
        return F.col(c), True, True
    node = c._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return c, True, True
    value = type(c)(SparkSession.active()._jvm.org.apache.spark.sql.Column(node.child()))
    return value, "$Ascending$" in node.sortDirection().toString(), "$NullsFirst$" in node.nullOrdering().toString()


def column_name(c: Column) -> str | None:
    """The name in a sort expression that is a plain column; None for any other."""
    node = c._jc.node()
    if node.getClass().getSimpleName() == "SortOrder":
        node = node.child()
    if node.getClass().getSimpleName() != "UnresolvedAttribute" or node.nameParts().size() != 1:
        return None
    return node.nameParts().apply(0)


def _rising(v: Column, dtype: T.DataType, up: bool) -> list[Column] | None:
    """Fields whose rising order (nulls first) is the value's order; None if a falling one has no such fields."""
    if up:
        return [v]
    if isinstance(dtype, T.IntegralType):
        return [F.bitwise_not(v)]
    if isinstance(dtype, (T.FloatType, T.DoubleType)):  # NaN is the greatest value, and its negative too
        return [F.when(v.isNotNull(), ~F.isnan(v)), -v]
    if isinstance(dtype, T.DecimalType):
        return [-v]
    if isinstance(dtype, T.DateType):
        return [F.bitwise_not(F.unix_date(v))]
    if isinstance(dtype, T.BooleanType):
        return [~v]
    return None


def _place(df: DataFrame, order: Sequence[str | Column]) -> tuple[Column, list[bool]]:
    """A row's place in the order: a struct of structs, and whether each of these rises.

    Structs compare field by field with nulls first.  Most orders become one
    rising struct; only falling values that cannot be negated, like strings,
    start another.
    """
    parts = [directed(c) for c in order]
    types = [f.dataType for f in df.select(*[v.alias(f"v{i}") for i, (v, _, _) in enumerate(parts)]).schema.fields]
    runs: list[tuple[bool, list[Column]]] = []
    for (v, up, first), dtype in zip(parts, types):
        fields, rises = _rising(v, dtype, up), True
        if fields is None:
            fields, rises = [v], False
        if first != rises:
            fields = [v.isNull(), *fields]
        if not runs or runs[-1][0] != rises:
            runs.append((rises, []))
        runs[-1][1].extend(fields)
    return (F.struct(*[F.struct(*[c.alias(f"f{j}") for j, c in enumerate(fields)]).alias(f"r{i}") for i, (_, fields) in enumerate(runs)]),
            [rises for rises, _ in runs])


def _not_after(x: Column, y: Column, rising: Sequence[bool], equal: bool) -> Column:
    """Whether place x stands before place y, or with it if ``equal``."""
    out = None
    for i in range(len(rising) - 1, -1, -1):
        a, b = (x[f"r{i}"], y[f"r{i}"]) if rising[i] else (y[f"r{i}"], x[f"r{i}"])
        if out is None:
            out = (a <= b) if equal else (a < b)
        else:
            out = F.when(a < b, F.lit(True)).when(a == b, out).otherwise(F.lit(False))
    return out


def with_range(df: DataFrame, order: Sequence[str | Column], ranges: int, out: str) -> DataFrame:
    """Adds the row's range (0 to ``ranges`` - 1) in an order; every row of a range stands before all of the next.

    Equal rows lie in one range, whichever other range they fill.  The bounds
    are from the ``SAMPLE_PER_RANGE`` rows per range with the smallest hashes
    (one narrow pass); they decide where rows are handled, never a result.
    Each halving is a column of its own, so a row's search is compiled code.
    """
    if ranges < 2 or not order:
        return df.withColumn(out, F.lit(0))
    place, rising = _place(df, order)
    values = [directed(c)[0] for c in order]
    rows = df.select(F.xxhash64(*[x for v in values for x in (v.isNull(), v)]).alias("_h"), place.alias("_place"))
    sample = rows.orderBy("_h").limit(SAMPLE_PER_RANGE * ranges)
    compare = lambda x, y: (F.when(_not_after(x, y, rising, False), -1).when(_not_after(y, x, rising, False), 1).otherwise(0))
    b = F.col("b")
    every = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get(b, (i.cast("long") * F.size(b) / ranges).cast("int")))
    bounds = (sample.agg(F.array_sort(F.collect_list("_place"), compare).alias("b"))
              .select(F.when(F.size(b) > 0, every).otherwise(F.slice(b, 1, 0)).alias("b")))
    found = df.withColumns({"_bounds": bounds.scalar(), "_place": place, "_at": F.lit(0)})
    at, size = F.col("_at"), F.size("_bounds")
    for step in halvings(ranges - 1):
        reached = _not_after(F.get("_bounds", at + F.lit(step - 1)), F.col("_place"), rising, True)
        found = found.withColumn("_at", at + F.when((at + step <= size) & reached, F.lit(step)).otherwise(F.lit(0)))
    return found.withColumn(out, at).drop("_bounds", "_place", "_at")
