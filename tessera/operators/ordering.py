"""Sort, duplicate removal, funnel (union), difference and partitioning stages."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import numbering
from tessera.operators.reconcile import repeated, signed_difference
from tessera.util import fits_broadcast

SortKey = str | tuple[str | Column, str] | Column


_DIRECTED = re.compile(r"(ASC|DESC) NULLS (FIRST|LAST)'>$")


def sort_exprs(keys: Sequence[SortKey], nulls: str = "first") -> list[Column]:
    """(column, 'asc'|'desc') pairs to sort expressions with explicit null placement."""
    out = []
    for k in keys:
        if isinstance(k, Column):
            out.append(k)
            continue
        name, direction = (k, "asc") if isinstance(k, str) else k
        c = name if isinstance(name, Column) else F.col(name)
        if direction.lower().startswith("d"):
            out.append(c.desc_nulls_first() if nulls == "first" else c.desc_nulls_last())
        else:
            out.append(c.asc_nulls_first() if nulls == "first" else c.asc_nulls_last())
    return out


def sort_stage(df: DataFrame, keys: Sequence[SortKey], nulls: str = "first",
               stable: bool = False, key_change: str | None = None,
               change_keys: Sequence[str] | int | None = None) -> DataFrame:
    """Sort stage.

    A global sort is a range shuffle plus per-partition sorts.  ``stable``
    appends every other column as a tie-break, so equal keys come out in one
    fixed order on every run.  ``key_change`` adds a 1/0 column that is 1 on
    the first row of each run of equal sort keys (or of ``change_keys``, a
    leading subset of them by name, or how many lead).  A Column sort key counts by its value; one that
    already carries a direction has none, so with ``key_change`` pass it as
    (Column, direction).
    """
    exprs = sort_exprs(keys, nulls)
    out = df
    if key_change:
        names, temps = [], []
        for k in keys:
            c = k[0] if isinstance(k, tuple) else k
            if isinstance(c, Column):
                if isinstance(k, Column) and _DIRECTED.search(str(c)):
                    raise ValueError("with key_change give a Column sort key as (Column, direction)")
                temps.append(f"_kc_{len(temps)}")
                out = out.withColumn(temps[-1], c)
                c = temps[-1]
            names.append(c)
        group = names[:change_keys] if isinstance(change_keys, int) else list(change_keys or names)
        rest = [e for n, e in zip(names, exprs) if n not in group]
        out = numbering.is_first(out, group, rest, "_kc")
        out = out.withColumn(key_change, F.col("_kc").cast("int")).drop("_kc", *temps)
    if stable:
        exprs = numbering.total_order(df, [], exprs)
    return out.orderBy(*exprs)


def top(df: DataFrame, keys: Sequence[SortKey], k: int, nulls: str = "last") -> DataFrame:
    """First k rows in an order (S4): TakeOrderedAndProject, a bounded top-k per task."""
    return df.orderBy(*sort_exprs(keys, nulls)).limit(k)


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[SortKey] | None = None,
          keep: str = "first") -> DataFrame:
    """Remove duplicates by key.

    Without an order any row of each key is kept (``dropDuplicates``).  With an
    ascending order, keep first/last is one aggregate: min/max of a struct of
    (order columns, every other column), which is combined on the mappers, so
    a hot key never gathers on one task and ties resolve the same way each run.
    Mixed directions fall back to the distributed group numbering.  On both
    ways a null is the smallest value, whichever the direction.
    """
    if not order:
        return df.dropDuplicates(list(keys))
    pairs = [(k, "asc") if isinstance(k, str) else k for k in order]
    directions = {d.lower()[0] for _, d in pairs}
    order_names = [n for n, _ in pairs]
    if len(directions) == 1:
        descending = directions == {"d"}
        take_min = (keep == "first") != descending
        rest = [c for c in df.columns if c not in keys and c not in order_names]
        s = F.struct(*[F.col(c) for c in order_names + rest])
        agg = F.min(s) if take_min else F.max(s)
        out = df.groupBy(*keys).agg(agg.alias("_row"))
        return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
    if keep == "last":
        pairs = [(n, "asc" if d.lower().startswith("d") else "desc") for n, d in pairs]
    exprs = [F.col(n).desc_nulls_last() if d.lower().startswith("d") else F.col(n).asc_nulls_first() for n, d in pairs]
    seq = numbering.group_row_number(df, list(keys), exprs, "_seq")
    return seq.filter(F.col("_seq") == 1).drop("_seq")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Exact-row distinct."""
    return df.distinct()


def funnel(dfs: Sequence[DataFrame], mode: str = "continuous", by_name: bool = False,
           keys: Sequence[SortKey] | None = None, allow_missing: bool = True,
           ordinal_col: str | None = None) -> DataFrame:
    """Funnel stage.

    ``continuous``: union (works on streaming frames as well);
    ``sort``: union then sort by ``keys``;
    ``sequence``: all rows of input 1, then input 2, ...; order inside an input
    is ``keys`` (a sequence has no meaning for unordered input otherwise).
    """
    if not dfs:
        raise ValueError("funnel needs inputs")
    if mode == "sequence":
        tagged = [d.withColumn("_ord", F.lit(i)) for i, d in enumerate(dfs)]
    else:
        tagged = list(dfs)
    if by_name:
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), tagged)
    else:
        out = reduce(lambda a, b: a.union(b), tagged)
    if mode == "continuous":
        return out
    if mode == "sort":
        return out.orderBy(*sort_exprs(keys or []))
    if mode == "sequence":
        out = out.orderBy(F.col("_ord"), *sort_exprs(keys or []))
        return out.withColumnRenamed("_ord", ordinal_col) if ordinal_col else out.drop("_ord")
    raise ValueError(mode)


def difference(a: DataFrame, b: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Rows of a not in b (S12): EXCEPT DISTINCT, or EXCEPT ALL by the signed balance of row digests."""
    if not keep_duplicates:
        return a.subtract(b)
    return repeated(signed_difference(a, b).filter("balance > 0"), F.col("balance")).drop("balance")


def repartition_stage(df: DataFrame, method: str, n: int | None = None,
                      cols: Sequence[str] = ()) -> DataFrame:
    """Partitioning methods of the job language.

    auto/same: unchanged; hash: hash of cols; modulus: partition = key mod n;
    range: range bounds on cols; round_robin: even spread; entire: a full copy
    for every consumer task (a broadcast hint, to be used on a small side).
    """
    m = method.lower()
    if m in ("auto", "same"):
        return df
    if m == "hash":
        return df.repartition(n, *cols) if n else df.repartition(*cols)
    if m == "modulus":
        if not n or len(cols) != 1:
            raise ValueError("modulus needs n and one integer key")
        return df.repartitionById(n, F.pmod(F.col(cols[0]), F.lit(n)).cast("int"))
    if m == "range":
        return df.repartitionByRange(n, *cols) if n else df.repartitionByRange(*cols)
    if m in ("round_robin", "roundrobin"):
        return df.repartition(n)
    if m == "entire":
        if not fits_broadcast(df):
            raise ValueError("entire gives every task a full copy: the input is not known to be small enough")
        return F.broadcast(df)
    raise ValueError(method)
