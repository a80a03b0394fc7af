"""Reconciliation between a source and a target dataset.

Each comparison is one plan over both inputs (a tagged union aggregated once,
or one join), so both sides are scanned once per comparison.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.basic import row_text
from tessera.session import ensure_checkpoint_dir, scratch_path
from tessera.util import maybe_broadcast


def compare_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row counts of both sides and their difference (R1), in one job."""
    u = a.select(F.lit(0).alias("_side")).union(b.select(F.lit(1).alias("_side")))
    s = u.agg(F.count_if(F.col("_side") == 0).alias("source_count"),
              F.count_if(F.col("_side") == 1).alias("target_count"))
    return s.withColumns({"count_diff": F.col("target_count") - F.col("source_count"),
                          "counts_match": F.col("target_count") == F.col("source_count")})


def _places(df: DataFrame, col: str) -> int:
    """Decimal places that hold a column's values (floats: 6)."""
    t = df.schema[col].dataType
    if isinstance(t, T.DecimalType):
        return t.scale
    return 6 if isinstance(t, (T.DoubleType, T.FloatType)) else 0


def compare_sums(a: DataFrame, b: DataFrame, cols: Sequence[str], scale: int | None = None) -> DataFrame:
    """Sum of numeric columns on both sides (R2), as decimals so that money
    columns held as doubles add exactly.  The scale is the largest that the
    columns have, unless given; a smaller one rounds each value."""
    dt = T.DecimalType(28 if scale is None else 18,
                       max(_places(x, c) for x in (a, b) for c in cols) if scale is None else scale)
    ta = a.select(F.lit(0).alias("_side"), *[F.col(c).cast(dt).alias(c) for c in cols])
    tb = b.select(F.lit(1).alias("_side"), *[F.col(c).cast(dt).alias(c) for c in cols])
    u = ta.union(tb)
    s = u.agg(*[F.struct(F.lit(c).alias("column_name"),
                         F.sum(F.when(F.col("_side") == 0, F.col(c))).alias("source_sum"),
                         F.sum(F.when(F.col("_side") == 1, F.col(c))).alias("target_sum")).alias(c) for c in cols])
    out = s.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("r")).select("r.*")
    return out.withColumns({"sum_diff": F.col("target_sum") - F.col("source_sum"),
                            "sums_match": F.col("target_sum").eqNullSafe(F.col("source_sum"))})


def _typed_text(df: DataFrame, cols: Sequence[str]) -> Column:
    """A row's text that no other row has: numbers, dates and the like end with ';', other texts go behind their length."""
    plain = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    return F.concat(*[
        F.concat(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit(";")) if isinstance(df.schema[c].dataType, plain) else row_text(c)
        for c in cols])


def dataset_checksum(df: DataFrame, cols: Sequence[str] | None = None, algo: str = "xxhash64") -> DataFrame:
    """Order-independent, duplicate-sensitive checksum (R3): row count plus the
    sum of a per-row hash, as decimal(38,0) so the sum cannot overflow.

    ``xxhash64`` is the fast native hash, over each value and whether it is
    null (the function itself skips nulls); ``md5`` (first 60 bits of the md5
    of the row's unambiguous text) gives the same number in engines without
    xxhash.
    """
    names = list(cols or df.columns)
    cs = [F.col(c) for c in names]
    if algo == "xxhash64":
        h = F.xxhash64(*[x for c in cs for x in (c.isNull(), c)]).cast(T.DecimalType(38, 0))
    elif algo == "md5":
        h = F.conv(F.substring(F.md5(_typed_text(df, names)), 1, 15), 16, 10).cast(T.DecimalType(38, 0))
    else:
        raise ValueError(algo)
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.sum(h).alias("checksum"))


def compare_schemas(a: DataFrame, b: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """Columns missing on a side or with another type (R4); metadata only."""
    ta = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    tb = {f.name: f.dataType.simpleString() for f in b.schema.fields}
    out = []
    for name in sorted(set(ta) | set(tb)):
        if ta.get(name) != tb.get(name):
            out.append((name, ta.get(name), tb.get(name)))
    return out


def _digest(df: DataFrame, cols: Sequence[str]) -> Column:
    """128 bits of a row; nulls count, inside nested values too."""
    parts = []
    for c in cols:
        nested = isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType))
        v = F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"}) if nested else F.col(c)
        parts += [v.isNull(), v]
    return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2"))


REPEATS = 10_000  # copies of a row that one array holds on their way out


def signed_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference both ways (R5, S12): the columns, and ``balance``, how many more often a row is in ``a``.

    One union with +1 and -1 per row digest and one aggregate, combined on the
    mappers, so each input is read once and 16 bytes and a count per row are
    shuffled.  Only the digests with a nonzero balance then meet the rows again,
    which are counted by value.  The columns are matched by position, and nulls are equal.
    """
    spark, cols = a.sparkSession, a.columns
    ensure_checkpoint_dir(spark)
    b = b.toDF(*cols)
    side = lambda df, sign: df.select(_digest(df, cols).alias("_d"), F.lit(sign).alias("_s"))
    path = scratch_path(spark, "balance")
    (side(a, 1).union(side(b, -1)).groupBy("_d").agg(F.sum("_s").alias("_net")).filter("_net <> 0")
     .select("_d").write.parquet(path))
    odd = maybe_broadcast(spark.read.parquet(path).withColumnRenamed("_d", "_odd"))
    rows = lambda df, sign: (df.withColumn("_d", _digest(df, cols)).join(odd, F.col("_d") == F.col("_odd"), "left_semi")
                             .select(*cols, F.lit(sign).alias("_s")))
    out = rows(a, 1).union(rows(b, -1)).groupBy(*cols).agg(F.sum("_s").alias("balance"))
    return out.filter("balance <> 0")


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as a count says, a bounded array at a time."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / REPEATS)))
    out = df.withColumn("_times", times).withColumn("_block", blocks)
    left = F.least(F.lit(REPEATS).cast("long"), F.col("_times") - F.col("_block") * REPEATS)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), left))).drop("_times", "_block", "_copy")


def compare_rows(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None,
                 compare: Sequence[str] | None = None) -> DataFrame:
    """Differences between two datasets.

    Without keys: rows only in source / only in target, duplicates counted
    (see ``signed_difference``), with a ``side`` column.  With keys: one row per
    differing cell (keys, column_name, source_value, target_value), plus rows
    for keys present on one side only (column_name null).
    """
    if not keys:
        d = signed_difference(a, b).withColumn("side", F.when(F.col("balance") > 0, "source_only").otherwise("target_only"))
        return repeated(d, F.abs("balance")).drop("balance")
    compare = list(compare or [c for c in a.columns if c not in keys])
    A = a.select(*keys, *compare).withColumn("_a", F.lit(True)).alias("a")
    B = b.select(*keys, *compare).withColumn("_b", F.lit(True)).alias("b")
    cond = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    j = A.join(B, cond, "full_outer")
    kcols = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"),
                               F.col(f"a.{c}").cast("string").alias("source_value"),
                               F.col(f"b.{c}").cast("string").alias("target_value"),
                               (~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias("_d")) for c in compare])
    missing = F.array(F.struct(F.lit(None).cast("string").alias("column_name"),
                               F.when(F.col("a._a").isNull(), F.lit(None)).otherwise(F.lit("present")).cast("string")
                               .alias("source_value"),
                               F.when(F.col("b._b").isNull(), F.lit(None)).otherwise(F.lit("present")).cast("string")
                               .alias("target_value"),
                               F.lit(True).alias("_d")))
    both = F.col("a._a").isNotNull() & F.col("b._b").isNotNull()
    e = j.select(*kcols, F.explode(F.when(both, F.filter(cells, lambda s: s["_d"])).otherwise(missing)).alias("c"))
    return e.select(*keys, "c.column_name", "c.source_value", "c.target_value")
