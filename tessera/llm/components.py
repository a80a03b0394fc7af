"""Connected components of a link table, in Spark.

Alternating large-star and small-star steps: every round hooks the larger
neighbours of a node, then the smaller ones, onto the smallest node around it.
Rounds are written to the shared checkpoint folder; only a count and a checksum
of the links reach the driver.  A hub with very many links costs a partial
aggregate and a join whose hot side Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _hook(e: DataFrame, only_smaller: bool) -> DataFrame:
    """Links of each node onto the smallest node around it (u larger than v in the result)."""
    near = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if not only_smaller:
        near = near.union(near.select(F.col("v"), F.col("u")))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    tied = near.join(low, near.u == low.w)
    if only_smaller:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("w", "m"))
    else:
        out = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable; ``links`` has columns u and v.

    Nodes without a link to another node are not in the result.  Nulls, loops
    and repeated links are ignored.
    """
    e = (links.select("u", "v").filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
         .distinct().checkpoint(eager=True))
    state = _state(e)
    while state[0]:
        e = _hook(_hook(e, False), True).checkpoint(eager=True)
        now = _state(e)
        if now == state:
            break
        state = now
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.union(pairs.select(F.col("root").alias("node"), "root").distinct())
