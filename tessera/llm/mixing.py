"""Mixing sources to target weights.

Tokens are summed per source; each source's target is its weighted share of the
whole, stopped at ``cap`` times the source (the excess is reshared by weight
until no target is above its stop).  A source's rate is target / size; each
document is emitted floor(rate) times plus one copy with probability equal to
the fraction, drawn from a hash of a seed and the document id, so that reruns
and retried tasks agree.

Only per-source sums are shuffled (one row per source and map task), the levels
of the resharing are found with scalar aggregates over that small table, and
the plan goes back to the documents as a broadcast below a checked row count,
as a plain join (which Spark can split for a hot source) beyond it.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NOT_SPACE
from tessera.operators.numbering import global_row_number

SEED = "mix-1"
CAP = 3
WEIGHTS = (1, 2, 3)
BROADCAST_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("bigint")


def source_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> tuple[DataFrame, int]:
    """(source, source_size, target) and the number of sources; ``sized`` has source and size.

    Weights go to the sources by code point, null last, and repeat.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_row_number(sums, [F.col("source").asc_nulls_last()], "rank", 0)
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(F.col("rank") % len(weights) == i, F.lit(w)).otherwise(weight)
    plan = (ranked.select("source", "source_size", weight.cast("bigint").alias("weight"))
            .checkpoint(eager=True))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    total, n = plan.agg(F.sum(wide("source_size")), F.count(F.lit(1))).first()
    total, level = Decimal(total or 0), None
    stopped: Column = F.lit(False)
    while True:  # each round stops at least one more source, or ends
        held, weights_left, n_stopped = plan.agg(
            F.sum(F.when(stopped, wide("source_size") * cap)), F.sum(F.when(~stopped, F.col("weight"))),
            F.count(F.when(stopped, 1))).first()
        rest, left = total - Decimal(held or 0), int(weights_left or 0)
        if level == n_stopped or not left:
            break
        level = n_stopped
        stopped = stopped | (wide("weight") * F.lit(rest).cast("decimal(38,0)") > wide("source_size") * (cap * left))
    free = (F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(left))) if left else F.lit(0.0)
    target = F.when(stopped, (F.col("source_size") * cap).cast("double")).otherwise(free)
    return plan.select("source", "source_size", target.alias("target")), n


def _draw(doc_id: Column, text: Column, seed: str) -> Column:
    """Uniform in [0, 1) from the id; rows without an id are drawn by their text."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    hex13 = F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13)
    return F.conv(hex13, 16, 10).cast("double") / F.lit(float(1 << 52))


def _with_copies(docs: DataFrame, keep: list[str], weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """``keep`` as k0, k1, ..., with size, source_size, target and copies."""
    sized = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], F.col("source").alias("source"),
                        word_count(F.col("text")).alias("size"),
                        _draw(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    plan, n = source_plan(docs.select("source", word_count(F.col("text")).alias("size")), weights, cap)
    plan = plan.withColumnRenamed("source", "plan_source")
    if n <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.least(F.floor("rate") + (F.col("draw") < F.col("rate") - F.floor("rate")).cast("bigint"), F.lit(cap))
    return (sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
            .withColumn("rate", rate).withColumn("copies", copies))


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Defined cases: null text has size 0; a null source is a source of its own,
    sorted last; a source whose documents are all empty has target 0; a null id
    is drawn by its text; repeated rows draw alike; an empty table gives an
    empty result; other columns are not read.  No document is taken more than
    ``cap`` times.
    """
    return _with_copies(docs, ["doc_id"], weights, cap, seed).select(
        F.col("k0").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: each document (same columns), once per copy.

    Defined cases: as ``taken``; empty documents are drawn at their source's rate, which is 0
    where the whole source is empty; repeated rows are each emitted as often as they draw; extra
    columns, whatever their names, are kept; an empty table gives no rows.
    """
    m = _with_copies(docs, docs.columns, weights, cap, seed).filter(F.col("copies") > 0)
    m = m.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return m.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('mix-1:' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT)
           / CAST(4503599627370496 AS DOUBLE) AS draw
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS sz,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS HUGEINT) AS w
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY CAST(3 * sz AS DOUBLE) / w, source NULLS LAST) AS r,
         sum(sz) OVER () AS total, sum(w) OVER () AS weights FROM src),
levels AS (
  SELECT r, total - coalesce(sum(3 * sz) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         weights - coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wleft, sz, w
  FROM ranked),
cut AS (SELECT rest, wleft, r FROM levels WHERE w * rest <= 3 * sz * wleft ORDER BY r LIMIT 1),
plan AS (
  SELECT ranked.source, sz,
         CASE WHEN ranked.r < cut.r THEN CAST(3 * sz AS DOUBLE)
              ELSE CAST(w AS DOUBLE) * CAST(cut.rest AS DOUBLE) / CAST(cut.wleft AS DOUBLE) END AS target
  FROM ranked, cut),
rates AS (SELECT *, CASE WHEN sz > 0 THEN target / CAST(sz AS DOUBLE) ELSE 0.0 END AS rate FROM plan)
SELECT d.doc_id, d.size, CAST(p.sz AS BIGINT) AS source_size, p.target,
       CAST(d.size * least(floor(p.rate) + CASE WHEN d.draw < p.rate - floor(p.rate) THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM sized d JOIN rates p ON d.source IS NOT DISTINCT FROM p.source
"""
