"""Fuzzy matching (Match stage): all string pairs within edit distance k,
exactly, without comparing every pair.

Two exact blocking methods, chosen by string length ``L`` against a cut-off
``T`` (default depends on k):

* short strings (L <= T): deletion neighbourhoods.  If lev(a, b) <= k there is
  a string reachable from both by at most k deletions each (a substitution is
  a deletion on both sides, an insertion a deletion on the other).  Each
  string emits its distinct deletion variants; an equi-join on the variant
  gives candidates.  Variants keep at least L - k characters, so the join key
  is selective even for short words, and the fan-out sum_{d<=k} C(L, d) stays
  small because L <= T.
* long strings (L > T): segment pigeonhole (Pass-Join, Li et al., VLDB 2011).
  Cut a string of length L into k+1 segments; with at most k edits one
  segment appears unchanged in the other string, at a shift d with |d| <= i
  and |len(b) - L - d| <= k - i for segment i (position-aware selection).
  Strings emit (L, i, segment) and probes (L, i, substring); the segments of
  long strings are long, hence selective.

A pair with min length <= T (then both are <= T + k) is found by the first
method, a pair of two long strings by the second.  Candidates are
deduplicated and verified with the thresholded ``levenshtein``.  Everything
is native Spark (explode, substring, equi-joins).  The joins' exchanges are
Spark's own, so that adaptive execution can split a variant or segment that
very many words share; the distinct strings are stored once, so the text is
read and cut into words once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

# length cut-off between the two methods, by edit distance: deletion fan-out
# sum_{d<=k} C(L + k, d) stays small below it (67 variants for k=2, L=11) and the
# k+1 segments above it are at least 4 characters long for k=2
_DEFAULT_CUTOFF = {0: 1 << 30, 1: 48, 2: 11, 3: 10}


def default_cutoff(k: int) -> int:
    return _DEFAULT_CUTOFF.get(k, 2 * k + 2)


def _distinct(df: DataFrame, col: str, out: str, n: int) -> DataFrame:
    # spread over n tasks for the explodes that follow, and stored: four joins read it
    return (df.select(F.col(col).alias(out)).filter(F.col(out).isNotNull()).distinct().repartition(n, out)
            .withColumn(f"{out}_len", F.length(out)).checkpoint(eager=True))


def _seg_start(L, i, k: int):
    return F.floor(i * L / F.lit(k + 1)).cast("int")


def deletion_variants(df: DataFrame, col: str, k: int) -> DataFrame:
    """(col, v): every distinct string obtained from ``col`` by <= k deletions.

    All variants of a string are built in one projection with higher-order
    functions (one deletion per level, de-duplicated per row), so no shuffle
    is needed until the join on the variant.
    """
    level = F.array(F.col(col))
    everything = level
    for _ in range(k):
        level = F.array_distinct(F.flatten(F.transform(level, lambda s: F.transform(
            F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0))),
            lambda p: F.concat(F.substring(s, 1, p), F.substring(s, p + 2, 1 << 30))))))
        everything = F.concat(everything, level)
    return df.select(col, F.explode(F.array_distinct(everything)).alias("v"))


def _segment_candidates(a: DataFrame, b: DataFrame, k: int, cutoff: int, ordered: bool) -> DataFrame:
    segs = (a.filter(F.col("a_len") > cutoff)
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k))))
            .withColumn("s0", _seg_start(F.col("a_len"), F.col("i"), k))
            .withColumn("sl", _seg_start(F.col("a_len"), F.col("i") + 1, k) - F.col("s0"))
            .select("a", F.col("a_len").alias("L"), "i", F.expr("substring(a, s0 + 1, sl)").alias("seg")))
    delta = F.col("b_len") - F.col("L")
    lo = F.greatest(F.col("b_len") - k, F.lit(cutoff + 1), F.lit(k + 1))
    probes = (b.filter(F.col("b_len") + k > cutoff)
              .withColumn("L", F.explode(F.sequence(lo, F.greatest(lo, F.col("b_len") + k))))
              .filter(F.col("L") <= F.col("b_len") + k)
              .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k))))
              .withColumn("d_lo", F.greatest(-F.col("i"), delta - (F.lit(k) - F.col("i"))))
              .withColumn("d_hi", F.least(F.col("i"), delta + (F.lit(k) - F.col("i"))))
              .filter(F.col("d_lo") <= F.col("d_hi"))
              .withColumn("d", F.explode(F.sequence("d_lo", "d_hi")))
              .withColumn("s0", _seg_start(F.col("L"), F.col("i"), k))
              .withColumn("sl", _seg_start(F.col("L"), F.col("i") + 1, k) - F.col("s0"))
              .withColumn("p", F.col("s0") + F.col("d"))
              .filter((F.col("p") >= 0) & (F.col("p") + F.col("sl") <= F.col("b_len")))
              .select("b", "L", "i", F.expr("substring(b, p + 1, sl)").alias("seg"))
              .distinct())
    keys = ["L", "i", "seg"]
    j = segs.join(probes, keys).select("a", "b")
    return j.filter(F.col("a") < F.col("b")) if ordered else j


def _deletion_candidates(a: DataFrame, b: DataFrame, k: int, cutoff: int, ordered: bool) -> DataFrame:
    va = deletion_variants(a.filter(F.col("a_len") <= cutoff + k).select("a"), "a", k)
    vb = deletion_variants(b.filter(F.col("b_len") <= cutoff + k).select("b"), "b", k)
    j = va.join(vb, "v").select("a", "b")
    if ordered:
        j = j.filter(F.col("a") < F.col("b"))
    return j.filter(F.least(F.length("a"), F.length("b")) <= cutoff)


def fuzzy_pairs(left: DataFrame, left_col: str, right: DataFrame | None = None, right_col: str | None = None,
                max_dist: int = 2, out=("left_value", "right_value", "distance"),
                num_partitions: int | None = None, cutoff: int | None = None) -> DataFrame:
    """Pairs (left value, right value, distance) with distance <= max_dist.

    With ``right`` omitted the column is matched against itself and each
    unordered pair is returned once (left value < right value).
    """
    k = int(max_dist)
    # strings of length <= k cannot be cut into k+1 segments: the cut-off is at least k
    T = max(default_cutoff(k) if cutoff is None else int(cutoff), k)
    self_match = right is None
    ensure_checkpoint_dir(left.sparkSession)
    n = num_partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = _distinct(left, left_col, "a", n)
    b = a.withColumnsRenamed({"a": "b", "a_len": "b_len"}) if self_match else \
        _distinct(right, right_col or left_col, "b", n)
    lo, ro, do = out
    # both methods are symmetric: in a self-match every pair is found in both
    # orientations, so only a < b is kept inside the joins
    cand = (_deletion_candidates(a, b, k, T, self_match)
            .unionByName(_segment_candidates(a, b, k, T, self_match))
            .distinct())
    dist = F.levenshtein(F.col("a"), F.col("b"), k)
    return (cand.withColumn(do, dist).filter((F.col(do) >= 0) & (F.col(do) <= k))
            .select(F.col("a").alias(lo), F.col("b").alias(ro), F.col(do).cast("int").alias(do)))


def fuzzy_match(left: DataFrame, right: DataFrame, left_col: str, right_col: str | None = None,
                max_dist: int = 2) -> DataFrame:
    """Rows of ``left`` and ``right`` whose columns are within ``max_dist``.

    Works on the distinct values (``fuzzy_pairs``) and joins the rows back;
    right-side columns are prefixed with ``right_``.
    """
    rc = right_col or left_col
    pairs = fuzzy_pairs(left, left_col, right, rc, max_dist, ("_lv", "_rv", "match_distance"))
    r = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    out = left.join(pairs, F.col(left_col) == F.col("_lv")).join(r, F.col("_rv") == F.col(f"right_{rc}"))
    return out.drop("_lv", "_rv")
