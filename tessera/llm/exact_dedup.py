"""Exact dedup: group by a 128-bit content hash, keep one row of each group.

Plan: one pass computes the normalised text, its MD5 (128 bits) and SHA-256.
The rows are aggregated on (md5, sha256, normalised bytes): the aggregate's key
comparison is the byte comparison inside a hash group, and the partial
aggregate leaves one row per group and map task, so a group with a third of all
rows reaches the shuffle already reduced.  The survivors are written to the
shared folder and go back to the rows on the two digests, without text, in a
join whose two exchanges Spark can split for a hot group.  If two different texts ever shared both
digests, the join would be ambiguous and the job stops with an error instead of
merging them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, stored


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after all ASCII white space is deleted.  The
    row with the most code points in its original text stays; ties go to the
    smallest id.

    Defined cases: null text counts as empty; a null id loses every tie against
    a real one, and keep_id is null where all ids of a group are null; repeated
    rows (same id, same text) are each returned, counted in group_size, and
    share the fate of their id; an empty table gives an empty result; other
    columns are not read.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    base = (docs.select(F.col(id_col).alias("doc_id"), raw.alias("raw"))
            .select("doc_id", F.char_length("raw").alias("n"), F.regexp_replace("raw", SPACE, "").alias("norm"))
            .select("doc_id", "n", "norm", F.md5("norm").alias("md5"), F.sha2("norm", 256).alias("sha")))
    groups = (base.groupBy("md5", "sha", "norm")
              .agg(F.count(F.lit(1)).alias("size"),
                   F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"),
                                  F.col("doc_id").alias("id"))).alias("best")))
    keep = stored(groups.groupBy("md5", "sha")
            .agg(F.count(F.lit(1)).alias("texts"), F.max("size").alias("size"), F.min("best").alias("best"))
            .select("md5", "sha", "best",
                    F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("bigint"))
                    .otherwise(F.col("size")).alias("group_size")), "exact-groups")
    return (base.select("doc_id", "n", "md5", "sha").join(keep, ["md5", "sha"])
            .select("doc_id", F.col("best.id").alias("keep_id"), "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n") == -F.col("best.n"))).alias("kept"),
                    F.col("sha").alias("text_sha256")))


SQL = r"""
WITH base AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
win AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id
  FROM base)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM win
"""
