"""Bulk response scoring over the conversation table.

Responses are the assistant turns of ``conversations``; model = ``m`` +
conv_id % 3, case = conv_id modulo the number of cases.  Each response gets a code block built from
its three most frequent words, of one of three kinds by conv_id % 4 (a read/transform/write
flow, a flow with a syntax error, a bare block) or none, so that the code
paths of the metrics are exercised by the table's data.  Cases are derived
from ``benchmark``: category by item_id % 7, expected keywords = the four
most frequent words of five or more letters in the item text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import scoring
from tessera.plans import fixtures


def with_top_words(df: DataFrame, words, k: int, out: str) -> DataFrame:
    """Add the k most frequent entries of an array column (ties alphabetical).

    Linear after one sort: the sorted words and the start positions of each
    run of equal words are materialised as columns (so lambdas read them
    instead of recomputing them), run lengths come from consecutive starts,
    and only the short list of (-count, word) pairs is sorted again.
    """
    srt, st = F.col("_tw_srt"), F.col("_tw_st")
    n = F.size(srt)
    df = df.withColumn("_tw_srt", F.array_sort(words))
    df = df.withColumn("_tw_st", F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == 1) | (
        F.try_element_at(srt, i) != F.try_element_at(srt, i - 1))))
    counted = F.transform(st, lambda s, j: F.struct(
        (-(F.coalesce(F.try_element_at(st, j + 2), n + 1) - s)).alias("c"), F.try_element_at(srt, s).alias("w")))
    ranked = F.array_sort(F.filter(counted, lambda t: t["w"].isNotNull()))
    return df.withColumn(out, F.transform(F.slice(ranked, 1, k), lambda t: t["w"])).drop("_tw_srt", "_tw_st")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fixtures.table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 5)
    # expected keywords: the four most frequent words of the whole text (ties alphabetical)
    b = with_top_words(b, words, 4, "_kw")
    keywords = F.col("_kw")
    return b.select(
        i.alias("test_id"),
        F.element_at(F.array(*[F.lit(c) for c in scoring.CATEGORIES]), (i % 7 + 1).cast("int")).alias("category"),
        F.col("text").alias("query"),
        keywords.alias("expected_keywords"),
        (i % 2 == 0).alias("must_have_code"),
        (F.lit(100) + (i % 5) * 50).cast("int").alias("min_length"),
        F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (i % 3 + 1).cast("int")).alias("difficulty"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    n_cases = fixtures.table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1))).scalar()
    k = F.col("conv_id")
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 3)
    # the three most frequent words of the whole response (ties alphabetical)
    c = with_top_words(c, words, 3, "_top")
    w = F.col("_top")
    w1 = F.coalesce(F.try_element_at(w, F.lit(1)), F.lit("src"))
    w2 = F.coalesce(F.try_element_at(w, F.lit(2)), F.lit("col"))
    w3 = F.coalesce(F.try_element_at(w, F.lit(3)), F.lit("key"))
    v = F.concat(F.lit("df"), k.cast("string"))
    flow = F.concat(
        F.lit("\n\n## Code\n```python\n"), v, F.lit(" = spark.read.table('"), w1, F.lit("')\n"),
        v, F.lit("b = "), v, F.lit(".withColumn('"), w2, F.lit("', F.trim(F.col('"), w3, F.lit("')))\n"),
        v, F.lit("b.filter(F.col('"), w2, F.lit("').isNotNull()).write.mode('overwrite').partitionBy('"),
        w3, F.lit("').save('/out')\n```"))
    broken = F.concat(F.lit("\n\n```python\nif ("), v, F.lit(" = spark.read.table('"), w1,
                      F.lit("')\n    df_x.show()\n```"))
    bare = F.concat(F.lit("\n\n```\n"), v, F.lit(".groupBy('"), w2, F.lit("').count()  # ...\n```"))
    code = (F.when(k % 4 == 0, flow).when(k % 4 == 1, broken).when(k % 4 == 2, bare).otherwise(F.lit("")))
    return c.select(F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"),
                    (k % n_cases).alias("test_id"), "conv_id", "turn",
                    F.concat(F.col("text"), code).alias("text"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_responses(responses(spark, sf_dir), cases(spark, sf_dir), id_cols=("conv_id", "turn"))


def run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    s = scored(spark, sf_dir)
    simple = scoring.simple_scores(responses(spark, sf_dir), cases(spark, sf_dir), id_cols=("conv_id", "turn"))
    return {
        "scored": s,
        "model_report": scoring.model_report(s),
        "category_matrix": scoring.category_matrix(s, ["m0", "m1", "m2"]),
        "quality": scoring.quality_averages(s),
        "rubric": scoring.rubric_averages(s),
        "head_to_head": scoring.head_to_head(s, "m0", "m1"),
        "simple": simple,
        "simple_report": scoring.simple_report(simple),
    }
