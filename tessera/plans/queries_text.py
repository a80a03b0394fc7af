"""Checked queries for the bulk text jobs: code-block extraction, code
features, the syntax check, response scoring and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import scoring
from tessera.plans import scoring_job as job
from tessera.plans import scoring_oracle as orc
from tessera.plans.catalog import register


def _round(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


def _sql_round(sql: str, cols, n=6) -> str:
    return "SELECT * REPLACE (" + ", ".join(f"round({c}, {n}) AS {c}" for c in cols) + f") FROM ({sql})"


def _blocks(spark, d):
    r = job.responses(spark, d)
    return r.select("conv_id", "turn", scoring.code_blocks(F.col("text")).alias("blocks"))


register("u5_code_blocks", f"WITH {orc.CASES},{orc.RESPONSES},{orc.BLOCKS}\n"
         "SELECT conv_id, turn, blocks FROM bc")(_blocks)


def _features(spark, d):
    r = _blocks(spark, d).withColumn("code", F.array_join("blocks", "\n"))
    f = scoring.code_features(F.col("code"))
    return r.select("conv_id", "turn", F.array_sort(f["columns"]).alias("columns"),
                    *[f[k].alias(k) for k in ("has_read", "has_write", "has_delta", "has_transforms",
                                              "has_validation", "has_parameters")],
                    f["best_practices"].alias("best_practices"))


register("u6_code_features", f"WITH {orc.CASES},{orc.RESPONSES},{orc.BLOCKS}\n" + r"""
SELECT conv_id, turn,
       list_sort(list_distinct(regexp_extract_all(code, '[''"]([a-zA-Z_][a-zA-Z0-9_]*)[''"]', 1))) AS columns,
       regexp_matches(code, 'spark\.read|spark\.table') AS has_read, regexp_matches(code, '\.write\.') AS has_write,
       contains(lower(code), 'delta') AS has_delta, regexp_matches(code, '\.withColumn|\.select|\.filter') AS has_transforms,
       regexp_matches(code, '(?i)isNotNull|isNull|filter.*!=|constraint') AS has_validation,
       contains(code, 'dbutils.widgets') AS has_parameters,
       list_filter([CASE WHEN contains(code, 'mode(''overwrite'')') OR contains(code, 'mode(''append'')')
                         THEN 'explicit_write_mode' END,
                    CASE WHEN contains(code, 'option(''header''') THEN 'csv_headers' END,
                    CASE WHEN contains(code, 'partitionBy') THEN 'partitioning' END,
                    CASE WHEN contains(code, 'OPTIMIZE') THEN 'optimization' END,
                    CASE WHEN contains(code, '# MAGIC %md') OR contains(code, '# COMMAND') THEN 'notebook_structure' END],
                   lambda x: x IS NOT NULL) AS best_practices
FROM bc
""")(_features)


def _syntax(spark, d):
    b = _blocks(spark, d)
    return b.select("conv_id", "turn", F.size("blocks").alias("n_blocks"),
                    scoring.valid_python_blocks(F.col("blocks")).alias("n_valid"))


register("u4_python_syntax_check", f"WITH {orc.CASES},{orc.RESPONSES},{orc.BLOCKS}\n"
         "SELECT conv_id, turn, CAST(len(blocks) AS INTEGER) AS n_blocks, "
         "CAST(len(list_filter(blocks, lambda x: NOT contains(x, 'if ('))) AS INTEGER) AS n_valid FROM bc")(_syntax)

_METRICS = [*scoring.WEIGHTS, "overall"]

register("x1_x8_x13_response_scores", _sql_round(orc.ORACLE_SCORED, _METRICS))(
    lambda spark, d: _round(job.scored(spark, d).drop("migration_details"), _METRICS))

register("x9_model_report", _sql_round(orc.ORACLE_MODEL_REPORT, _METRICS))(
    lambda spark, d: _round(job.run(spark, d)["model_report"], _METRICS))

register("x10_category_model_matrix", _sql_round(orc.ORACLE_CATEGORY_MATRIX, ["m0", "m1", "m2"]))(
    lambda spark, d: _round(job.run(spark, d)["category_matrix"], ["m0", "m1", "m2"]))

_Q = ["groundedness", "relevance", "coherence", "quality_avg"]
register("x11_quality_averages", _sql_round(orc.ORACLE_QUALITY, _Q))(
    lambda spark, d: _round(job.run(spark, d)["quality"], _Q))

register("x12_rubric_averages", _sql_round(orc.ORACLE_RUBRIC, ["avg_pct"]))(
    lambda spark, d: _round(job.run(spark, d)["rubric"], ["avg_pct"]))

register("x14_head_to_head", _sql_round(orc.ORACLE_HEAD_TO_HEAD, ["score_a", "score_b", "difference"]))(
    lambda spark, d: _round(job.run(spark, d)["head_to_head"], ["score_a", "score_b", "difference"]))

_S = ["keyword_coverage", "includes_code", "well_structured", "category_specific", "overall"]
register("x15_simple_scores", _sql_round(orc.ORACLE_SIMPLE, _S))(
    lambda spark, d: _round(job.run(spark, d)["simple"], _S))

register("x15_simple_report", _sql_round(orc.ORACLE_SIMPLE_REPORT, _S))(
    lambda spark, d: _round(job.run(spark, d)["simple_report"], _S))
