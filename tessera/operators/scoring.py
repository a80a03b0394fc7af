"""Bulk response scoring: the evaluator's seven metrics, the migration rubric,
the weighted overall score and the comparison reports, as Spark columns.

Input: ``responses(model, test_id, text[, elapsed_sec])`` and
``cases(test_id, category, query, expected_keywords array<string>,
must_have_code boolean, min_length int, difficulty)``.  Cases are joined to
responses (broadcast only after a size check); every metric is a native
expression over the response text (``contains``, ``rlike``,
``regexp_extract_all``, array set operations), so scoring stays inside
codegen.  The only Python is the syntax check of code blocks (``ast.parse``),
an Arrow-batched pandas UDF evaluated for migration cases only.
"""

from __future__ import annotations

import ast
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.util import fits_broadcast

# ---------------------------------------------------------------- fixed values
# Values the scores depend on; they must stay as written.

WEIGHTS = {
    "keyword_coverage": 0.10,
    "includes_code": 0.10,
    "well_structured": 0.05,
    "groundedness": 0.20,
    "relevance": 0.15,
    "coherence": 0.15,
    "category_specific": 0.25,
}
CODE_SIGNALS = ["```python", "```", "F.", "spark.", "df.", ".withColumn", ".filter", "import "]
HEADER_MARKS = ["##", "###", "**"]
BULLET_MARKS = ["- ", "* ", "1. "]
INVALID_API_PATTERNS = [r"\.to_delta\(", r"\.save_delta\(", r"spark\.write_table\(", r"df\.to_databricks\(",
                        r"F\.datastage\(", r"\.pandas_df\("]
KNOWLEDGE_CONCEPTS = ["delta lake", "databricks", "pyspark", "dataframe", "transformation", "partition",
                      "optimize", "merge", "medallion", "bronze", "silver", "gold", "datastage", "etl", "pipeline"]
KNOWLEDGE_PATTERNS = ["spark.read.format", "withColumn", 'format("delta")', "partitionBy", "mode(", "option("]
COMPONENTS = ["aggregator", "join", "lookup", "transformer", "filter", "sort", "funnel"]
EXPLANATION_MARKS = ["se usa para", "utiliza", "permite", "purpose", "function"]
PATTERN_TERMS = ["patrón", "pattern", "approach", "método"]
OPTIMIZATION_TERMS = ["partition", "cache", "broadcast", "optimize", "performance", "repartition"]
TROUBLE_MARKS = ["error", "problema", "solución", "resolver", "fix", "debug"]
BEST_PRACTICE_TERMS = ["best practice", "buena práctica", "recomendación", "delta", "medallion"]
INCOMPLETE_MARKS = ["...", "# TODO", "# FIXME", "pass  # incomplete"]
TRANSFORM_GROUPS = [["trim", "upper", "lower", "concat"], ["datediff", "date_add", "current_date", "to_date"],
                    ["isnull", "isnotnull", "coalesce", "when"], ["groupby", "agg", "sum", "count", "avg"]]
ERROR_PATTERNS = ["try:", "except", "raise", "assert", "logger", "logging"]
DOC_MARKS = ["# MAGIC %md", "##", '"""', "'''"]
OPT_KEYWORDS = ["OPTIMIZE", "Z-ORDER", "partition", "cache", "broadcast", "AQE"]
RUBRIC_PARTS = ["syntax_valid", "schema_fidelity", "transformations", "all_stages", "parameters", "validations",
                "delta_lake", "partitioning", "error_handling", "documentation", "notebook_structure"]
CATEGORIES = ["expression_translation", "full_migration", "component_explanation", "pattern_explanation",
              "optimization", "troubleshooting", "best_practices"]
MIGRATION_QUERY_MARKS = ["migra", "migrate"]
MIGRATION_CODE_MARKS = ["spark.read", "df.write", "```python"]
MIGRATION_STAGE_WORDS = ["read", "transform", "write", "validation"]
SOURCE_TOOL_TERMS = ["datastage", "basic", "transformer"]
SPARK_TERMS = ["pyspark", "f.", "spark"]
EXAMPLE_MARK = "ejemplo"
SOLUTION_MARK = "solución"
FENCE = "```"
COMPONENT_PURPOSE = ["propósito", "purpose", "qué hace", "what"]
COMPONENT_EQUIVALENT = ["pyspark", "spark", "equivalent", "equivalente"]
STEP_WORDS = ["paso", "step", "primero", "first"]
EXPRESSION_SOURCE = ["DataStage", "BASIC", "expression"]
SIMPLE_EXPRESSION_SOURCE = "DataStage"
EXPRESSION_TARGET = ["PySpark", "Spark", "F."]
SIMPLE_EXPRESSION_TARGET = "PySpark"
LIST_MARKS = ["- ", "* ", "1."]
DELTA_OPTIMIZE = "OPTIMIZE"
DELTA_MERGE = "merge"
NOTEBOOK_HEADER = "# Databricks notebook source"
NOTEBOOK_CELL_MARKS = ["# MAGIC %md", "# COMMAND"]
WIDGETS = "dbutils.widgets"
GLOBAL_NAMES = ["spark", "F", "dbutils"]
WRITE_MODE_MARKS = ["mode('overwrite')", "mode('append')"]
HEADER_OPTION = "option('header'"
SIMPLE_CODE_MARKS = ["```python", "F.", "spark.", "df."]
SIMPLE_STAGE_WORDS = ["read", "transform", "write", "validate"]
SIMPLE_PURPOSE = ["purpose", "propósito", "qué hace"]
SIMPLE_SPARK = ["pyspark", "spark"]
PARTITION_WRITE_MARK = "partitionBy"
PARTITION_TUNING_MARKS = ["repartition", "coalesce"]
READ_FILES_MARK = "spark.read"
READ_TABLE_MARK = "spark.table"
READ_MARKS = [READ_FILES_MARK, READ_TABLE_MARK]
WRITE_MARK = ".write."
DF_MARK = "df."
READ_RX = r"spark\.read|spark\.table"
WRITE_RX = r"\.write\."
TRANSFORM_RX = r"\.withColumn|\.select|\.filter"
FLOW_TRANSFORM_RX = r"\.withColumn|\.select|\.filter|\.groupBy"
VALIDATION_RX = r"(?i)isNotNull|isNull|filter.*!=|constraint"
CONTRADICTIONS = [(r"mode\(['\"]overwrite['\"]", r"mode\(['\"]append['\"]"),
                  (r"format\(['\"]delta['\"]", r"format\(['\"]parquet['\"]")]

# Regular expressions of the evaluator; (?U) gives Python's Unicode \s and \w.
PY_BLOCK = r"(?sU)```python\s*\n(.*?)```"
ANY_BLOCK = r"(?sU)```\s*\n(.*?)```"
QUOTED_NAME = r"['\"]([a-zA-Z_][a-zA-Z0-9_]*)['\"]"
ASSIGNMENT = r"(?U)(\w+)\s*=\s*(?:spark\.read|\w+\.withColumn|\w+\.filter)"
DF_USAGE = r"(?U)(?<!\w)(df\w*)\."
WITH_COLUMN_NAME = r"withColumn\(['\"]([^'\"]+)['\"]"
COL_NAME = r"F\.col\(['\"]([^'\"]+)['\"]"


# ---------------------------------------------------------------- helpers

def has(col: Column, s: str) -> Column:
    return col.contains(s)


def has_any(col: Column, items: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [has(col, s) for s in items])


def count_present(col: Column, items: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(has(col, s), 1).otherwise(0) for s in items])


def code_blocks(text: Column) -> Column:
    """Fenced code blocks (U5): python-tagged ones, then untagged-pattern ones,
    stripped, empty ones dropped -- the evaluator's extraction, including its
    re-matching of text between two fences by the generic pattern."""
    blocks = F.concat(F.regexp_extract_all(text, F.lit(PY_BLOCK), 1),
                      F.regexp_extract_all(text, F.lit(ANY_BLOCK), 1))
    stripped = F.transform(blocks, lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda b: b != "")


def distinct_matches(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))


@F.pandas_udf(T.IntegerType())
def valid_python_blocks(blocks: pd.Series) -> pd.Series:
    """Number of blocks that parse as Python (U4)."""
    def n_ok(arr) -> int:
        if arr is None:
            return 0
        k = 0
        for b in arr:
            try:
                ast.parse(b)
                k += 1
            except Exception:  # noqa: BLE001 - any parse failure counts as invalid
                pass
        return k
    return blocks.apply(n_ok).astype("int32")


def code_features(code: Column) -> dict[str, Column]:
    """Read/write/transform/validation/parameter flags and best-practice tags."""
    practices = F.array_compact(F.array(
        F.when(has_any(code, WRITE_MODE_MARKS), F.lit("explicit_write_mode")),
        F.when(has(code, HEADER_OPTION), F.lit("csv_headers")),
        F.when(has(code, PARTITION_WRITE_MARK), F.lit("partitioning")),
        F.when(has(code, "OPTIMIZE"), F.lit("optimization")),
        F.when(has_any(code, NOTEBOOK_CELL_MARKS), F.lit("notebook_structure"))))
    return {
        "columns": distinct_matches(code, QUOTED_NAME),
        "has_read": code.rlike(READ_RX),
        "has_write": code.rlike(WRITE_RX),
        "has_delta": has(F.lower(code), "delta"),
        "has_transforms": code.rlike(TRANSFORM_RX),
        "has_validation": code.rlike(VALIDATION_RX),
        "has_parameters": has(code, WIDGETS),
        "best_practices": practices,
    }


# ---------------------------------------------------------------- metrics

def _groundedness(text: Column, code: Column, has_code: Column, system_prompt: bool) -> Column:
    scope = F.when(has_code, code).otherwise(text)
    halluc = reduce(lambda a, b: a + b, [F.when(scope.rlike(p), 1).otherwise(0) for p in INVALID_API_PATTERNS])
    s = F.lit(1.0) - halluc * 0.2
    s = F.when(count_present(F.lower(text), KNOWLEDGE_CONCEPTS) >= 3, F.least(s + 0.1, F.lit(1.0))).otherwise(s)
    if system_prompt:
        s = F.when(count_present(scope, KNOWLEDGE_PATTERNS) >= 2, F.least(s + 0.1, F.lit(1.0))).otherwise(s)
    return F.greatest(s, F.lit(0.0))


def _relevance(text: Column, query: Column, cat: Column) -> Column:
    tl, ql = F.lower(text), F.lower(query)
    mig_pys = has_any(text, MIGRATION_CODE_MARKS)
    mig_stages = count_present(tl, MIGRATION_STAGE_WORDS)
    full_mig = F.when(~has_any(ql, MIGRATION_QUERY_MARKS), 0.0) \
        .when(mig_pys & (mig_stages >= 2), 1.0).when(mig_pys, 0.7).otherwise(0.3)
    ds, ps = has_any(tl, SOURCE_TOOL_TERMS), has_any(tl, SPARK_TERMS)
    expr = F.when(ds & ps, 1.0).when(ps, 0.7).otherwise(0.4)
    qcomp = F.coalesce(*[F.when(has(ql, c), F.lit(c)) for c in COMPONENTS])
    comp = F.when(qcomp.isNotNull() & tl.contains(qcomp),
                  F.when(has_any(tl, EXPLANATION_MARKS), 1.0).otherwise(0.6)).otherwise(0.3)
    pexp, pex = has_any(tl, PATTERN_TERMS), has(text, FENCE) | has(tl, EXAMPLE_MARK)
    patt = F.when(pexp & pex, 1.0).when(pexp, 0.7).otherwise(0.5)
    nopt = count_present(tl, OPTIMIZATION_TERMS)
    opt = F.when(nopt >= 3, 1.0).when(nopt >= 2, 0.7).otherwise(0.4)
    diag, sol = has_any(tl, TROUBLE_MARKS), has(text, FENCE) | has(tl, SOLUTION_MARK)
    trouble = F.when(diag & sol, 1.0).when(diag, 0.6).otherwise(0.3)
    nbp = count_present(tl, BEST_PRACTICE_TERMS)
    bp = F.when(nbp >= 2, 1.0).when(nbp >= 1, 0.7).otherwise(0.4)
    return (F.when(cat == "full_migration", full_mig).when(cat == "expression_translation", expr)
            .when(cat == "component_explanation", comp).when(cat == "pattern_explanation", patt)
            .when(cat == "optimization", opt).when(cat == "troubleshooting", trouble)
            .when(cat == "best_practices", bp).otherwise(0.7))


def _coherence(code: Column, has_code: Column) -> Column:
    """No upper cap: a fully coherent read->write flow scores 1.1, as in the evaluator."""
    has_read = code.rlike(READ_RX)
    has_tr = code.rlike(FLOW_TRANSFORM_RX)
    has_wr = code.rlike(WRITE_RX)
    read_pos = F.when(has(code, READ_FILES_MARK), F.instr(code, READ_FILES_MARK)).otherwise(F.instr(code, READ_TABLE_MARK))
    order_bonus = F.when(has_read & has_tr & has_wr & (read_pos < F.instr(code, WRITE_MARK)), 0.1).otherwise(0.0)
    undefined = F.array_except(F.array_except(distinct_matches(code, DF_USAGE), distinct_matches(code, ASSIGNMENT)),
                               F.array(*[F.lit(g) for g in GLOBAL_NAMES]))
    defined_cols, used_cols = distinct_matches(code, WITH_COLUMN_NAME), distinct_matches(code, COL_NAME)
    col_pen = F.when((F.size(used_cols) > 0) & (F.size(defined_cols) > 0) &
                     (F.size(F.array_except(used_cols, defined_cols)) > 5), 0.1).otherwise(0.0)
    contra = [F.when(code.rlike(p1) & code.rlike(p2), 0.1).otherwise(0.0) for p1, p2 in CONTRADICTIONS]
    # deductions applied one by one, in the evaluator's order (same float results)
    s = F.lit(1.0) + order_bonus
    s = s - F.size(undefined) * 0.15
    s = s - col_pen
    for c in contra:
        s = s - c
    for m in INCOMPLETE_MARKS:
        s = s - F.when(has(code, m), 0.1).otherwise(0.0)
    return F.when(~has_code, F.lit(0.8)).otherwise(F.greatest(s, F.lit(0.0)))


def rubric(text: Column, blocks: Column, code: Column, nvalid: Column | None = None,
           job_columns: Column | None = None, job_params: Column | None = None) -> Column:
    """Eleven-part migration rubric (40/30/20/10) as a struct of part scores.

    ``nvalid`` is the number of blocks that parse; computed here when not given.
    ``job_columns`` and ``job_params`` (arrays; null where a case has no job
    file, see ``inventory.job_schemas``) switch two parts to the file: schema
    fidelity becomes the share of its columns that the code names, parameters
    the share of its parameters that the code names.
    """
    feats = code_features(code)
    any_code = F.size(blocks) > 0
    nonempty = F.length(code) > 0
    if nvalid is None:
        # the UDF gets null (and returns at once) for rows without blocks
        nvalid = valid_python_blocks(F.when(any_code, blocks))
    syntax = F.when(any_code, nvalid / F.size(blocks) * 0.10).otherwise(0.0)
    ncols = F.size(feats["columns"])
    schema = F.when(nonempty & (ncols >= 5), 0.15).when(nonempty & (ncols >= 3), 0.10).otherwise(0.0)
    cl = F.lower(code)
    if job_columns is not None:
        named = F.size(F.array_intersect(job_columns, feats["columns"]))
        of_file = F.when(F.size(job_columns) > 0, named / F.size(job_columns) * 0.15).otherwise(0.0)
        schema = F.when(job_columns.isNotNull() & nonempty, of_file).otherwise(schema)
    ngroups = reduce(lambda a, b: a + b, [F.when(has_any(cl, g), 1).otherwise(0) for g in TRANSFORM_GROUPS])
    transforms = ngroups / F.lit(len(TRANSFORM_GROUPS)) * 0.15
    nstages = (feats["has_read"].cast("int") + feats["has_transforms"].cast("int") + feats["has_write"].cast("int"))
    stages = F.when(nonempty, nstages / F.lit(3.0) * 0.15).otherwise(0.0)
    params = F.when(has(code, WIDGETS), 0.07).otherwise(0.0)
    if job_params is not None:
        named = F.size(F.filter(job_params, lambda p: F.instr(cl, F.lower(p)) > 0))
        params = F.when(has(code, WIDGETS) & (F.coalesce(F.size(job_params), F.lit(0)) > 0),
                        named / F.size(job_params) * 0.10).otherwise(params)
    validations = F.when(nonempty & feats["has_validation"], 0.05).otherwise(0.0)
    delta = F.when(nonempty & feats["has_delta"],
                   F.when(has(code, DELTA_OPTIMIZE) | has(cl, DELTA_MERGE), 0.08).otherwise(0.05)).otherwise(0.0)
    partitioning = F.when(has(code, PARTITION_WRITE_MARK), 0.06) \
        .when(has_any(code, PARTITION_TUNING_MARKS), 0.03).otherwise(0.0)
    nerr = count_present(cl, ERROR_PATTERNS)
    errors = F.when(nerr >= 2, 0.06).when(nerr == 1, 0.03).otherwise(0.0)
    ndoc = count_present(text, DOC_MARKS)
    docs = F.when(ndoc >= 3, 0.05).when(ndoc >= 2, 0.03).when(ndoc >= 1, 0.02).otherwise(0.0)
    nb = F.when(has(text, NOTEBOOK_HEADER), 0.05) \
        .when(has_any(text, NOTEBOOK_CELL_MARKS), 0.03).otherwise(0.0)
    parts = [syntax, schema, transforms, stages, params, validations, delta, partitioning, errors, docs, nb]
    return F.struct(*[p.cast("double").alias(n) for p, n in zip(parts, RUBRIC_PARTS)])


def _category_specific(text: Column, cat: Column, min_len: Column, rub: Column) -> Column:
    tl = F.lower(text)
    n = F.length(text)
    expr = F.when(has_any(text, EXPRESSION_SOURCE) & has_any(text, EXPRESSION_TARGET),
                  1.0).otherwise(0.5)
    migration = F.least(reduce(lambda a, b: a + b, [rub[p] for p in RUBRIC_PARTS]), F.lit(1.0))
    comp = (F.when(has_any(tl, COMPONENT_PURPOSE), 0.4).otherwise(0.0) +
            F.when(has_any(tl, COMPONENT_EQUIVALENT), 0.3).otherwise(0.0) +
            F.when(has(text, FENCE) | has(text, DF_MARK), 0.3).otherwise(0.0))
    patt = (F.when(has(text, FENCE), 0.5).otherwise(0.0) +
            F.when(has_any(tl, STEP_WORDS), 0.25).otherwise(0.0) +
            F.when(n >= F.coalesce(min_len, F.lit(300)), 0.25).otherwise(0.0))
    opt = F.least(count_present(text, OPT_KEYWORDS) / F.lit(3.0), F.lit(1.0))
    other = F.when(has_any(text, LIST_MARKS) & (n >= 200), 1.0).otherwise(0.5)
    return (F.when(cat == "expression_translation", expr).when(cat == "full_migration", migration)
            .when(cat == "component_explanation", comp).when(cat == "pattern_explanation", patt)
            .when(cat == "optimization", opt).otherwise(other)).cast("double")


def score_responses(responses: DataFrame, cases: DataFrame, system_prompt: bool = True,
                    text_col: str = "text", id_cols: Sequence[str] = ()) -> DataFrame:
    """One row per (model, test_id): seven metrics, overall, rubric parts, band.

    Cases that name a job file carry its ``job_columns`` and ``job_params``.
    """
    c = cases if not fits_broadcast(cases) else F.broadcast(cases)
    j = responses.join(c, "test_id", "inner")
    text = F.col(text_col)
    kws = F.col("expected_keywords")
    j = j.withColumn("_blocks", code_blocks(text))
    j = j.withColumn("_code", F.array_join("_blocks", "\n")).withColumn("_has_code", F.size("_blocks") > 0)
    code, has_code = F.col("_code"), F.col("_has_code")
    found = F.size(F.filter(kws, lambda k: F.instr(F.lower(text), F.lower(k)) > 0))
    scores = {
        "keyword_coverage": F.when(F.coalesce(F.size(kws), F.lit(0)) > 0, found / F.size(kws)).otherwise(1.0),
        "includes_code": F.when(F.coalesce(F.col("must_have_code"), F.lit(False)),
                                F.when(has_any(text, CODE_SIGNALS), 1.0).otherwise(0.0)).otherwise(1.0),
        "well_structured": F.least(
            F.when(has_any(text, HEADER_MARKS), 0.4).otherwise(0.0) + F.when(has_any(text, BULLET_MARKS), 0.3)
            .otherwise(0.0) + F.when(F.length(text) >= F.coalesce(F.col("min_length"), F.lit(0)), 0.3).otherwise(0.0),
            F.lit(1.0)),
        "groundedness": _groundedness(text, code, has_code, system_prompt),
        "relevance": _relevance(text, F.coalesce(F.col("query"), F.lit("")), F.col("category")),
        "coherence": _coherence(code, has_code),
    }
    j = j.withColumns({k: v.cast("double") for k, v in scores.items()})
    is_mig = F.col("category") == "full_migration"
    # Python parses code blocks of migration cases only; other rows pass null
    j = j.withColumn("_nvalid", valid_python_blocks(F.when(is_mig & has_code, F.col("_blocks"))))
    j = j.withColumn("migration_details", F.when(is_mig, rubric(
        text, F.col("_blocks"), code, F.col("_nvalid"), *[F.col(c) for c in ("job_columns", "job_params") if c in j.columns])))
    j = j.withColumn("category_specific", _category_specific(text, F.col("category"), F.col("min_length"),
                                                             F.col("migration_details")))
    overall = reduce(lambda a, b: a + b, [F.col(k) * F.lit(w) for k, w in WEIGHTS.items()])
    j = j.withColumn("overall", overall)
    j = j.withColumn("band", F.when(F.col("overall") * 100 >= 70, "ok").when(F.col("overall") * 100 >= 50, "warn")
                     .otherwise("fail"))
    extra = [c for c in ("elapsed_sec", "output_tokens") if c in responses.columns]
    return j.select("model", "test_id", *id_cols, "category", "difficulty", "query",
                    F.length(text).alias("response_length"), *extra, *WEIGHTS, "overall", "band",
                    "migration_details")


# ---------------------------------------------------------------- reports

def model_report(scored: DataFrame) -> DataFrame:
    """Mean of each metric (and time, if present) per model, best model flagged."""
    aggs = [F.avg(k).alias(k) for k in [*WEIGHTS, "overall"]]
    if "elapsed_sec" in scored.columns:
        aggs.append(F.avg("elapsed_sec").alias("avg_time"))
    rep = scored.groupBy("model").agg(F.count(F.lit(1)).alias("cases"), *aggs)
    return _flag_best(rep)


def _flag_best(rep: DataFrame) -> DataFrame:
    """Mark the model(s) with the highest overall; the report has one row per
    model, so the unpartitioned window sees a handful of rows."""
    return rep.withColumn("is_best", F.col("overall") == F.max("overall").over(Window.partitionBy()))


def category_matrix(scored: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Mean overall per category x model, 0 where a model has no case."""
    g = scored.groupBy("category")
    p = g.pivot("model", list(models)) if models is not None else g.pivot("model")
    out = p.agg(F.avg("overall"))
    return out.fillna(0.0)


def quality_averages(scored: DataFrame) -> DataFrame:
    """Groundedness, relevance, coherence and their mean per model and
    category, plus a per-model total row (category 'TOTAL') (X11)."""
    m = ["groundedness", "relevance", "coherence"]
    per_cat = scored.groupBy("model", "category").agg(*[F.avg(k).alias(k) for k in m])
    total = scored.groupBy("model").agg(*[F.avg(k).alias(k) for k in m]).withColumn("category", F.lit("TOTAL"))
    out = per_cat.unionByName(total)
    return out.withColumn("quality_avg", (F.col(m[0]) + F.col(m[1]) + F.col(m[2])) / 3)


def rubric_averages(scored: DataFrame) -> DataFrame:
    """Each rubric part x100 averaged over migration cases, per model."""
    mig = scored.filter(F.col("migration_details").isNotNull())
    long = mig.select("model", F.inline(F.array(*[
        F.struct(F.lit(p).alias("part"), (F.col(f"migration_details.{p}") * 100).alias("pct"))
        for p in RUBRIC_PARTS])))
    return long.groupBy("model", "part").agg(F.avg("pct").alias("avg_pct"), F.count(F.lit(1)).alias("cases"))


def head_to_head(scored: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """Per metric: mean of two models, difference (b - a) and winner."""
    rep = model_report(scored).filter(F.col("model").isin(model_a, model_b))
    metrics = [*WEIGHTS, "overall"]
    long = rep.select("model", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"))
                                                  for k in metrics])))
    w = long.groupBy("metric").agg(F.max(F.when(F.col("model") == model_a, F.col("value"))).alias("score_a"),
                                   F.max(F.when(F.col("model") == model_b, F.col("value"))).alias("score_b"))
    return w.withColumns({"model_a": F.lit(model_a), "model_b": F.lit(model_b),
                          "difference": F.col("score_b") - F.col("score_a"),
                          "winner": F.when(F.col("score_b") > F.col("score_a"), F.lit(model_b))
                          .when(F.col("score_a") > F.col("score_b"), F.lit(model_a)).otherwise(F.lit("tie"))})


def simple_scores(responses: DataFrame, cases: DataFrame, text_col: str = "text",
                  id_cols: Sequence[str] = ()) -> DataFrame:
    """The guide's four-metric scorer with an unweighted mean."""
    c = cases if not fits_broadcast(cases) else F.broadcast(cases)
    j = responses.join(c, "test_id", "inner")
    text, tl, kws = F.col(text_col), F.lower(F.col(text_col)), F.col("expected_keywords")
    found = F.size(F.filter(kws, lambda k: F.instr(tl, F.lower(k)) > 0))
    cat = F.col("category")
    headers = has_any(text, HEADER_MARKS)
    stages = count_present(tl, SIMPLE_STAGE_WORDS)
    s = {
        "keyword_coverage": F.when(F.coalesce(F.size(kws), F.lit(0)) > 0, found / F.size(kws)).otherwise(0.0),
        "includes_code": F.when(has_any(text, SIMPLE_CODE_MARKS), 1.0).otherwise(0.0),
        "well_structured": F.when(headers & (F.length(text) > 200), 1.0).when(headers, 0.5).otherwise(0.0),
        "category_specific": (
            F.when(cat == "expression_translation",
                   F.when(has(text, SIMPLE_EXPRESSION_SOURCE) & has(text, SIMPLE_EXPRESSION_TARGET), 1.0).otherwise(0.0))
            .when(cat == "full_migration", stages / F.lit(4.0))
            .when(cat == "pattern_explanation",
                  F.when(has(text, FENCE) & (F.length(text) > 300), 1.0).otherwise(0.5))
            .otherwise(F.when(has_any(tl, SIMPLE_PURPOSE) &
                              has_any(tl, SIMPLE_SPARK), 1.0).otherwise(0.5))),
    }
    j = j.withColumns({k: v.cast("double") for k, v in s.items()})
    j = j.withColumn("overall", reduce(lambda a, b: a + b, [F.col(k) for k in s]) / F.lit(len(s)))
    return j.select("model", "test_id", *id_cols, "category", *s, "overall")


def simple_report(simple: DataFrame) -> DataFrame:
    """Per-model means of the simple scorer and the best model."""
    rep = simple.groupBy("model").agg(*[F.avg(k).alias(k) for k in
                                        ["overall", "keyword_coverage", "includes_code", "well_structured",
                                         "category_specific"]])
    return _flag_best(rep)
