"""DuckDB SQL for the scoring queries, written from the same fixed value lists.

Differences of the SQL engine are handled here, not in the Spark code: DuckDB
string literals have no escapes (newline is chr(10)), decimal literals are
cast to DOUBLE so the arithmetic matches, RE2 has no look-behind (a preceding
non-word character is matched instead), and Python's ``ast.parse`` has no SQL
form -- the oracle knows which generated block is the broken one ('if (').
"""

from __future__ import annotations

from tessera.operators.scoring import (BEST_PRACTICE_TERMS, BULLET_MARKS, CATEGORIES, CODE_SIGNALS, COMPONENTS,
                                       COMPONENT_EQUIVALENT, COMPONENT_PURPOSE, CONTRADICTIONS, DELTA_MERGE,
                                       DELTA_OPTIMIZE, DF_MARK, DOC_MARKS, ERROR_PATTERNS, EXAMPLE_MARK,
                                       EXPLANATION_MARKS, EXPRESSION_SOURCE, EXPRESSION_TARGET, FENCE, SIMPLE_EXPRESSION_TARGET,
                                       FLOW_TRANSFORM_RX, GLOBAL_NAMES, HEADER_MARKS, INCOMPLETE_MARKS,
                                       INVALID_API_PATTERNS, KNOWLEDGE_CONCEPTS, KNOWLEDGE_PATTERNS, LIST_MARKS,
                                       MIGRATION_CODE_MARKS, MIGRATION_QUERY_MARKS, MIGRATION_STAGE_WORDS,
                                       NOTEBOOK_CELL_MARKS, NOTEBOOK_HEADER, OPTIMIZATION_TERMS, OPT_KEYWORDS,
                                       PARTITION_TUNING_MARKS, PARTITION_WRITE_MARK, PATTERN_TERMS, READ_FILES_MARK,
                                       READ_RX, READ_TABLE_MARK, RUBRIC_PARTS, SIMPLE_CODE_MARKS,
                                       SIMPLE_EXPRESSION_SOURCE, SIMPLE_PURPOSE, SIMPLE_SPARK, SIMPLE_STAGE_WORDS,
                                       SOLUTION_MARK, SOURCE_TOOL_TERMS, SPARK_TERMS, STEP_WORDS, TRANSFORM_GROUPS,
                                       TRANSFORM_RX, TROUBLE_MARKS, VALIDATION_RX, WEIGHTS, WIDGETS, WRITE_MARK,
                                       WRITE_RX)


def lit(s: str) -> str:
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


def d(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def has(col: str, s: str) -> str:
    return f"contains({col}, {lit(s)})"


def has_any(col: str, items) -> str:
    return "(" + " OR ".join(has(col, s) for s in items) + ")"


def count_present(col: str, items) -> str:
    return "(" + " + ".join(f"(CASE WHEN {has(col, s)} THEN 1 ELSE 0 END)" for s in items) + ")"


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {lit(pattern)})"


def when(cond: str, a, b) -> str:
    return f"(CASE WHEN {cond} THEN {a} ELSE {b} END)"


def with_top_words(source: str, words: str, k: int, out: str) -> str:
    """SELECT adding the k most frequent entries of a list column (ties
    alphabetical); the sorted list and the run starts are computed once per row
    in nested selects, then run lengths are taken from consecutive starts."""
    counted = ("list_transform(_tw_st, lambda s, j: {'c': -(coalesce(_tw_st[j + 1], len(_tw_srt) + 1) - s), "
               "'w': _tw_srt[s]})")
    top = f"list_transform(list_slice(list_sort({counted}), 1, {k}), lambda t: t.w)"
    return (f"SELECT * EXCLUDE (_tw_srt, _tw_st), {top} AS {out} FROM ("
            f"SELECT *, list_filter(range(1, len(_tw_srt) + 1), lambda i: i = 1 OR _tw_srt[i] <> _tw_srt[i - 1]) "
            f"AS _tw_st FROM (SELECT *, list_sort({words}) AS _tw_srt FROM ({source})))")


_CASE_WORDS = ("SELECT *, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 5) "
               "AS ws FROM benchmark")

CASES = f"""
cases AS (
  SELECT item_id AS test_id, [{', '.join(lit(c) for c in CATEGORIES)}][item_id % 7 + 1] AS category,
         text AS query, kw AS expected_keywords,
         item_id % 2 = 0 AS must_have_code, CAST(100 + (item_id % 5) * 50 AS INTEGER) AS min_length,
         ['easy', 'medium', 'hard'][item_id % 3 + 1] AS difficulty
  FROM ({with_top_words(_CASE_WORDS, 'ws', 4, 'kw')}))"""

_V = "'df' || CAST(conv_id AS VARCHAR)"
_FLOW = (f"{lit(chr(10) * 2 + '## Code' + chr(10) + '```python' + chr(10))} || {_V} || ' = spark.read.table(''' || w1"
         f" || ''')' || chr(10) || {_V} || 'b = ' || {_V} || '.withColumn(''' || w2 || ''', F.trim(F.col(''' || w3"
         f" || ''')))' || chr(10) || {_V} || 'b.filter(F.col(''' || w2 || ''').isNotNull()).write.mode(''overwrite'')"
         f".partitionBy(''' || w3 || ''').save(''/out'')' || chr(10) || '```'")
_BROKEN = (f"{lit(chr(10) * 2 + '```python' + chr(10) + 'if (')} || {_V} || ' = spark.read.table(''' || w1 || ''')'"
           f" || chr(10) || '    df_x.show()' || chr(10) || '```'")
_BARE = (f"{lit(chr(10) * 2 + '```' + chr(10))} || {_V} || '.groupBy(''' || w2 || ''').count()  # ...'"
         f" || chr(10) || '```'")

RESPONSES = f"""
conv0 AS (
  SELECT *, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 3) AS words
  FROM conversations WHERE role = 'assistant'),
conv AS ({with_top_words('SELECT * FROM conv0', 'words', 3, 'w')}),
conv2 AS (SELECT *, coalesce(w[1], 'src') AS w1, coalesce(w[2], 'col') AS w2, coalesce(w[3], 'key') AS w3 FROM conv),
resp AS (
  SELECT 'm' || CAST(conv_id % 3 AS VARCHAR) AS model, conv_id % (SELECT count(*) FROM benchmark) AS test_id, conv_id, turn,
         text || CASE conv_id % 4 WHEN 0 THEN {_FLOW} WHEN 1 THEN {_BROKEN} WHEN 2 THEN {_BARE} ELSE '' END AS text
  FROM conv2)"""

_PY_BLOCK = r"(?s)```python\s*\n(.*?)```"
_ANY_BLOCK = r"(?s)```\s*\n(.*?)```"

BLOCKS = f"""
j AS (SELECT r.*, c.* EXCLUDE (test_id) FROM resp r JOIN cases c ON r.test_id = c.test_id),
b AS (
  SELECT *, list_filter(list_transform(list_concat(regexp_extract_all(text, {lit(_PY_BLOCK)}, 1),
                                                   regexp_extract_all(text, {lit(_ANY_BLOCK)}, 1)),
                                       lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS blocks
  FROM j),
bc AS (SELECT *, array_to_string(blocks, chr(10)) AS code, len(blocks) > 0 AS has_code, lower(text) AS tl,
              lower(coalesce(query, '')) AS ql FROM b),
bs AS (SELECT *, CASE WHEN has_code THEN code ELSE text END AS scope FROM bc)"""


def _undefined_count() -> str:
    used = r"list_distinct(regexp_extract_all(code, '(?:^|[^A-Za-z0-9_])(df[A-Za-z0-9_]*)\.', 1))"
    defined = r"list_distinct(regexp_extract_all(code, '([A-Za-z0-9_]+)\s*=\s*(?:spark\.read|[A-Za-z0-9_]+\.withColumn|[A-Za-z0-9_]+\.filter)', 1))"
    return (f"len(list_filter({used}, lambda x: NOT list_contains({defined}, x) AND x NOT IN ({', '.join(lit(g) for g in GLOBAL_NAMES)})))")


def _metrics_sql() -> str:
    kw = ("CASE WHEN coalesce(len(expected_keywords), 0) > 0 THEN "
          "CAST(len(list_filter(expected_keywords, lambda k: contains(tl, lower(k)))) AS DOUBLE) / len(expected_keywords) "
          "ELSE 1.0 END")
    inc = when("coalesce(must_have_code, false)", when(has_any("text", CODE_SIGNALS), d(1.0), d(0.0)), d(1.0))
    ws = (f"least({when(has_any('text', HEADER_MARKS), d(0.4), d(0.0))} + {when(has_any('text', BULLET_MARKS), d(0.3), d(0.0))}"
          f" + {when('length(text) >= coalesce(min_length, 0)', d(0.3), d(0.0))}, {d(1.0)})")
    halluc = "(" + " + ".join(f"(CASE WHEN {rx('scope', p)} THEN 1 ELSE 0 END)" for p in INVALID_API_PATTERNS) + ")"
    g0 = f"({d(1.0)} - {halluc} * {d(0.2)})"
    g1 = when(f"{count_present('tl', KNOWLEDGE_CONCEPTS)} >= 3", f"least({g0} + {d(0.1)}, {d(1.0)})", g0)
    g2 = when(f"{count_present('scope', KNOWLEDGE_PATTERNS)} >= 2", f"least({g1} + {d(0.1)}, {d(1.0)})", g1)
    ground = f"greatest({g2}, {d(0.0)})"

    mig_pys = has_any("text", MIGRATION_CODE_MARKS)
    mig_st = count_present("tl", MIGRATION_STAGE_WORDS)
    full_mig = (f"(CASE WHEN NOT {has_any('ql', MIGRATION_QUERY_MARKS)} THEN {d(0.0)} "
                f"WHEN {mig_pys} AND {mig_st} >= 2 THEN {d(1.0)} WHEN {mig_pys} THEN {d(0.7)} ELSE {d(0.3)} END)")
    ds, ps = has_any("tl", SOURCE_TOOL_TERMS), has_any("tl", SPARK_TERMS)
    expr = f"(CASE WHEN {ds} AND {ps} THEN {d(1.0)} WHEN {ps} THEN {d(0.7)} ELSE {d(0.4)} END)"
    qcomp = "(CASE " + " ".join(f"WHEN {has('ql', c)} THEN {lit(c)}" for c in COMPONENTS) + " END)"
    comp = (f"(CASE WHEN {qcomp} IS NOT NULL AND contains(tl, {qcomp}) THEN "
            f"{when(has_any('tl', EXPLANATION_MARKS), d(1.0), d(0.6))} ELSE {d(0.3)} END)")
    pexp, pex = has_any("tl", PATTERN_TERMS), f"({has('text', FENCE)} OR {has('tl', EXAMPLE_MARK)})"
    patt = f"(CASE WHEN {pexp} AND {pex} THEN {d(1.0)} WHEN {pexp} THEN {d(0.7)} ELSE {d(0.5)} END)"
    nopt = count_present("tl", OPTIMIZATION_TERMS)
    opt = f"(CASE WHEN {nopt} >= 3 THEN {d(1.0)} WHEN {nopt} >= 2 THEN {d(0.7)} ELSE {d(0.4)} END)"
    diag, sol = has_any("tl", TROUBLE_MARKS), f"({has('text', FENCE)} OR {has('tl', SOLUTION_MARK)})"
    trouble = f"(CASE WHEN {diag} AND {sol} THEN {d(1.0)} WHEN {diag} THEN {d(0.6)} ELSE {d(0.3)} END)"
    nbp = count_present("tl", BEST_PRACTICE_TERMS)
    bp = f"(CASE WHEN {nbp} >= 2 THEN {d(1.0)} WHEN {nbp} >= 1 THEN {d(0.7)} ELSE {d(0.4)} END)"
    relevance = (f"(CASE category WHEN 'full_migration' THEN {full_mig} WHEN 'expression_translation' THEN {expr} "
                 f"WHEN 'component_explanation' THEN {comp} WHEN 'pattern_explanation' THEN {patt} "
                 f"WHEN 'optimization' THEN {opt} WHEN 'troubleshooting' THEN {trouble} "
                 f"WHEN 'best_practices' THEN {bp} ELSE {d(0.7)} END)")

    has_read = rx("code", READ_RX)
    has_tr = rx("code", FLOW_TRANSFORM_RX)
    has_wr = rx("code", WRITE_RX)
    read_pos = (f"(CASE WHEN {has('code', READ_FILES_MARK)} THEN instr(code, {lit(READ_FILES_MARK)}) "
                f"ELSE instr(code, {lit(READ_TABLE_MARK)}) END)")
    bonus = when(f"{has_read} AND {has_tr} AND {has_wr} AND {read_pos} < instr(code, {lit(WRITE_MARK)})", d(0.1), d(0.0))
    dcols = r"list_distinct(regexp_extract_all(code, 'withColumn\([''\"]([^''\"]+)[''\"]', 1))"
    ucols = r"list_distinct(regexp_extract_all(code, 'F\.col\([''\"]([^''\"]+)[''\"]', 1))"
    colpen = when(f"len({ucols}) > 0 AND len({dcols}) > 0 AND len(list_filter({ucols}, lambda x: NOT list_contains({dcols}, x))) > 5",
                  d(0.1), d(0.0))
    s = f"({d(1.0)} + {bonus})"
    s = f"({s} - {_undefined_count()} * {d(0.15)})"
    s = f"({s} - {colpen})"
    for p1, p2 in CONTRADICTIONS:
        s = f"({s} - {when(rx('code', p1) + ' AND ' + rx('code', p2), d(0.1), d(0.0))})"
    for m in INCOMPLETE_MARKS:
        s = f"({s} - {when(has('code', m), d(0.1), d(0.0))})"
    coherence = when("NOT has_code", d(0.8), f"greatest({s}, {d(0.0)})")
    return (f"CAST({kw} AS DOUBLE) AS keyword_coverage, {inc} AS includes_code, {ws} AS well_structured, "
            f"{ground} AS groundedness, {relevance} AS relevance, {coherence} AS coherence")


def _rubric_sql() -> str:
    nonempty = "length(code) > 0"
    nvalid = "len(list_filter(blocks, lambda x: NOT contains(x, 'if (')))"
    syntax = when("has_code", f"CAST({nvalid} AS DOUBLE) / len(blocks) * {d(0.10)}", d(0.0))
    ncols = "len(list_distinct(regexp_extract_all(code, '[''\"]([a-zA-Z_][a-zA-Z0-9_]*)[''\"]', 1)))"
    schema = f"(CASE WHEN {nonempty} AND {ncols} >= 5 THEN {d(0.15)} WHEN {nonempty} AND {ncols} >= 3 THEN {d(0.10)} ELSE {d(0.0)} END)"
    ngroups = "(" + " + ".join(f"(CASE WHEN {has_any('lower(code)', g)} THEN 1 ELSE 0 END)" for g in TRANSFORM_GROUPS) + ")"
    transforms = f"CAST({ngroups} AS DOUBLE) / {len(TRANSFORM_GROUPS)} * {d(0.15)}"
    nst = (f"(CAST({rx('code', READ_RX)} AS INTEGER) + "
           f"CAST({rx('code', TRANSFORM_RX)} AS INTEGER) + CAST({rx('code', WRITE_RX)} AS INTEGER))")
    stages = when(nonempty, f"{nst} / {d(3.0)} * {d(0.15)}", d(0.0))
    params = when(has("code", WIDGETS), d(0.07), d(0.0))
    validation = when(f"{nonempty} AND {rx('code', VALIDATION_RX)}", d(0.05), d(0.0))
    delta = when(f"{nonempty} AND contains(lower(code), 'delta')",
                 when(f"{has('code', DELTA_OPTIMIZE)} OR {has('lower(code)', DELTA_MERGE)}", d(0.08), d(0.05)),
                 d(0.0))
    part = (f"(CASE WHEN {has('code', PARTITION_WRITE_MARK)} THEN {d(0.06)} WHEN {has_any('code', PARTITION_TUNING_MARKS)} "
            f"THEN {d(0.03)} ELSE {d(0.0)} END)")
    nerr = count_present("lower(code)", ERROR_PATTERNS)
    errs = f"(CASE WHEN {nerr} >= 2 THEN {d(0.06)} WHEN {nerr} = 1 THEN {d(0.03)} ELSE {d(0.0)} END)"
    ndoc = count_present("text", DOC_MARKS)
    docs = (f"(CASE WHEN {ndoc} >= 3 THEN {d(0.05)} WHEN {ndoc} >= 2 THEN {d(0.03)} WHEN {ndoc} >= 1 THEN {d(0.02)} "
            f"ELSE {d(0.0)} END)")
    nb = (f"(CASE WHEN {has('text', NOTEBOOK_HEADER)} THEN {d(0.05)} WHEN {has_any('text', NOTEBOOK_CELL_MARKS)} "
          f"THEN {d(0.03)} ELSE {d(0.0)} END)")
    parts = [syntax, schema, transforms, stages, params, validation, delta, part, errs, docs, nb]
    return ", ".join(f"{p} AS r_{n}" for p, n in zip(parts, RUBRIC_PARTS))


def _category_sql() -> str:
    expr = when(f"{has_any('text', EXPRESSION_SOURCE)} AND {has_any('text', EXPRESSION_TARGET)}", d(1.0), d(0.5))
    mig = "least(" + " + ".join(f"r_{p}" for p in RUBRIC_PARTS) + f", {d(1.0)})"
    comp = (f"({when(has_any('tl', COMPONENT_PURPOSE), d(0.4), d(0.0))} + "
            f"{when(has_any('tl', COMPONENT_EQUIVALENT), d(0.3), d(0.0))} + "
            f"{when(has('text', FENCE) + ' OR ' + has('text', DF_MARK), d(0.3), d(0.0))})")
    patt = (f"({when(has('text', FENCE), d(0.5), d(0.0))} + {when(has_any('tl', STEP_WORDS), d(0.25), d(0.0))}"
            f" + {when('length(text) >= coalesce(min_length, 300)', d(0.25), d(0.0))})")
    opt = f"least({count_present('text', OPT_KEYWORDS)} / {d(3.0)}, {d(1.0)})"
    other = when(f"{has_any('text', LIST_MARKS)} AND length(text) >= 200", d(1.0), d(0.5))
    return (f"(CASE category WHEN 'expression_translation' THEN {expr} WHEN 'full_migration' THEN {mig} "
            f"WHEN 'component_explanation' THEN {comp} WHEN 'pattern_explanation' THEN {patt} "
            f"WHEN 'optimization' THEN {opt} ELSE {other} END)")


def scored_cte() -> str:
    overall = " + ".join(f"{k} * {d(w)}" for k, w in WEIGHTS.items())
    return (f"WITH {CASES},{RESPONSES},{BLOCKS},\n"
            f"m AS (SELECT *, {_metrics_sql()}, {_rubric_sql()} FROM bs),\n"
            f"m2 AS (SELECT *, CAST({_category_sql()} AS DOUBLE) AS category_specific FROM m),\n"
            f"scored AS (SELECT *, {overall} AS overall FROM m2)\n")


SCORED_COLS = ("model, test_id, conv_id, turn, category, difficulty, query, CAST(length(text) AS INTEGER) AS response_length, "
               + ", ".join(WEIGHTS) + ", overall, "
               "CASE WHEN overall * 100 >= 70 THEN 'ok' WHEN overall * 100 >= 50 THEN 'warn' ELSE 'fail' END AS band")

ORACLE_SCORED = scored_cte() + f"SELECT {SCORED_COLS} FROM scored"

ORACLE_RUBRIC = scored_cte() + "SELECT model, part, avg(pct) AS avg_pct, count(*) AS cases FROM (\n" + \
    "\nUNION ALL\n".join(f"SELECT model, '{p}' AS part, r_{p} * 100 AS pct FROM scored WHERE category = 'full_migration'"
                         for p in RUBRIC_PARTS) + ") GROUP BY model, part"

ORACLE_MODEL_REPORT = scored_cte() + (
    "SELECT *, overall = max(overall) OVER () AS is_best FROM (SELECT model, count(*) AS cases, "
    + ", ".join(f"avg({k}) AS {k}" for k in [*WEIGHTS, "overall"]) + " FROM scored GROUP BY model)")

ORACLE_CATEGORY_MATRIX = scored_cte() + (
    "SELECT category, " + ", ".join(f"coalesce(avg(CASE WHEN model = '{m}' THEN overall END), 0.0) AS {m}"
                                    for m in ("m0", "m1", "m2")) + " FROM scored GROUP BY category")

ORACLE_QUALITY = scored_cte() + (
    "SELECT *, (groundedness + relevance + coherence) / 3 AS quality_avg FROM (\n"
    "SELECT model, category, avg(groundedness) AS groundedness, avg(relevance) AS relevance, "
    "avg(coherence) AS coherence FROM scored GROUP BY model, category\n"
    "UNION ALL SELECT model, 'TOTAL', avg(groundedness), avg(relevance), avg(coherence) FROM scored GROUP BY model)")

_H2H_METRICS = [*WEIGHTS, "overall"]
ORACLE_HEAD_TO_HEAD = scored_cte() + (
    ", rep AS (SELECT model, " + ", ".join(f"avg({k}) AS {k}" for k in _H2H_METRICS) + " FROM scored GROUP BY model),\n"
    "lng AS (" + " UNION ALL ".join(f"SELECT model, '{k}' AS metric, {k} AS value FROM rep" for k in _H2H_METRICS) + "),\n"
    "w AS (SELECT metric, max(CASE WHEN model = 'm0' THEN value END) AS score_a, "
    "max(CASE WHEN model = 'm1' THEN value END) AS score_b FROM lng WHERE model IN ('m0', 'm1') GROUP BY metric)\n"
    "SELECT metric, score_a, score_b, 'm0' AS model_a, 'm1' AS model_b, score_b - score_a AS difference, "
    "CASE WHEN score_b > score_a THEN 'm1' WHEN score_a > score_b THEN 'm0' ELSE 'tie' END AS winner FROM w")


def _simple_cte() -> str:
    kw = ("CASE WHEN coalesce(len(expected_keywords), 0) > 0 THEN "
          "CAST(len(list_filter(expected_keywords, lambda k: contains(tl, lower(k)))) AS DOUBLE) / len(expected_keywords) "
          f"ELSE {d(0.0)} END")
    inc = when(has_any("text", SIMPLE_CODE_MARKS), d(1.0), d(0.0))
    hdr = has_any("text", HEADER_MARKS)
    ws = f"(CASE WHEN {hdr} AND length(text) > 200 THEN {d(1.0)} WHEN {hdr} THEN {d(0.5)} ELSE {d(0.0)} END)"
    stages = count_present("tl", SIMPLE_STAGE_WORDS)
    cat = (f"(CASE category WHEN 'expression_translation' THEN "
           f"{when(has('text', SIMPLE_EXPRESSION_SOURCE) + ' AND ' + has('text', SIMPLE_EXPRESSION_TARGET), d(1.0), d(0.0))} "
           f"WHEN 'full_migration' THEN {stages} / {d(4.0)} "
           f"WHEN 'pattern_explanation' THEN {when(has('text', FENCE) + ' AND length(text) > 300', d(1.0), d(0.5))} "
           f"ELSE {when(has_any('tl', SIMPLE_PURPOSE) + ' AND ' + has_any('tl', SIMPLE_SPARK), d(1.0), d(0.5))} END)")
    return (f"WITH {CASES},{RESPONSES},\n"
            f"j AS (SELECT r.*, c.* EXCLUDE (test_id), lower(r.text) AS tl FROM resp r JOIN cases c ON r.test_id = c.test_id),\n"
            f"s AS (SELECT model, test_id, conv_id, turn, category, {kw} AS keyword_coverage, {inc} AS includes_code, "
            f"{ws} AS well_structured, CAST({cat} AS DOUBLE) AS category_specific FROM j),\n"
            f"simple AS (SELECT *, (keyword_coverage + includes_code + well_structured + category_specific) / {d(4.0)}"
            f" AS overall FROM s)\n")


ORACLE_SIMPLE = _simple_cte() + "SELECT * FROM simple"
ORACLE_SIMPLE_REPORT = _simple_cte() + (
    "SELECT *, overall = max(overall) OVER () AS is_best FROM (SELECT model, avg(overall) AS overall, "
    "avg(keyword_coverage) AS keyword_coverage, avg(includes_code) AS includes_code, "
    "avg(well_structured) AS well_structured, avg(category_specific) AS category_specific FROM simple GROUP BY model)")
