import pytest
from pyspark.sql import functions as F

from tessera.operators import inventory, scoring
from tests.conftest import rows

RESP = ("## Plan\n- read, transform and write with validation\n```python\n"
        'df = spark.read.format("csv").option("header", "true").load(p)\n'
        'df2 = df.withColumn("x", F.trim(F.col("a")))\n'
        'df2.filter(F.col("x").isNotNull()).write.format("delta").mode("overwrite").partitionBy("x").save(out)\n'
        "```")


def _cases(spark):
    return spark.createDataFrame(
        [("c1", "full_migration", "Migrate this job", ["spark.read", "withColumn", "missing"], True, 50, "hard"),
         ("c2", "optimization", "tune it", [], False, 10, "easy")],
        "test_id string, category string, query string, expected_keywords array<string>, must_have_code boolean, "
        "min_length int, difficulty string")


def test_full_migration_scores_by_hand(spark):
    resp = spark.createDataFrame([("mA", "c1", RESP)], "model string, test_id string, text string")
    r = scoring.score_responses(resp, _cases(spark)).first()
    assert r.keyword_coverage == pytest.approx(2 / 3)
    assert (r.includes_code, r.well_structured, r.groundedness, r.relevance) == (1.0, 1.0, 1.0, 1.0)
    assert r.coherence == pytest.approx(1.1)           # no upper cap, as in the evaluator
    md = r.migration_details
    assert (md.syntax_valid, md.schema_fidelity, md.transformations, md.all_stages) == pytest.approx((0.1, 0.15, 0.075, 0.15))
    assert (md.validations, md.delta_lake, md.partitioning, md.documentation) == pytest.approx((0.05, 0.05, 0.06, 0.02))
    assert r.category_specific == pytest.approx(0.655)
    assert r.overall == pytest.approx(0.0666667 + 0.1 + 0.05 + 0.2 + 0.15 + 0.165 + 0.16375, abs=1e-6)
    assert r.band == "ok"


def test_generic_fence_rematch_between_blocks(spark):
    # The untagged pattern also captures the prose between two fences
    text = "```python\na = 1\n```\nSome prose\n```python\nb = 2\n```"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(scoring.code_blocks(F.col("t")).alias("b")).first().b
    assert got == ["a = 1", "b = 2", "Some prose"]
    n = df.select(scoring.valid_python_blocks(scoring.code_blocks(F.col("t"))).alias("n")).first().n
    assert n == 2


def test_no_code_paths_and_reports(spark):
    resp = spark.createDataFrame([("mA", "c2", "plain words about cache and broadcast"),
                                  ("mB", "c2", "OPTIMIZE with partition, cache and broadcast; AQE too"),
                                  ("mB", "c1", RESP)], "model string, test_id string, text string")
    s = scoring.score_responses(resp, _cases(spark))
    a = s.filter(F.col("model") == "mA").first()
    assert a.coherence == 0.8 and a.keyword_coverage == 1.0 and a.category_specific == pytest.approx(2 / 3)
    rep = {r.model: r for r in scoring.model_report(s).collect()}
    assert rep["mB"].is_best and not rep["mA"].is_best
    m = {r.category: r for r in scoring.category_matrix(s, ["mA", "mB"]).collect()}
    assert m["full_migration"].mA == 0.0
    h = {r.metric: r for r in scoring.head_to_head(s, "mA", "mB").collect()}
    assert h["overall"].winner == "mB"
    assert scoring.rubric_averages(s).filter(F.col("model") == "mB").count() == len(scoring.RUBRIC_PARTS)
    q = scoring.quality_averages(s).filter(F.col("category") == "TOTAL").count()
    assert q == 2
    simple = scoring.simple_scores(resp, _cases(spark))
    assert simple.count() == 3 and scoring.simple_report(simple).filter("is_best").count() >= 1


JOB = """<?xml version="1.0"?>
<DSExport><Job Identifier="{name}"><Record Identifier="J" Type="ServerJob">
<Property Name="Name">{name}</Property><Property Name="Description">demo job</Property>
<Property Name="Parameters"><Parameter><Property Name="Name">IN</Property>
<Property Name="DefaultValue">/in.csv</Property></Parameter></Property>
<Record Identifier="S1" Type="CustomStage"><Property Name="Name">Src</Property>
<Property Name="StageType">Sequential_File</Property><Property Name="Columns">
<Column Name="Id" SqlType="INTEGER" Nullable="0" PrimaryKey="1"/><Column Name="Nm" SqlType="VARCHAR" Length="20" Nullable="1"/>
</Property></Record>
<Record Identifier="S2" Type="CustomStage"><Property Name="Name">Xf</Property>
<Property Name="StageType">{t2}</Property></Record>
<Property Name="DataFlow"><Stage From="Src" To="Xf" Link="Main"/></Property>
</Record></Job></DSExport>"""


def test_job_inventory(spark, tmp_dir):
    import os
    d = tmp_dir.replace("file:", "")
    os.makedirs(d)
    for n, t2 in (("a", "Transformer"), ("b", "ChangeCapture")):
        with open(f"{d}/{n}.dsx", "w") as f:
            f.write(JOB.format(name=f"job_{n}", t2=t2))
    inv = inventory.job_inventory(spark, f"{tmp_dir}/*.dsx")
    jobs = {r.job_name: r for r in inv["jobs"].collect()}
    assert jobs["job_a"].stage_count == 2 and jobs["job_a"].complexity == "Low"
    assert jobs["job_b"].complexity == "High"
    cols = rows(inv["columns"].filter(F.col("path").endswith("a.dsx")), "column_name", "sql_type", "length",
                "nullable", "primary_key")
    assert cols == [("Id", "INTEGER", None, False, True), ("Nm", "VARCHAR", 20, True, False)]
    assert rows(inv["params"], "param_name", "default_value") == [("IN", "/in.csv"), ("IN", "/in.csv")]
    assert rows(inv["links"], "from_stage", "to_stage", "link")[0] == ("Src", "Xf", "Main")
    assert inv["stage_types"].count() == 4


def test_inventory_complexity_bands(spark, tmp_dir):
    import os
    d = tmp_dir.replace("file:", "")
    os.makedirs(d)
    stage = ('<Record Identifier="S{i}" Type="CustomStage"><Property Name="Name">St{i}</Property>'
             '<Property Name="StageType">Transformer</Property></Record>')
    for name, n in (("four", 4), ("twelve", 12)):
        body = "".join(stage.format(i=i) for i in range(n))
        with open(f"{d}/{name}.dsx", "w") as f:
            f.write(f'<DSExport><Job Identifier="{name}"><Record Identifier="J" Type="ServerJob">{body}'
                    f'</Record></Job></DSExport>')
    jobs = {r.job_name: r for r in inventory.job_inventory(spark, f"{tmp_dir}/*.dsx")["jobs"].collect()}
    assert (jobs["four"].stage_count, jobs["four"].complexity) == (4, "Medium")
    assert (jobs["twelve"].stage_count, jobs["twelve"].complexity) == (12, "Very High")


def test_component_explanation_by_hand(spark):
    case = spark.createDataFrame([("c3", "component_explanation", "Explain the Lookup stage", ["lookup", "broadcast"],
                                   False, 50, "easy")],
                                 "test_id string, category string, query string, expected_keywords array<string>, "
                                 "must_have_code boolean, min_length int, difficulty string")
    text = ("## Lookup\nThe lookup is used for reference data; purpose: enrich rows.\n```python\n"
            "df.join(F.broadcast(ref), 'k')\n```")
    r = scoring.score_responses(spark.createDataFrame([("m", "c3", text)], "model string, test_id string, text string"),
                                case).first()
    assert (r.keyword_coverage, r.includes_code, r.groundedness, r.relevance) == (1.0, 1.0, 1.0, 1.0)
    assert r.well_structured == pytest.approx(0.7)       # headers + length, no bullets
    assert r.coherence == pytest.approx(0.85)            # `df` used, never assigned
    assert r.category_specific == pytest.approx(0.7)     # purpose + example, no equivalence word
    assert r.overall == pytest.approx(0.8875)


def test_simple_scorer_expression_rule(spark):
    cases = spark.createDataFrame([("e1", "expression_translation", "q", ["trim"], True, 10, "easy")],
                                  "test_id string, category string, query string, expected_keywords array<string>, "
                                  "must_have_code boolean, min_length int, difficulty string")
    resp = spark.createDataFrame([("m", "e1", "## DataStage Trim -> PySpark F.trim")],
                                 "model string, test_id string, text string")
    r = scoring.simple_scores(resp, cases).first()
    assert (r.keyword_coverage, r.includes_code, r.well_structured, r.category_specific) == (1.0, 1.0, 0.5, 1.0)
    assert r.overall == pytest.approx(0.875)


@pytest.mark.parametrize("category,query,keywords,code,least,text,want", [
    # coverage, code, structure, groundedness, relevance, coherence, category, overall: computed by hand
    ("expression_translation", "Translate a trim", ["trim"], True, 10, "DataStage Trim becomes F.trim in PySpark. plain.",
     (1.0, 1.0, 0.3, 1.0, 1.0, 0.8, 1.0, 0.935)),
    ("pattern_explanation", "Explain it", ["missing", "approach"], False, None, "The usual approach has one step.",
     (0.5, 1.0, 0.3, 1.0, 0.7, 0.8, 0.25, 0.6525)),
    ("optimization", "Make it fast", [], True, 5, "Use cache and broadcast; then OPTIMIZE",
     (1.0, 0.0, 0.3, 1.0, 1.0, 0.8, 1.0, 0.835)),
    ("troubleshooting", "Why does it fail", ["null", "skew"], False, 500, "The error comes from a null key; fix it.",
     (0.5, 1.0, 0.0, 1.0, 0.6, 0.8, 0.5, 0.685)),
    ("best_practices", "What is good", ["delta"], False, 0, "A best practice: - keep delta tables small",
     (1.0, 1.0, 0.6, 1.0, 1.0, 0.8, 0.5, 0.825)),
])
def test_other_categories_by_hand(spark, category, query, keywords, code, least, text, want):
    case = spark.createDataFrame([("c", category, query, keywords, code, least, "easy")],
                                 "test_id string, category string, query string, expected_keywords array<string>, "
                                 "must_have_code boolean, min_length int, difficulty string")
    r = scoring.score_responses(spark.createDataFrame([("m", "c", text)], "model string, test_id string, text string"), case).first()
    assert [r[k] for k in (*scoring.WEIGHTS, "overall")] == pytest.approx(list(want))
