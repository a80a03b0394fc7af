"""Bulk job-file inventory (U3): stages, columns, parameters and links of many
XML job exports, stage-type counts per job and a complexity band.

Each file is one row (whole-text read, one task per file); the stage records,
column tags, parameter blocks and flow links are cut out with regular
expressions and parsed with ``xpath_string`` / ``regexp_extract``, then
exploded -- every step is a native Spark expression, so thousands of files are
processed in parallel and nothing goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import read_whole_files

STAGE_RECORD = r"""(?s)<Record[^>]*Type="CustomStage"[^>]*>.*?</Record>"""
COLUMN_TAG = r"<Column\s[^>]*>"
PARAMETER_BLOCK = r"(?s)<Parameter>.*?</Parameter>"
FLOW_LINK = r"<Stage\s[^>]*From=[^>]*>"
# stage types whose presence makes a job complex (change capture, pivots, SCD logic)
COMPLEX_TYPES = ["ChangeCapture", "Change_Capture", "Pivot", "SCD", "SurrogateKeyGenerator"]


def _attr(tag: Column, name: str) -> Column:
    v = F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1)
    return F.when(v == "", F.lit(None)).otherwise(v)


def _prop(xml: Column, name: str) -> Column:
    v = F.xpath_string(xml, F.lit(f"/*/Property[@Name='{name}']"))
    return F.when(v == "", F.lit(None)).otherwise(v)


def parse_files(files: DataFrame) -> dict[str, DataFrame]:
    """Inventory tables from a (path, body) frame."""
    jobs = files.select(
        "path",
        F.regexp_extract("body", r'<Job\s[^>]*Identifier="([^"]*)"', 1).alias("job_name"),
        F.regexp_extract("body", r'(?s)<Property Name="Description">(.*?)</Property>', 1).alias("description"))
    stages = (files.select("path", F.posexplode(F.regexp_extract_all("body", F.lit(STAGE_RECORD), 0))
                           .alias("stage_no", "rec"))
              .select("path", "stage_no", "rec", _prop(F.col("rec"), "Name").alias("stage_name"),
                      _prop(F.col("rec"), "StageType").alias("stage_type"),
                      _prop(F.col("rec"), "StageMode").alias("stage_mode")))
    columns = (stages.select("path", "stage_name", F.posexplode(F.regexp_extract_all("rec", F.lit(COLUMN_TAG), 0))
                             .alias("column_no", "tag"))
               .select("path", "stage_name", "column_no", _attr(F.col("tag"), "Name").alias("column_name"),
                       _attr(F.col("tag"), "SqlType").alias("sql_type"),
                       _attr(F.col("tag"), "Length").cast("int").alias("length"),
                       F.coalesce(_attr(F.col("tag"), "Nullable") == "1", F.lit(True)).alias("nullable"),
                       F.coalesce(_attr(F.col("tag"), "PrimaryKey") == "1", F.lit(False)).alias("primary_key")))
    params = (files.select("path", F.explode(F.regexp_extract_all("body", F.lit(PARAMETER_BLOCK), 0)).alias("p"))
              .select("path", _prop(F.col("p"), "Name").alias("param_name"),
                      _prop(F.col("p"), "DefaultValue").alias("default_value")))
    links = (files.select("path", F.explode(F.regexp_extract_all("body", F.lit(FLOW_LINK), 0)).alias("t"))
             .select("path", _attr(F.col("t"), "From").alias("from_stage"), _attr(F.col("t"), "To").alias("to_stage"),
                     _attr(F.col("t"), "Link").alias("link")))
    stages = stages.drop("rec")
    per_job = stages.groupBy("path").agg(
        F.count(F.lit(1)).alias("stage_count"),
        F.count_if(F.col("stage_type").isin(*COMPLEX_TYPES)).alias("complex_stages"),
        F.count_if(F.col("stage_type") == "Transformer").alias("transformers"))
    summary = jobs.join(per_job, "path", "left").fillna(0, ["stage_count", "complex_stages", "transformers"])
    band = (F.when(F.col("stage_count") > 10, "Very High")
            .when((F.col("complex_stages") > 0) | (F.col("stage_count") > 6), "High")
            .when(F.col("stage_count") > 3, "Medium").otherwise("Low"))
    summary = summary.withColumn("complexity", band)
    type_counts = stages.groupBy("path", "stage_type").agg(F.count(F.lit(1)).alias("stages"))
    return {"jobs": summary, "stages": stages, "columns": columns, "params": params, "links": links,
            "stage_types": type_counts}


def job_schemas(files: DataFrame) -> DataFrame:
    """(path, job_columns, job_params): what the migration rubric needs of each job file.

    Distinct column names and all parameter names, sorted; empty arrays where a
    file has none.
    """
    t = parse_files(files)
    columns = t["columns"].filter(F.col("column_name").isNotNull()).groupBy("path").agg(
        F.array_sort(F.collect_set("column_name")).alias("job_columns"))
    params = t["params"].filter(F.col("param_name").isNotNull()).groupBy("path").agg(
        F.array_sort(F.collect_list("param_name")).alias("job_params"))
    none = F.array().cast("array<string>")
    return (files.select("path").join(columns, "path", "left").join(params, "path", "left")
            .select("path", F.coalesce("job_columns", none).alias("job_columns"), F.coalesce("job_params", none).alias("job_params")))


def job_inventory(spark: SparkSession, path_glob: str) -> dict[str, DataFrame]:
    """Inventory of every job file matching ``path_glob``."""
    return parse_files(read_whole_files(spark, path_glob))
