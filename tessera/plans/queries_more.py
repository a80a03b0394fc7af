"""Checked queries for dirty input: null partitions and keys, repeated keys, null
order values, header-like data lines, and for operators without a query so far."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import dimension, inventory, layout, matching, merge, ordering, reconcile, scoring
from tessera.plans import fixtures, queries_ops
from tessera.plans.catalog import register
from tessera.session import scratch_path
from tessera.sinks import files as sinks
from tessera.sources import files as sources
from tessera.streaming import stages as streaming


def TB(spark, d, name):
    return fixtures.table(spark, d, name)


# ------------------------------------------------------------------ keyed loads with null partitions

def _customers(spark, d):
    """Customers partitioned by segment, every seventh without one."""
    return TB(spark, d, "customer").select(
        "c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("balance"), F.lit(1).alias("seq"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"))


def _customer_changes(spark, d):
    """Changes that touch the partition without a segment and one other."""
    c = _customers(spark, d).filter(F.col("segment").isNull() | (F.col("segment") == "BUILDING"))
    return (c.filter(F.col("c_custkey") % 3 == 0)
            .withColumns({"balance": (F.col("balance") + 5).cast("decimal(18,2)"), "seq": F.lit(2)}))


_CHANGED = """
SELECT c_custkey, CASE WHEN hit THEN CAST(bal + 5 AS DECIMAL(18,2)) ELSE bal END AS balance,
       CASE WHEN hit THEN 2 ELSE 1 END AS seq, segment
FROM (SELECT *, c_custkey % 3 = 0 AND (segment IS NULL OR segment = 'BUILDING') AS hit
      FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS bal,
                   CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment FROM customer))
"""


def _partitioned_load(spark, d):
    path = scratch_path(spark, "partitioned-load")
    merge.load(spark, path, _customers(spark, d), ["c_custkey"], "FULL", ["segment"])
    merge.load(spark, path, _customer_changes(spark, d), ["c_custkey"], "INCREMENTAL", ["segment"])
    return spark.read.parquet(path)


register("b17_partitioned_load", _CHANGED)(_partitioned_load)


def _partitioned_stream(spark, d):
    base = scratch_path(spark, "partitioned-stream")
    first = _customers(spark, d)
    first.write.parquet(f"{base}/in")
    args = (f"{base}/in", first.schema, f"{base}/target", ["c_custkey"], "seq", f"{base}/ckpt")
    streaming.stream_upsert(spark, *args, partition_by=["segment"])
    _customer_changes(spark, d).write.mode("append").parquet(f"{base}/in")
    streaming.stream_upsert(spark, *args, partition_by=["segment"])
    return spark.read.parquet(f"{base}/target")


register("w2_partitioned_stream_upsert", _CHANGED)(_partitioned_stream)


def _append(spark, d):
    path = scratch_path(spark, "append")
    li = TB(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    sinks.write_delimited(li.filter("l_linenumber <= 3"), path)
    sinks.write_delimited(li.filter("l_linenumber > 3"), path, mode="append")
    return sources.read_delimited(spark, path, "l_orderkey long, l_linenumber int, l_returnflag string")


register("b2_append", "SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, l_returnflag FROM lineitem")(_append)

register("a5_b3_dataset_read_back", "SELECT event_id, user_id, ts, value, event_type FROM events")(
    lambda spark, d: sources.read_dataset(spark, sinks.write_dataset(
        TB(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type"),
        scratch_path(spark, "events-all"), partition_by=["event_type"], files=4))
    .select("event_id", "user_id", "ts", "value", "event_type"))


# ------------------------------------------------------------------ repeated keys

def _repeated_updates(spark, d):
    """Three updates of every fourth part, the last by ``seq`` wins."""
    p = TB(spark, d, "part").filter(F.col("p_partkey") % 4 == 0)
    return p.withColumn("seq", F.explode(F.array(F.lit(2), F.lit(3), F.lit(1)))).select(
        "p_partkey", F.concat(F.lit("v"), F.col("seq").cast("string")).alias("p_brand"), "p_size", "seq")


def _parts(spark, d):
    return TB(spark, d, "part").filter(F.col("p_partkey") % 8 != 0).select("p_partkey", "p_brand", "p_size")


register("b14_update_repeated_keys", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'v3' ELSE p_brand END AS p_brand, p_size FROM part WHERE p_partkey % 8 <> 0
""")(lambda spark, d: merge.update_by_keys(_parts(spark, d), _repeated_updates(spark, d), ["p_partkey"], ["p_brand"], "seq"))

register("b15_upsert_repeated_keys", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'v3' ELSE p_brand END AS p_brand, p_size FROM part
""")(lambda spark, d: merge.upsert(_parts(spark, d), _repeated_updates(spark, d), ["p_partkey"], "seq"))


_DIM = ("DimensionKey int, c_custkey long, name string, EffectiveDate timestamp_ntz, EndDate timestamp_ntz, "
        "IsCurrent int, RecordVersion int")


def _dirty_dimension(spark, d):
    """A dimension with rows whose current flag is null, loaded from a source with repeated keys."""
    c = TB(spark, d, "customer")
    k = F.col("c_custkey")
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    dim = c.select(k.cast("int").alias("DimensionKey"), k.alias("c_custkey"), F.col("c_name").alias("name"),
                   stamp.alias("EffectiveDate"), F.lit(None).cast("timestamp_ntz").alias("EndDate"),
                   F.when(k % 11 != 0, F.lit(1)).alias("IsCurrent"), F.lit(1).alias("RecordVersion"))
    dim = dim.to(T._parse_datatype_string(_DIM))
    src = c.select("c_custkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), F.col("c_name").alias("n"))
    src = src.select("c_custkey", "seq", F.when((F.col("seq") == 2) & (F.col("c_custkey") % 5 == 0), F.concat("n", F.lit("*")))
                     .otherwise(F.col("n")).alias("name"))
    out = dimension.scd2(dim, src, ["c_custkey"], ["name"], "2024-02-01 00:00:00", latest_by="seq")["dimension"]
    return out.select("c_custkey", "name", "EffectiveDate", "EndDate", "IsCurrent", "RecordVersion")


register("h2_dirty_dimension", """
WITH c AS (SELECT c_custkey AS k, c_name AS n, c_custkey % 11 = 0 AS closed, c_custkey % 5 = 0 AS changed FROM customer),
old AS (
  SELECT k AS c_custkey, n AS name, TIMESTAMP '2024-01-01 00:00:00' AS EffectiveDate,
         CASE WHEN NOT closed AND changed THEN TIMESTAMP '2024-02-01 00:00:00' END AS EndDate,
         CASE WHEN closed THEN NULL WHEN changed THEN 0 ELSE 1 END AS IsCurrent, 1 AS RecordVersion FROM c),
new AS (
  SELECT k, CASE WHEN changed THEN n || '*' ELSE n END, TIMESTAMP '2024-02-01 00:00:00', CAST(NULL AS TIMESTAMP), 1, 2
  FROM c WHERE closed OR changed)
SELECT * FROM old UNION ALL SELECT * FROM new
""")(_dirty_dimension)


# ------------------------------------------------------------------ nulls in checksums, order and keys

def _shifted(spark, d, swap):
    """Orders with a null in one of two text columns, or with the two columns swapped."""
    k = F.col("o_orderkey")
    a, b = F.when(k % 2 == 0, F.col("o_orderstatus")), F.when(k % 2 == 1, F.col("o_orderstatus"))
    return TB(spark, d, "orders").select("o_orderkey", (b if swap else a).alias("a"), (a if swap else b).alias("b"))


def _checksums_see_shifted_nulls(spark, d):
    parts = []
    for algo in ("md5", "xxhash64"):
        one, two = (reconcile.dataset_checksum(_shifted(spark, d, s), algo=algo) for s in (False, True))
        again = reconcile.dataset_checksum(_shifted(spark, d, False).repartition(3), algo=algo)
        parts.append(one.select(F.lit(algo).alias("algo"), "row_count",
                                (F.col("checksum") != two.select("checksum").scalar()).alias("shift_seen"),
                                (F.col("checksum") == again.select("checksum").scalar()).alias("order_ignored")))
    return parts[0].unionByName(parts[1])


register("r3_checksum_null_shift", """
SELECT algo, (SELECT count(*) FROM orders) AS row_count, true AS shift_seen, true AS order_ignored
FROM (VALUES ('md5'), ('xxhash64')) AS v(algo)
""")(_checksums_see_shifted_nulls)


def _null_orders(spark, d):
    li = TB(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity")).alias("q"))
    one = ordering.dedup(li, ["l_orderkey"], [("q", "desc"), ("l_linenumber", "desc")], "first")
    two = ordering.dedup(li, ["l_orderkey"], [("q", "desc"), ("l_linenumber", "asc")], "first")
    low = ordering.dedup(li, ["l_orderkey"], [("q", "asc"), ("l_linenumber", "desc")], "first")
    tag = lambda df, name: df.select(F.lit(name).alias("way"), *df.columns)
    return tag(one, "one direction").unionByName(tag(two, "mixed")).unionByName(tag(low, "lowest"))


register("s6_dedup_null_order", """
WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END AS q FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC NULLS LAST, l_linenumber DESC) AS a,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC NULLS LAST, l_linenumber) AS b,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY q ASC NULLS FIRST, l_linenumber DESC) AS c FROM t)
SELECT 'one direction' AS way, l_orderkey, l_linenumber, q FROM r WHERE a = 1
UNION ALL SELECT 'mixed', l_orderkey, l_linenumber, q FROM r WHERE b = 1
UNION ALL SELECT 'lowest', l_orderkey, l_linenumber, q FROM r WHERE c = 1
""")(_null_orders)

register("g5_sort_key_change_columns", """
SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_returnflag, floor(l_quantity / 10) ORDER BY l_orderkey, l_linenumber) = 1
       AS INTEGER) AS changed
FROM lineitem
""")(lambda spark, d: ordering.sort_stage(
    TB(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"),
    ["l_returnflag", (F.floor(F.col("l_quantity") / 10), "desc"), "l_orderkey", "l_linenumber"],
    key_change="changed", change_keys=2).select("l_orderkey", "l_linenumber", "changed"))


def _null_keys_compared(spark, d):
    c = TB(spark, d, "customer").select(F.when(F.col("c_custkey") != 7, F.col("c_custkey")).alias("k"), "c_name")
    t = c.withColumn("c_name", F.when(F.col("k").isNull() | (F.col("k") % 100 == 0), F.lit("new")).otherwise(F.col("c_name")))
    return dimension.change_capture(c, t, ["k"], ["c_name"], emit=("I", "U", "D"))


register("h1_null_key_capture", """
SELECT CASE WHEN c_custkey <> 7 THEN c_custkey END AS k, 'new' AS c_name, 'U' AS change_type
FROM customer WHERE c_custkey = 7 OR c_custkey % 100 = 0
""")(_null_keys_compared)


# ------------------------------------------------------------------ reject scan

_SCAN = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()),
                      T.StructField("note", T.StringType())])


def _scan_two_files(spark, d):
    """Files with a header each (one per partition of orders), a data line equal to the header in one more, notes over two lines."""
    path = scratch_path(spark, "orders-with-headers")
    o = TB(spark, d, "orders")
    price = F.when(F.col("o_orderkey") % 97 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    note = F.concat(F.lit("first line\n"), F.col("o_orderstatus"), F.lit(", second"))
    lines = o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), price.alias("o_totalprice"), note.alias("note"))
    stray = spark.range(1).select(*[F.lit(c).alias(c) for c in lines.columns])
    lines.unionByName(stray).write.option("header", True).csv(path)
    good, bad = sources.read_with_rejects(spark, path, _SCAN, multi_line=True)
    return (good.select(F.lit("good").alias("link"), "o_orderkey", "note")
            .unionByName(bad.select(F.lit("reject").alias("link"),
                                    F.split_part("raw_record", F.lit(","), F.lit(1)).try_cast("long").alias("o_orderkey"),
                                    F.lit(None).cast("string").alias("note"))))


register("a3_scan_header_and_lines", """
SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'reject' ELSE 'good' END AS link, o_orderkey,
       CASE WHEN o_orderkey % 97 <> 0 THEN 'first line' || chr(10) || o_orderstatus || ', second' END AS note FROM orders
UNION ALL SELECT 'reject', NULL, NULL
""")(_scan_two_files)


# ------------------------------------------------------------------ layout

def _wide_zorder(spark, d):
    o = TB(spark, d, "orders")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    o = o.withColumns({f"name{i}": F.concat(F.lit("Customer#"), F.lpad(((F.col("o_custkey") * (i + 3)) % 1009).cast("string"), 9, "0"))
                       for i in range(3)})
    z = layout.z_value(o, [*cols, "name0", "name1", "name2"])
    one = layout.z_value(o, ["name0"])
    return o.agg(F.count(F.lit(1)).alias("orders"), (F.min(z) >= 0).alias("not_negative"),
                 (F.count_distinct(one) > 20).alias("prefix_seen"))


register("b10_zorder_nine_columns", "SELECT count(*) AS orders, true AS not_negative, true AS prefix_seen FROM orders")(_wide_zorder)


# ------------------------------------------------------------------ matching rows

def _match_rows(spark, d):
    """Benchmark words joined by spelling to the distinct benchmark words, of every length on both sides."""
    left = TB(spark, d, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word <> ''")
    right = queries_ops.words(TB(spark, d, "benchmark"), "text")
    return matching.fuzzy_match(left, right, "word", "word", 1).select(
        "item_id", "word", F.col("right_word").alias("other"), F.col("match_distance").cast("int").alias("distance"))


register("d13_fuzzy_match_rows", """
WITH w AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark)
SELECT l.item_id, l.word, r.word AS other, CAST(levenshtein(l.word, r.word) AS INTEGER) AS distance
FROM w l, (SELECT DISTINCT word FROM w WHERE word <> '') r
WHERE l.word <> '' AND levenshtein(l.word, r.word) <= 1
""")(_match_rows)


# ------------------------------------------------------------------ catalog and partitioning

def _saved_table(spark, d):
    path = scratch_path(spark, "saved-table")
    name = "tessera_" + path.rsplit("-", 1)[1]
    sinks.save_table(TB(spark, d, "supplier"), name, bucket_by=(4, ["s_suppkey"]))
    try:
        sinks.analyze(spark, name, ["s_suppkey"])
        sources.read_table(spark, name).write.parquet(path)
    finally:
        spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(path)


register("a8_b7_b11_saved_table", "SELECT * FROM supplier")(_saved_table)


def _partitioning(spark, d):
    o = TB(spark, d, "orders").select("o_orderkey", "o_custkey")
    by_key = ordering.repartition_stage(o, "modulus", 5, ["o_orderkey"]).withColumn("part", F.spark_partition_id())
    by_range = ordering.repartition_stage(o, "range", 4, ["o_orderkey"]).withColumn("part", F.spark_partition_id())
    edges = by_range.groupBy("part").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    a, b = edges.alias("a"), edges.alias("b")
    crossing = a.join(b, (F.col("a.part") < F.col("b.part")) & (F.col("a.hi") >= F.col("b.lo"))).count()
    return by_key.select("o_orderkey", (F.col("part") == F.pmod(F.col("o_orderkey"), F.lit(5))).alias("in_its_partition"),
                         F.lit(crossing == 0).alias("ranges_apart"))


register("s13_partitioning", "SELECT o_orderkey, true AS in_its_partition, true AS ranges_apart FROM orders")(_partitioning)


# ------------------------------------------------------------------ job files

def _job_files(spark, d):
    """One XML job per supplier: 1 + key % 7 columns over 1 + key % 5 stages, 1 + key % 3 parameters."""
    k = F.col("s_suppkey").cast("int")
    column = lambda i: F.concat(F.lit('<Column Name="col_'), i.cast("string"), F.lit('" SqlType="VarChar" Length="20"/>'))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Transformer", "Aggregator", "Pivot")]), (k % 3 + 1).cast("int"))
    stage = lambda i: F.concat(
        F.lit('<Record Type="CustomStage"><Property Name="Name">stage_'), i.cast("string"),
        F.lit('</Property><Property Name="StageType">'), kind, F.lit("</Property>"),
        F.when(i == 0, F.array_join(F.transform(F.sequence(F.lit(0), k % 7), column), "")).otherwise(F.lit("")), F.lit("</Record>"))
    param = lambda i: F.concat(F.lit('<Parameter><Property Name="Name">Param_'), i.cast("string"), F.lit("</Property></Parameter>"))
    body = F.concat(F.lit('<DSExport><Job Identifier="job_'), k.cast("string"), F.lit('">'),
                    F.array_join(F.transform(F.sequence(F.lit(0), k % 5), stage), "\n"),
                    F.array_join(F.transform(F.sequence(F.lit(0), k % 3), param), "\n"), F.lit("</Job></DSExport>"))
    return TB(spark, d, "supplier").select(F.concat(F.lit("job_"), k.cast("string")).alias("path"), body.alias("body"))


def _inventory(spark, d):
    t = inventory.parse_files(_job_files(spark, d))
    columns = t["columns"].groupBy("path").agg(F.count(F.lit(1)).alias("columns"))
    params = t["params"].groupBy("path").agg(F.count(F.lit(1)).alias("params"))
    return (t["jobs"].join(columns, "path").join(params, "path")
            .select("path", "job_name", F.col("stage_count").cast("long").alias("stage_count"), "complexity", "columns", "params"))


register("u3_job_inventory", """
SELECT 'job_' || s_suppkey AS path, 'job_' || s_suppkey AS job_name, CAST(s_suppkey % 5 + 1 AS BIGINT) AS stage_count,
       CASE WHEN s_suppkey % 3 = 2 THEN 'High' WHEN s_suppkey % 5 + 1 > 3 THEN 'Medium' ELSE 'Low' END AS complexity,
       CAST(s_suppkey % 7 + 1 AS BIGINT) AS columns, CAST(s_suppkey % 3 + 1 AS BIGINT) AS params
FROM supplier
""")(_inventory)


def _rubric_with_files(spark, d):
    """A generated answer per supplier, scored against the supplier's job file; every eleventh has none."""
    k = F.col("s_suppkey").cast("int")
    reads = F.array_join(F.transform(F.sequence(F.lit(0), k % 4), lambda i: F.concat(
        F.lit("df = df.withColumn('col_"), i.cast("string"), F.lit("', F.lit(1))\n"))), "")
    widgets = F.when(k % 5 != 0, F.array_join(F.transform(F.sequence(F.lit(0), k % 2), lambda i: F.concat(
        F.lit("dbutils.widgets.get(names.PARAM_"), i.cast("string"), F.lit(")\n"))), "")).otherwise(F.lit(""))
    code = F.concat(reads, widgets)
    answers = TB(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("job_"), k.cast("string")).alias("path"), code.alias("code"))
    schemas = inventory.job_schemas(_job_files(spark, d)).filter(F.split_part("path", F.lit("_"), F.lit(2)).cast("int") % 11 != 0)
    j = answers.join(schemas, "path", "left")
    parts = scoring.rubric(F.col("code"), F.array("code"), F.col("code"), F.lit(1), F.col("job_columns"), F.col("job_params"))
    return j.select("s_suppkey", parts.alias("r")).select(
        "s_suppkey", F.round(F.col(f"r.{scoring.RUBRIC_PARTS[1]}"), 6).alias("schema_fidelity"),
        F.round(F.col(f"r.{scoring.RUBRIC_PARTS[4]}"), 6).alias("parameters"))


register("x7_rubric_with_job_file", """
WITH s AS (SELECT s_suppkey, s_suppkey % 4 + 1 AS used, s_suppkey % 7 + 1 AS cols, s_suppkey % 2 + 1 AS named,
                  s_suppkey % 3 + 1 AS params, s_suppkey % 5 <> 0 AS widgets, s_suppkey % 11 <> 0 AS file FROM supplier)
SELECT s_suppkey, round(CASE WHEN file THEN CAST(least(used, cols) AS DOUBLE) / cols * 0.15
                             WHEN used >= 5 THEN 0.15 WHEN used >= 3 THEN 0.10 ELSE 0.0 END, 6) AS schema_fidelity,
       round(CASE WHEN NOT widgets THEN 0.0 WHEN file THEN CAST(least(named, params) AS DOUBLE) / params * 0.10 ELSE 0.07 END, 6) AS parameters
FROM s
""")(_rubric_with_files)
