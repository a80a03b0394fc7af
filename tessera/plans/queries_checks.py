"""Checked queries of operators whose effect is a check, a statistic or a layout, and of nested records,
multiset differences and several medians."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregate, joins, layout, numbering, ordering, quality, reconcile, transform
from tessera.plans import fixtures
from tessera.plans.catalog import register
from tessera.session import scratch_path
from tessera.sinks import files as sinks
from tessera.sources import files as sources
from tessera.util import plan_text


def TB(spark, d, name):
    return fixtures.table(spark, d, name)


# ------------------------------------------------------------------ nested records

def _nested(spark, d):
    """Orders as records of three levels: structs, arrays of structs with arrays, a map; some empty, some null."""
    k = F.col("o_orderkey")
    mark = lambda *m: F.array(*m).cast("array<string>")
    item = lambda n, marks: F.struct(F.lit(n).alias("n"), marks.alias("marks"))
    items = F.array(item(1, mark(F.lit("a"), F.col("o_orderstatus"))), item(2, F.lit(None).cast("array<string>")), item(3, mark()))
    who = F.struct(F.col("o_custkey").alias("key"), F.struct(F.col("o_orderpriority").alias("priority")).alias("more"))
    return TB(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("doc_who_key"),
        F.when(k % 7 != 0, F.struct(who.alias("who"), F.when(k % 5 != 0, F.when(k % 3 == 0, F.slice(items, 1, 0)).otherwise(items)).alias("items")))
        .alias("doc"),
        F.when(k % 2 == 0, F.create_map(F.lit("total"), F.col("o_totalprice"))).alias("attr"))


register("f14_flatten_nested", """
WITH o AS (SELECT *, o_orderkey AS k FROM orders),
parts(n, mark, own) AS (VALUES (1, 'a', false), (1, NULL, true), (2, NULL, false), (3, NULL, false))
SELECT k AS o_orderkey, o_orderstatus AS doc_who_key, CASE WHEN k % 7 <> 0 THEN o_custkey END AS doc_who_key_2,
       CASE WHEN k % 7 <> 0 THEN o_orderpriority END AS doc_who_more_priority, CAST(n AS INTEGER) AS doc_items_n,
       CASE WHEN own THEN o_orderstatus ELSE mark END AS doc_items_marks,
       CASE WHEN k % 2 = 0 THEN 'total' END AS attr_key, CASE WHEN k % 2 = 0 THEN o_totalprice END AS attr_value
FROM o JOIN parts ON k % 7 <> 0 AND k % 5 <> 0 AND k % 3 <> 0
UNION ALL
SELECT k, o_orderstatus, CASE WHEN k % 7 <> 0 THEN o_custkey END, CASE WHEN k % 7 <> 0 THEN o_orderpriority END, NULL, NULL,
       CASE WHEN k % 2 = 0 THEN 'total' END, CASE WHEN k % 2 = 0 THEN o_totalprice END
FROM o WHERE NOT (k % 7 <> 0 AND k % 5 <> 0 AND k % 3 <> 0)
""")(lambda spark, d: transform.flatten(_nested(spark, d)))


# ------------------------------------------------------------------ multiset difference

def _two_versions(spark, d):
    """Line items without their keys: repeated rows and nulls; the second version differs in some counts and values."""
    li = TB(spark, d, "lineitem").select(
        "l_linenumber", F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("flag"),
        (F.col("l_orderkey") % 50).alias("k"), "l_orderkey")
    a = li.drop("l_orderkey")
    other = F.when(F.col("l_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("flag"))
    b = li.filter("l_orderkey % 13 <> 0").withColumn("flag", other).drop("l_orderkey")
    return a, b


_VERSIONS = """
WITH li AS (SELECT l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS flag, l_orderkey % 50 AS k, l_orderkey FROM lineitem),
a AS (SELECT l_linenumber, flag, k FROM li),
b AS (SELECT l_linenumber, CASE WHEN l_orderkey % 11 <> 0 THEN flag END AS flag, k FROM li WHERE l_orderkey % 13 <> 0)
"""

register("r5_signed_difference", _VERSIONS + """
SELECT *, 'source_only' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT *, 'target_only' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
""")(lambda spark, d: reconcile.compare_rows(*_two_versions(spark, d)))

register("s12_difference_all_repeats", _VERSIONS + "SELECT * FROM a EXCEPT ALL SELECT * FROM b")(
    lambda spark, d: ordering.difference(*_two_versions(spark, d), keep_duplicates=True))


# ------------------------------------------------------------------ several medians

def _medians(spark, d):
    """Three medians beside other measures; one group holds a third of the rows, one measure is null in a group."""
    li = TB(spark, d, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 == 0, F.lit("hot")).when(F.col("l_linenumber") != 7, F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
        .alias("g"),
        "l_quantity", "l_extendedprice", F.when(F.col("l_returnflag") != "R", F.col("l_discount")).alias("l_discount"))
    return aggregate.aggregate(li, ["g"], {
        "rows": ("count", None), "quantity": ("median", "l_quantity"), "most": ("max", "l_quantity"),
        "price": ("median", "l_extendedprice"), "discount": ("median", "l_discount")}).select(
        "g", "rows", F.round("quantity", 6).alias("quantity"), "most", F.round("price", 6).alias("price"), F.round("discount", 6).alias("discount"))


register("e8_three_medians", """
WITH li AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' WHEN l_linenumber <> 7 THEN l_returnflag || l_linenumber END AS g,
                   l_quantity, l_extendedprice, CASE WHEN l_returnflag <> 'R' THEN l_discount END AS l_discount FROM lineitem)
SELECT g, count(*) AS rows, round(CAST(median(l_quantity) AS DOUBLE), 6) AS quantity, max(l_quantity) AS most,
       round(CAST(median(l_extendedprice) AS DOUBLE), 6) AS price, round(CAST(median(l_discount) AS DOUBLE), 6) AS discount
FROM li GROUP BY g
""")(_medians)


# ------------------------------------------------------------------ row hashes

def _ambiguous_rows(spark, d):
    """Values with separators and null marks inside: two splits of one text, a mark and a null, an empty text and a null."""
    s = TB(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("n"))
    mark = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    n, null = F.col("n"), F.lit(None).cast("string")
    pairs = [mark(F.concat(n, F.lit("|x")), F.lit("y")), mark(n, F.lit("x|y")), mark(n, F.lit("\\N")), mark(n, null),
             mark(n, F.lit("")), mark(n, F.lit("-")), mark(F.concat(n, F.lit("1:")), F.lit("z")), mark(n, F.lit("1:z"))]
    rows = s.select("s_suppkey", F.explode(F.array(*pairs)).alias("p")).select("s_suppkey", "p.*")
    from tessera import functions as fx
    return rows.withColumns({"md5": fx.row_hash("a", "b"), "sha": fx.row_hash("a", "b", algo="sha256")}).groupBy("s_suppkey").agg(
        F.count_distinct("md5").alias("md5s"), F.count_distinct("sha").alias("shas"))


register("h13_row_hash_of_separators", "SELECT s_suppkey, 8 AS md5s, 8 AS shas FROM supplier")(
    lambda spark, d: _ambiguous_rows(spark, d).select("s_suppkey", F.col("md5s").cast("int").alias("md5s"), F.col("shas").cast("int").alias("shas")))


# ------------------------------------------------------------------ sources and gates

def _reject_limits(spark, d):
    """Order lines as text, some prices no numbers: the reject count against a limit that holds and one that does not."""
    path = scratch_path(spark, "reject-limit")
    price = F.when(F.col("o_orderkey") % 97 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    TB(spark, d, "orders").select("o_orderkey", price.alias("o_totalprice")).write.option("header", True).csv(path)
    schema = spark.createDataFrame([], "o_orderkey long, o_totalprice double").schema
    _, bad = sources.read_with_rejects(spark, path, schema)
    n = sources.enforce_reject_limit(bad, 10**9)
    try:
        sources.enforce_reject_limit(bad, n - 1)
        outcome = "passed"
    except sources.RejectLimitExceeded as e:
        outcome = str(e)
    return spark.createDataFrame([(n, outcome)], "rejects long, at_one_less string")


register("a4_reject_limit", """
SELECT count(*) AS rejects, 'reject limit ' || (count(*) - 1) || ' exceeded' AS at_one_less FROM orders WHERE o_orderkey % 97 = 0
""")(_reject_limits)


def _generated(spark, d):
    """As many rows as there are customers, numbered from 10 in steps of 3."""
    n = TB(spark, d, "customer").count()
    return sources.generate_rows(spark, n, {"square": F.col("row_id") * F.col("row_id"), "label": F.concat(F.lit("row "), F.col("row_id"))}, 10, 3)


register("a9_generated_rows", """
WITH r AS (SELECT 10 + 3 * (row_number() OVER () - 1) AS row_id FROM customer)
SELECT row_id, row_id * row_id AS square, 'row ' || row_id AS label FROM r
""")(_generated)

register("a10_literal_rows", """
SELECT c_custkey, c_mktsegment, rank, label FROM customer
LEFT JOIN (VALUES ('BUILDING', 1, 'first'), ('MACHINERY', 2, NULL)) AS v(segment, rank, label) ON c_mktsegment = segment
""")(lambda spark, d: joins.join_stage(
    TB(spark, d, "customer").select("c_custkey", "c_mktsegment"),
    sources.rows(spark, [("BUILDING", 1, "first"), ("MACHINERY", 2, None)], "segment string, rank int, label string"),
    [("c_mktsegment", "segment")], "left").select("c_custkey", "c_mktsegment", "rank", "label"))


def _attached(spark, d):
    """Job files from suppliers, named in cases: each case gets its file's body, a case of a missing file stays as it is."""
    path = scratch_path(spark, "job-files")
    job = F.concat(F.lit("<Job Identifier=\"job_"), F.col("s_suppkey").cast("string"), F.lit("\"/>"))
    TB(spark, d, "supplier").select(job.alias("value")).repartition(3).write.text(path)
    files = sources.read_whole_files(spark, path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    cases = files.select(F.concat(F.lit("Migrate file: "), name, F.lit(" please")).alias("question")).union(
        spark.createDataFrame([("Migrate file: missing.txt please",), ("No file",)], "question string"))
    got = sources.attach_file_body(cases, "question", files, r"file: (\S+)")
    return got.agg(F.sum(F.regexp_count("question", F.lit("<Job "))).cast("long").alias("jobs"),
                   F.count_if(F.col("attached").isNull()).alias("without"),
                   F.count_if(F.col("attached").isNull() & F.col("question").contains("<Job")).alias("wrong"),
                   F.count_if(F.col("attached").isNotNull() & ~F.col("question").startswith("Migrate file: part-")).alias("lost"))


register("a11_attached_files", "SELECT count(*) AS jobs, 2 AS without, 0 AS wrong, 0 AS lost FROM supplier")(
    lambda spark, d: _attached(spark, d).select("jobs", *[F.col(c).cast("int").alias(c) for c in ("without", "wrong", "lost")]))


def _gated(spark, d):
    """Customers behind a schema gate, with what a second gate refuses."""
    c = sources.require_columns(TB(spark, d, "customer"), ["c_custkey", "c_name"])
    try:
        sources.require_columns(c, ["c_name", "c_email", "c_phone2"])
        refused = "nothing"
    except sources.MissingColumns as e:
        refused = str(e)
    return c.select("c_custkey", F.lit(refused).alias("refused"))


register("a12_schema_gate", "SELECT c_custkey, 'missing columns: [''c_email'', ''c_phone2'']' AS refused FROM customer")(_gated)


# ------------------------------------------------------------------ catalog

def _table_name(path):
    return "tessera_" + path.rsplit("-", 1)[1]


def _statistics(spark, d):
    """What ANALYZE stored about a saved table, read back from the catalog."""
    name = _table_name(scratch_path(spark, "analyzed"))
    sinks.save_table(TB(spark, d, "supplier").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 10 != 0, F.col("s_acctbal"))), name)
    try:
        sinks.analyze(spark, name)
        sinks.analyze(spark, name, ["s_suppkey", "s_acctbal"])
        table = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
        rows = int(table["Statistics"].split(", ")[1].split(" ")[0])
        out = []
        for c in ("s_suppkey", "s_acctbal"):
            s = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE EXTENDED {name} {c}").collect()}
            out.append((c, rows, float(s["min"]), float(s["max"]), int(s["num_nulls"])))
    finally:
        spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(out, "column_name string, row_count long, low double, high double, nulls long")


register("b11_statistics_read_back", """
WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 <> 0 THEN s_acctbal END AS b FROM supplier)
SELECT 's_suppkey' AS column_name, count(*) AS row_count, CAST(min(s_suppkey) AS DOUBLE) AS low, CAST(max(s_suppkey) AS DOUBLE) AS high,
       count(*) - count(s_suppkey) AS nulls FROM s
UNION ALL SELECT 's_acctbal', count(*), CAST(min(b) AS DOUBLE), CAST(max(b) AS DOUBLE), count(*) - count(b) FROM s
""")(_statistics)


def _declared(spark, d):
    """A declared partitioned table, filled by name and read back with its number of partitions."""
    path = scratch_path(spark, "declared")
    name = _table_name(path)
    s = TB(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"))
    sinks.create_table(spark, name, s.schema, ["s_nationkey"])
    try:
        sinks.create_table(spark, name, s.schema, ["s_nationkey"])  # declared already: nothing happens
        s.write.mode("append").format("parquet").partitionBy("s_nationkey").saveAsTable(name)
        parts = spark.sql(f"SHOW PARTITIONS {name}").count()
        sources.read_table(spark, name).withColumn("partitions", F.lit(parts)).write.parquet(path)
    finally:
        spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(path).select("s_suppkey", "s_name", "s_nationkey", "partitions")


register("b12_declared_table", """
SELECT s_suppkey, s_name, CAST(s_nationkey AS INTEGER) AS s_nationkey, (SELECT CAST(count(DISTINCT s_nationkey) AS INTEGER) FROM supplier) AS partitions
FROM supplier
""")(_declared)


# ------------------------------------------------------------------ parameters, hints, caches

def _parameters(spark, d):
    """Job parameters name the table and bound the rows; one is overridden, the run date is a default."""
    p = transform.Params({"DIR": d, "TABLE": "customer", "LOW": 0, "RUN_DATE": "1996-03-01"})
    v = p.resolve({"TABLE": "orders", "LOW": 100_000})
    rows = spark.read.parquet(p.substitute("#DIR#/#TABLE#.parquet", v))
    return rows.filter((F.col("o_totalprice") > v["LOW"]) & (F.col("o_orderdate") < F.lit(v["RUN_DATE"]).cast("date"))).select(
        "o_orderkey", F.lit(v["RUN_DATE"]).alias("run_date"))


register("c9_parameters", """
SELECT o_orderkey, '1996-03-01' AS run_date FROM orders WHERE o_totalprice > 100000 AND o_orderdate < DATE '1996-03-01'
""")(_parameters)


def _threshold(spark, d):
    """A lookup of nations on both sides of the broadcast limit: the plan changes, the rows do not."""
    s = TB(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = TB(spark, d, "nation")
    before = spark.conf.get("tessera.broadcast.maxBytes", None)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    out = []
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only the checked hint decides
        for limit in ("10485760", "1"):
            spark.conf.set("tessera.broadcast.maxBytes", limit)
            j = joins.lookup(s, n, [("s_nationkey", "n_nationkey")], ["n_name"])
            text = plan_text(j, "simple")
            kind = "broadcast" if "BroadcastHashJoin" in text else "shuffle" if "SortMergeJoin" in text else "other"
            out.append(j.select("s_suppkey", "n_name", F.lit(limit).cast("long").alias("limit"), F.lit(kind).alias("join")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        spark.conf.unset("tessera.broadcast.maxBytes") if before is None else spark.conf.set("tessera.broadcast.maxBytes", before)
    return out[0].unionByName(out[1])


register("d10_broadcast_threshold", """
SELECT s_suppkey, n_name, l.lim AS "limit", l.kind AS "join" FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
CROSS JOIN (VALUES (CAST(10485760 AS BIGINT), 'broadcast'), (CAST(1 AS BIGINT), 'shuffle')) AS l(lim, kind)
""")(_threshold)


def _expectations(spark, d):
    """Expectations on customers that hold, with what they measured, and what the others say."""
    c = TB(spark, d, "customer").withColumn("name", F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")))
    held = quality.expect(c, min_rows=1, not_null=["c_custkey"])
    said = []
    for broken in ({"not_null": ["c_custkey", "name"]}, {"exact_rows": held["rows"] + 1}, {"min_rows": held["rows"] + 5, "not_null": ["name"]}):
        try:
            quality.expect(c, **broken)
            said.append("held")
        except quality.ExpectationFailed as e:
            said.append(str(e))
    return spark.createDataFrame([(held["rows"], held["null_c_custkey"], *said)],
                                 "rows long, nulls long, not_null string, exact string, both string")


register("v13_expectations", """
WITH t AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 10 = 0) AS e FROM customer)
SELECT n AS rows, CAST(0 AS BIGINT) AS nulls, e || ' null values in name' AS not_null, 'rows ' || n || ' != ' || (n + 1) AS exact,
       'rows ' || n || ' < ' || (n + 5) || '; ' || e || ' null values in name' AS both FROM t
""")(_expectations)


def _schemas(spark, d):
    """Suppliers against a changed copy: a column gone, one more, one of another type; with the row counts of both."""
    s = TB(spark, d, "supplier")
    t = s.drop("s_acctbal").withColumns({"s_suppkey": F.col("s_suppkey").cast("string"), "extra": F.lit(1)})
    found = spark.createDataFrame(reconcile.compare_schemas(s, t), "column_name string, source_type string, target_type string")
    counts = reconcile.compare_counts(s, t)
    return found.withColumns({c: counts.select(c).scalar() for c in ("source_count", "target_count")})


register("r4_compare_schemas", """
SELECT v.column_name, v.source_type, v.target_type, n AS source_count, n AS target_count
FROM (VALUES ('s_acctbal', 'double', NULL), ('s_suppkey', 'bigint', 'string'), ('extra', NULL, 'int')) AS v(column_name, source_type, target_type),
     (SELECT count(*) AS n FROM supplier)
""")(_schemas)


def _reused(spark, d):
    """Two actions over one cached frame: the second sees what the first computed, and the cache is released."""
    f = TB(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")).withColumn("stamp", F.expr("uuid()"))
    with layout.reused(f) as r:
        held = r.storageLevel.useMemory and r.storageLevel.useDisk
        one = {(x.o_custkey, x.stamp) for x in r.filter("o_custkey % 100 = 1").collect()}
        two = {(x.o_custkey, x.stamp) for x in r.filter("o_custkey % 100 = 1").collect()}
        customers = r.count()
    released = not (f.storageLevel.useMemory or f.storageLevel.useDisk)
    return spark.createDataFrame([(customers, held, one == two, released)], "customers long, held boolean, same boolean, released boolean")


register("u2_reused_frame", "SELECT count(DISTINCT o_custkey) AS customers, true AS held, true AS same, true AS released FROM orders")(_reused)


# ------------------------------------------------------------------ clustering and numbering

def _file_ranges(spark, d):
    """Files clustered by three columns against files sorted by the first: widths of their ranges of the other two."""
    o = TB(spark, d, "orders").select("o_custkey", "o_totalprice", F.datediff("o_orderdate", F.lit("1990-01-01")).alias("day"))
    cols = ["o_custkey", "o_totalprice", "day"]
    z = layout.cluster(o, cols, 16).withColumn("file", F.spark_partition_id())
    plain = o.repartitionByRange(16, "o_custkey").withColumn("file", F.spark_partition_id())
    width = lambda df: df.groupBy("file").agg(*[(F.max(c) - F.min(c)).alias(c) for c in cols]).agg(*[F.avg(c).alias(c) for c in cols])
    a, b = width(z), width(plain)
    narrower = lambda c: a.select(c).scalar() < 0.8 * b.select(c).scalar()
    return o.agg(F.count(F.lit(1)).alias("orders")).select(
        "orders", narrower("o_totalprice").alias("price_narrower"), narrower("day").alias("day_narrower"))


register("b10_zorder_file_ranges", "SELECT count(*) AS orders, true AS price_narrower, true AS day_narrower FROM orders")(_file_ranges)


def _mixed_order(spark, d):
    """Sequence, running sum and neighbours in an order of mixed directions with nulls, one group a third of all rows."""
    li = TB(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("l_returnflag")).alias("g"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("q"))
    order = [F.col("q").desc_nulls_first(), F.col("l_orderkey").asc(), F.col("l_linenumber").desc()]
    out = numbering.group_row_number(li, ["g"], order, "seq")
    out = numbering.running_sum(out, ["g"], order, "l_linenumber", "running")
    out = numbering.shifted(out, ["g"], order, "l_orderkey", "before", "lag")
    return numbering.shifted(out, ["g"], order, "l_orderkey", "after", "lead")


register("g1_g3_g7_mixed_directions", """
WITH li AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 <> 0 THEN l_returnflag END AS g,
                   CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, g, q, CAST(row_number() OVER w AS INTEGER) AS seq,
       CAST(sum(l_linenumber) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running,
       lag(l_orderkey) OVER w AS before, lead(l_orderkey) OVER w AS after
FROM li WINDOW w AS (PARTITION BY g ORDER BY q DESC NULLS FIRST, l_orderkey, l_linenumber DESC)
""")(_mixed_order)
