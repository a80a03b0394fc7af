"""Checked queries for the function library, transformer, join and aggregate
stages.  Every query reads the driver tables (whole tables) and has an
equivalent DuckDB SQL with the same column names and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import functions as fx
from tessera.operators import aggregate as agg
from tessera.operators import joins, matching, transform
from tessera.plans import fixtures
from tessera.plans.catalog import register

T = fixtures.table
RUN = fixtures.RUN_DATE


# ------------------------------------------------------------------ functions

def _f_strings(spark, d):
    c = T(spark, d, "customer")
    k = F.col("c_custkey")
    maybe = F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment"))
    return c.select(
        "c_custkey",
        fx.trim(F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).alias("f_trim"),
        fx.upcase("c_mktsegment").alias("f_upcase"),
        fx.downcase("c_name").alias("f_downcase"),
        fx.length("c_name").alias("f_len"),
        fx.cat(F.col("c_name"), F.lit("/"), maybe).alias("f_cat"),
        fx.cat_sep("|", F.col("c_name"), maybe).alias("f_cat_sep"),
        fx.field("c_name", "#", 2).alias("f_field"),
        fx.index("c_name", "0", 1).alias("f_index1"),
        fx.index("c_name", "0", 2).alias("f_index2"),
        fx.substr("c_name", 3, 5).alias("f_substr"),
        fx.digits_only("c_name").alias("f_digits"),
        fx.letters_only("c_name").alias("f_letters"),
    )


register("f01_f10_string_functions", """
SELECT c_custkey, trim('  ' || c_name || ' ') AS f_trim, upper(c_mktsegment) AS f_upcase,
       lower(c_name) AS f_downcase, CAST(length(c_name) AS INTEGER) AS f_len,
       c_name || '/' || CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS f_cat,
       concat_ws('|', c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END) AS f_cat_sep,
       split_part(c_name, '#', 2) AS f_field,
       CAST(instr(c_name, '0') AS INTEGER) AS f_index1,
       CAST(CASE WHEN instr(c_name, '0') = 0 OR instr(substr(c_name, instr(c_name, '0') + 1), '0') = 0 THEN 0
            ELSE instr(c_name, '0') + instr(substr(c_name, instr(c_name, '0') + 1), '0') END AS INTEGER) AS f_index2,
       substr(c_name, 3, 5) AS f_substr,
       regexp_replace(c_name, '[^0-9]', '', 'g') AS f_digits,
       regexp_replace(c_name, '[^A-Za-z ]', '', 'g') AS f_letters
FROM customer
""")(_f_strings)


def _f_hashes(spark, d):
    c = fixtures.customers_raw(spark, d)
    return c.select("CustomerID",
                    fx.checksum("FirstName", "LastName", "Email").alias("checksum"),
                    fx.row_hash("CustomerID", "Email", "Status").alias("row_md5"),
                    fx.row_hash("CustomerID", "Email", "Status", algo="sha256").alias("row_sha256"))


_RAW_CUSTOMERS_SQL = """
WITH raw AS (
  SELECT CAST(c_custkey AS INTEGER) AS CustomerID,
         '  ' || split_part(c_name, '#', 1) AS FirstName,
         split_part(c_name, '#', 2) AS LastName,
         CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE ' ' || c_name || '@Example.COM ' END AS Email,
         CASE WHEN c_custkey % 97 = 0 THEN DATE '2000-02-29'
              ELSE CAST(DATE '1950-01-01' + CAST((c_custkey * 37) % 20000 AS INTEGER) AS DATE) END AS BirthDate,
         CASE c_custkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'INACTIVE' WHEN 2 THEN NULL
              WHEN 3 THEN 'blocked' ELSE ' Active ' END AS Status,
         CAST(DATE '2015-01-01' + CAST(c_custkey % 3000 AS INTEGER) AS DATE) AS RegistrationDate
  FROM customer)
"""

register("f09_h13_checksum_row_hash", _RAW_CUSTOMERS_SQL + r"""
SELECT CustomerID, md5(concat_ws('|', FirstName, LastName, Email)) AS checksum, md5(t) AS row_md5, sha256(t) AS row_sha256
FROM (SELECT *, coalesce(length(CAST(CustomerID AS VARCHAR)) || ':' || CustomerID, '-') || coalesce(length(Email) || ':' || Email, '-')
                || coalesce(length(Status) || ':' || Status, '-') AS t FROM raw)
""")(_f_hashes)


def _f_levenshtein(spark, d):
    p = T(spark, d, "part")
    return p.select("p_partkey", fx.levenshtein("p_name", "p_type").alias("dist"),
                    fx.levenshtein("p_name", "p_type", 5).alias("dist_upto5"))


register("f11_levenshtein", """
SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS dist,
       CAST(CASE WHEN levenshtein(p_name, p_type) > 5 THEN -1 ELSE levenshtein(p_name, p_type) END AS INTEGER)
         AS dist_upto5
FROM part
""")(_f_levenshtein)

register("f11_soundex", r"""
WITH w AS (SELECT c_custkey, upper(regexp_replace(c_name, '[^A-Za-z]', '', 'g')) AS w FROM customer),
c AS (SELECT c_custkey, w, list_filter(
        [translate(substr(w, i, 1), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000099') for i in range(1, length(w) + 1)],
        lambda x: x <> '9') AS cs FROM w),
r AS (SELECT c_custkey, w, list_filter([CASE WHEN cs[i] <> cs[i - 1] THEN cs[i] ELSE '0' END for i in range(2, len(cs) + 1)],
                                       lambda x: x <> '0') AS ds FROM c)
SELECT c_custkey, substr(w[1] || array_to_string(ds, '') || '000', 1, 4) AS code FROM r
""")(lambda spark, d: T(spark, d, "customer").select(
    "c_custkey", fx.soundex(fx.letters_only("c_name")).alias("code")))


def _f_json(spark, d):
    e = T(spark, d, "events")
    return e.select("event_id", fx.json_field("props", "$.k").cast("int").alias("k"),
                    F.from_json("props", "k INT")["k"].alias("k_struct"))


register("f12_json_field", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k_struct
FROM events
""")(_f_json)


def _f_flatten(spark, d):
    o = T(spark, d, "orders")
    doc = F.to_json(F.array(
        F.struct(F.lit("total").alias("kind"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("v")),
        F.struct(F.lit("customer").alias("kind"), F.col("o_custkey").cast("string").alias("v"))))
    j = o.select("o_orderkey", doc.alias("doc"))
    return j.select("o_orderkey", F.inline(F.from_json("doc", "array<struct<kind:string,v:string>>")))


register("f14_flatten_json", """
SELECT o_orderkey, 'total' AS kind, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS v FROM orders
UNION ALL
SELECT o_orderkey, 'customer' AS kind, CAST(o_custkey AS VARCHAR) AS v FROM orders
""")(_f_flatten)


def _f_xml(spark, d):
    # a small file is one task, and parsing takes far longer than reading: rows are dealt out to all tasks first
    p = T(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    xml = F.concat(F.lit("<part><key>"), F.col("p_partkey").cast("string"), F.lit("</key><name>"),
                   F.col("p_name"), F.lit("</name><brand>"), F.col("p_brand"), F.lit("</brand></part>"))
    x = p.select(xml.alias("x"))
    return x.select(F.xpath_long("x", F.lit("/part/key")).alias("p_partkey"),
                    fx.xml_field("x", "/part/name").alias("x_name"),
                    fx.xml_values("x", "/part/brand/text()")[0].alias("x_brand"))


register("f13_xml_field", "SELECT p_partkey, p_name AS x_name, p_brand AS x_brand FROM part")(_f_xml)


def _f_loop(spark, d):
    p = T(spark, d, "part")
    return p.select("p_partkey", F.posexplode(fx.loop_values("p_name", " ")).alias("pos", "token"))


register("f15_loop_values", """
SELECT p_partkey, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS pos, unnest(arr) AS token
FROM (SELECT p_partkey, string_split(p_name, ' ') AS arr FROM part)
""")(_f_loop)


def _f_dates(spark, d):
    o = T(spark, d, "orders")
    od = F.to_date("o_orderdate")
    return o.select(
        "o_orderkey",
        fx.current_date(RUN).alias("run_date"),
        fx.years_from_date(od, RUN).alias("years"),
        F.round(fx.months_from_date(od, RUN), 6).alias("months"),
        fx.days_since(od, RUN).alias("days"),
        fx.date_from_days_since(F.col("o_orderkey") % 20000).alias("from_days"),
        fx.date_to_string(od).alias("as_text"),
        fx.year(od).alias("y"), fx.month(od).alias("m"), fx.day(od).alias("dd"),
        fx.day_name(od).alias("day_name"),
        fx.is_weekend(od).alias("weekend"),
        fx.date_diff(F.lit(RUN).cast("date"), od).alias("diff"),
    )


register("f16_f25_date_functions", """
SELECT o_orderkey, DATE '2024-01-15' AS run_date,
       CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '2024-01-15') AS INTEGER) AS years,
       round((2024 - year(o_orderdate)) * 12 + (1 - month(o_orderdate))
             + CAST(15 - day(o_orderdate) AS DOUBLE) / 31.0, 6) AS months,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-01-15') AS INTEGER) AS days,
       CAST(DATE '1967-12-31' + CAST(o_orderkey % 20000 AS INTEGER) AS DATE) AS from_days,
       strftime(o_orderdate, '%Y-%m-%d') AS as_text,
       CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
       CAST(day(o_orderdate) AS INTEGER) AS dd,
       dayname(o_orderdate) AS day_name,
       CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 1 ELSE 0 END AS weekend,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-01-15') AS INTEGER) AS diff
FROM orders
""")(_f_dates)


def _f_logic(spark, d):
    c = T(spark, d, "customer")
    k = F.col("c_custkey")
    x = F.when(k % 4 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal"))
    return c.select(
        "c_custkey",
        fx.is_null(x).alias("x_is_null"),
        fx.is_not_null(x).alias("x_not_null"),
        fx.set_null("int").alias("nothing"),
        F.round(fx.null_to_value(x, 0.0), 2).alias("x_or_zero"),
        fx.if_then_else((x.isNull(), "none"), (x < 0, "negative"), (x < 5000, "low"), otherwise="high").alias("band"),
        fx.mod(k, k % 5).alias("k_mod"),
        F.round(fx.abs_("c_acctbal"), 2).alias("abs_bal"),
        F.round(fx.sqrt(fx.abs_("c_acctbal")), 6).alias("sqrt_bal"),
        ((k > 100) & (k % 2 == 0) | ~(F.col("c_mktsegment") != "BUILDING")).alias("logic"),
        F.round(fx.clamp_non_negative(x), 2).alias("clamped"),
        (F.col("c_acctbal") * 2).cast("decimal(18,2)").alias("times_two"),
    )


register("f26_f32_f36_null_logic_math", """
WITH c AS (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS x FROM customer)
SELECT c_custkey, x IS NULL AS x_is_null, x IS NOT NULL AS x_not_null, CAST(NULL AS INTEGER) AS nothing,
       round(coalesce(x, 0.0), 2) AS x_or_zero,
       CASE WHEN x IS NULL THEN 'none' WHEN x < 0 THEN 'negative' WHEN x < 5000 THEN 'low' ELSE 'high' END AS band,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % (c_custkey % 5) END AS k_mod,
       round(abs(c_acctbal), 2) AS abs_bal, round(sqrt(abs(c_acctbal)), 6) AS sqrt_bal,
       (c_custkey > 100 AND c_custkey % 2 = 0) OR NOT (c_mktsegment <> 'BUILDING') AS logic,
       round(CASE WHEN x IS NULL OR x < 0 THEN 0 ELSE x END, 2) AS clamped,
       CAST(c_acctbal * 2 AS DECIMAL(18,2)) AS times_two
FROM c
""")(_f_logic)


def _f_convert(spark, d):
    t = fixtures.transactions_raw(spark, d)
    return t.select(
        F.col("_event_id").alias("event_id"),
        fx.convert_to_numeric("Amount").alias("amount_num"),
        fx.convert_to_numeric("Amount", 18, 2).alias("amount_num2"),
        fx.string_to_date(fx.trim("TransactionDate"), "%yyyy-%mm-%dd").alias("tx_date"),
        fx.to_string(fx.convert_to_numeric("Amount", 18, 2)).alias("amount_text"),
        fx.to_string(F.col("_event_id")).alias("id_text"),
        fx.to_string(fx.string_to_date(fx.trim("TransactionDate"))).alias("date_text"),
    )


register("f33_f35_conversions", """
WITH t AS (
  SELECT event_id,
         CASE WHEN event_id % 31 = 0 THEN 'abc' WHEN event_id % 29 = 0 THEN '0.001'
              WHEN event_id % 23 = 0 THEN '2000000' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS Amount,
         CASE WHEN event_id % 37 = 0 THEN '2024-13-45' ELSE strftime(ts, '%Y-%m-%d') END AS TransactionDate
  FROM events)
SELECT event_id, TRY_CAST(trim(Amount) AS DECIMAL(18,4)) AS amount_num,
       TRY_CAST(trim(Amount) AS DECIMAL(18,2)) AS amount_num2,
       CAST(try_strptime(trim(TransactionDate), '%Y-%m-%d') AS DATE) AS tx_date,
       CAST(TRY_CAST(trim(Amount) AS DECIMAL(18,2)) AS VARCHAR) AS amount_text,
       CAST(event_id AS VARCHAR) AS id_text,
       CAST(CAST(try_strptime(trim(TransactionDate), '%Y-%m-%d') AS DATE) AS VARCHAR) AS date_text
FROM t
""")(_f_convert)

def _salt_uuid(spark, d):
    t = T(spark, d, "lineitem").select(fx.salt(16, "l_orderkey", "l_linenumber").alias("salt"), fx.uuid_key().alias("uuid"))
    # every salt in use, none outside 0..15, about evenly; every uuid different and well formed
    per = t.groupBy("salt").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("uuid") == 36).alias("ok"))
    salts = per.agg(F.sum("n").alias("n"), F.min("salt").cast("int").alias("low"), F.max("salt").cast("int").alias("high"),
                    (F.max("n") < F.min("n") * 2).alias("even"), F.sum("ok").alias("well_formed"))
    return salts.withColumn("different", t.select("uuid").distinct().agg(F.count(F.lit(1))).scalar())


register("f37_f38_salt_uuid", """
SELECT count(*) AS n, 0 AS low, 15 AS high, true AS even, count(*) AS well_formed, count(*) AS different FROM lineitem
""")(_salt_uuid)


# ------------------------------------------------------------------ transformer stage

def _c_derive_constrain(spark, d):
    li = T(spark, d, "lineitem")
    out = transform.derive(li, {
        "revenue": (F.col("l_extendedprice").cast("decimal(18,2)") *
                    (F.lit(1) - F.col("l_discount").cast("decimal(18,2)"))).cast("decimal(18,2)"),
        "ship_year": fx.year("l_shipdate"),
    }, keep=["l_orderkey", "l_linenumber", "l_returnflag", "revenue", "ship_year", "l_shipdate", "l_quantity"])
    return transform.constrain(out, [
        F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"),
        F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"),
        F.col("l_returnflag").isin("R", "A"),
        F.col("l_quantity") > 10,
    ]).drop("l_shipdate", "l_quantity")


register("c1_c3_c7_c8_derive_constrain", """
SELECT l_orderkey, l_linenumber, l_returnflag,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,2))
         AS revenue,
       CAST(year(l_shipdate) AS INTEGER) AS ship_year
FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
  AND l_returnflag IN ('R', 'A') AND l_quantity > 10
""")(_c_derive_constrain)


def _c_stage_vars(spark, d):
    o = T(spark, d, "orders")
    return transform.derive_staged(o, {
        "sv_price": F.col("o_totalprice").cast("decimal(18,2)"),
        "sv_big": F.col("sv_price") > 200000,
    }, outputs={"price_band": F.when(F.col("sv_big"), "BIG").otherwise("SMALL"),
                "price_k": (F.col("sv_price") / 1000).cast("decimal(18,5)")}).select(
        "o_orderkey", "price_band", "price_k")


register("c4_stage_variables", """
SELECT o_orderkey, CASE WHEN CAST(o_totalprice AS DECIMAL(18,2)) > 200000 THEN 'BIG' ELSE 'SMALL' END AS price_band,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) / 1000 AS DECIMAL(18,5)) AS price_k
FROM orders
""")(_c_stage_vars)


def _route_links():
    return {"high_value": F.col("o_totalprice") > 200000,
            "urgent": F.col("o_orderpriority") == "1-URGENT",
            "open": F.col("o_orderstatus") == "O"}


register("c5_route_all_links", """
SELECT o_orderkey, 'high_value' AS link FROM orders WHERE o_totalprice > 200000
UNION ALL SELECT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT o_orderkey, 'open' FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, 'otherwise' FROM orders
  WHERE NOT (o_totalprice > 200000 OR o_orderpriority = '1-URGENT' OR o_orderstatus = 'O')
""")(lambda spark, d: transform.route_union(T(spark, d, "orders"), _route_links()).select("o_orderkey", "link"))

register("c5_route_exclusive", """
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high_value' WHEN o_orderpriority = '1-URGENT' THEN 'urgent'
                        WHEN o_orderstatus = 'O' THEN 'open' ELSE 'otherwise' END AS link
FROM orders
""")(lambda spark, d: transform.route_union(T(spark, d, "orders"), _route_links(), exclusive=True)
     .select("o_orderkey", "link"))


def _route_dict_sizes(spark, d):
    outs = transform.route(T(spark, d, "orders"), _route_links(), exclusive=True)
    parts = [df.select(F.lit(n).alias("link"), "o_orderkey") for n, df in outs.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("link").agg(F.count(F.lit(1)).alias("records"))


register("c5_route_outputs", """
SELECT CASE WHEN o_totalprice > 200000 THEN 'high_value' WHEN o_orderpriority = '1-URGENT' THEN 'urgent'
            WHEN o_orderstatus = 'O' THEN 'open' ELSE 'otherwise' END AS link, count(*) AS records
FROM orders GROUP BY 1
""")(_route_dict_sizes)

register("c6_classify", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'LARGE' WHEN o_totalprice >= 100000 THEN 'MEDIUM'
                        ELSE 'SMALL' END AS size_class
FROM orders
""")(lambda spark, d: transform.classify(T(spark, d, "orders"), "size_class", [
    (F.col("o_totalprice") >= 300000, "LARGE"), (F.col("o_totalprice") >= 100000, "MEDIUM")], "SMALL")
     .select("o_orderkey", "size_class"))

register("c10_audit_columns", """
SELECT o_orderkey, TIMESTAMP '2024-01-15 14:30:00' AS process_ts, 'order_load' AS job_name, 'run-0001' AS run_id,
       'etl' AS processed_by
FROM orders
""")(lambda spark, d: transform.with_audit(T(spark, d, "orders").select("o_orderkey"), "order_load", "run-0001",
                                           fixtures.RUN_TS, "etl"))


# ------------------------------------------------------------------ joins and lookups

def _orders_customers(spark, d, how="inner", hint=None):
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = T(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return joins.join_stage(o, c, [("o_custkey", "c_custkey")], how, hint=hint)


register("d1_d7_inner_join_named_keys", """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_name, c.c_mktsegment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")(lambda spark, d: _orders_customers(spark, d))

register("d11_shuffle_merge_join", """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_name, c.c_mktsegment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")(lambda spark, d: _orders_customers(spark, d, hint="shuffle_merge"))


def _left_composite(spark, d):
    li = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    ret = (T(spark, d, "lineitem").filter(F.col("l_returnflag") == "R")
           .select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("r_suppkey")))
    return joins.join_stage(li, ret, ["l_orderkey", "l_linenumber"], "left")


register("d2_left_join_composite_key", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, r.l_suppkey AS r_suppkey
FROM lineitem l LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') r
  ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber
""")(_left_composite)


def _cust_side(spark, d):
    # every fifth customer is left out by key, so that the joins have misses
    return T(spark, d, "customer").filter(F.col("c_custkey") % 5 != 0).select(
        F.col("c_custkey").alias("custkey"), "c_name")


def _order_side(spark, d):
    return T(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey")


register("d3_right_join", """
SELECT o.custkey, c.c_name, o.o_orderkey
FROM (SELECT c_custkey AS custkey, c_name FROM customer WHERE c_custkey % 5 <> 0) c
RIGHT JOIN (SELECT o_custkey AS custkey, o_orderkey FROM orders) o
  ON c.custkey = o.custkey
""")(lambda spark, d: joins.join_stage(_cust_side(spark, d), _order_side(spark, d), ["custkey"], "right"))

register("d4_full_outer_join", """
SELECT coalesce(c.custkey, o.custkey) AS custkey, c.c_name, o.o_orderkey
FROM (SELECT c_custkey AS custkey, c_name FROM customer WHERE c_custkey % 5 <> 0) c
FULL OUTER JOIN (SELECT o_custkey AS custkey, o_orderkey FROM orders) o
  ON c.custkey = o.custkey
""")(lambda spark, d: joins.join_stage(_cust_side(spark, d), _order_side(spark, d), ["custkey"], "full"))


def _join_many(spark, d):
    li = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    o = T(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = T(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = T(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    r = T(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    out = joins.join_many(li, [(o, ["l_orderkey"], "inner"), (c, ["o_custkey"], "inner"),
                               (n, ["c_nationkey"], "inner"), (r, ["n_regionkey"], "inner")])
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "n_name", "r_name")


register("d5_multi_way_join", """
SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, n.n_name, r.r_name
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""")(_join_many)


def _join_rejects(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = T(spark, d, "customer").filter(F.col("c_custkey") % 10 != 0).select("c_custkey", "c_name")
    res = joins.join_stage(o, c, [("o_custkey", "c_custkey")], "inner", rejects=("left", "right"))
    a = res["out"].select(F.lit("out").alias("link"), "o_orderkey", F.col("o_custkey").alias("custkey"))
    b = res["left_rejects"].select(F.lit("left_rejects").alias("link"), "o_orderkey",
                                   F.col("o_custkey").alias("custkey"))
    r = res["right_rejects"].select(F.lit("right_rejects").alias("link"), F.lit(None).cast("long").alias("o_orderkey"),
                                    F.col("c_custkey").alias("custkey"))
    return a.unionByName(b).unionByName(r)


register("d6_join_reject_links", """
WITH c AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 0)
SELECT 'out' AS link, o.o_orderkey, o.o_custkey AS custkey FROM orders o JOIN c ON o.o_custkey = c.c_custkey
UNION ALL
SELECT 'left_rejects', o.o_orderkey, o.o_custkey FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.c_custkey = o.o_custkey)
UNION ALL
SELECT 'right_rejects', CAST(NULL AS BIGINT), c.c_custkey FROM c
  WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
""")(_join_rejects)


def _lookup(spark, d):
    li = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("ProductID"))
    return joins.lookup(li, fixtures.products_input(spark, d), ["ProductID"],
                        ["ProductName", "Category", "UnitPrice"],
                        defaults={"ProductName": "UNKNOWN", "Category": "UNCATEGORIZED", "UnitPrice": 0},
                        match_col="matched")


register("d8_d9_lookup_defaults", """
WITH p AS (SELECT p_partkey AS ProductID, p_name AS ProductName,
                  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS Category,
                  CAST(p_retailprice AS DECIMAL(10,2)) AS UnitPrice
           FROM part WHERE p_partkey % 7 <> 0)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey AS ProductID,
       CASE WHEN p.ProductID IS NULL THEN 'UNKNOWN' ELSE p.ProductName END AS ProductName,
       CASE WHEN p.ProductID IS NULL THEN 'UNCATEGORIZED' ELSE p.Category END AS Category,
       CASE WHEN p.ProductID IS NULL THEN CAST(0 AS DECIMAL(10,2)) ELSE p.UnitPrice END AS UnitPrice,
       p.ProductID IS NOT NULL AS matched
FROM lineitem l LEFT JOIN p ON l.l_partkey = p.ProductID
""")(_lookup)


def _lookup_reject(spark, d):
    li = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("ProductID"))
    good, bad = joins.lookup(li, fixtures.products_input(spark, d), ["ProductID"], ["ProductName"],
                             failure="reject")
    return good.select(F.lit("matched").alias("link"), "l_orderkey", "l_linenumber").unionByName(
        bad.select(F.lit("rejected").alias("link"), "l_orderkey", "l_linenumber"))


register("d8_lookup_reject_link", """
SELECT CASE WHEN l_partkey % 7 <> 0 THEN 'matched' ELSE 'rejected' END AS link, l_orderkey, l_linenumber
FROM lineitem
""")(_lookup_reject)


def _salted(spark, d):
    li = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = T(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    # salt and replicate only keys holding at least 0.1% of the lines
    return joins.salted_join(li, p, ["l_partkey"], "inner", salts=8, hot=joins.hot_keys(li, ["l_partkey"], 0.001))


register("d12_salted_join", """
SELECT l.l_partkey, l.l_orderkey, l.l_linenumber, p.p_name
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
""")(_salted)


# ------------------------------------------------------------------ fuzzy matching

def words(df, col: str):
    """Distinct lower-case ASCII-letter words."""
    w = df.select(F.explode(F.split(F.lower(F.col(col)), "[^a-z]+")).alias("word"))
    return w.filter(F.col("word") != "").distinct()


WORDS_SQL = """
SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(lower({col}), '[^a-z]+')) AS w FROM {table})
WHERE w <> ''
"""


def _fuzzy_dups(spark, d):
    conv = T(spark, d, "conversations")
    return matching.fuzzy_pairs(words(conv, "text"), "word", max_dist=2)


register("v15_fuzzy_duplicates", f"""
WITH w AS ({WORDS_SQL.format(col='text', table='conversations')})
SELECT a.word AS left_value, b.word AS right_value, CAST(levenshtein(a.word, b.word) AS INTEGER) AS distance
FROM w a, w b WHERE a.word < b.word AND levenshtein(a.word, b.word) <= 2
""")(_fuzzy_dups)


def _fuzzy_match(spark, d):
    bench = words(T(spark, d, "benchmark"), "text")
    conv = words(T(spark, d, "conversations"), "text")
    return matching.fuzzy_pairs(bench, "word", conv, "word", max_dist=2)


register("d13_fuzzy_match_two_sources", f"""
WITH a AS ({WORDS_SQL.format(col='text', table='benchmark')}),
     b AS ({WORDS_SQL.format(col='text', table='conversations')})
SELECT a.word AS left_value, b.word AS right_value, CAST(levenshtein(a.word, b.word) AS INTEGER) AS distance
FROM a, b WHERE levenshtein(a.word, b.word) <= 2
""")(_fuzzy_match)


# ------------------------------------------------------------------ aggregation

def _stats_median(spark, d):
    li = T(spark, d, "lineitem")
    sd = agg.aggregate(li, ["l_returnflag"], {"qty_stddev": F.round(agg.agg_expr("stddev", "l_quantity"), 6)})
    # both medians in one distributed pass: unpivot, then one percentile per (flag, column)
    long = agg.unpivot(li.select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"],
                       ["l_quantity", "l_extendedprice"], "column_name", "v")
    med = agg.exact_percentile(long, ["l_returnflag", "column_name"], "v", 0.5, "m")
    wide = med.groupBy("l_returnflag").agg(
        F.round(F.max(F.when(F.col("column_name") == "l_quantity", F.col("m"))), 6).alias("qty_median"),
        F.round(F.max(F.when(F.col("column_name") == "l_extendedprice", F.col("m"))), 6).alias("price_median"))
    return sd.join(wide, "l_returnflag")


register("e7_e8_stddev_median", """
SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS qty_stddev,
       round(CAST(quantile_cont(l_quantity, 0.5) AS DOUBLE), 6) AS qty_median,
       round(CAST(quantile_cont(l_extendedprice, 0.5) AS DOUBLE), 6) AS price_median
FROM lineitem GROUP BY l_returnflag
""")(_stats_median)

register("e9_distinct_count", """
SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY l_returnflag
""")(lambda spark, d: agg.aggregate(T(spark, d, "lineitem"), ["l_returnflag"], {
    "parts": ("count_distinct", "l_partkey"), "suppliers": ("count_distinct", "l_suppkey")}))

register("e9_distinct_rows", """
SELECT count(*) AS distinct_count FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
""")(lambda spark, d: agg.distinct_count(T(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]))

register("e10_having", """
SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
FROM orders GROUP BY o_custkey HAVING count(*) > 15
""")(lambda spark, d: agg.aggregate(
    T(spark, d, "orders").withColumn("p", F.col("o_totalprice").cast("decimal(18,2)")), ["o_custkey"],
    {"orders": ("count", None), "total": ("sum", "p")}, having=F.col("orders") > 15))


def _days_between(spark, d):
    o = T(spark, d, "orders").withColumn("od", F.to_date("o_orderdate"))
    a = agg.aggregate(o, ["o_custkey"], {"first_order": ("min", "od"), "last_order": ("max", "od")})
    return transform.derive(a, {"active_days": fx.date_diff("last_order", "first_order")})


register("e5_e11_first_last_days", """
SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_order, max(CAST(o_orderdate AS DATE)) AS last_order,
       CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS INTEGER) AS active_days
FROM orders GROUP BY o_custkey
""")(_days_between)

register("e12_global_aggregate", """
SELECT count(*) AS line_count, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total_qty,
       round(avg(l_extendedprice), 4) AS avg_price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
FROM lineitem
""")(lambda spark, d: agg.aggregate(T(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("decimal(18,2)")),
                                    [], {"line_count": ("count", None), "total_qty": ("sum", "q"),
                                         "avg_price": F.round(F.avg("l_extendedprice"), 4),
                                         "first_ship": ("min", "l_shipdate"), "last_ship": ("max", "l_shipdate")}))

register("e13_frequencies", """
SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderpriority
""")(lambda spark, d: agg.frequencies(T(spark, d, "orders"), "o_orderpriority"))

register("e14_pivot", """
SELECT o_orderpriority,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DECIMAL(28,2)) AS "F",
       CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DECIMAL(28,2)) AS "O",
       CAST(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DECIMAL(28,2)) AS "P"
FROM orders GROUP BY o_orderpriority
""")(lambda spark, d: agg.pivot(T(spark, d, "orders").withColumn("p", F.col("o_totalprice").cast("decimal(18,2)")),
                                ["o_orderpriority"], "o_orderstatus", F.sum("p"), ["F", "O", "P"]))

register("e15_unpivot", """
SELECT l_orderkey, l_linenumber, name, value FROM (
  SELECT l_orderkey, l_linenumber, 'l_quantity' AS name, l_quantity AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem)
""")(lambda spark, d: agg.unpivot(T(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"],
                                  ["l_quantity", "l_discount", "l_tax"]))

register("e1_e16_grouped_ordered", """
SELECT l_returnflag, l_linestatus, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS qty,
       min(l_discount) AS min_disc, max(l_discount) AS max_disc, CAST(count(*) FILTER (WHERE l_tax > 0.04) AS BIGINT) AS taxed
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")(lambda spark, d: agg.aggregate(
    T(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("decimal(18,2)")), ["l_returnflag", "l_linestatus"],
    {"lines": ("count", None), "qty": ("sum", "q"), "min_disc": ("min", "l_discount"),
     "max_disc": ("max", "l_discount"), "taxed": ("count_if", F.col("l_tax") > 0.04)}, order=True))
