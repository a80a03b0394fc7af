"""Checked queries of keyed loads: null keys, keys that move, repeated keys, buckets, watermarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import merge
from tessera.plans import fixtures
from tessera.plans.catalog import register
from tessera.session import scratch_path
from tessera.streaming import stages as streaming


def TB(spark, d, name):
    return fixtures.table(spark, d, name)


# ------------------------------------------------------------------ null keys

def _named(spark, d):
    """Customers whose key is null for one of them."""
    c = TB(spark, d, "customer")
    return c.select(F.when(F.col("c_custkey") != 7, F.col("c_custkey")).alias("k"), F.col("c_name").alias("name"),
                    F.col("c_nationkey").alias("nation"))


def _renamed(spark, d):
    """Changes of every third customer and of the null key, and new customers."""
    n = _named(spark, d).filter(F.col("k").isNull() | (F.col("k") % 3 == 0))
    new = _named(spark, d).filter((F.col("k") % 3 == 0) & (F.col("k") > 0)).select(-F.col("k"), "name", "nation")
    return n.withColumn("name", F.lit("new")).union(new)


_NAMED = "SELECT CASE WHEN c_custkey <> 7 THEN c_custkey END AS k, c_name AS name, c_nationkey AS nation, c_custkey = 7 OR c_custkey % 3 = 0 AS hit FROM customer"

register("b15_null_keys", f"""
WITH c AS ({_NAMED})
SELECT k, CASE WHEN hit THEN 'new' ELSE name END AS name, nation FROM c
UNION ALL SELECT -k, name, nation FROM c WHERE hit AND k > 0
""")(lambda spark, d: merge.upsert(_named(spark, d), _renamed(spark, d), ["k"]))

register("b14_null_keys", f"WITH c AS ({_NAMED}) SELECT k, CASE WHEN hit THEN 'new' ELSE name END AS name, nation FROM c")(
    lambda spark, d: merge.update_by_keys(_named(spark, d), _renamed(spark, d), ["k"], ["name"]))

register("b16_null_keys", f"WITH c AS ({_NAMED}) SELECT k, name, nation FROM c WHERE NOT hit")(
    lambda spark, d: merge.delete_by_keys(_named(spark, d), _renamed(spark, d), ["k"]))


# ------------------------------------------------------------------ keys that move

def _by_nation(spark, d):
    """Customers partitioned by nation, every seventh without one."""
    return TB(spark, d, "customer").select(
        "c_custkey", F.lit(1).alias("seq"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey").cast("int")).alias("nation"))


def _moves(spark, d):
    """Every fifth customer moves on to the next nation (some from, some to none); all of nation 3 leave it."""
    c = _by_nation(spark, d).filter((F.col("c_custkey") % 5 == 0) | (F.col("nation") == 3))
    to = F.when(F.col("c_custkey") % 2 == 0, (F.coalesce("nation", F.lit(23)) + 1) % 25)
    return c.select("c_custkey", F.lit(2).alias("seq"), F.when((F.col("nation") == 3) & to.isNull(), 4).otherwise(to).cast("int").alias("nation"))


_MOVED = """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS n FROM customer),
m AS (SELECT c_custkey, n, coalesce(c_custkey % 5 = 0 OR n = 3, c_custkey % 5 = 0) AS moved,
             CASE WHEN c_custkey % 2 = 0 THEN (coalesce(n, 23) + 1) % 25 WHEN n = 3 THEN 4 END AS target FROM c)
SELECT c_custkey, CASE WHEN moved THEN 2 ELSE 1 END AS seq, CAST(CASE WHEN moved THEN target ELSE n END AS INTEGER) AS nation FROM m
"""


def _moved_load(spark, d):
    path = scratch_path(spark, "moved-load")
    merge.load(spark, path, _by_nation(spark, d), ["c_custkey"], "FULL", ["nation"])
    merge.load(spark, path, _moves(spark, d), ["c_custkey"], "INCREMENTAL", ["nation"])
    return spark.read.parquet(path).select("c_custkey", "seq", "nation")


register("b17_moved_keys", _MOVED)(_moved_load)


def _moved_stream(spark, d):
    base = scratch_path(spark, "moved-stream")
    first = _by_nation(spark, d)
    first.write.parquet(f"{base}/in")
    args = (f"{base}/in", first.schema, f"{base}/target", ["c_custkey"], "seq", f"{base}/ckpt")
    streaming.stream_upsert(spark, *args, partition_by=["nation"])
    _moves(spark, d).write.mode("append").parquet(f"{base}/in")
    streaming.stream_upsert(spark, *args, partition_by=["nation"])
    return spark.read.parquet(f"{base}/target").select("c_custkey", "seq", "nation")


register("w2_moved_keys", _MOVED)(_moved_stream)


def _bucketed_stream(spark, d):
    base = scratch_path(spark, "bucketed-stream")
    first = _by_nation(spark, d)
    first.write.parquet(f"{base}/in")
    args = (f"{base}/in", first.schema, f"{base}/target", ["c_custkey"], "seq", f"{base}/ckpt")
    streaming.stream_upsert(spark, *args, buckets=8)
    _moves(spark, d).write.mode("append").parquet(f"{base}/in")
    streaming.stream_upsert(spark, *args, buckets=8)
    return streaming.read_bucketed(spark, f"{base}/target").select("c_custkey", "seq", "nation")


register("w2_bucketed_stream_upsert", _MOVED)(_bucketed_stream)


# ------------------------------------------------------------------ repeated keys and watermarks

def _event_versions(spark, d):
    """Each event three times, an hour apart, the last with another value."""
    e = TB(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    e = e.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(0))))
    return e.select("event_id", F.expr("ts + make_interval(0, 0, 0, 0, v)").alias("ts"), (F.col("value") + F.col("v")).alias("value"))


def _full_repeated(spark, d):
    path = scratch_path(spark, "full-repeated")
    rows = _event_versions(spark, d)
    high = merge.incremental_load(spark, path, rows, "ts", None, ["event_id"], "FULL")
    return spark.read.parquet(path).select("event_id", "ts", "value", F.lit(high).cast("timestamp_ntz").alias("watermark"))


register("h10_full_repeated_keys", """
SELECT event_id, ts + INTERVAL 2 HOUR AS ts, value + 2 AS value, (SELECT max(ts) + INTERVAL 2 HOUR FROM events) AS watermark FROM events
""")(_full_repeated)


def _observed_watermarks(spark, d):
    """Three incremental loads of events by user-partitioned target: the last brings nothing."""
    path = scratch_path(spark, "observed-watermarks")
    e = _event_versions(spark, d).withColumn("third", (F.col("event_id") % 3).cast("int"))
    first = merge.incremental_load(spark, path, e.filter("third = 0"), "ts", None, ["event_id"], partition_by=["third"])
    second = merge.incremental_load(spark, path, e, "ts", first, ["event_id"], partition_by=["third"])
    third = merge.incremental_load(spark, path, e, "ts", second, ["event_id"], partition_by=["third"])
    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("stored"), F.count_distinct("event_id").alias("keys")).select(
        "stored", "keys", stamp(first).alias("first"), stamp(second).alias("second"), stamp(third).alias("third"))


register("h10_observed_watermarks", """
WITH e AS (SELECT event_id, ts + INTERVAL 2 HOUR AS ts FROM events),
f AS (SELECT max(ts) AS first FROM e WHERE event_id % 3 = 0),
n AS (SELECT count(*) AS stored FROM e, f WHERE event_id % 3 = 0 OR ts > first)
SELECT stored, stored AS keys, first, greatest(first, (SELECT max(ts) FROM e)) AS second, greatest(first, (SELECT max(ts) FROM e)) AS third FROM n, f
""")(_observed_watermarks)
