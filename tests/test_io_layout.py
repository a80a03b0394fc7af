import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import layout, ordering
from tessera.sinks import files as sinks
from tessera.sources import files as sources
from tessera.sources.jdbc import read_jdbc
from tessera.util import plan_text
from tests.conftest import SF, rows

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()),
                       T.StructField("d", T.DateType())])


def _local(p):
    return p.replace("file:", "")


def test_delimited_round_trip_and_rejects(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a|b", None), (2, None, None)], SCHEMA)
    sinks.write_delimited(df, tmp_dir, delimiter="|", null_value="NULL")
    back = sources.read_delimited(spark, tmp_dir, SCHEMA, delimiter="|", null_value="NULL")
    assert rows(back) == rows(df)
    bad_dir = tmp_dir + "-bad"
    spark.createDataFrame([("id,name,d",), ("1,x,2024-01-01",), ("oops,y,2024-01-02",), ("3,z,notadate",)],
                          "value string").coalesce(1).write.text(bad_dir)
    good, rej = sources.read_with_rejects(spark, bad_dir, SCHEMA)
    assert rows(good, "id") == [(1,)]
    assert sorted(r.raw_record for r in rej.collect()) == ["3,z,notadate", "oops,y,2024-01-02"]
    assert sources.enforce_reject_limit(rej, 5) == 2
    with pytest.raises(sources.RejectLimitExceeded):
        sources.enforce_reject_limit(rej, 1)


def test_fixed_width(spark, tmp_dir):
    spark.createDataFrame([("0001ABC  12",), ("0002XY   zz",)], "value string").write.text(tmp_dir)
    out = sources.read_fixed_width(spark, tmp_dir, [("id", 1, 4, "int"), ("code", 5, 5, "string"), ("n", 10, 2, "int")])
    assert rows(out) == [(1, "ABC", 12), (2, "XY", None)]


def test_staged_overwrite_and_partition_pruning(spark, tmp_dir):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    sinks.write_dataset(ev, tmp_dir, partition_by=["event_type"], files=2)
    sinks.write_dataset(ev.filter(F.col("event_type") != "error"), tmp_dir, partition_by=["event_type"])
    back = sources.read_dataset(spark, tmp_dir)
    assert back.filter(F.col("event_type") == "error").count() == 0
    assert not glob.glob(_local(tmp_dir) + ".__*")          # staging and old copies are gone
    p = plan_text(back.filter(F.col("event_type") == "click").select("event_id"))
    assert "PartitionFilters: [isnotnull(event_type" in p
    # dynamic partition overwrite touches only the partitions present
    sinks.write_dataset(ev.filter(F.col("event_type") == "view").limit(3), tmp_dir, partition_by=["event_type"],
                        dynamic_partitions=True)
    assert sources.read_dataset(spark, tmp_dir).filter(F.col("event_type") == "view").count() == 3
    assert sources.read_dataset(spark, tmp_dir).filter(F.col("event_type") == "click").count() > 3


def test_filter_and_projection_reach_the_scan(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    p = plan_text(li.filter(F.col("l_quantity") > 10).select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_compaction_and_cluster(spark, tmp_dir):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    li.repartition(12).write.parquet(tmp_dir)
    layout.compact(spark, tmp_dir, 2)
    assert len(glob.glob(_local(tmp_dir) + "/*.parquet")) == 2
    assert rows(spark.read.parquet(tmp_dir)) == rows(li)
    c = layout.cluster(li, ["l_orderkey", "l_partkey"], 4)
    assert rows(c) == rows(li)
    one = layout.cluster(li, ["l_orderkey"], 4)
    bounds = one.groupBy(F.spark_partition_id().alias("p")).agg(F.min("l_orderkey").alias("lo"),
                                                                  F.max("l_orderkey").alias("hi")).orderBy("lo").collect()
    assert all(a.hi <= b.lo for a, b in zip(bounds, bounds[1:]))


def test_single_export_and_source_file(spark, tmp_dir):
    df = spark.range(50).repartition(4)
    sinks.export_single(df, tmp_dir)
    assert len(glob.glob(_local(tmp_dir) + "/*.csv")) == 1
    r = sources.with_source_file(spark.read.parquet(f"{SF}/region.parquet")).first()
    assert r.source_file.endswith("region.parquet")


def test_schema_gate_rows_and_generator(spark):
    df = spark.range(3)
    sources.require_columns(df, ["id"])
    with pytest.raises(sources.MissingColumns):
        sources.require_columns(df, ["nope"])
    g = sources.generate_rows(spark, 5, {"sq": F.col("row_id") * F.col("row_id")}, start=10, step=2)
    assert [r.sq for r in g.orderBy("row_id").collect()] == [100, 144, 196, 256, 324]
    assert sources.rows(spark, [(1, "a")], "i int, s string").count() == 1


def test_catalog_table_ddl_and_stats(spark):
    df = spark.read.parquet(f"{SF}/nation.parquet")
    sinks.save_table(df, "nation_copy", bucket_by=(4, ["n_nationkey"]))
    assert sources.read_table(spark, "nation_copy").count() == df.count()
    sinks.analyze(spark, "nation_copy", ["n_nationkey"])
    sinks.create_table(spark, "ev_part", T.StructType([T.StructField("a", T.IntegerType()),
                                                       T.StructField("p", T.StringType())]), ["p"])
    assert "p" in spark.read.table("ev_part").columns


def test_conform_casts_safely(spark):
    df = spark.createDataFrame([("1", "x")], "a string, b string")
    out = sinks.conform(df, T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.IntegerType())]))
    assert out.columns == ["b", "a"] and out.first().a == 1
    bad = sinks.conform(spark.createDataFrame([("zz",)], "a string"), T.StructType([T.StructField("a", T.IntegerType())]))
    assert bad.first().a is None


def test_jdbc_arguments_are_checked(spark):
    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:none", table="t", query="select 1")
    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:none", table="t", partition_column="id")


def test_partitioning_methods(spark):
    df = spark.range(40)
    m = ordering.repartition_stage(df, "modulus", 4, ["id"])
    parts = m.select(F.spark_partition_id().alias("p"), (F.col("id") % 4).alias("r")).distinct().collect()
    assert all(r.p == r.r for r in parts)
    assert ordering.repartition_stage(df, "hash", 3, ["id"]).rdd.getNumPartitions() == 3
    assert ordering.repartition_stage(df, "round_robin", 5).rdd.getNumPartitions() == 5
    assert ordering.repartition_stage(df, "same") is df
    big = spark.range(1000).withColumnRenamed("id", "k")
    p = plan_text(big.join(ordering.repartition_stage(df.withColumnRenamed("id", "k"), "entire"), "k"))
    assert "BroadcastHashJoin" in p


def test_reused_cache(spark):
    df = spark.range(10)
    with layout.reused(df) as d:
        assert d.is_cached and d.count() == 10
    assert not df.is_cached


def test_append_mode_and_attach_file_body(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a", None)], SCHEMA)
    sinks.write_delimited(df, tmp_dir)
    sinks.write_delimited(df, tmp_dir, mode="append")
    assert sources.read_delimited(spark, tmp_dir, SCHEMA).count() == 2
    d = tmp_dir.replace("file:", "") + "-files"
    os.makedirs(d)
    with open(f"{d}/job_a.dsx", "w") as f:
        f.write("<Job>A</Job>")
    files = sources.read_whole_files(spark, f"{d}/*.dsx")
    cases = spark.createDataFrame([(1, "Migrate test-artifacts/job_a.dsx please"), (2, "no file")], "id int, q string")
    out = {r.id: r for r in sources.attach_file_body(cases, "q", files, r"([\w.-]+\.dsx)").collect()}
    assert out[1].q.endswith("<Job>A</Job>") and out[1].attached == "<Job>A</Job>"
    assert out[2].q == "no file" and out[2].attached is None


def test_file_row_number(spark, tmp_dir):
    a = spark.range(0, 500).coalesce(1)
    b = spark.range(500, 800).coalesce(1)
    a.write.parquet(f"{tmp_dir}/part_a")
    b.write.parquet(f"{tmp_dir}/part_b")
    df = spark.read.option("maxPartitionBytes", 512).parquet(f"{tmp_dir}/part_a", f"{tmp_dir}/part_b")
    out = sources.file_row_number(df, "rn")
    got = sorted((r.id, r.rn) for r in out.collect())
    assert got == [(i, i + 1) for i in range(800)]


def test_zorder_on_strings_and_dates(spark):
    import datetime as dt
    df = spark.createDataFrame([(f"name{i % 37:03d}", dt.date(2020, 1, 1) + dt.timedelta(days=i % 400), i)
                                for i in range(500)], "s string, d date, i int")
    out = layout.cluster(df, ["s", "d"], 4)
    assert rows(out) == rows(df)


def test_bucketed_tables_join_without_shuffle(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_quantity")
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey")
    sinks.save_table(li, "li_bucketed", bucket_by=(8, ["l_orderkey"]))
    sinks.save_table(o, "o_bucketed", bucket_by=(8, ["o_orderkey"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.read.table("li_bucketed").join(spark.read.table("o_bucketed"),
                                                 F.col("l_orderkey") == F.col("o_orderkey"))
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_zorder_narrows_per_file_ranges(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i * 104729 % 1000, i) for i in range(4000)], "a int, b int, i int")

    def mean_width(d):
        g = d.groupBy(F.spark_partition_id().alias("p")).agg(
            (F.max("a") - F.min("a")).alias("wa"), (F.max("b") - F.min("b")).alias("wb"))
        r = g.agg(F.avg("wa"), F.avg("wb")).first()
        return r[0] + r[1]

    assert mean_width(layout.cluster(df, ["a", "b"], 8)) < 0.8 * mean_width(df.repartition(8))


def test_stable_sort_order_does_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([(i % 5, f"r{i}") for i in range(200)], "k int, v string")
    a = [tuple(r) for r in ordering.sort_stage(df.repartition(3), [("k", "asc")], stable=True).collect()]
    b = [tuple(r) for r in ordering.sort_stage(df.repartition(7).orderBy(F.rand(1)), [("k", "asc")],
                                               stable=True).collect()]
    assert a == b


def test_file_count_control(spark, tmp_dir):
    spark.range(1000).repartition(9).write.parquet(tmp_dir + "-src")
    sinks.write_dataset(spark.read.parquet(tmp_dir + "-src"), tmp_dir, files=3)
    assert len(glob.glob(_local(tmp_dir) + "/*.parquet")) == 3


def test_delimited_schema_inference(spark, tmp_dir):
    spark.createDataFrame([("id,amount,day",), ("1,2.5,2024-01-02",), ("2,3.0,2024-01-03",)],
                          "value string").coalesce(1).write.text(tmp_dir)
    df = sources.read_delimited(spark, tmp_dir)
    types = dict(df.dtypes)
    assert types["id"] == "int" and types["amount"] == "double" and df.count() == 2


def test_replace_partitions_multi_column_and_partitioned_compaction(spark, tmp_dir):
    df = spark.createDataFrame([(i, i % 2, i % 3) for i in range(12)], "v int, a int, b int")
    sinks.write_dataset(df, tmp_dir, partition_by=["a", "b"])
    new = spark.createDataFrame([(100, 0, 0), (101, 1, 2)], "v int, a int, b int")
    assert sorted(sinks.replace_partitions(new, tmp_dir, ["a", "b"])) == ["a=0/b=0", "a=1/b=2"]
    exp = sorted([(i, i % 2, i % 3) for i in range(12) if (i % 2, i % 3) not in [(0, 0), (1, 2)]]
                 + [(100, 0, 0), (101, 1, 2)])
    assert sorted(tuple(r) for r in spark.read.parquet(tmp_dir).select("v", "a", "b").collect()) == exp
    layout.compact(spark, tmp_dir, 6, partition_by=["a", "b"])
    assert sorted(tuple(r) for r in spark.read.parquet(tmp_dir).select("v", "a", "b").collect()) == exp
    assert all(len(glob.glob(p + "/*.parquet")) == 1 for p in glob.glob(_local(tmp_dir) + "/a=*/b=*"))


def test_zorder_bounds_come_from_all_rows(spark):
    n = 20_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("i"), F.date_add(F.lit("1990-01-01"), (F.col("id") % 5000).cast("int")).alias("d"),
                               F.concat(F.lit("Customer#"), F.lpad(((F.col("id") * 7919) % n).cast("string"), 9, "0")).alias("s"),
                               F.when(F.col("id") % 100 == 0, F.lit("rare")).when(F.col("id") % 3 > 0, F.lit("much")).alias("few"))
    numbers, dates, strings, few = layout._bounds(df, ["i", "d", "s", "few"], 256)
    values = sorted(r.s for r in df.select("s").collect())
    assert strings == [values[n * q // 256] for q in range(1, 256)]
    assert few == ["much", "rare"]
    assert len(numbers) == 255 and all(abs(b - n * q / 256) <= 4 for q, b in zip(range(1, 256), numbers))
    assert len(dates) == 255
    assert layout._bounds(df.limit(0), ["i", "s"], 256) == [[], []]


def test_compaction_bounds_the_file_of_one_task(spark, tmp_dir):
    df = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    df.repartition(6).write.parquet(tmp_dir)
    size = sum(os.path.getsize(p) for p in glob.glob(_local(tmp_dir) + "/*.parquet"))
    layout.compact(spark, tmp_dir, 2, max_file_bytes=size // 4)
    files = glob.glob(_local(tmp_dir) + "/*.parquet")
    assert 4 <= len(files) <= 5 and max(os.path.getsize(p) for p in files) < 1.3 * size / 4
    assert rows(spark.read.parquet(tmp_dir)) == rows(df)


def test_file_row_number_keeps_large_files_out_of_one_task(spark, tmp_dir, monkeypatch):
    spark.range(0, 500).coalesce(1).write.parquet(f"{tmp_dir}/part_a")
    spark.range(500, 800).coalesce(1).write.parquet(f"{tmp_dir}/part_b")
    df = spark.read.parquet(f"{tmp_dir}/part_a", f"{tmp_dir}/part_b")
    wide = df.select("id", *[F.lit("x" * 50).alias(f"c{i}") for i in range(20)])
    spark.conf.set("tessera.broadcast.maxBytes", "1000")  # less than the estimate of the rows, more than two files
    try:
        plan = sources.file_row_number(wide, "rn")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        spark.conf.set("tessera.broadcast.maxBytes", "1")
        monkeypatch.setattr(sources, "BLOCK_ROWS", 100)
        out = sources.file_row_number(df, "rn")
        assert sorted((r.id, r.rn) for r in out.collect()) == [(i, i + 1) for i in range(800)]
        assert "_rb" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("tessera.broadcast.maxBytes")
