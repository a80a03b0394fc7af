"""Plan checks over every registered query (at sf0.001)."""

import __spark_entry__ as E
from tessera.operators import reconcile
from tests.conftest import SF

PYTHON_OK = ("u4_", "x1_", "x9_", "x10_", "x11_", "x12_", "x14_")


def test_registered_plans_have_no_cross_products_or_row_udfs(spark):
    bad = []
    for name, fn in sorted(E.queries().items()):
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append((name, "cross product"))
        if "BatchEvalPython" in plan:
            bad.append((name, "row-at-a-time python udf"))
        if "ArrowEvalPython" in plan and not name.startswith(PYTHON_OK):
            bad.append((name, "python outside the syntax check"))
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            # one task may only receive aggregated rows (partial global aggregates,
            # per-partition summaries, per-model reports), never raw data
            if "Exchange SinglePartition" in line and "Aggregate(" not in lines[i + 1]:
                bad.append((name, "raw rows into one partition"))
    assert bad == []


def test_entry_schema_is_stable(spark):
    a = E.entry(spark).schema.simpleString()
    b = E.entry(spark).schema.simpleString()
    assert a == b


def test_filters_reach_the_scan_in_registered_queries(spark):
    from tessera.util import plan_text
    p = plan_text(E.queries()["c1_c3_c7_c8_derive_constrain"](spark, SF))
    pushed = p[p.index("PushedFilters:"):].splitlines()[0]
    for f in ("GreaterThanOrEqual(l_shipdate", "LessThan(l_shipdate", "In(l_returnflag", "GreaterThan(l_quantity"):
        assert f in pushed
    schema = p[p.index("ReadSchema:"):].splitlines()[0]
    assert "l_partkey" not in schema and "l_tax" not in schema       # columns pruned at the scan


def test_flagship_uses_checked_broadcast_for_the_product_lookup(spark):
    import re
    p = E.queries()["job02_order_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[ProductID#\d+L\], \[ProductID#\d+L\], LeftOuter", p)


def test_one_pass_queries_start_no_checkpoint(spark):
    for name in ("job04_good", "job04_error_counts", "job03_change_counts", "h1_change_capture"):
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and "Window" not in plan, name


def test_dimension_joins_its_source_once(spark):
    plan = E.queries()["job03_scd2_dimension"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # the change set of the full outer join is materialised; what is left joins inserts to history
    assert "FullOuter" not in plan and "ExistingRDD" in plan


def test_no_step_is_bound_to_a_fixed_or_single_task(spark):
    """The parse of a one-file table is dealt out; a comparison's reshuffle has no fixed number of tasks."""
    assert E.queries()["f13_xml_field"](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plans = []
    real = reconcile.dataset_checksum
    try:
        reconcile.dataset_checksum = lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *a, **k)
        E.queries()["r3_dataset_checksum_xxhash"](spark, SF)
    finally:
        reconcile.dataset_checksum = real
    assert sum("RebalancePartitions [l_suppkey" in p for p in plans) == 1 and not any("RepartitionByExpression" in p for p in plans)
