import os

from tessera.plans import fixtures
from tessera.session import scratch_path
from tests.conftest import SF

README = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")


def test_readme_example_runs(spark):
    src = open(README).read().split("```python", 1)[1].split("```", 1)[0]
    src = src.replace("orders = spark.read.parquet(orders_path)", "pass")
    dim = fixtures.dim_customer(spark, SF).withColumnsRenamed({"CustomerName": "Name", "CustomerSegment": "Segment"})
    source = fixtures.source_customers(spark, SF).withColumnsRenamed({"CustomerName": "Name",
                                                                      "CustomerSegment": "Segment"})
    env = {"spark": spark, "orders": fixtures.orders_input(spark, SF), "products": fixtures.products_input(spark, SF),
           "dim": dim, "source": source, "out_path": scratch_path(spark, "readme-out"),
           "dim_path": scratch_path(spark, "readme-dim")}
    exec(src, env)
    assert spark.read.parquet(env["out_path"]).count() > 0
    assert spark.read.parquet(env["dim_path"]).filter("IsCurrent = 1").count() > 0
