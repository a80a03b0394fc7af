"""The job inputs derived from the driver tables reproduce the counts measured
independently for them (FIXTURES.md) at sf0.01."""

from tessera.plans import dim_customer, orders, transactions

SF01 = "/root/testdata/sf0.01"


def test_job_counts_match_the_fixture_description(spark):
    cc = {r.change_type: r.records for r in dim_customer.run(spark, SF01)["change_counts"].collect()}
    assert cc == {"C": 1112, "U": 193, "I": 106, "D": 83}
    assert dim_customer.run(spark, SF01)["dimension"].count() == 1781
    ec = {r.ErrorCode: r.records for r in transactions.run(spark, SF01)["error_counts"].collect()}
    assert ec == {"": 4429, "E001": 244, "E002": 227, "E003": 258, "E004": 300, "E005": 308, "E006": 375,
                  "E007": 876, "E008": 2983}
    assert orders.run(spark, SF01, sort=False).count() == 13835
