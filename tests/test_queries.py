"""Registered queries against their SQL on the smallest tables, and the driver contract."""

import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences

# One query per part of the engine; `python -m checks.compare` runs all of them.
SAMPLE = [
    "order_items", "state_hub_distances", "weekly_demand", "demand_features", "naive_holdout",
    "empirical_flows", "routing_baseline", "freight_line", "policy_hub_loads", "plan_costs",
    "scenario_results", "sweep_hub_units", "whatif_grid", "flow_share_report", "ridge_holdout",
]


@pytest.fixture(scope="module")
def duck(small_folder):
    return connect(small_folder)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, small_folder, duck, name):
    result = contract.queries()[name](spark, small_folder)
    assert differences(result, duck, contract.oracle_sql()[name]) == []


def test_every_oracle_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_a_stable_schema(spark, small_folder):
    result = contract.entry(spark)
    assert result.columns == ["scenario", "policy_cost", "optimised_cost", "saving_pct",
                              "policy_capacity_breach"]
    assert result.count() == 200


def test_pushdown_reaches_the_scans(spark, small_folder):
    from hubloom import Planning
    from hubloom.operators.items import lane_weeks
    items = Planning.over_star(spark, small_folder, freight=False).items
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    physical = lane_weeks(items)._jdf.queryExecution().explainString(mode)
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_orderdate), EqualTo(o_orderstatus,F)" in physical
    assert "GreaterThanOrEqual(o_orderdate,1999-12-06T00:00)" in physical
    assert "LessThan(o_orderdate,2001-07-23T00:00)" in physical
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in physical
    assert "l_extendedprice" not in physical  # not needed for the lane summary
    assert "CartesianProduct" not in physical and "NestedLoopJoin" not in physical
