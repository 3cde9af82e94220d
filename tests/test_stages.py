"""Batch stages end to end, sinks, and published results where they are at hand."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from hubloom.config import RETAIL_NETWORK, STAR_NETWORK
from hubloom.operators import placement, scenarios
from hubloom.plans import stages
from hubloom.sources.sinks import REPORTING_TYPES, jdbc_options, reporting_columns
from hubloom.sources.small import literal_table
from hubloom.sources.star import add_distance_freight, read_star_tables


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_stages_chain_through_stored_tables(spark, small_folder, tmp_path, fmt):
    store = stages.Store(spark, str(tmp_path / "store"), fmt)
    summary = stages.prepare(read_star_tables(spark, small_folder), store, STAR_NETWORK,
                             add_distance_freight)
    total = summary.where("hub = 'all'").first()["items"]
    assert store.read("order_items").count() == total == 83
    accuracy = stages.fit_forecast(store, STAR_NETWORK).first()
    assert accuracy.improvement_pct == pytest.approx(100 * (1 - accuracy.model_mae / accuracy.naive_mae))
    assert 0 <= stages.fit_flows(store, STAR_NETWORK).first().max_flow_diff < 1
    sums = store.read("routing_probabilities").groupBy("customer_state").agg(F.sum("p").alias("p")).collect()
    assert all(r.p == pytest.approx(1.0) for r in sums)
    costs = stages.optimise(store, STAR_NETWORK).first()
    placed = store.read("optimal_placement")
    plan = store.read("planning_demand")
    assert placed.count() == 3 * plan.count()
    assert placed.agg(F.sum("units")).first()[0] == pytest.approx(plan.agg(F.sum("demand")).first()[0])
    assert costs.feasible
    assert store.read("scenario_results").count() == 200
    assert stages.write_figure_tables(store, STAR_NETWORK).first().scenarios == 200
    answers = stages.whatif(store, STAR_NETWORK, [1.0, 2.0], [0.0]).collect()
    weekly = plan.agg(F.sum("demand")).first()[0]
    assert len(answers) == 2 and all(
        abs(sum(row[f"units_{hub}"] for hub in STAR_NETWORK.hubs) - weekly) <= 1.5
        for row in answers if row.feasible)
    for table, schema in stages.TABLES.items():
        assert [f.name for f in store.read(table).schema] == [f.name for f in T.StructType.fromDDL(schema)]


def test_jdbc_options_and_types(spark):
    options = jdbc_options("jdbc:postgresql://host/db", "order_items", partitions=4, user="u")
    assert options["dbtable"] == "order_items" and options["user"] == "u"
    assert options["numPartitions"] == "4"
    assert options["createTableColumnTypes"] == \
        "customer_state VARCHAR(2), hub VARCHAR(20), product_group VARCHAR(20)"
    demand = spark.createDataFrame([(3, "x")], "demand bigint, extra string").selectExpr(
        "date '2017-01-02' AS week", "'SP' AS customer_state", "'home' AS product_group", "demand", "extra")
    typed = reporting_columns(demand, "weekly_demand")
    assert typed.columns == list(REPORTING_TYPES["weekly_demand"])
    assert typed.schema["demand"].dataType == T.IntegerType()
    assert typed.schema["week"].dataType == T.DateType()


# Folder of published result tables of the retail network (wide, as CSV); optional.
PUBLISHED = os.environ.get("HUBLOOM_PUBLISHED")
# The freight line and peak weeks that belong to those tables.
PUBLISHED_LINE = (14.338524151912495, 0.010545834052751123)
PUBLISHED_PEAKS = (2151, 377, 381)


def _long(spark, frame: pd.DataFrame, value: str):
    melted = frame.melt("customer_state", var_name="hub", value_name=value)
    return literal_table(spark, **{c: melted[c].tolist() for c in melted})


@pytest.mark.skipif(not PUBLISHED, reason="no published tables at hand")
def test_published_costs_are_reproduced(spark):
    def table(name: str) -> pd.DataFrame:
        return pd.read_csv(os.path.join(PUBLISHED, name + ".csv"))

    a, b = PUBLISHED_LINE
    network = placement.network_row(
        _long(spark, table("state_hub_distance_km"), "km"), literal_table(spark, a=[a], b=[b]),
        _long(spark, table("routing_probabilities"), "p"),
        literal_table(spark, hub=list(RETAIL_NETWORK.hubs), peak=list(PUBLISHED_PEAKS)), RETAIL_NETWORK)
    priced = network.checkpoint()
    plan, holdout = table("planning_demand"), table("forecast_holdout")
    cells = literal_table(spark, **{c: plan[c].tolist() for c in plan})

    sweep = scenarios.capacity_sensitivity(cells, priced, RETAIL_NETWORK).toPandas()
    sweep = sweep.sort_values("regional_capacity_frac")
    assert np.allclose(sweep.saving_pct, table("capacity_sensitivity").saving_pct, atol=1e-6)

    base = scenarios.assumption_grid(spark, [1.5], [1.0])
    result = scenarios.whatif(base, cells, priced, RETAIL_NETWORK).first()
    assert result.policy_cost == pytest.approx(27392.73, abs=0.01)
    assert result.optimised_cost == pytest.approx(24320.01, abs=0.01)
    units = placement.place_units(
        scenarios.whatif_plans(base, cells, network.checkpoint(), RETAIL_NETWORK),
        [], RETAIL_NETWORK).groupBy("customer_state", "hub").agg(F.sum("units").alias("units")).toPandas()
    known = table("optimal_placement").groupby(["customer_state", "hub"]).units.sum()
    assert np.allclose(units.set_index(["customer_state", "hub"]).units.reindex(known.index), known, atol=1e-4)

    # replay the published draws, then evaluate all of them as one job
    rng = np.random.default_rng(7)
    history = {k: g.residual.to_numpy() for k, g in
               holdout.sort_values("week").groupby(["customer_state", "product_group"])}
    drawn = [(i, r.customer_state, r.product_group,
              max(r.demand + rng.choice(history[r.customer_state, r.product_group]), 0.0))
             for i in range(200) for r in plan.itertuples()]
    demand = literal_table(spark, scenario=[d[0] for d in drawn], customer_state=[d[1] for d in drawn],
                           product_group=[d[2] for d in drawn], demand=[d[3] for d in drawn])
    got = scenarios.evaluate_scenarios(demand, priced, RETAIL_NETWORK).toPandas().sort_values("scenario")
    known = table("scenario_results")
    assert np.allclose(got.policy_cost, known.policy_cost, atol=1e-6)
    assert np.allclose(got.optimised_cost, known.optimised_cost, atol=1e-3)
    assert np.allclose(got.saving_pct, known.saving_pct, atol=1e-5)
    assert not got.policy_capacity_breach.any()
