"""Batch stages that hand over through stored tables.

Each stage reads the tables of the stages before it and replaces its own, so stages
can run as separate Spark applications, be repeated on their own, and never depend on
an executor that held an earlier result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hubloom.config import NetworkConfig
from hubloom.operators import costs, demand, forecast, geography, items, placement, reports
from hubloom.operators import routing, scenarios
from hubloom.session import materialise, shared_folder
from hubloom.sources.raw import REJECTED, RawTables
from hubloom.sources.sinks import load_reporting_table
from hubloom.sources.snapshots import SnapshotTable

TABLES: dict[str, str] = {
    "order_items": "order_id STRING, order_item_id INT, product_id STRING, seller_id STRING, week DATE, "
                   "customer_state STRING, hub STRING, product_group STRING, price DOUBLE, freight_value DOUBLE",
    "lane_weeks": "week DATE, customer_state STRING, hub STRING, product_group STRING, items BIGINT, freight DOUBLE",
    "weekly_demand": "week DATE, customer_state STRING, product_group STRING, demand BIGINT",
    "state_hub_distance": "customer_state STRING, hub STRING, km DOUBLE",
    "forecast_holdout": "week DATE, customer_state STRING, product_group STRING, demand BIGINT, "
                        "forecast DOUBLE, residual DOUBLE",
    "planning_demand": "customer_state STRING, product_group STRING, demand DOUBLE",
    "routing_probabilities": "customer_state STRING, hub STRING, p DOUBLE",
    "optimal_placement": "customer_state STRING, product_group STRING, hub STRING, units DOUBLE",
    "capacity_sensitivity": "regional_capacity_frac DOUBLE, optimised_cost DOUBLE, saving_pct DOUBLE",
    "capacity_breakpoints": "from_frac DOUBLE, to_frac DOUBLE, from_cost DOUBLE, to_cost DOUBLE",
    "scenario_results": "scenario BIGINT, policy_cost DOUBLE, optimised_cost DOUBLE, saving_pct DOUBLE, "
                        "policy_capacity_breach BOOLEAN",
    "rejected_rows": REJECTED,
}


@dataclass(frozen=True)
class Store:
    """Stage tables under one folder, as parquet or CSV, each replaced by publishing a new version."""

    spark: SparkSession
    folder: str
    fmt: str = "parquet"

    def table(self, table: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.folder.rstrip('/')}/{table}", self.fmt)

    def write(self, table: str, df: DataFrame) -> None:
        if table in TABLES:
            df = df.select(T.StructType.fromDDL(TABLES[table]).fieldNames())
        self.table(table).publish(df)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The current version as it stands now; later versions don't change what is read."""
        return self.table(table).read(TABLES[table] if self.fmt == "csv" else None, version)


def store_round_trip(order_items: DataFrame, weekly_demand: DataFrame) -> DataFrame:
    """Rows and sum of two versions of two stored tables in both formats, read after the second one.

    The first version holds a part, the second all. A reader opened between the two has to see
    the first one still; it is counted as version 1.
    """
    spark = order_items.sparkSession
    tables = {"order_items": (order_items, "product_group = 'home'", "price"), "weekly_demand": (weekly_demand, "demand > 0", "demand")}
    results = []
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for name, (table, part, measure) in tables.items():
        written = materialise(table)
        for fmt in ("parquet", "csv"):
            kept = Store(spark, f"{folder}/{fmt}", fmt)
            kept.write(name, written.where(part))
            opened = kept.read(name)
            kept.write(name, written)
            for number, seen in ((1, opened), (2, kept.read(name))):
                results.append(seen.agg(
                    F.lit(name).alias("stored_table"), F.lit(fmt).alias("format"), F.lit(number).alias("version"),
                    F.count("*").alias("rows"), F.sum(F.col(measure).cast("double")).alias("total")))
    return reduce(DataFrame.unionByName, results)


def prepare(raw: RawTables, store: Store, config: NetworkConfig, freight_rule=None) -> DataFrame:
    """Distances, order items, their lane summary, the weekly demand, and what the reader has rejected."""
    store.write("rejected_rows", raw.rejected if raw.rejected is not None else store.spark.createDataFrame([], REJECTED))
    centroids = materialise(geography.state_centroids(raw.geolocation, config.centroid_accuracy))
    store.write("state_hub_distance", geography.state_hub_distances(centroids, config))
    built = items.build_order_items(raw, config)
    if freight_rule is not None:
        built = freight_rule(built, store.read("state_hub_distance"))
    store.write("order_items", built)
    store.write("lane_weeks", items.lane_weeks(store.read("order_items")))
    lanes = store.read("lane_weeks")
    store.write("weekly_demand", demand.weekly_demand(lanes, config))
    return items.preparation_summary(lanes)


def fit_forecast(store: Store, config: NetworkConfig) -> DataFrame:
    """Holdout forecast and planning demand; returns both forecasts' error and the improvement."""
    features = demand.demand_features(store.read("weekly_demand"), config)
    store.write("forecast_holdout", forecast.ridge_forecast(features, config).holdout)
    holdout = store.read("forecast_holdout")
    store.write("planning_demand", demand.planning_demand(holdout))
    naive = demand.naive_holdout(features, config)
    return demand.accuracy_report(holdout, naive)


def fit_flows(store: Store, config: NetworkConfig) -> DataFrame:
    """Flow matrix of the routing model; returns its metrics next to the baseline's, and the
    largest difference between a modelled and an observed flow."""
    profile = materialise(routing.routing_profile(store.read("order_items"), config))
    fitted = routing.fit_routing(profile, store.read("state_hub_distance"), config)
    store.write("routing_probabilities", routing.model_flows(fitted.scored, config))
    fit = routing.flow_fit(store.read("routing_probabilities"),
                           costs.empirical_flows(store.read("lane_weeks"), config))
    return (routing.routing_metrics(fitted.scored)
            .join(routing.baseline_metrics(profile, config), "test_items")
            .withColumn("max_flow_diff", fit.agg(F.max("max_abs_diff")).scalar()))


def planning_network(store: Store, config: NetworkConfig) -> DataFrame:
    lanes, distances = store.read("lane_weeks"), store.read("state_hub_distance")
    return materialise(placement.network_row(
        distances, costs.fit_freight_line(lanes, distances), store.read("routing_probabilities"),
        costs.hub_peaks(lanes), config))


def optimise(store: Store, config: NetworkConfig) -> DataFrame:
    """Placement, capacity sweep and scenarios; returns the costs of the planning week."""
    plan, holdout = store.read("planning_demand"), store.read("forecast_holdout")
    network = planning_network(store, config)
    placed = placement.place_units(scenarios.base_plan(plan, network, config), [], config)
    store.write("optimal_placement", placed)
    store.write("capacity_sensitivity", scenarios.capacity_sensitivity(plan, network, config))
    store.write("capacity_breakpoints", scenarios.capacity_breakpoints(plan, network, config))
    store.write("scenario_results", scenarios.evaluate_scenarios(
        scenarios.scenario_demand(plan, holdout, config), network, config))
    return placement.evaluate_plans(scenarios.base_plan(plan, network, config)).select(
        "feasible", "units", *scenarios.RESULT)


def whatif(store: Store, config: NetworkConfig, headrooms: list[float], holdings: list[float]) -> DataFrame:
    """Costs and units by hub for every pairing of the given assumptions, from the stored tables."""
    network, plan = planning_network(store, config), store.read("planning_demand")
    grid = scenarios.assumption_grid(store.spark, headrooms, holdings)
    keys = ["capacity_headroom", "holding_cost"]
    placed = placement.place_units(scenarios.whatif_plans(grid, plan, network, config), keys, config)
    return reports.whatif_answer(scenarios.whatif(grid, plan, network, config),
                                 placement.placement_by_hub(placed, keys), config)


def figure_tables(store: Store, config: NetworkConfig) -> dict[str, DataFrame]:
    """The data behind the four figures."""
    lanes, distances = store.read("lane_weeks"), store.read("state_hub_distance")
    flows, plan = store.read("routing_probabilities"), store.read("planning_demand")
    lane_costs = costs.lane_costs(distances, costs.fit_freight_line(lanes, distances))
    results = store.read("scenario_results")
    return {
        "figure_weekly_totals": demand.weekly_group_totals(store.read("weekly_demand"), config),
        "figure_holdout_totals": demand.holdout_totals(store.read("forecast_holdout")),
        "figure_flow_matrix": reports.flow_matrix(flows, config),
        "figure_hub_volumes": reports.hub_volumes(
            costs.policy_lanes(plan, flows, lane_costs), store.read("optimal_placement"), config),
        "figure_saving_histogram": scenarios.saving_histogram(results, config),
        "figure_capacity_sensitivity": store.read("capacity_sensitivity"),
    }


def write_figure_tables(store: Store, config: NetworkConfig) -> DataFrame:
    """Store the figure tables; returns the summary of the scenario savings."""
    for name, table in figure_tables(store, config).items():
        store.write(name, table)
    return scenarios.saving_summary(store.read("scenario_results"))


def load_reporting(store: Store, url: str, **options: str) -> None:
    """Replace the reporting tables of a database with the stored ones."""
    for table in ("order_items", "weekly_demand"):
        load_reporting_table(store.read(table), url, table, **options)
