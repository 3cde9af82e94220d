"""The registered queries over the star-schema tables, by name.

Every query starts from the parquet tables of a folder. Doubles leave rounded half up,
to six digits unless noted, so that engines which add in another order agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from hubloom.functions.numeric import round_half_up
from hubloom.operators import costs, demand, forecast, geography, items, placement, reports, routing, scenarios
from hubloom.plans import stages
from hubloom.plans.planning import Planning
from hubloom.session import materialise
from hubloom.sources.raw import table_counts
from hubloom.sources.sinks import reporting_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Assumptions of the registered what-if grid.
HEADROOMS = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]
HOLDINGS = [0.0, 1.0, 5.0, 50.0]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        round_half_up(F.col(f"`{name}`"), digits).alias(name) if kind == "double" else F.col(f"`{name}`")
        for name, kind in df.dtypes])


def query(digits: int = 6, **options) -> Callable[[Callable[[Planning], DataFrame]], Query]:
    """Register a query written against a `Planning` built with the given options."""
    def register(build: Callable[[Planning], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(build(Planning.over_star(spark, folder, **options)), digits)

        run.__doc__ = build.__doc__
        QUERIES[build.__name__] = run
        return run

    return register


counts_only = query(freight=False)
full = query()
shared = query(freight=False, share_items=True)  # lanes and routing profile of the same items
fitted = query(digits=2, models=True)  # costs to the cent: the fit is iterative


# sources and preparation

@counts_only
def raw_table_rows(p: Planning) -> DataFrame:
    """Rows of each raw table, and rows rejected as malformed."""
    return table_counts(p.raw)


@counts_only
def delivered_orders(p: Planning) -> DataFrame:
    return items.delivered_orders(p.raw, p.config)


@counts_only
def product_groups(p: Planning) -> DataFrame:
    return items.product_groups(p.raw, p.config)


@full
def order_items(p: Planning) -> DataFrame:
    return p.items


@counts_only
def preparation_summary(p: Planning) -> DataFrame:
    return items.preparation_summary(p.lanes)


@counts_only
def state_centroids(p: Planning) -> DataFrame:
    return p.centroids


@counts_only
def state_centroids_sketch(p: Planning) -> DataFrame:
    """State medians by sketch, in one pass: off by at most one rank in 10,000."""
    return geography.state_centroids(p.raw.geolocation, accuracy=10_000)


@counts_only
def hub_centroids(p: Planning) -> DataFrame:
    return p.hub_centroids


@counts_only
def state_hub_distances(p: Planning) -> DataFrame:
    return p.distances


@full
def store_round_trip(p: Planning) -> DataFrame:
    """Two published versions of stored tables, read back as they stood: rows and sums."""
    return stages.store_round_trip(p.items, p.weekly_demand)


# demand

@counts_only
def calendar_bounds(p: Planning) -> DataFrame:
    return demand.calendar_bounds(p.lanes)


@counts_only
def weekly_demand(p: Planning) -> DataFrame:
    return p.weekly_demand


@counts_only
def reporting_weekly_demand(p: Planning) -> DataFrame:
    """Weekly demand in the types of the reporting table."""
    return reporting_columns(p.weekly_demand, "weekly_demand")


@full
def reporting_order_items(p: Planning) -> DataFrame:
    """Order items in the reporting types, money as text so that no digit is lost."""
    typed = reporting_columns(p.items, "order_items")
    return typed.withColumns({c: F.col(c).cast("decimal(38,6)").cast("string") for c in ("price", "freight_value")})


@counts_only
def weekly_group_totals(p: Planning) -> DataFrame:
    return demand.weekly_group_totals(p.weekly_demand, p.config)


@counts_only
def demand_features(p: Planning) -> DataFrame:
    return p.features


@counts_only
def demand_design_totals(p: Planning) -> DataFrame:
    """Sum of every model feature over the rows of the demand design."""
    design = forecast.model_frame(p.features, p.config)
    totals = design.agg(vector_to_array(Summarizer.sum(F.col("features"))).alias("total"))
    return _named(totals, forecast.feature_names(p.config))


def _named(totals: DataFrame, names: list[str]) -> DataFrame:
    return totals.select(F.posexplode("total").alias("i", "total")).select(
        F.get(F.lit(names), F.col("i")).alias("feature"), "total")


@counts_only
def holdout_weeks(p: Planning) -> DataFrame:
    """Rows per week with the training or holdout flag."""
    return (demand.mark_holdout(p.features, p.config).groupBy("week", "is_holdout")
            .agg(F.count("*").alias("rows")))


@counts_only
def naive_holdout(p: Planning) -> DataFrame:
    return p.naive_holdout


@counts_only
def naive_accuracy(p: Planning) -> DataFrame:
    return demand.forecast_accuracy(p.naive_holdout)


@counts_only
def naive_holdout_totals(p: Planning) -> DataFrame:
    return demand.holdout_totals(p.naive_holdout)


@counts_only
def naive_planning_demand(p: Planning) -> DataFrame:
    return p.plan


@counts_only
def naive_planning_totals(p: Planning) -> DataFrame:
    return demand.planning_totals(p.plan)


# routing

@counts_only
def empirical_flows(p: Planning) -> DataFrame:
    return p.empirical_flows


@counts_only
def empirical_flow_matrix(p: Planning) -> DataFrame:
    return reports.flow_matrix(p.empirical_flows, p.config)


@counts_only
def routing_features(p: Planning) -> DataFrame:
    """Distances to all hubs and log price of every item."""
    rows = routing.routing_features(p.items, p.distances, p.config)
    return rows.select(*items.ITEM_KEY, "price", "hub", "product_group", "customer_state",
                       *routing.distance_columns(p.config), "log_price")


@counts_only
def routing_design_totals(p: Planning) -> DataFrame:
    """Sum of every model feature over all items."""
    design = routing.routing_design(p.routing_profile, p.distances, p.config)
    weighted = Summarizer.metrics("sum").summary(F.col("features"), F.col("n").cast("double"))
    totals = design.agg(vector_to_array(weighted["sum"]).alias("total"))
    names = [*routing.distance_columns(p.config), "log_price",
             *[f"g_{g}" for g in sorted(p.config.groups)],
             *[f"st_{s}" for s in sorted(p.config.states)]]
    return _named(totals, names)


@counts_only
def routing_split(p: Planning) -> DataFrame:
    return routing.hub_split(p.routing_profile)


@counts_only
def routing_baseline(p: Planning) -> DataFrame:
    return routing.baseline_metrics(p.routing_profile, p.config)


# costs of the current policy

@full
def freight_line(p: Planning) -> DataFrame:
    return p.freight_line


@full
def lane_costs(p: Planning) -> DataFrame:
    return p.lane_costs


@counts_only
def hub_capacities(p: Planning) -> DataFrame:
    return p.capacities


@full
def policy_cost(p: Planning) -> DataFrame:
    return costs.policy_cost(p.policy_lanes, p.config.holding_cost)


@full
def policy_hub_loads(p: Planning) -> DataFrame:
    return costs.policy_loads(p.policy_lanes, p.capacities)


# placement

@full
def plan_costs(p: Planning) -> DataFrame:
    """Current and optimised cost, saving, breach and feasibility of the planning week."""
    return p.plan_result


@full
def optimal_placement(p: Planning) -> DataFrame:
    return p.optimal_placement


@full
def placement_by_hub(p: Planning) -> DataFrame:
    return placement.placement_by_hub(p.optimal_placement, [])


@full
def placement_vs_nearest(p: Planning) -> DataFrame:
    return placement.placement_vs_nearest(p.optimal_placement, p.lane_costs)


@full
def hub_volumes(p: Planning) -> DataFrame:
    return p.hub_volumes()


# scenarios and what-ifs

@counts_only
def scenario_demand(p: Planning) -> DataFrame:
    return p.scenario_demand


@full
def scenario_results(p: Planning) -> DataFrame:
    return p.scenario_results


@full
def scenario_saving_summary(p: Planning) -> DataFrame:
    return scenarios.saving_summary(p.scenario_table)


@full
def scenario_saving_histogram(p: Planning) -> DataFrame:
    return scenarios.saving_histogram(p.scenario_table, p.config)


@full
def capacity_sensitivity(p: Planning) -> DataFrame:
    return p.capacity_sensitivity


@full
def capacity_breakpoints(p: Planning) -> DataFrame:
    """The fractions of regional capacity at which the optimised cost changes its slope."""
    return p.capacity_breakpoints


@full
def scenario_breakpoints(p: Planning) -> DataFrame:
    """Where the optimised cost of each demand scenario stops falling, and how much it falls to there."""
    pieces = scenarios.scenario_breakpoints(p.scenario_demand, p.network, p.config)
    falling = F.when(F.col("to_cost") < F.col("from_cost") - 1e-6, F.col("to_frac"))
    return pieces.groupBy("scenario").agg(
        F.coalesce(F.max(falling), F.min("from_frac")).alias("enough_capacity_frac"),
        F.max("from_cost").alias("cost_without"), F.min("to_cost").alias("cost_with"))


@full
def sweep_placement_checks(p: Planning) -> DataFrame:
    """Units, cost and hub use of the placements of the capacity sweep.

    The cost is added up over the placed units and has to meet the optimised cost; every
    cell's units have to meet its demand, and no hub's load may exceed its capacity.
    """
    placed = materialise(p.sweep_placement)
    per_unit = p.lane_costs.select("customer_state", "hub", "unit_cost")
    frac = "regional_capacity_frac"
    cells = (placed.groupBy(frac, *demand.CELL).agg(F.sum("units").alias("units"))
             .join(F.broadcast(p.plan), demand.CELL)
             .groupBy(frac).agg(round_half_up(F.max(F.abs(F.col("units") - F.col("demand"))), 6).alias("demand_gap")))
    share = F.when(F.col("hub") == p.config.primary_hub, p.config.primary_multiplier).otherwise(F.col(frac))
    over = F.col("load") - F.col("capacity") * share
    hubs = (placed.groupBy(frac, "hub").agg(F.sum("units").alias("load"))
            .join(F.broadcast(p.capacities), "hub")
            .groupBy(frac).agg(round_half_up(F.greatest(F.max(over), F.lit(0.0)), 6).alias("over_capacity")))
    return (placed.join(F.broadcast(per_unit), ["customer_state", "hub"])
            .groupBy(frac)
            .agg(round_half_up(F.sum("units"), 6).alias("units"),
                 round_half_up(F.sum(F.col("units") * (F.col("unit_cost")
                                                       + F.lit(p.config.holding_cost))), 3)
                 .alias("placement_cost"),
                 (F.min("units") >= -1e-9).alias("non_negative"))
            .join(cells, frac).join(hubs, frac))


@full
def sweep_hub_units(p: Planning) -> DataFrame:
    """Units per hub along the capacity sweep."""
    return rounded(placement.placement_by_hub(p.sweep_placement, ["regional_capacity_frac"]), 3)


def _assumptions(p: Planning) -> DataFrame:
    return scenarios.assumption_grid(p.spark, HEADROOMS, HOLDINGS)


@full
def whatif_grid(p: Planning) -> DataFrame:
    return p.whatif(_assumptions(p))


@full
def whatif_summary(p: Planning) -> DataFrame:
    return reports.whatif_summary(p.whatif(_assumptions(p)))


@full
def whatif_hub_units(p: Planning) -> DataFrame:
    return rounded(p.whatif_units(_assumptions(p)), 3)


@full
def whatif_answer(p: Planning) -> DataFrame:
    """Rounded costs, saving and weekly units by hub of every assumption, in one row each."""
    return p.whatif_answer(_assumptions(p))


# reports

@counts_only
def flow_share_report(p: Planning) -> DataFrame:
    return reports.flow_share_report(p.lanes)


@counts_only
def moving_average_report(p: Planning) -> DataFrame:
    return reports.moving_average_report(p.weekly_demand)


@full
def hub_freight_report(p: Planning) -> DataFrame:
    return reports.hub_freight_report(p.lanes)


# fitted models and what follows from them

@counts_only
def ridge_coefficients(p: Planning) -> DataFrame:
    return p.ridge.coefficients(p.config)


@counts_only
def ridge_holdout(p: Planning) -> DataFrame:
    return p.ridge.holdout


@counts_only
def ridge_accuracy(p: Planning) -> DataFrame:
    return demand.accuracy_report(p.ridge.holdout, p.naive_holdout)


@counts_only
def ridge_holdout_totals(p: Planning) -> DataFrame:
    return demand.holdout_totals(p.ridge.holdout)


@counts_only
def ridge_planning_demand(p: Planning) -> DataFrame:
    return demand.planning_demand(p.ridge.holdout)


@counts_only
def routing_metrics(p: Planning) -> DataFrame:
    return routing.routing_metrics(p.routing_model.scored)


@counts_only
def routing_model_flows(p: Planning) -> DataFrame:
    return reports.flow_matrix(routing.model_flows(p.routing_model.scored, p.config), p.config)


@shared
def routing_flow_fit(p: Planning) -> DataFrame:
    model = routing.model_flows(p.routing_model.scored, p.config)
    return routing.flow_fit(model, p.empirical_flows)


@fitted
def model_plan_costs(p: Planning) -> DataFrame:
    return p.plan_result


@fitted
def model_placement(p: Planning) -> DataFrame:
    return p.optimal_placement


@fitted
def model_scenario_results(p: Planning) -> DataFrame:
    return p.scenario_results


@fitted
def model_capacity_sensitivity(p: Planning) -> DataFrame:
    return p.capacity_sensitivity


@fitted
def model_whatif_grid(p: Planning) -> DataFrame:
    return p.whatif(_assumptions(p))
