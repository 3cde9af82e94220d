"""The planning stages chained over one set of raw tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from hubloom.config import NetworkConfig, STAR_NETWORK
from hubloom.operators import costs, demand, forecast, geography, items, placement, reports
from hubloom.operators import routing, scenarios
from hubloom.session import materialise, store
from hubloom.sources.raw import RawTables
from hubloom.sources.star import add_distance_freight, read_star_tables

FreightRule = Callable[[DataFrame, DataFrame], DataFrame]


class Planning:
    """Stage tables over `raw`, each built on first use and shared by later stages.

    `models` picks the fitted models (ridge demand, logistic routing); without it the
    plan uses the naive forecast and the observed flows, which plain SQL can check.
    `freight_rule` completes item freight from the distances, for sources without a
    freight column; `freight=False` leaves the step out where freight is not used.

    Tables that several later stages read are written once to the shared folder: centroids,
    distances, the weekly lane summary and the network row, bounded by the configuration;
    the routing profile and the scenario results, which are not. With `models` (or
    `share_items`), where both the lane summary and the routing profile are wanted, the
    joined items are written as well. So the raw items are read once per query, and a lost
    executor never sends a later stage back to them.
    """

    def __init__(self, raw: RawTables, config: NetworkConfig, *, models: bool = False,
                 freight: bool = True, freight_rule: FreightRule | None = None,
                 share_items: bool = False) -> None:
        self.raw, self.config, self.models = raw, config, models
        self._share_items = models or share_items
        self._freight_rule = freight_rule if freight else None

    @classmethod
    def over_star(cls, spark: SparkSession, folder: str, **options) -> "Planning":
        return cls(read_star_tables(spark, folder), STAR_NETWORK,
                   freight_rule=add_distance_freight, **options)

    @property
    def spark(self) -> SparkSession:
        return self.raw.order_items.sparkSession

    # geography
    @cached_property
    def centroids(self) -> DataFrame:
        return materialise(geography.state_centroids(self.raw.geolocation, self.config.centroid_accuracy))

    @cached_property
    def hub_centroids(self) -> DataFrame:
        return geography.hub_centroids(self.centroids, self.config)

    @cached_property
    def distances(self) -> DataFrame:
        return materialise(geography.state_hub_distances(self.centroids, self.config))

    # items and demand
    @cached_property
    def items(self) -> DataFrame:
        built = items.build_order_items(self.raw, self.config)
        built = built if self._freight_rule is None else self._freight_rule(built, self.distances)
        return store(built) if self._share_items else built

    @cached_property
    def lanes(self) -> DataFrame:
        return materialise(items.lane_weeks(self.items))

    @cached_property
    def weekly_demand(self) -> DataFrame:
        return demand.weekly_demand(self.lanes, self.config)

    @cached_property
    def features(self) -> DataFrame:
        return demand.demand_features(self.weekly_demand, self.config)

    # forecast
    @cached_property
    def ridge(self) -> forecast.RidgeForecast:
        return forecast.ridge_forecast(self.features, self.config)

    @cached_property
    def naive_holdout(self) -> DataFrame:
        return demand.naive_holdout(self.features, self.config)

    @cached_property
    def holdout(self) -> DataFrame:
        return self.ridge.holdout if self.models else self.naive_holdout

    @cached_property
    def plan(self) -> DataFrame:
        return demand.planning_demand(self.holdout)

    # routing
    @cached_property
    def routing_profile(self) -> DataFrame:
        return materialise(routing.routing_profile(self.items, self.config))

    @cached_property
    def routing_model(self) -> routing.RoutingModel:
        return routing.fit_routing(self.routing_profile, self.distances, self.config)

    @cached_property
    def empirical_flows(self) -> DataFrame:
        return costs.empirical_flows(self.lanes, self.config)

    @cached_property
    def flows(self) -> DataFrame:
        if self.models:
            return routing.model_flows(self.routing_model.scored, self.config)
        return self.empirical_flows

    # costs
    @cached_property
    def freight_line(self) -> DataFrame:
        return costs.fit_freight_line(self.lanes, self.distances)

    @cached_property
    def lane_costs(self) -> DataFrame:
        return costs.lane_costs(self.distances, self.freight_line)

    @cached_property
    def peaks(self) -> DataFrame:
        return costs.hub_peaks(self.lanes)

    @cached_property
    def capacities(self) -> DataFrame:
        return costs.hub_capacities(self.lanes, self.config.capacity_headroom)

    @cached_property
    def policy_lanes(self) -> DataFrame:
        return costs.policy_lanes(self.plan, self.flows, self.lane_costs)

    # placement
    @cached_property
    def network(self) -> DataFrame:
        return materialise(placement.network_row(
            self.distances, self.freight_line, self.flows, self.peaks, self.config))

    @cached_property
    def plan_result(self) -> DataFrame:
        return placement.evaluate_plans(scenarios.base_plan(
            self.plan, self.network, self.config)).select(
            "feasible", "units", *scenarios.RESULT)

    @cached_property
    def optimal_placement(self) -> DataFrame:
        return placement.place_units(scenarios.base_plan(
            self.plan, self.network, self.config), [], self.config)

    # evaluation
    @cached_property
    def scenario_demand(self) -> DataFrame:
        return scenarios.scenario_demand(self.plan, self.holdout, self.config)

    @cached_property
    def scenario_results(self) -> DataFrame:
        return scenarios.evaluate_scenarios(self.scenario_demand, self.network, self.config)

    @cached_property
    def scenario_table(self) -> DataFrame:
        """The scenario results written once, for the summaries that read them repeatedly."""
        return materialise(self.scenario_results)

    @cached_property
    def capacity_sensitivity(self) -> DataFrame:
        return scenarios.capacity_sensitivity(self.plan, self.network, self.config)

    @cached_property
    def capacity_breakpoints(self) -> DataFrame:
        return scenarios.capacity_breakpoints(self.plan, self.network, self.config)

    @cached_property
    def sweep_placement(self) -> DataFrame:
        plans = scenarios.sweep_plans(self.plan, self.network, self.config)
        return placement.place_units(plans, ["regional_capacity_frac"], self.config)

    def whatif(self, assumptions: DataFrame) -> DataFrame:
        return scenarios.whatif(assumptions, self.plan, self.network, self.config)

    def whatif_units(self, assumptions: DataFrame) -> DataFrame:
        plans = scenarios.whatif_plans(assumptions, self.plan, self.network, self.config)
        keys = ["capacity_headroom", "holding_cost"]
        return placement.placement_by_hub(placement.place_units(plans, keys, self.config), keys)

    def whatif_answer(self, assumptions: DataFrame) -> DataFrame:
        return reports.whatif_answer(self.whatif(assumptions), self.whatif_units(assumptions), self.config)

    def hub_volumes(self) -> DataFrame:
        return reports.hub_volumes(self.policy_lanes, self.optimal_placement, self.config)
