"""Cheapest placement of many plans at once, under hub capacity.

A plan asks for demand per state; the unit cost of serving a state depends on the hub only, and
each hub has a capacity. The network (costs and flows by state, peaks by hub) is one row that
the configuration bounds; it stands next to each plan, so a plan is one row that is valued on
its own: no join and no shuffle between plans. The cheapest units of a batch of plans are found
by `transport.placed_units`, for any number of hubs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hubloom.config import NetworkConfig
from hubloom.functions.draws import hash_unit
from hubloom.functions.numeric import saving_pct
from hubloom.operators.costs import lane_costs
from hubloom.operators.transport import cost_pieces, placed_units

# Unit costs are shifted by at most this much, by lane, to tell tied placements apart.
TIE_SHIFT = 1e-7


def _total(values: str) -> str:
    return f"aggregate({values}, 0.0D, (acc, v) -> acc + v)"


def network_row(distances: DataFrame, freight_line: DataFrame, flows: DataFrame,
                peaks: DataFrame, config: NetworkConfig) -> DataFrame:
    """The fixed part of all plans as one row.

    states: array of (customer_state, cost, tight_cost, policy) by state, each by hub
    peaks: array of the hubs' weekly peaks
    All arrays over hubs follow the order of `config.hubs`. `policy` is null for a state
    without flows. A state without a distance to one of the hubs is an error that names both.
    """
    def by_hub(column: str) -> Column:
        return F.array(*[F.max(F.when(F.col("hub") == h, F.col(column))) for h in config.hubs])

    def known(column: str) -> Column:
        """Costs by hub, or an error for the first hub without one."""
        values = by_hub(column)
        hub = F.get(F.lit(list(config.hubs)), (F.array_position(F.transform(values, lambda v: v.isNull()), True) - 1).cast("int"))
        message = F.concat(F.lit("no distance from state "), F.first("customer_state"), F.lit(" to hub "), hub)
        return F.when(F.exists(values, lambda v: v.isNull()), F.raise_error(message)).otherwise(values)

    lanes = (lane_costs(distances, freight_line)
             .join(F.broadcast(flows.select("customer_state", "hub", "p")),
                   ["customer_state", "hub"], "left")
             .withColumn("tight_cost", F.col("unit_cost")
                         + F.lit(TIE_SHIFT) * hash_unit(F.col("customer_state"), F.col("hub"))))
    states = (lanes.groupBy("customer_state")
              .agg(known("unit_cost").alias("cost"), known("tight_cost").alias("tight_cost"),
                   F.when(F.count("p") > 0, by_hub("p")).alias("policy"))
              .agg(F.array_sort(F.collect_list(
                  F.struct("customer_state", "cost", "tight_cost", "policy"))).alias("states")))
    peak_row = peaks.agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("hub") == h, F.col("peak"))), F.lit(0)).cast("double")
        for h in config.hubs]).alias("peaks"))
    return states.withColumn("peaks", peak_row.scalar())


def plan_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row per plan: its keys and its cells (state, group, demand) as an array.

    A plan has one cell per configured state and group, which bounds the array.
    """
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "customer_state", "product_group", F.col("demand").cast("double").alias("demand"))))
        .alias("cells"))


def single_plan(plan: DataFrame) -> DataFrame:
    return plan.agg(F.array_sort(F.collect_list(F.struct(
        "customer_state", "product_group", F.col("demand").cast("double").alias("demand"))))
        .alias("cells"))


def attach_network(plans: DataFrame, network: DataFrame) -> DataFrame:
    """Put the network next to each plan and line the plan's demand up with its states.

    Demand for a state the network does not know, or that has no flows, is an error:
    it must not drop out of the costs.
    """
    net = network.select(F.struct("*").alias("net")).scalar()
    attached = plans.withColumn("net", net)
    stranded = F.expr("""
        filter(cells, c -> c.demand > 0 AND NOT exists(net.states,
            s -> s.customer_state = c.customer_state AND s.policy IS NOT NULL))""")
    by_state = F.expr("""
        transform(net.states, s -> aggregate(
            filter(cells, c -> c.customer_state = s.customer_state),
            0.0D, (total, c) -> total + c.demand))""")
    message = F.concat(F.lit("no flow or distance for state "), stranded[0]["customer_state"])
    return attached.withColumn(
        "demand", F.when(F.size(stranded) > 0, F.raise_error(message)).otherwise(by_state))


def capacity_columns(plans: DataFrame, multipliers: Column) -> DataFrame:
    """Capacity of each hub in each plan: its peak times the plan's multiplier."""
    return plans.withColumn("caps", F.zip_with("net.peaks", multipliers, lambda p, m: p * m))


def evaluate_plans(plans: DataFrame) -> DataFrame:
    """Current-policy cost, cheapest cost, saving, feasibility and policy breach.

    `plans` carries net, demand, caps and holding.
    """
    def over_states(per_unit: str) -> str:
        return _total(f"zip_with(net.states, demand, (s, d) -> if(d > 0, d * {per_unit}, 0.0D))")

    loads = f"transform(net.peaks, (peak, h) -> {over_states('s.policy[h]')})"
    shipping = over_states(_total("zip_with(s.policy, s.cost, (p, c) -> p * c)"))
    costs = F.expr("flatten(net.states.cost)")
    shipped = _total("zip_with(flatten(net.states.cost), cheapest, (c, u) -> c * u)")
    return (plans
            .withColumn("cheapest", placed_units(costs, F.col("demand"), F.col("caps")))
            .withColumn("units", F.expr(_total("demand")))
            .withColumn("feasible", F.expr(f"units <= {_total('caps')}"))
            .withColumn("policy_loads", F.expr(loads))
            .withColumn("policy_cost", F.expr(f"{shipping} + holding * {_total('policy_loads')}"))
            .withColumn("optimised_cost", F.expr(f"if(feasible, {shipped} + holding * units, NULL)"))
            .withColumn("saving_pct", saving_pct(F.col("policy_cost"), F.col("optimised_cost")))
            .withColumn("policy_capacity_breach", F.expr(
                "exists(zip_with(policy_loads, caps, (load, cap) -> load > cap), b -> b)"))
            .drop("cheapest"))


def place_units(plans: DataFrame, keys: list[str], config: NetworkConfig) -> DataFrame:
    """An optimal placement of every feasible plan: units per state, group and hub.

    `plans` carries net, cells, demand and caps. Costs shifted by lane make the placement the
    only cheapest one. A state's units are split over its groups in proportion to their demand.
    """
    hubs = len(config.hubs)
    chosen = (plans.where(F.expr(f"{_total('demand')} <= {_total('caps')}"))
              .withColumn("placed", placed_units(F.expr("flatten(net.states.tight_cost)"), F.col("demand"), F.col("caps"))))
    by_state = chosen.select(*keys, "cells", "demand", "placed",
                             F.posexplode(F.expr("net.states.customer_state")).alias("i", "customer_state"))
    by_cell = by_state.select(
        *keys, "customer_state", F.expr("demand[i]").alias("state_demand"),
        F.expr(f"slice(placed, i * {hubs} + 1, {hubs})").alias("placed"),
        F.explode(F.expr("filter(cells, c -> c.customer_state = customer_state)")).alias("cell"))
    by_hub = F.inline(F.array(*[F.struct(F.lit(hub).alias("hub"), F.get("placed", F.lit(h)).alias("placed"))
                                for h, hub in enumerate(config.hubs)]))
    return (by_cell
            .select(*keys, "customer_state", F.col("cell.product_group").alias("product_group"),
                    F.expr("if(state_demand > 0, cell.demand / state_demand, 0.0D)").alias("share"), by_hub)
            .select(*keys, "customer_state", "product_group", "hub",
                    (F.col("placed") * F.col("share")).alias("units")))


def capacity_pieces(plans: DataFrame, keys: list[str]) -> DataFrame:
    """The cheapest cost of each plan as its capacity goes from `low_caps` to `caps`.

    Columns from_frac, to_frac, from_cost, to_cost, one row for each stretch on which the cost
    is linear in the fraction of the way; from the first fraction at which the plan is feasible,
    no row where it never is.
    """
    pieces = cost_pieces(F.expr("flatten(net.states.cost)"), F.col("demand"), F.col("low_caps"), F.col("caps"))
    held = F.col("holding") * F.expr(_total("demand"))
    return (plans.select(*keys, held.alias("held"), pieces.alias("pieces"))
            .select(*keys, "held", F.inline("pieces"))
            .select(*keys, "from_frac", "to_frac", (F.col("from_cost") + F.col("held")).alias("from_cost"),
                    (F.col("to_cost") + F.col("held")).alias("to_cost")))


def placement_by_hub(placement: DataFrame, keys: list[str]) -> DataFrame:
    return placement.groupBy(*keys, "hub").agg(F.sum("units").alias("units"))


def top_hub(placement: DataFrame) -> DataFrame:
    """Hub of the largest single placement of each state (ties: first hub by name)."""
    return placement.groupBy("customer_state").agg(
        F.min_by("hub", F.struct(-F.col("units"), F.col("hub"))).alias("chosen_hub"))


def cheapest_hub(costs: DataFrame) -> DataFrame:
    return costs.groupBy("customer_state").agg(
        F.min_by("hub", F.struct("unit_cost", "hub")).alias("nearest_hub"))


def placement_vs_nearest(placement: DataFrame, costs: DataFrame) -> DataFrame:
    return (top_hub(placement).join(cheapest_hub(costs), "customer_state")
            .withColumn("is_nearest", F.col("chosen_hub") == F.col("nearest_hub")))
