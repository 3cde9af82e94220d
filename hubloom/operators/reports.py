"""Report tables: flow shares, moving averages, hub freight, hub volumes, extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hubloom.config import NetworkConfig
from hubloom.functions.numeric import round_half_up
from hubloom.operators.demand import CELL


def flow_share_report(lanes: DataFrame) -> DataFrame:
    """Share of each state's items per hub that ships to it, rounded to 3 digits."""
    in_state = Window.partitionBy("customer_state")
    counts = lanes.groupBy("customer_state", "hub").agg(F.sum("items").alias("n"))
    share = F.col("n") / F.sum("n").over(in_state)
    return (counts.select("customer_state", "hub", round_half_up(share, 3).alias("share"))
            .orderBy("customer_state", F.desc("share")))


def moving_average_report(demand: DataFrame) -> DataFrame:
    """Weekly demand with the mean of up to four weeks ending there, to 1 digit."""
    trailing = Window.partitionBy(*CELL).orderBy("week").rowsBetween(-3, Window.currentRow)
    return (demand.select("week", *CELL, "demand", round_half_up(
                F.avg("demand").over(trailing), 1).alias("demand_ma4"))
            .orderBy(*CELL, "week"))


def hub_freight_report(lanes: DataFrame) -> DataFrame:
    """Items, mean freight and total freight per hub, busiest first."""
    totals = lanes.groupBy("hub").agg(F.sum("items").alias("items"), F.sum("freight").alias("freight"))
    return totals.select(
        "hub", "items",
        round_half_up(F.col("freight") / F.col("items"), 2).alias("avg_freight"),
        round_half_up(F.col("freight"), 0).alias("total_freight")).orderBy(F.desc("items"))


def hub_volumes(policy: DataFrame, placement: DataFrame, config: NetworkConfig) -> DataFrame:
    """Planning-week units per hub: current policy against the optimised plan."""
    hubs = policy.sparkSession.range(1).select(F.explode(F.lit(list(config.hubs))).alias("hub"))
    moved = policy.select("hub", F.col("units").alias("policy_units"), F.lit(0.0).alias("optimised_units"))
    placed = placement.select("hub", F.lit(0.0).alias("policy_units"), F.col("units").alias("optimised_units"))
    none = hubs.select("hub", F.lit(0.0).alias("policy_units"), F.lit(0.0).alias("optimised_units"))
    return moved.unionByName(placed).unionByName(none).groupBy("hub").agg(
        F.sum("policy_units").alias("policy_units"),
        F.sum("optimised_units").alias("optimised_units"))


def flow_matrix(flows: DataFrame, config: NetworkConfig, digits: int = 4) -> DataFrame:
    """Flows with one rounded column per hub."""
    return flows.groupBy("customer_state").agg(*[
        round_half_up(F.max(F.when(F.col("hub") == hub, F.col("p"))), digits).alias(hub)
        for hub in config.hubs])


def whatif_summary(evaluated: DataFrame) -> DataFrame:
    """What-if results rounded for presentation."""
    return evaluated.select(
        "capacity_headroom", "holding_cost", "feasible",
        round_half_up(F.col("policy_cost"), 0).alias("current_policy_cost"),
        round_half_up(F.col("optimised_cost"), 0).alias("optimised_cost"),
        round_half_up(F.col("saving_pct"), 2).alias("saving_pct"))


def whatif_answer(evaluated: DataFrame, hub_units: DataFrame, config: NetworkConfig) -> DataFrame:
    """What-if summary with the weekly units of each hub, rounded to whole units.

    An infeasible assumption keeps its row; its units are null like its costs.
    """
    keys = ["capacity_headroom", "holding_cost"]
    units = hub_units.groupBy(*keys).agg(*[
        round_half_up(F.sum(F.when(F.col("hub") == hub, F.col("units"))), 0).alias(f"units_{hub}")
        for hub in config.hubs])
    return whatif_summary(evaluated).join(units, keys, "left")
