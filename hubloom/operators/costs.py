"""Freight line, hub capacities, flows and the cost of the current policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hubloom.config import NetworkConfig


def known_distance(state: Column, km: Column) -> Column:
    """The distance of a lane, or an error that names the state without one."""
    return F.when(km.isNull(), F.raise_error(F.concat(F.lit("no distance for state "), state))).otherwise(km)


def fit_freight_line(lanes: DataFrame, distances: DataFrame) -> DataFrame:
    """Least squares of item freight on distance over all items: freight = a + b km.

    All items of a lane share one distance, so the item-level fit only needs the
    count and the freight sum per lane.
    """
    per_lane = (lanes.groupBy("customer_state", "hub")
                .agg(F.sum("items").alias("n"), F.sum("freight").alias("freight"))
                .join(F.broadcast(distances), ["customer_state", "hub"], "left")
                .withColumn("km", known_distance(F.col("customer_state"), F.col("km"))))
    sums = per_lane.agg(
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("n") * F.col("km")).alias("x"),
        F.sum(F.col("n") * F.col("km") * F.col("km")).alias("xx"),
        F.sum("freight").alias("y"),
        F.sum(F.col("km") * F.col("freight")).alias("xy"))
    n, x, xx, y, xy = (F.col(c) for c in ("n", "x", "xx", "y", "xy"))
    slope = (n * xy - x * y) / F.nullif(n * xx - x * x, F.lit(0.0))
    return (sums.withColumn("b", slope)
            .select(((y - F.col("b") * x) / n).alias("a"), "b"))


def unit_cost(a: Column, b: Column, km: Column) -> Column:
    return a + b * km


def lane_costs(distances: DataFrame, freight_line: DataFrame) -> DataFrame:
    """Shipping cost per unit for every state and hub."""
    line = freight_line.select(F.struct("a", "b").alias("line")).scalar()
    return (distances.withColumn("line", line)
            .select("customer_state", "hub", "km",
                    unit_cost(F.col("line.a"), F.col("line.b"), F.col("km")).alias("unit_cost")))


def hub_peaks(lanes: DataFrame) -> DataFrame:
    """Largest weekly item count of each hub."""
    return (lanes.groupBy("hub", "week").agg(F.sum("items").alias("items"))
            .groupBy("hub").agg(F.max("items").alias("peak")))


def hub_capacities(lanes: DataFrame, headroom: float) -> DataFrame:
    return hub_peaks(lanes).select(
        "hub", (F.col("peak").cast("double") * F.lit(float(headroom))).alias("capacity"))


def empirical_flows(lanes: DataFrame, config: NetworkConfig) -> DataFrame:
    """Share of each state's items that each hub ships; 0 where a hub ships none."""
    shipped = [F.sum(F.when(F.col("hub") == hub, F.col("items")).otherwise(0)) for hub in config.hubs]
    per_state = lanes.groupBy("customer_state").agg(
        F.sum("items").alias("total"),
        F.array(*[F.struct(F.lit(hub).alias("hub"), n.alias("n"))
                  for hub, n in zip(config.hubs, shipped)]).alias("hubs"))
    return per_state.select("customer_state", "total", F.inline("hubs")).select(
        "customer_state", "hub", (F.col("n") / F.col("total")).alias("p"))


def policy_lanes(demand: DataFrame, flows: DataFrame, costs: DataFrame) -> DataFrame:
    """Units the current policy sends over each lane, with their unit cost.

    `flows` and `costs` hold one row per configured (state, hub). A cell whose state
    has no flow or cost keeps a null lane, so that it fails below instead of
    dropping its demand.
    """
    lanes = costs.join(F.broadcast(flows), ["customer_state", "hub"], "left")
    return (demand.join(F.broadcast(lanes), "customer_state", "left")
            .withColumn("units", F.when(F.col("demand") == 0, F.lit(0.0))
                        .otherwise(F.col("demand") * F.col("p")))
            .withColumn("units", F.when(
                (F.col("demand") != 0) & (F.col("p").isNull() | F.col("unit_cost").isNull()),
                F.raise_error(F.concat(F.lit("no flow or distance for state "),
                                       F.col("customer_state")))).otherwise(F.col("units"))))


def policy_cost(lanes: DataFrame, holding: float) -> DataFrame:
    return lanes.agg(F.sum(F.col("units") * (F.col("unit_cost") + F.lit(float(holding))))
                     .alias("policy_cost"))


def policy_loads(lanes: DataFrame, capacities: DataFrame) -> DataFrame:
    """Policy load per hub against its capacity (strictly above is a breach).

    A hub that has shipped nothing has no capacity, as in the placement.
    """
    return (lanes.groupBy("hub").agg(F.sum("units").alias("load"))
            .join(F.broadcast(capacities), "hub", "left")
            .withColumn("capacity", F.coalesce("capacity", F.lit(0.0)))
            .withColumn("breach", F.col("load") > F.col("capacity")))
