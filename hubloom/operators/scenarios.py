"""Demand scenarios, the capacity sweep and the what-if grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hubloom.config import NetworkConfig
from hubloom.functions.draws import hash32
from hubloom.functions.numeric import non_negative
from hubloom.operators.demand import CELL
from hubloom.operators.placement import (
    attach_network, capacity_columns, capacity_pieces, evaluate_plans, plan_rows, single_plan)
from hubloom.operators.quantiles import exact_quantiles
from hubloom.sources.small import literal_table

RESULT = ["policy_cost", "optimised_cost", "saving_pct", "policy_capacity_breach"]


def _uniform(multiplier: Column, config: NetworkConfig) -> Column:
    return F.array(*[multiplier for _ in config.hubs])


def scenario_demand(plan: DataFrame, holdout: DataFrame, config: NetworkConfig,
                    count: int | None = None, seed: int | None = None) -> DataFrame:
    """Bootstrap scenarios: each cell's planned demand plus one of its own residuals.

    A residual is drawn with replacement per scenario and cell, by a hash of both, and
    demand is kept non-negative. Scenario ids come from a distributed range and meet
    the cells (one row per configured state and group) as an array, so scenarios
    spread over the executors and stay there.
    """
    count = config.scenario_count if count is None else count
    seed = config.seed if seed is None else seed
    residuals = holdout.groupBy(*CELL).agg(
        F.array_sort(F.collect_list(F.struct("week", "residual"))).alias("history"))
    known = F.when(F.size("history") > 0, F.col("history.residual")).otherwise(
        F.raise_error(F.concat(F.lit("no holdout residuals for cell "), F.concat_ws("|", *CELL))))
    cells = plan.join(F.broadcast(residuals), CELL, "left").agg(
        F.array_sort(F.collect_list(F.struct(
            *CELL, "demand", known.alias("residuals")))).alias("cells"))
    drawn = hash32(F.lit(seed), F.col("scenario"), F.col("cell.customer_state"),
                   F.col("cell.product_group")) % F.size("cell.residuals")
    return (plan.sparkSession.range(count).withColumnRenamed("id", "scenario")
            .withColumn("cell", F.explode(cells.scalar()))
            .select("scenario", "cell.customer_state", "cell.product_group",
                    non_negative(F.col("cell.demand")
                                 + F.get("cell.residuals", drawn.cast("int"))).alias("demand")))


def evaluate_scenarios(scenarios: DataFrame, network: DataFrame, config: NetworkConfig) -> DataFrame:
    """Cost of the current policy and of the re-optimised plan, scenario by scenario."""
    plans = attach_network(plan_rows(scenarios, ["scenario"]), network)
    plans = capacity_columns(plans, _uniform(F.lit(config.capacity_headroom), config))
    plans = plans.withColumn("holding", F.lit(config.holding_cost))
    return evaluate_plans(plans).select("scenario", *RESULT)


def saving_summary(results: DataFrame) -> DataFrame:
    """Describe the savings, and the share of scenarios where the policy breaches.

    Reads the results several times: pass a written table.
    """
    quartiles = exact_quantiles(results.selectExpr("1 AS all", "saving_pct"), "all",
                                ["saving_pct"], [0.25, 0.5, 0.75])
    row = quartiles.agg(F.expr("map_from_entries(collect_list(struct(fraction, value)))").alias("q"))
    return results.agg(
        F.count("saving_pct").alias("scenarios"),
        F.avg("saving_pct").alias("mean"), F.stddev_samp("saving_pct").alias("std"),
        F.min("saving_pct").alias("min"), F.max("saving_pct").alias("max"),
        F.avg(F.col("policy_capacity_breach").cast("int")).alias("breach_rate"),
    ).withColumn("q", row.scalar()).selectExpr(
        "scenarios", "mean", "std", "min", "q[0.25D] AS p25", "q[0.5D] AS p50",
        "q[0.75D] AS p75", "max", "breach_rate")


def saving_histogram(results: DataFrame, config: NetworkConfig) -> DataFrame:
    """Equal-width bins between the smallest and the largest saving, the last one closed.

    When all savings are equal the bins span one unit around them.
    """
    bins = config.saving_bins
    span = results.agg(F.min("saving_pct").alias("lo"), F.max("saving_pct").alias("hi"))
    pad = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    span = span.select(F.struct((F.col("lo") - pad).alias("lo"),
                                (F.col("hi") + pad).alias("hi")).alias("span"))
    position = (F.col("saving_pct") - F.col("span.lo")) / (F.col("span.hi") - F.col("span.lo"))
    counted = (results.where(F.col("saving_pct").isNotNull())
               .withColumn("span", span.scalar())
               .select(F.least(F.floor(position * F.lit(float(bins))), F.lit(bins - 1))
                       .cast("int").alias("bin"), F.lit(1).alias("n")))
    empty = results.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), F.lit(0).alias("n"))
    counts = counted.unionByName(empty).groupBy("bin").agg(F.sum("n").alias("scenarios"))
    width = (F.col("span.hi") - F.col("span.lo")) / F.lit(float(bins))
    return (counts.withColumn("span", span.scalar())
            .select("bin", (F.col("span.lo") + F.col("bin") * width).alias("bin_start"), "scenarios"))


def base_plan(plan: DataFrame, network: DataFrame, config: NetworkConfig) -> DataFrame:
    """The planned demand as one plan, with the configured headroom and holding cost."""
    plans = capacity_columns(attach_network(single_plan(plan), network),
                             _uniform(F.lit(config.capacity_headroom), config))
    return plans.withColumn("holding", F.lit(config.holding_cost))


def sweep_plans(plan: DataFrame, network: DataFrame, config: NetworkConfig) -> DataFrame:
    """The planned demand under a sweep of regional capacity, one plan per fraction.

    The primary hub gets ample capacity; the others the given fraction of theirs.
    """
    steps = config.sweep_steps
    fractions = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    plans = (attach_network(single_plan(plan), network)
             .withColumn("step", fractions)
             .withColumn("regional_capacity_frac", F.col("step") / F.lit(float(steps))))
    multipliers = _regional(F.col("regional_capacity_frac"), config)
    return capacity_columns(plans, multipliers).withColumn("holding", F.lit(config.holding_cost))


def _regional(fraction: Column, config: NetworkConfig) -> Column:
    """Multipliers of the hubs' peaks when the regional hubs have a fraction of their capacity."""
    return F.array(*[
        F.lit(config.capacity_headroom) * (F.lit(config.primary_multiplier) if hub == config.primary_hub else fraction)
        for hub in config.hubs])


def capacity_sensitivity(plan: DataFrame, network: DataFrame, config: NetworkConfig) -> DataFrame:
    return evaluate_plans(sweep_plans(plan, network, config)).select(
        "regional_capacity_frac", "optimised_cost", "saving_pct")


def capacity_breakpoints(plan: DataFrame, network: DataFrame, config: NetworkConfig) -> DataFrame:
    """Between which fractions of regional capacity the optimised cost is linear: the sweep, exactly."""
    plans = attach_network(single_plan(plan), network).withColumn("holding", F.lit(config.holding_cost))
    plans = capacity_columns(plans, _regional(F.lit(0.0), config)).withColumnRenamed("caps", "low_caps")
    return capacity_pieces(capacity_columns(plans, _regional(F.lit(1.0), config)), [])


def scenario_breakpoints(scenarios: DataFrame, network: DataFrame, config: NetworkConfig) -> DataFrame:
    """`capacity_breakpoints` of every scenario."""
    plans = attach_network(plan_rows(scenarios, ["scenario"]), network).withColumn("holding", F.lit(config.holding_cost))
    plans = capacity_columns(plans, _regional(F.lit(0.0), config)).withColumnRenamed("caps", "low_caps")
    return capacity_pieces(capacity_columns(plans, _regional(F.lit(1.0), config)), ["scenario"])


def assumption_grid(spark, headrooms: list[float], holdings: list[float]) -> DataFrame:
    """Every pairing of the given what-if assumptions; values out of range are an error."""
    if not all(0 < h <= 5 for h in headrooms):
        raise ValueError("capacity_headroom must lie in (0, 5]")
    if not all(0 <= h <= 50 for h in holdings):
        raise ValueError("holding_cost must lie in [0, 50]")
    pairs = [(c, h) for c in headrooms for h in holdings]
    return literal_table(spark, capacity_headroom=[float(c) for c, _ in pairs],
                         holding_cost=[float(h) for _, h in pairs])


def whatif_plans(assumptions: DataFrame, plan: DataFrame, network: DataFrame,
                 config: NetworkConfig) -> DataFrame:
    """One plan per row of (capacity_headroom, holding_cost).

    Tables of assumptions are checked row by row as well.
    """
    valid = (F.col("capacity_headroom").between(F.lit(0.0), F.lit(5.0))
             & (F.col("capacity_headroom") > 0)
             & F.col("holding_cost").between(F.lit(0.0), F.lit(50.0)))
    headroom = F.when(valid, F.col("capacity_headroom")).otherwise(
        F.raise_error(F.lit("capacity_headroom must lie in (0, 5], holding_cost in [0, 50]")))
    plans = attach_network(assumptions.withColumn("cells", single_plan(plan).scalar()), network)
    plans = plans.withColumn("multiplier", headroom).withColumn("holding", F.col("holding_cost"))
    return capacity_columns(plans, _uniform(F.col("multiplier"), config))


def whatif(assumptions: DataFrame, plan: DataFrame, network: DataFrame,
           config: NetworkConfig) -> DataFrame:
    """Costs and saving per assumption; an infeasible one is a flagged row."""
    evaluated = evaluate_plans(whatif_plans(assumptions, plan, network, config))
    return evaluated.select("capacity_headroom", "holding_cost", "feasible",
                            "policy_cost", "optimised_cost", "saving_pct")
