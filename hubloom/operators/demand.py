"""Weekly demand series: dense grid, features, holdout split, naive forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hubloom.config import NetworkConfig
from hubloom.functions.calendar import seasonal_terms, weeks_since

CELL = ["customer_state", "product_group"]


def calendar_bounds(lanes: DataFrame) -> DataFrame:
    return lanes.agg(F.min("week").alias("first_week"), F.max("week").alias("last_week"))


def weekly_demand(lanes: DataFrame, config: NetworkConfig) -> DataFrame:
    """Item count per week and cell, with a row for every week of every cell.

    The calendar runs from the first to the last week seen, without gaps. Zero rows
    for the whole grid are added to the counts and summed, partitioned by cell, so
    the same shuffle serves the window functions that follow.
    """
    grid = (calendar_bounds(lanes)
            .select(F.explode(F.sequence("first_week", "last_week", F.expr("interval 7 days")))
                    .alias("week"))
            .select("week", F.explode(F.lit(list(config.states))).alias("customer_state"))
            .select("*", F.explode(F.lit(list(config.groups))).alias("product_group"))
            .select("*", F.lit(0).cast("bigint").alias("items")))
    return (lanes.select("week", *CELL, "items").unionByName(grid)
            .repartition(*CELL)
            .groupBy("week", *CELL)
            .agg(F.sum("items").alias("demand")))


def lag_columns(config: NetworkConfig) -> list[str]:
    return [f"lag{k}" for k in range(1, config.lags + 1)]


def seasonal_columns() -> list[str]:
    return ["t", "sin1", "cos1", "sin2", "cos2"]


def demand_features(demand: DataFrame, config: NetworkConfig) -> DataFrame:
    """Trend, seasonality and lags per series; rows without all lags are dropped."""
    origin = demand.agg(F.min("week")).scalar()
    in_series = Window.partitionBy(*CELL).orderBy("week")
    lagged = demand.select(
        "week", *CELL, "demand",
        F.concat_ws("|", *CELL).alias("series"),
        *[F.lag("demand", k).over(in_series).alias(f"lag{k}")
          for k in range(1, config.lags + 1)])
    return (lagged.dropna(subset=lag_columns(config))
            .withColumn("t", weeks_since(F.col("week"), origin))
            .withColumns(seasonal_terms(F.col("week"))))


def holdout_cutoff(frame: DataFrame, config: NetworkConfig) -> DataFrame:
    """First of the last `holdout_weeks` distinct weeks, as a one-row table."""
    latest = frame.select("week").distinct().orderBy(F.desc("week")).limit(config.holdout_weeks)
    return latest.agg(F.min("week").alias("cutoff"))


def mark_holdout(frame: DataFrame, config: NetworkConfig) -> DataFrame:
    return frame.withColumn(
        "is_holdout", F.col("week") >= holdout_cutoff(frame, config).scalar())


def naive_forecast(config: NetworkConfig) -> Column:
    """Mean of the previous weeks of the same series."""
    total = sum((F.col(c).cast("double") for c in lag_columns(config)[1:]),
                F.col("lag1").cast("double"))
    return total / F.lit(float(config.lags))


def naive_holdout(features: DataFrame, config: NetworkConfig) -> DataFrame:
    return (mark_holdout(features, config).where("is_holdout")
            .withColumn("forecast", naive_forecast(config))
            .select("week", *CELL, "demand", "forecast",
                    (F.col("demand") - F.col("forecast")).alias("residual")))


def planning_demand(holdout: DataFrame) -> DataFrame:
    """Mean holdout forecast per cell: the demand of the planning week."""
    return holdout.groupBy(*CELL).agg(F.avg("forecast").alias("demand"))


def planning_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count("*").alias("cells"), F.sum("demand").alias("weekly_units"))


def forecast_accuracy(holdout: DataFrame) -> DataFrame:
    return holdout.agg(F.avg(F.abs("residual")).alias("mae"))


def accuracy_report(model_holdout: DataFrame, naive: DataFrame) -> DataFrame:
    """Mean absolute error of the model and of the naive forecast, and the improvement."""
    errors = (forecast_accuracy(model_holdout).withColumn("forecast", F.lit("model"))
              .unionByName(forecast_accuracy(naive).withColumn("forecast", F.lit("naive")))
              .groupBy().pivot("forecast", ["model", "naive"]).agg(F.first("mae")))
    return errors.select(F.col("model").alias("model_mae"), F.col("naive").alias("naive_mae"),
                         (F.lit(100.0) * (1 - F.col("model") / F.col("naive"))).alias("improvement_pct"))


def weekly_group_totals(demand: DataFrame, config: NetworkConfig) -> DataFrame:
    """Demand per week, one column per group."""
    return demand.groupBy("week").pivot("product_group", sorted(config.groups)).sum("demand")


def holdout_totals(holdout: DataFrame) -> DataFrame:
    return holdout.groupBy("week").agg(
        F.sum("demand").alias("demand"), F.sum("forecast").alias("forecast"))
