"""Exact interpolated quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hubloom.session import materialise, store

# Strips that a range of values is cut into, and the rows up to which single values are looked at.
STRIPS = 1024
FEW_ROWS = 100_000


def exact_quantiles(points: DataFrame, key: str, values: list[str], fractions: list[float],
                    few_rows: int = FEW_ROWS, strips: int = STRIPS) -> DataFrame:
    """Quantiles of each of `values` per `key`, as rows (key, axis, fraction, value).

    `percentile` keeps every distinct value of a group in one task. Here a group's range is
    cut into strips; rows are counted per strip (a small table after map-side aggregation),
    a running count finds the strips that hold the ranks next to each quantile, and their
    rows are gone on with, until none holds more than `few_rows` rows of different values.
    Only then single values are counted. So a window never sees more than `strips` rows or
    `few_rows` values of a group, whatever the data. Nulls and NaNs are left out.
    """
    axes = ", ".join(f"struct('{v}' AS axis, {v} AS value)" for v in values)
    rows = (points.selectExpr(f"{key} AS key", f"inline(array({axes}))")
            .where("key IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
            .withColumn("before", F.lit(0).cast("long")))
    group = ["key", "axis", "before"]  # `before` rows of the group stand ahead: it names a strip
    cells = materialise(rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")))
    ranks = cells.withColumn("fraction", F.explode(F.lit([float(f) for f in fractions]))).select(
        F.col("key").alias("of"), F.col("axis").alias("along"), "fraction",
        (F.col("fraction") * (F.col("n") - 1)).alias("rank"))
    while (cells.where("low < high").agg(F.max("n")).first()[0] or 0) > few_rows:
        place = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * strips)
        cut = (rows.join(cells.select(*group, "low", "high"), group)
               .withColumn("slot", F.when(F.col("low") < F.col("high"), F.least(place, F.lit(strips - 1)))
                           .otherwise(0).cast("int")))
        counts = cut.groupBy(*group, "slot").agg(
            F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        found = materialise(_next_to_ranks(counts, group, "slot", ranks)
                            .select(*group, "slot", "first", "n", "low", "high").distinct())
        rows = store(cut.drop("low", "high").join(found.select(*group, "slot", "first"), [*group, "slot"])
                     .select("key", "axis", "value", F.col("first").alias("before")))
        cells = found.select("key", "axis", F.col("first").alias("before"), "n", "low", "high")
    single = rows.groupBy(*group, "value").agg(F.count("*").alias("n"))
    return (_next_to_ranks(single, group, "value", ranks)
            .groupBy("key", "axis", "fraction", "rank")
            .agg(F.expr("max(if(floor(rank) BETWEEN first AND last, value, NULL))").alias("below"),
                 F.expr("max(if(ceil(rank) BETWEEN first AND last, value, NULL))").alias("above"))
            .selectExpr(f"key AS {key}", "axis", "fraction",
                        "below + (above - below) * (rank - floor(rank)) AS value"))


def _next_to_ranks(counts: DataFrame, group: list[str], slot: str, ranks: DataFrame) -> DataFrame:
    """Slots that hold the rank below or above a quantile, with the ranks they cover."""
    running = Window.partitionBy(*group).orderBy(slot).rowsBetween(Window.unboundedPreceding, 0)
    covered = (counts.withColumn("last", F.col("before") - 1 + F.sum("n").over(running))
               .withColumn("first", F.col("last") - F.col("n") + 1))
    return (covered.join(ranks, (F.col("key") == F.col("of")) & (F.col("axis") == F.col("along")))
            .where("floor(rank) BETWEEN first AND last OR ceil(rank) BETWEEN first AND last"))
