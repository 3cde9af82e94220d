"""Pooled ridge forecast over all series."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from hubloom.config import NetworkConfig
from hubloom.functions.numeric import non_negative
from hubloom.operators.demand import CELL, lag_columns, mark_holdout, seasonal_columns
from hubloom.session import materialise
from hubloom.sources.small import literal_table


def level_index(column: str, levels: tuple[str, ...], name: str) -> Column:
    """Position of a value in a fixed list of levels, labelled for the ML encoders.

    The label metadata tells the encoder its size, so it needs no pass over the data.
    """
    position = F.array_position(F.lit(list(levels)), F.col(column)) - 1
    return position.cast("double").alias(
        name, metadata={"ml_attr": {"type": "nominal", "name": name, "vals": list(levels)}})


def assemble(frame: DataFrame, numeric: list[str], levels: dict[str, tuple[str, ...]]) -> DataFrame:
    """Feature vector of numeric columns and one-hot columns that keep every level."""
    indexed = frame.select("*", *[level_index(c, v, f"{c}_index") for c, v in levels.items()])
    encoder = OneHotEncoder(inputCols=[f"{c}_index" for c in levels],
                            outputCols=[f"{c}_onehot" for c in levels], dropLast=False)
    assembler = VectorAssembler(inputCols=[*numeric, *[f"{c}_onehot" for c in levels]],
                                outputCol="features")
    encoded = encoder.fit(indexed).transform(indexed)
    return assembler.transform(encoded).drop(
        *[f"{c}_index" for c in levels], *[f"{c}_onehot" for c in levels])


def feature_names(config: NetworkConfig) -> list[str]:
    return seasonal_columns() + lag_columns(config) + [f"s_{s}" for s in config.series]


def model_frame(features: DataFrame, config: NetworkConfig) -> DataFrame:
    """Feature vectors of the demand model, with the holdout flag."""
    return assemble(mark_holdout(features, config),
                    seasonal_columns() + lag_columns(config), {"series": config.series})


@dataclass(frozen=True)
class RidgeForecast:
    intercept: float
    weights: tuple[float, ...]  # of the numeric features
    series: DataFrame  # series, offset: the coefficient of each series seen in training
    holdout: DataFrame

    def coefficients(self, config: NetworkConfig) -> DataFrame:
        """Intercept and coefficients by feature name; 0 for series without training weeks."""
        spark = self.holdout.sparkSession
        numeric = seasonal_columns() + lag_columns(config)
        common = literal_table(spark, feature=["intercept", *numeric],
                               coefficient=[self.intercept, *self.weights])
        every = literal_table(spark, series=list(config.series))
        offsets = every.join(self.series, "series", "left").select(
            F.concat(F.lit("s_"), "series").alias("feature"),
            F.coalesce("offset", F.lit(0.0)).alias("coefficient"))
        return common.unionByName(offsets)


def fit_ridge(train: DataFrame, numeric: list[str], alpha: float,
              label: str = "demand") -> tuple[float, tuple[float, ...], DataFrame]:
    """Least squares plus alpha * |coefficients|^2, intercept free, features as they are.

    The one-hot columns of the series part the rows, so each series' coefficient follows
    from the others: (sum of its labels - sum of its features times their weights) / (rows +
    alpha). Put in, one small system over intercept and numeric features is left, whatever
    the number of series; it needs one aggregation by series and no iteration.
    """
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in numeric]]
    y, size = F.col(label).cast("double"), len(columns)
    sums = train.groupBy("series").agg(
        F.count("*").cast("double").alias("n"), F.sum(y).alias("m"),
        F.array(*[F.sum(z) for z in columns]).alias("u"),
        F.array(*[F.sum(z * y) for z in columns]).alias("zy"),
        F.array(*[F.sum(columns[i] * columns[j]) for i in range(size) for j in range(size)]).alias("zz"))
    sums = materialise(sums)
    shrink = F.col("n") + F.lit(float(alpha))
    left = [F.sum(F.col("zz")[i * size + j] - F.col("u")[i] * F.col("u")[j] / shrink)
            for i in range(size) for j in range(size)]
    right = [F.sum(F.col("zy")[i] - F.col("u")[i] * F.col("m") / shrink) for i in range(size)]
    row = sums.agg(F.array(*left).alias("left"), F.array(*right).alias("right"), F.sum("n").alias("n")).first()
    if not row["n"]:
        raise ValueError("no training weeks before the holdout")
    system = np.array(row["left"]).reshape(size, size) + alpha * np.diag([0.0, *[1.0] * (size - 1)])
    weights = np.linalg.solve(system, np.array(row["right"]))
    explained = sum((F.col("u")[i] * F.lit(float(w)) for i, w in enumerate(weights[1:], 1)),
                    F.col("n") * F.lit(float(weights[0])))
    offsets = sums.select("series", ((F.col("m") - explained) / shrink).alias("offset"))
    return float(weights[0]), tuple(map(float, weights[1:])), offsets


def ridge_forecast(features: DataFrame, config: NetworkConfig) -> RidgeForecast:
    """Fit on the weeks before the holdout and forecast each holdout week one step ahead.

    The lags of a holdout week are the actual demands of the weeks before it.
    """
    numeric = seasonal_columns() + lag_columns(config)
    frame = materialise(mark_holdout(features, config))
    intercept, weights, offsets = fit_ridge(frame.where(~F.col("is_holdout")), numeric, config.ridge_alpha)
    common = sum((F.col(c) * F.lit(w) for c, w in zip(numeric, weights)), F.lit(intercept))
    holdout = (frame.where("is_holdout").join(offsets, "series", "left")
               .withColumn("forecast", non_negative(common + F.coalesce("offset", F.lit(0.0))))
               .select("week", *CELL, "demand", "forecast",
                       (F.col("demand") - F.col("forecast")).alias("residual")))
    return RidgeForecast(intercept, weights, offsets, holdout)
