"""State and hub centroids and the state-to-hub distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hubloom.config import NetworkConfig
from hubloom.functions.geo import haversine_km
from hubloom.operators.quantiles import exact_quantiles
from hubloom.sources.small import literal_table


def state_centroids(geolocation: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Median latitude and median longitude per state, each on its own.

    With `accuracy` the medians are those of a quantile sketch: one pass over the points, sketches
    of about `accuracy` values merged before the shuffle. A state of n points gets one of its
    values whose rank is within n / `accuracy` of n / 2, not the mean of the middle two.
    """
    points = geolocation.selectExpr("geolocation_state AS state", "geolocation_lat AS lat",
                                    "geolocation_lng AS lng")
    if accuracy is not None:
        return points.groupBy("state").agg(*[
            F.percentile_approx(axis, 0.5, accuracy).alias(axis) for axis in ("lat", "lng")])
    medians = exact_quantiles(points, "state", ["lat", "lng"], [0.5])
    return medians.groupBy("state").agg(
        F.expr("max(if(axis = 'lat', value, NULL))").alias("lat"),
        F.expr("max(if(axis = 'lng', value, NULL))").alias("lng"))


def hub_member_table(spark: SparkSession, config: NetworkConfig) -> DataFrame:
    pairs = [(hub, state) for hub, members in config.hub_members for state in members]
    return literal_table(spark, hub=[h for h, _ in pairs], seller_state=[s for _, s in pairs])


def hub_centroids(centroids: DataFrame, config: NetworkConfig) -> DataFrame:
    """Unweighted mean of the centroids of a hub's member states that have one."""
    members = hub_member_table(centroids.sparkSession, config)
    return (centroids
            .join(F.broadcast(members), centroids.state == members.seller_state)
            .groupBy("hub").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng")))


def state_hub_distances(centroids: DataFrame, config: NetworkConfig) -> DataFrame:
    """Kilometres from each planned state's centroid to each hub's centroid."""
    hubs = hub_centroids(centroids, config).agg(
        F.collect_list(F.struct("hub", "lat", "lng")).alias("hubs"))
    planned = centroids.where(F.col("state").isin(list(config.states)))
    return (planned
            .withColumn("target", F.explode(hubs.scalar()))
            .select(F.col("state").alias("customer_state"),
                    F.col("target.hub").alias("hub"),
                    haversine_km(F.col("lat"), F.col("lng"),
                                 F.col("target.lat"), F.col("target.lng")).alias("km")))
