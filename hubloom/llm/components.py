"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hubloom.llm.tables import written


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """Columns node, component (the smallest node reachable) for each node of `links` (a, b).

    Alternating large-star and small-star steps: each node hands its smallest neighbour to the
    larger and then to the smaller ones, until all that is left are stars. Links stay at most as many as
    given; a node with very many links is summed up map-side, and its join is split as skewed.
    Each step's links are written in at most `most` partitions, where given.
    """
    edges = written(links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), most)
    while not are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(smallest, "a").filter((F.col("b") > F.col("a")) & (F.col("b") != F.col("m")))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = written(
            large.join(smallest, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                    F.col("m").alias("b"))
            .distinct(), most)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def are_stars(edges: DataFrame) -> bool:
    """Whether each larger end hangs on one smaller end only, which hangs on none itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter(
        (F.col("hangs") > 1) | ((F.col("hangs") == 1) & (F.col("holds") == 1))).isEmpty()
