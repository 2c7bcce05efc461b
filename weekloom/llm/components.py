"""Connected components of a graph given by its edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.session import settled


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Large-star ties every larger neighbour of a node to the smallest node next to it, small-star
    every smaller one; both keep the components, and repeating them until only stars are left takes
    a number of rounds that grows with the logarithm of the longest path.
    Smallest neighbours are aggregated before they are joined, so a node with very many links
    needs no task of its own. Each round is written, which keeps the plan short.
    """
    links = settled(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settled(large, "large-star")
        if _stars(large):
            links = large
            break
        least = settled(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = settled(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every node hangs on one smaller node, which hangs on none."""
    places = links.select(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        links.select(F.col("v").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    by = places.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return by.where("below > 1 OR (below = 1 AND above = 1)").limit(1).count() == 0
