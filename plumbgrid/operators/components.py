"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) where component is the smallest node of each component.

    ``nodes`` has the column node, ``edges`` a and b. The method is that of alternating stars:
    every edge is kept as (high, low). First each high end is tied to the smallest node its
    low end is tied to, then all low ends of a node and the node itself are tied to the
    smallest of them. Both steps keep what is connected connected, and they end in one star
    per component around its smallest node, after rounds that grow with the logarithm of the
    graph, whatever the order of its names. A step is one aggregate that combines before its
    shuffle and one join with a single row per key on the other side, so a hub's or a giant
    component's rows can be split over tasks by adaptive execution.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
                .where(F.col("high") != F.col("low")).distinct())
    while not _only_stars(links):
        tied = links.join(_smallest(links, "low"), "low", "left").select(
            "high", F.coalesce("_to", "low").alias("low")).distinct()
        ends = tied.join(_smallest(tied, "high"), "high").select(
            F.explode(F.array(F.struct(F.col("high").alias("high"), F.col("_to").alias("low")),
                              F.struct(F.col("low").alias("high"), F.col("_to").alias("low")))).alias("_e"))
        links = cut(ends.select("_e.high", "_e.low").where(F.col("high") != F.col("low")).distinct())
    stars = links.select(F.col("high").alias("node"), F.col("low").alias("_to"))
    return nodes.join(stars, "node", "left").select("node", F.coalesce("_to", "node").alias("component"))


def _smallest(links: DataFrame, name: str) -> DataFrame:
    """(``name``, _to): the smallest node that each high end is tied to."""
    return links.groupBy(F.col("high").alias(name)).agg(F.min("low").alias("_to"))


def _only_stars(links: DataFrame) -> bool:
    """Whether every high end is tied to one low end, which is tied to nothing lower itself."""
    ends = links.select(F.explode(F.array(F.struct(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                          F.struct(F.col("low").alias("node"), F.lit(0).alias("up"),
                                                   F.lit(1).alias("down")))).alias("_e")).select("_e.*")
    degrees = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return degrees.where("up > 1 or (up > 0 and down > 0)").isEmpty()
