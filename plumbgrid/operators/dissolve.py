"""Borders of groups of adjoining zones, by cancelling the edges they share.

A border between two zones of a group is an edge of both, so it goes, and what is left bounds
their union. Zones may meet in the middle of each other's edges: every edge is first cut at
the corners of its group that lie on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .crossings import Ends, crossing
from .pairs import SPLIT_ROWS, attach

ENDS = ("x1", "y1", "x2", "y2")


def _point(x: str, y: str) -> Column:
    # One zero: -0.0 and 0.0 are one place.
    return F.struct((F.col(x) + F.lit(0.0)).alias("x"), (F.col(y) + F.lit(0.0)).alias("y"))


def cut_at_corners(edges: DataFrame, group: str, cell: float, ends: Ends = ENDS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(group, a, b): edges cut at all corners of their group that lie on them, as pairs of points.

    A corner lies on an edge if doubles say exactly so, as they do on shared corners and for
    edges along an axis or on a lattice.
    """
    known = edges.where(F.col(group).isNotNull()).select(
        F.col(group).alias("_g"), _point(ends[0], ends[1]).alias("_a"), _point(ends[2], ends[3]).alias("_b"))
    corners = known.select("_g", F.explode(F.array("_a", "_b")).alias("p")).distinct().select(
        F.col("_g").alias("_pg"), F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("p.x").alias("qx"), F.col("p.y").alias("qy"))
    # Equal edges are cut once and counted.
    distinct = known.groupBy("_g", "_a", "_b").agg(F.count("*").alias("_n")).where(F.col("_a") != F.col("_b")).select(
        "*", F.col("_a.x").alias("ax"), F.col("_a.y").alias("ay"), F.col("_b.x").alias("bx"), F.col("_b.y").alias("by"))
    met = crossing(distinct, corners, ("ax", "ay", "bx", "by"), ("px", "py", "qx", "qy"), cell, ("_x", "_y"), split_rows)
    # Along the edge: its points ascend or descend together with it.
    at = F.when(F.col("_a") < F.col("_b"), F.struct("px", "py")).otherwise(F.struct((-F.col("px")).alias("px"), (-F.col("py")).alias("py")))
    here = F.struct(F.col("px").alias("x"), F.col("py").alias("y"))
    following = F.lead(here).over(W.partitionBy("_g", "_a", "_b").orderBy(at))
    parts = met.where(F.col("_g") == F.col("_pg")).select("_g", "_n", here.alias("a"), following.alias("b")).where(F.col("b").isNotNull())
    return parts.select(F.col("_g").alias(group), "a", "b", F.col("_n").alias("n"))


def dissolve(edges: DataFrame, group: str, cell: float, ends: Ends = ENDS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(group, x1, y1, x2, y2): the border of the union of each group's zones, in pieces.

    ``edges`` has the edges of zones that do not overlap, with their zone's ``group``. A piece
    that an even number of edges share is inside and goes; the direction of the others is that
    of most of theirs, so if all rings run one way, the border does, around holes the other way.
    A null group, or an edge with an end that is null, NaN or infinite, has no border.
    """
    parts = cut_at_corners(edges, group, cell, ends, split_rows)
    ahead = F.col("a") < F.col("b")
    ends_of = parts.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n",
                           F.when(ahead, F.col("n")).otherwise(-F.col("n")).alias("way"))
    left = ends_of.groupBy(group, "a", "b").agg(F.sum("n").alias("n"), F.sum("way").alias("way")).where(F.col("n") % 2 == 1)
    first = F.when(F.col("way") > 0, F.col("a")).otherwise(F.col("b"))
    last = F.when(F.col("way") > 0, F.col("b")).otherwise(F.col("a"))
    return left.select(group, first["x"].alias(ends[0]), first["y"].alias(ends[1]), last["x"].alias(ends[2]), last["y"].alias(ends[3]))


def grouped(edges: DataFrame, groups: DataFrame, zone: str, group: str) -> DataFrame:
    """Edges with the group of their zone, from a table (zone, group) with one row per zone."""
    named = groups.select(F.col(zone).alias("_zone"), group)
    return attach(edges, named, [(zone, "_zone")])
