"""Zones as edge tables: measures, containment joins and zonal statistics.

A zone is the set of its edges, one row each: (zone_id, seq, x1, y1, x2, y2). Holes are
further edges of the same zone, by the even-odd rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions.planar import valid_xy
from ..functions.polygon import crosses_upward, crossings, upward
from ..session import cut
from .pairs import SPLIT_ROWS, disjoint, hot_groups, split_join

# Edges of one zone in one cell are held as arrays of at most about this many.
CHUNK_EDGES = 512
# A cover measured to be no larger than this is sent to every executor.
BROADCAST_BYTES = 32 << 20


def ring_edges(rings: DataFrame, zone: str = "zone_id", ring: str = "ring") -> DataFrame:
    """One row per edge from an ARRAY<STRUCT<x,y>> of corners; the closing edge is added."""
    corners = F.col(ring)
    following = F.concat(F.slice(corners, 2, F.size(corners)), F.slice(corners, 1, 1))
    out = rings.select(zone, F.posexplode(F.arrays_zip(corners.alias("a"), following.alias("b"))))
    return out.select(zone, F.col("pos").alias("seq"),
                      F.col("col.a.x").alias("x1"), F.col("col.a.y").alias("y1"),
                      F.col("col.b.x").alias("x2"), F.col("col.b.y").alias("y2"))


def zone_measures(edges: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Area, perimeter and centroid. Outer rings run one way round and holes the other."""
    turn = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sums = edges.groupBy(zone).agg(
        (F.sum(turn) / 2).alias("signed"),
        F.sum(F.sqrt(dx * dx + dy * dy)).alias("perimeter"),
        F.sum((F.col("x1") + F.col("x2")) * turn).alias("mx"),
        F.sum((F.col("y1") + F.col("y2")) * turn).alias("my"))
    moment = F.nullif(6 * F.col("signed"), F.lit(0.0))
    return sums.select(zone, F.abs("signed").alias("area"), "perimeter",
                       (F.col("mx") / moment).alias("cx"), (F.col("my") / moment).alias("cy"))


def extents(points: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Bounding box and row count per group, of the rows with a position."""
    return points.where(valid_xy(x, y)).groupBy(*by).agg(
        F.min(x).alias("x_min"), F.min(y).alias("y_min"),
        F.max(x).alias("x_max"), F.max(y).alias("y_max"), F.count("*").alias("n"))


def _cell_span(low: Column, high: Column, cell: float) -> Column:
    """Every cell index between two coordinates, with a margin for rounding."""
    slack = F.lit(cell * 1e-9) + (F.abs(low) + F.abs(high)) * F.lit(1e-12)
    return F.sequence(F.floor((low - slack) / cell), F.floor((high + slack) / cell))


def zone_cover(edges: DataFrame, cell: float, zone: str = "zone_id") -> DataFrame:
    """The grid cells each zone meets, as (_zone, _c0, _c1, _edges, _chunks).

    Border cells carry the edges that decide containment for points in them: those of
    the zone in the same grid row, not wholly to the left. Inner cells, with null edges,
    meet no edge, so all their points are inside.

    Everything below works on one (zone, grid row) at a time, so the edges are shuffled
    by that once and not again.
    """
    ax, ay, bx, by = upward("x1", "y1", "x2", "y2")
    ends = edges.where(F.col("y1").isNotNull() & F.col("y2").isNotNull()).select(
        F.col(zone).alias("_zone"), "seq", ax.alias("x1"), ay.alias("y1"),
        bx.alias("x2"), by.alias("y2"),
        F.least("x1", "x2").alias("_left"), F.greatest("x1", "x2").alias("_right"))
    in_row = ends.select("*", F.explode(_cell_span(F.col("y1"), F.col("y2"), cell)).alias("_c1"))

    # The part of each edge inside its grid row, widened by the slack in _cell_span.
    bottom, top = F.col("_c1") * F.lit(cell), (F.col("_c1") + 1) * F.lit(cell)
    flat = F.col("y1") == F.col("y2")

    def x_at(y: Column) -> Column:
        clipped = F.least(F.greatest(y, F.col("y1")), F.col("y2"))
        x = F.col("x1") + (F.col("x2") - F.col("x1")) * (
            (clipped - F.col("y1")) / F.when(~flat, F.col("y2") - F.col("y1")))
        return F.least(F.greatest(x, F.col("_left")), F.col("_right"))

    entry, leave = x_at(bottom - cell * 1e-9), x_at(top + cell * 1e-9)
    low_x = F.when(flat, F.col("_left")).otherwise(F.least(entry, leave))
    high_x = F.when(flat, F.col("_right")).otherwise(F.greatest(entry, leave))
    in_row = (in_row.select("_zone", "_c1", "seq", "x1", "y1", "x2", "y2",
                            _cell_span(low_x, high_x, cell).alias("_cells"))
              .repartition("_zone", "_c1"))
    border_cells = in_row.select("_zone", "_c1", F.explode("_cells").alias("_c0")).distinct()

    # Edges needed by a border cell: same zone and row, reaching at least as far right.
    # Horizontal edges are never crossed.
    row_edges = in_row.where(~flat).select(
        "_zone", "_c1", "seq", "x1", "y1", "x2", "y2", F.array_max("_cells").alias("_last"))
    edge = F.when(F.col("_last") >= F.col("_c0"), F.struct("x1", "y1", "x2", "y2"))
    # An edge's part follows from its place, so that parts are even however rings are numbered.
    parts = F.ceil(F.count("*").over(W.partitionBy("_zone", "_c1", "_c0")) / F.lit(CHUNK_EDGES))
    border = (border_cells.join(row_edges, ["_zone", "_c1"], "left")
              .withColumn("_chunk", F.pmod(F.xxhash64("x1", "y1", "x2", "y2"), parts))
              .groupBy("_zone", "_c1", "_c0", "_chunk")
              .agg(F.collect_list(edge).alias("_edges"))
              .select("_zone", "_c0", "_c1", "_edges",
                      F.count("*").over(W.partitionBy("_zone", "_c1", "_c0")).alias("_chunks")))

    # Between two neighbouring border cells of a row the zone is all in or all out.
    runs = border_cells.select("_zone", "_c1", F.col("_c0").alias("_from"), F.lead("_c0").over(
        W.partitionBy("_zone", "_c1").orderBy("_c0")).alias("_to")).where(
            F.col("_to") - F.col("_from") > 1)
    hit = (F.col("_last") > F.col("_from")) & crosses_upward(
        (F.col("_from") + 1.5) * F.lit(cell), (F.col("_c1") + 0.5) * F.lit(cell),
        "x1", "y1", "x2", "y2")
    inner = (runs.join(row_edges, ["_zone", "_c1"])
             .groupBy("_zone", "_c1", "_from", "_to")
             .agg((F.sum(hit.cast("int")) % 2).alias("_odd")).where("_odd = 1")
             .select("_zone", "_c1", F.explode(
                 F.sequence(F.col("_from") + 1, F.col("_to") - 1)).alias("_c0")))
    return border.unionByName(inner, allowMissingColumns=True)


def locate(points: DataFrame, edges: DataFrame, cell: float, xy: tuple[str, str],
           zone: str = "zone_id", how: str = "inner", key: str | None = None,
           split_rows: int = SPLIT_ROWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Containment join: every point with each zone that holds it.

    Points meet zones by an equi-join on the cell. In inner cells that settles it; in
    border cells the crossings with the cell's edges are counted. When the measured cover
    is small it is sent to the points, which then are not shuffled at all; otherwise both
    sides are shuffled by cell, with cells that hold too many rows cut up. The points are
    not regrouped afterwards, unless a zone has more edges in a cell than fit in one array.

    ``how`` may be inner, left_semi (in some zone) or left_anti (in none); the latter two
    need the name of the points' ``key``. Equal rows of ``points`` each count.
    """
    if how != "inner" and (how not in {"left_semi", "left_anti"} or key is None):
        raise ValueError("how is inner, or left_semi or left_anti with a key")
    keys = ["_c0", "_c1"]
    x, y = xy
    # Written once: it is read several times below.
    cover = cut(zone_cover(edges, cell, zone))
    placed = points.where(valid_xy(x, y)).select(
        "*", *[F.floor(F.col(c) / F.lit(cell)).alias(k) for c, k in zip(xy, keys)])
    disjoint(placed.drop(*keys), cover.drop(*keys))
    weight = cover.agg(F.count("*") * 64 + F.coalesce(
        F.sum(F.greatest(F.size("_edges"), F.lit(0))) * 32, F.lit(0))).first()[0]
    split = None
    if weight <= broadcast_bytes:
        cover = F.broadcast(cover)
    else:
        split = hot_groups(placed.groupBy(*keys).agg(F.count("*").alias("_nl")),
                         cover.groupBy(*keys).agg(F.count("*").alias("_nr")), keys, split_rows)
    odd = crossings(x, y, "_edges", crosses_upward) % 2 == 1
    met = split_join(placed, cover, keys, split, F.lit(True))
    columns = [*points.columns, F.col("_zone").alias(zone)]
    found = met.where(F.col("_edges").isNull() | ((F.col("_chunks") == 1) & odd)).select(*columns)
    if not cover.where(F.col("_chunks") > 1).isEmpty():
        # Equal rows fall in one group: each has met all parts of the cell, so the group holds
        # as many rows as it has rows per part, and each of them has its share of the hits.
        copies = F.col("_met") / F.col("_parts")
        in_parts = (met.where(F.col("_chunks") > 1)
                    .groupBy(*points.columns, "_zone").agg(
                        F.sum(odd.cast("int")).alias("_hits"), F.count("*").alias("_met"),
                        F.max("_chunks").alias("_parts"))
                    .where((F.col("_hits") / copies).cast("bigint") % 2 == 1)
                    .withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))))
        found = found.unionByName(in_parts.select(*columns))
    return found if how == "inner" else points.join(found.select(key), key, how)


def zonal_stats(points: DataFrame, edges: DataFrame, cell: float, xy: tuple[str, str],
                value: str, zone: str = "zone_id") -> DataFrame:
    """Count, sum, mean, min and max of a value per zone; empty zones are kept with count 0."""
    found = locate(points, edges, cell, xy, zone)
    stats = found.groupBy(zone).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"),
        F.min(value).alias("low"), F.max(value).alias("high"))
    return (edges.select(zone).distinct().join(stats, zone, "left")
            .fillna(0, subset=["n"]))
