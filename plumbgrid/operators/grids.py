"""Counts, densities and interpolation on square and hexagonal grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.cells import hex_cell, hex_centre, square_cell
from ..functions.planar import dist2, valid_xy
from .nearest import nearest
from .pairs import SPLIT_ROWS


def square_counts(points: DataFrame, xy: tuple[str, str], size: float, *aggregates) -> DataFrame:
    """(col, row, n, ...) per occupied square cell. Counts combine before the shuffle, so a
    crowded cell costs one row per task."""
    col, row = square_cell(*xy, size)
    return (points.where(valid_xy(*xy)).groupBy(col.alias("col"), row.alias("row"))
            .agg(F.count("*").alias("n"), *aggregates))


def hex_counts(points: DataFrame, xy: tuple[str, str], size: float, *aggregates) -> DataFrame:
    """(q, r, n, ..., cx, cy) per occupied hexagon."""
    q, r = hex_cell(*xy, size)
    counts = (points.where(valid_xy(*xy)).groupBy(q.alias("q"), r.alias("r"))
              .agg(F.count("*").alias("n"), *aggregates))
    cx, cy = hex_centre("q", "r", size)
    return counts.select("*", cx.alias("cx"), cy.alias("cy"))


def density(points: DataFrame, xy: tuple[str, str], size: float, bandwidth: float) -> DataFrame:
    """(col, row, density): quartic-kernel intensity at the centres of square cells.

    Positions are added up first, then copied to the cells within the bandwidth.
    """
    spots = (points.where(valid_xy(*xy)).groupBy(F.col(xy[0]).alias("_x"), F.col(xy[1]).alias("_y"))
             .agg(F.count("*").alias("n")))
    s, h2 = F.lit(float(size)), float(bandwidth) * float(bandwidth)
    for name, c in (("col", "_x"), ("row", "_y")):
        span = F.sequence(F.floor((F.col(c) - F.lit(float(bandwidth))) / s),
                          F.floor((F.col(c) + F.lit(float(bandwidth))) / s))
        spots = spots.select("*", F.explode(span).alias(name))
    d2 = dist2("_x", "_y", (F.col("col") + 0.5) * s, (F.col("row") + 0.5) * s)
    u = F.lit(1.0) - F.col("d2") / F.lit(h2)
    return (spots.select("col", "row", "n", d2.alias("d2")).where(F.col("d2") < F.lit(h2))
            .groupBy("col", "row")
            .agg(F.sum(F.col("n") * u * u * F.lit(3 / (math.pi * h2))).alias("density")))


def grid_centres(points: DataFrame, xy: tuple[str, str], size: float) -> DataFrame:
    """(col, row, cx, cy) for every cell of the points' bounding box, empty ones included."""
    s = F.lit(float(size))
    low_col, low_row = square_cell("x0", "y0", size)
    high_col, high_row = square_cell("x1", "y1", size)
    box = points.where(valid_xy(*xy)).agg(
        F.min(xy[0]).alias("x0"), F.min(xy[1]).alias("y0"),
        F.max(xy[0]).alias("x1"), F.max(xy[1]).alias("y1")).where(F.col("x0").isNotNull())
    # One task lists the rows of the grid; the cells of each row are listed by many.
    rows = box.select(low_col.alias("_from"), high_col.alias("_to"),
                      F.explode(F.sequence(low_row, high_row)).alias("row")).repartition("row")
    cells = rows.select(F.explode(F.sequence("_from", "_to")).alias("col"), "row")
    return cells.select("col", "row", ((F.col("col") + 0.5) * s).alias("cx"),
                        ((F.col("row") + 0.5) * s).alias("cy"))


def near_centres(points: DataFrame, xy: tuple[str, str], size: float, reach: int) -> DataFrame:
    """(col, row, cx, cy) for every cell at most ``reach`` columns and rows from one with a point.

    A stray point costs its own surroundings, not a grid that reaches out to it.
    """
    s = F.lit(float(size))
    col, row = square_cell(*xy, size)
    cells = points.where(valid_xy(*xy)).select(col.alias("col"), row.alias("row")).distinct()
    for name in ("col", "row"):
        other = "row" if name == "col" else "col"
        around = F.explode(F.sequence(F.col(name) - reach, F.col(name) + reach)).alias(name)
        cells = cells.select(around, other).distinct()
    return cells.select("col", "row", ((F.col("col") + 0.5) * s).alias("cx"), ((F.col("row") + 0.5) * s).alias("cy"))


def inverse_distance(points: DataFrame, key: str, xy: tuple[str, str], value: str, size: float,
                     k: int, split_rows: int = SPLIT_ROWS, reach: int | None = None) -> DataFrame:
    """(col, row, estimate): mean of the k nearest values at each cell centre, weighted by
    inverse squared distance. Points on the centre itself decide alone.

    For every cell of the points' bounding box, or for those at most ``reach`` cells from a point.
    """
    known = points.where(F.col(value).isNotNull()).select(
        F.col(key).alias("_key"), F.col(xy[0]).alias("_px"), F.col(xy[1]).alias("_py"),
        F.col(value).alias("_value"))
    cells = grid_centres(points, xy, size) if reach is None else near_centres(points, xy, size, reach)
    centres = cells.select(
        F.struct("col", "row").alias("_cell"), "col", "row", "cx", "cy")
    near = nearest(centres, known, k, "_cell", "_key", ("cx", "cy"), ("_px", "_py"), split_rows)
    near = near.join(known, "_key")
    d2 = F.col("distance") * F.col("distance")
    pull = F.when(d2 > 0, 1.0 / d2)
    sums = near.groupBy("col", "row").agg(
        F.avg(F.when(d2 == 0, F.col("_value"))).alias("exact"),
        F.sum(pull * F.col("_value")).alias("total"), F.sum(pull).alias("pull"))
    return sums.select("col", "row", F.coalesce("exact", F.col("total") / F.col("pull"))
                       .alias("estimate"))
