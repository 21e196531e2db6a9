"""Where points lie as a whole, and whether they cluster."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.cells import square_cell
from ..functions.planar import valid_xy
from .grids import square_counts
from .nearest import nearest_others
from .pairs import SPLIT_ROWS
from .sums import CROWDED, class_sums, positions


def centres(points: DataFrame, xy: tuple[str, str], weight: str, *by: str) -> DataFrame:
    """Mean centre, weighted centre, standard distance and deviational ellipse per group."""
    x, y = (F.col(c) for c in xy)
    w = F.col(weight)
    sums = points.where(valid_xy(*xy)).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"),
        (F.sum(w * x) / F.sum(w)).alias("x_weighted"),
        (F.sum(w * y) / F.sum(w)).alias("y_weighted"),
        F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_c"))
    middle = (F.col("_vx") + F.col("_vy")) / 2
    half = (F.col("_vx") - F.col("_vy")) / 2
    spread = F.sqrt(half * half + F.col("_c") * F.col("_c"))
    return sums.select(
        *by, "n", "x_mean", "y_mean", "x_weighted", "y_weighted",
        F.sqrt(F.col("_vx") + F.col("_vy")).alias("standard_distance"),
        F.sqrt(middle + spread).alias("major"),
        F.sqrt(F.greatest(middle - spread, F.lit(0.0))).alias("minor"),
        F.degrees(F.atan2(F.col("_c"), half) / 2).alias("angle"))


def quadrat_test(points: DataFrame, xy: tuple[str, str], size: float) -> DataFrame:
    """One row (cells, n, ratio, chi2): variance-to-mean ratio of counts over all cells of the
    bounding box. Empty cells enter by their number; they are not listed."""
    low_col, low_row = square_cell("x0", "y0", size)
    high_col, high_row = square_cell("x1", "y1", size)
    sides = square_counts(points, xy, size, F.min(xy[0]).alias("x0"), F.max(xy[0]).alias("x1"),
                          F.min(xy[1]).alias("y0"), F.max(xy[1]).alias("y1"))
    sums = sides.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"),
                     F.min("x0").alias("x0"), F.max("x1").alias("x1"),
                     F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    cells = (high_col - low_col + 1) * (high_row - low_row + 1)
    sums = sums.select("n", "n2", cells.alias("cells"))
    chi2 = F.col("n2") * F.col("cells") / F.col("n") - F.col("n")
    return sums.select("cells", "n", (chi2 / (F.col("cells") - 1)).alias("ratio"),
                       chi2.alias("chi2"))


def nearest_index(points: DataFrame, key: str, xy: tuple[str, str],
                  split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Clark-Evans index over the bounding box: one row (n, observed, expected, ratio, z)."""
    box = points.where(valid_xy(*xy)).agg(((F.max(xy[0]) - F.min(xy[0]))
                                           * (F.max(xy[1]) - F.min(xy[1]))).alias("a"))
    near = nearest_others(points, 1, key, xy, split_rows)
    mean = near.agg(F.count("*").alias("n"), F.avg("distance").alias("observed"))
    density = F.col("n") / F.col("area")
    out = mean.select("n", "observed", box.scalar().alias("area"))
    out = out.select("n", "observed", (0.5 / F.sqrt(density)).alias("expected"),
                     F.sqrt(F.col("n") * density).alias("_root"))
    # Fixed value: standard error factor of the index, sqrt((4 - pi) / (4 pi)).
    factor = math.sqrt((4 - math.pi) / (4 * math.pi))
    return out.select("n", "observed", "expected",
                      (F.col("observed") / F.col("expected")).alias("ratio"),
                      ((F.col("observed") - F.col("expected")) * F.col("_root") / factor).alias("z"))


def ripley(points: DataFrame, xy: tuple[str, str], radii: Sequence[float],
           split_rows: int = SPLIT_ROWS, crowded: int = CROWDED) -> DataFrame:
    """(radius, pairs, k, l) per radius over the bounding box, without edge correction.

    ``pairs`` counts ordered pairs of rows within the radius.
    """
    radii = sorted(float(r) for r in radii)
    spots = positions(points, xy)
    squares = np.array([r * r for r in radii])
    beyond = [F.lit(r * r) for r in radii]
    sums = class_sums(spots, radii, lambda d2: sum(((d2 > e).cast("int") for e in beyond), F.lit(0)),
                      split_rows, crowded, lambda d2: np.searchsorted(squares, d2))
    # One row: the number of unordered pairs within each radius.
    within = sums.agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("class") <= i, F.col("pairs"))), F.lit(0))
        for i in range(len(radii))]).alias("half"))
    base = spots.agg(F.sum("n").alias("n"), ((F.max("x") - F.min("x"))
                                             * (F.max("y") - F.min("y"))).alias("area"))
    out = within.select("half", *[base.select(c).scalar().alias(c) for c in ("n", "area")])
    rows = F.array(*[F.struct(F.lit(r).alias("radius"), (F.col("half")[i] * 2).alias("pairs"))
                     for i, r in enumerate(radii)])
    out = out.select("n", "area", F.explode(rows).alias("at")).select("n", "area", "at.*")
    k = F.col("area") * F.col("pairs") / (F.col("n") * (F.col("n") - 1))
    return out.select("radius", "pairs", k.alias("k"), F.sqrt(k / math.pi).alias("l"))
