"""Spatial autocorrelation with distance-band weights, binary or row-standardised.

Global statistics need one row per position with the sums over its neighbourhood; no
table of pairs is formed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.planar import valid_xy
from .pairs import SPLIT_ROWS
from .sums import CROWDED, class_sums, position_sums, positions, sums_within


def centred(points: DataFrame, value: str, xy: tuple[str, str]) -> DataFrame:
    """Points with ``_z``, the value less its mean; the mean is a subquery of the same plan.

    Rows without a position or a value (null or NaN) are in neither the mean nor the sums."""
    known = points.where(valid_xy(*xy) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    mean = known.agg(F.avg(value).alias("mean")).scalar()
    return known.withColumn("_z", F.col(value) - mean)


def _sums(points: DataFrame, xy: tuple[str, str], value: str, radius: float,
          split_rows: int) -> DataFrame:
    return position_sums(positions(centred(points, value, xy), xy, "_z"), radius, split_rows)


def _share(standardise: bool) -> Column:
    """Weight of one neighbour of a row."""
    degree = F.col("n_in") - 1
    one = F.lit(1.0)
    return F.when(degree > 0, one / degree).otherwise(0.0) if standardise else one


def moran(points: DataFrame, xy: tuple[str, str], value: str, radius: float,
          standardise: bool = False, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Global Moran's I: one row (n, weight_sum, moran_i, expected_i)."""
    share = _share(standardise)
    # A position's n rows have n_in - 1 neighbours each, and the values s meet s_in
    # except that no row meets itself.
    sums = _sums(points, xy, value, radius, split_rows).agg(
        F.sum("n").alias("n"), F.sum("q").alias("q"),
        F.sum(F.col("n") * (F.col("n_in") - 1) * share).alias("weight_sum"),
        F.sum((F.col("s") * F.col("s_in") - F.col("q")) * share).alias("cross"))
    return sums.select("n", "weight_sum", (
        F.col("n") / F.nullif("weight_sum", F.lit(0.0)) * F.col("cross")
        / F.nullif("q", F.lit(0.0))).alias("moran_i"), (-1.0 / (F.col("n") - 1)).alias("expected_i"))


def geary(points: DataFrame, xy: tuple[str, str], value: str, radius: float,
          standardise: bool = False, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Geary's C: one row (n, weight_sum, geary_c)."""
    share = _share(standardise)
    spread = (F.col("q") * F.col("n_in") - 2 * F.col("s") * F.col("s_in")
              + F.col("n") * F.col("q_in"))
    sums = _sums(points, xy, value, radius, split_rows).agg(
        F.sum("n").alias("n"), F.sum("q").alias("q"),
        F.sum(F.col("n") * (F.col("n_in") - 1) * share).alias("weight_sum"),
        F.sum(spread * share).alias("spread"))
    return sums.select("n", "weight_sum", (
        (F.col("n") - 1) * F.col("spread")
        / (2 * F.nullif("weight_sum", F.lit(0.0)) * F.nullif("q", F.lit(0.0)))).alias("geary_c"))


def local_moran(points: DataFrame, key: str, xy: tuple[str, str], value: str, radius: float,
                split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(key, degree, local_i, quadrant) with row-standardised weights.

    The quadrant says whether a row and its neighbours lie above (H) or below (L) the mean.
    Rows without neighbours have a null statistic.
    """
    rows = centred(points, value, xy).select(key, *xy, "_z")
    second = rows.agg(F.avg(F.col("_z") * F.col("_z")).alias("m2")).scalar()
    near = sums_within(rows, xy, radius, "_z", split_rows)
    mean_near = F.col("lag") / F.nullif("degree", F.lit(0))
    side = F.concat(F.when(F.col("_z") >= 0, "H").otherwise("L"),
                    F.when(mean_near >= 0, "H").when(mean_near < 0, "L"))
    return near.select(key, "degree", (F.col("_z") * mean_near / second).alias("local_i"),
                       side.alias("quadrant"))


def hot_spots(points: DataFrame, key: str, xy: tuple[str, str], value: str, radius: float,
              split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Getis-Ord Gi*: (key, degree, gi_star), each row counted among its own neighbours."""
    rows = centred(points, value, xy).select(key, *xy, "_z")
    total = rows.agg(F.count("*").alias("n")).scalar()
    deviation = rows.agg(F.sqrt(F.avg(F.col("_z") * F.col("_z"))).alias("sd")).scalar()
    near = sums_within(rows, xy, radius, "_z", split_rows)
    # Centred on the mean, so the expected sum is zero.
    weight = F.col("degree") + 1
    spread = deviation * F.sqrt((total * weight - weight * weight) / (total - 1))
    return near.select(key, "degree", ((F.col("lag") + F.col("_z"))
                                       / F.nullif(spread, F.lit(0.0))).alias("gi_star"))


def variogram(points: DataFrame, xy: tuple[str, str], value: str, lag: float, bins: int,
              split_rows: int = SPLIT_ROWS, crowded: int = CROWDED) -> DataFrame:
    """Empirical semivariogram: (bin, pairs, gamma) for distances in [bin, bin + 1) lags.

    Unordered pairs of rows; those at one position fall in bin 0.
    """
    lag = float(lag)
    spots = positions(centred(points, value, xy), xy, "_z")
    sums = class_sums(spots, [lag * (i + 1) for i in range(bins)],
                      lambda d2: F.floor(F.sqrt(d2) / F.lit(lag)), split_rows, crowded,
                      lambda d2: np.floor(np.sqrt(d2) / lag))
    return sums.select(F.col("class").alias("bin"), "pairs",
                       (F.col("spread") / (2 * F.col("pairs"))).alias("gamma"))
