"""Rasters as cell tables (band, row, col, value); nodata is null or an absent row."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .zones import locate


def combine_bands(cells: DataFrame, bands: Sequence[str],
                  formula: Callable[..., Column]) -> DataFrame:
    """(row, col, value): a formula over the named bands of each cell, where all are present."""
    wide = cells.where(F.col("band").isin(list(bands))).groupBy("row", "col").agg(
        *[F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"_b{i}")
          for i, b in enumerate(bands)])
    value = formula(*[F.col(f"_b{i}") for i in range(len(bands))])
    return wide.select("row", "col", value.alias("value")).where(F.col("value").isNotNull())


# Windows of at most this reach are made by copying each cell to those around it.
COPIED_REACH = 1
# Cells of a tile per axis, or twice the reach where that is more.
TILE = 256


def focal(cells: DataFrame, reach: int = 1) -> DataFrame:
    """(band, row, col, n, mean, low, high) over the square window around every present cell.

    In small windows each value is sent to the cells whose window holds it, and combined before
    the shuffle; larger ones are looked up in tables of sums (``focal_tiles``).
    """
    if reach > COPIED_REACH:
        return focal_tiles(cells, reach)
    window = list(itertools.product(range(-reach, reach + 1), repeat=2))
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in window])
    sent = (cells.where(F.col("value").isNotNull())
            .select("band", "row", "col", "value", F.explode(offsets).alias("o")))
    here = (F.col("o.a") == 0) & (F.col("o.b") == 0)
    out = sent.groupBy("band", (F.col("row") + F.col("o.a")).alias("row"),
                       (F.col("col") + F.col("o.b")).alias("col")).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"),
        F.max("value").alias("high"), F.count_if(here).alias("_here"))
    return out.where(F.col("_here") > 0).drop("_here")


def focal_tiles(cells: DataFrame, reach: int, tile: int = TILE) -> DataFrame:
    """As ``focal``, for windows of any reach at the same cost per cell.

    The raster is cut into tiles, and each tile gets a border one reach wide from its
    neighbours, so a cell is in four tiles at most and in one mostly. Within a tile, sums over
    all cells above and left of each (a summed-area table) give the sum of any window by four
    look-ups, and extremes are taken over runs that double. A table spans one tile only, so
    large sums far away do not cost digits. A task holds one tile, absent cells included.
    """
    side = max(tile, 2 * reach)
    value = F.col("value").cast("double")
    # Repeated cells are added up first, so a tile has at most one row per cell.
    whole = cells.where(F.col("value").isNotNull()).groupBy(
        "band", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).agg(
        F.count("*").alias("n"), F.sum(F.when(_is_finite(value), value).otherwise(0.0)).alias("total"),
        *[F.count_if(value == F.lit(float(x))).alias(f"is_{x}") for x in ODD],
        F.min(value).alias("low"), F.max(value).alias("high"))

    def reached(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / F.lit(side)), F.floor((F.col(c) + reach) / F.lit(side))))

    placed = whole.select("*", reached("row").alias("tile_row")).select("*", reached("col").alias("tile_col"))
    band = whole.schema["band"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        return _tile_windows(table, side, reach)

    return placed.groupBy("band", "tile_row", "tile_col").applyInArrow(
        run, f"band {band}, row bigint, col bigint, n bigint, mean double, low double, high double")


# Values that would spoil every sum they are part of are counted instead.
ODD = ("inf", "-inf", "nan")


def _is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def _window_sums(values: np.ndarray, reach: int) -> np.ndarray:
    """Sums over the windows around the inner cells, by four look-ups each."""
    table = np.zeros((values.shape[0] + 1, values.shape[1] + 1), dtype=values.dtype)
    table[1:, 1:] = values.cumsum(axis=0).cumsum(axis=1)
    size = 2 * reach + 1
    return table[size:, size:] - table[:-size, size:] - table[size:, :-size] + table[:-size, :-size]


def _window_extremes(values: np.ndarray, reach: int, best: np.ufunc) -> np.ndarray:
    """Extremes over the same windows: over runs that double, then two that cover a window."""
    size = 2 * reach + 1
    for _ in range(2):
        length = 1
        runs = values
        while 2 * length <= size:
            runs = best(runs[:-length], runs[length:])
            length *= 2
        rest = size - length
        values = (best(runs[:len(runs) - rest], runs[rest:]) if rest else runs).T
    return values


def _tile_windows(table: pa.Table, side: int, reach: int) -> pa.Table:
    names = ("row", "col", "tile_row", "tile_col", "n", "total", "low", "high", *(f"is_{x}" for x in ODD))
    got = {c: table.column(c).to_numpy() for c in names}
    top, left = got["tile_row"][0] * side - reach, got["tile_col"][0] * side - reach
    at = (got["row"] - top, got["col"] - left)
    shape = (side + 2 * reach, side + 2 * reach)

    def spread(values: np.ndarray, empty: float, kind: type) -> np.ndarray:
        out = np.full(shape, empty, dtype=kind)
        out[at] = values
        return out

    inner = (at[0] >= reach) & (at[0] < side + reach) & (at[1] >= reach) & (at[1] < side + reach)
    here = (at[0][inner] - reach, at[1][inner] - reach)
    n = _window_sums(spread(got["n"], 0, np.int64), reach)[here]
    odd = [_window_sums(spread(got[f"is_{x}"], 0, np.int64), reach)[here] > 0 for x in ODD]
    total = _window_sums(spread(got["total"], 0.0, float), reach)[here]
    total = np.where(odd[0], np.inf, np.where(odd[1], -np.inf, total))
    total = np.where(odd[2] | (odd[0] & odd[1]), np.nan, total)
    # NaN is the largest value: the least only of windows that hold nothing else.
    known = ~np.isnan(got["low"])
    low = _window_extremes(spread(np.where(known, got["low"], np.inf), np.inf, float), reach, np.minimum)[here]
    some = _window_sums(spread(known, 0, np.int64), reach)[here] > 0
    low = np.where(some, low, np.nan)
    high = _window_extremes(spread(np.where(np.isnan(got["high"]), -np.inf, got["high"]), -np.inf, float), reach, np.maximum)[here]
    high = np.where(odd[2], np.nan, high)
    return pa.table({"band": table.column("band").filter(pa.array(inner)), "row": got["row"][inner], "col": got["col"][inner],
                     "n": n, "mean": total / np.maximum(n, 1), "low": low, "high": high})


def coarsen(cells: DataFrame, factor: int) -> DataFrame:
    """(band, row, col, value, n): mean over blocks of factor x factor cells."""
    block = [F.floor(F.col(c) / F.lit(factor)).alias(c) for c in ("row", "col")]
    return cells.where(F.col("value").isNotNull()).groupBy("band", *block).agg(
        F.avg("value").alias("value"), F.count("*").alias("n"))


def zonal(cells: DataFrame, edges: DataFrame, size: float, cover_cell: float) -> DataFrame:
    """(zone_id, band, n, mean, low, high) of the cells whose centre lies in each zone."""
    centres = cells.where(F.col("value").isNotNull()).select(
        "band", "row", "col", "value", ((F.col("col") + 0.5) * F.lit(float(size))).alias("_x"),
        ((F.col("row") + 0.5) * F.lit(float(size))).alias("_y"))
    return locate(centres, edges, cover_cell, ("_x", "_y")).groupBy("zone_id", "band").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"),
        F.max("value").alias("high"))
