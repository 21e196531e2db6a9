"""Cells that can be rolled up: counts, sums, distinct counts and quantiles over grid levels.

Points are read once, into a table of the finest cells. A coarser level, a region or a longer
period is made of that table, without the points: counts and sums add up, extremes meet, and
what does not add up is stored as a sketch that merges. A sketch has a bounded size whatever
its cell holds, so a crowded cell is one small row, and partial ones merge before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import square_cell
from ..functions.planar import valid_xy
from ..session import cut

# Base-two logarithm of the buckets of a distinct count, and the size of a quantile sketch.
DISTINCT_BITS, QUANTILE_SIZE = 12, 200


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """Relative standard error of a distinct count: 1.04 over the root of the number of buckets."""
    return 1.04 / math.sqrt(1 << bits)


def summed_cells(points: DataFrame, xy: tuple[str, str], size: float, who: str, value: str, *by: str,
                 bits: int = DISTINCT_BITS, quantile_size: int = QUANTILE_SIZE) -> DataFrame:
    """(by, level, col, row, n, total, low, high, seen, spread) per square cell of width ``size``.

    ``seen`` is a sketch of the distinct ``who``, ``spread`` one of ``value``. Nulls count in
    neither, and a value that is NaN or infinite counts as null; ``n`` counts rows. Points
    without a finite position are left out. ``level`` is 0.
    """
    col, row = square_cell(*xy, size)
    v = F.col(value).cast("double")
    clean = F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)
    rows = points.where(valid_xy(*xy)).select(*by, col.alias("col"), row.alias("row"), F.col(who).alias("_who"), clean.alias("_v"))
    return rows.groupBy(*by, "col", "row").agg(
        F.count("*").alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("low"), F.max("_v").alias("high"),
        F.hll_sketch_agg("_who", bits).alias("seen"), F.kll_sketch_agg_double("_v", F.lit(quantile_size)).alias("spread")).select(
        *by, F.lit(0).alias("level"), "col", "row", "n", "total", "low", "high", "seen", "spread")


def rolled_up(cells: DataFrame, *by: str, factor: int = 2) -> DataFrame:
    """The next coarser level of summed cells: ``factor`` by ``factor`` of them each.

    ``by`` may name fewer columns than the cells were made by; the others are merged as well.
    """
    return cells.groupBy(*by, (F.col("level") + 1).alias("level"), *[F.floor(F.col(c) / F.lit(factor)).alias(c) for c in ("col", "row")]).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_union_agg("seen").alias("seen"), F.kll_merge_agg_double("spread").alias("spread"))


def pyramid(cells: DataFrame, levels: int, *by: str, factor: int = 2) -> DataFrame:
    """Summed cells and ``levels`` coarser levels, each made of the one before.

    Give it a stored table: a level then costs a pass over the cells of the one below.
    """
    out = level = cells.select(*by, "level", "col", "row", "n", "total", "low", "high", "seen", "spread")
    for _ in range(levels):
        level = rolled_up(level, *by, factor=factor)
        out = out.unionByName(level)
    return out


def distinct_levels(points: DataFrame, xy: tuple[str, str], size: float, who: str, levels: int, *by: str, factor: int = 2) -> DataFrame:
    """(by, level, col, row, distinct) of cells of width ``size`` and ``levels`` coarser levels, exact.

    For counts that have to be right where a sketch is off. Every ``who`` of a cell is one row, so
    this grows with the points, not with the cells. Cells without a ``who`` are left out.
    """
    col, row = square_cell(*xy, size)
    rows = points.where(valid_xy(*xy) & F.col(who).isNotNull())
    base = cut(rows.select(*by, col.alias("col"), row.alias("row"), F.col(who).alias("_who")).distinct())
    wide = F.pow(F.lit(float(factor)), F.col("level"))
    coarser = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).select(
        *by, "level", *[F.floor(F.col(c) / wide).alias(c) for c in ("col", "row")], "_who")
    return coarser.groupBy(*by, "level", "col", "row").agg(F.count_distinct("_who").alias("distinct"))


def estimates(cells: DataFrame, quantiles: Sequence[float], *by: str) -> DataFrame:
    """(by, level, col, row, n, total, low, high, distinct, quantiles) of summed cells.

    ``distinct`` is off by ``distinct_error`` as a standard error, and exact for a few hundred;
    of m values a quantile is the value at about the wanted share of ranks: within 1.4 % of m
    for the default size in 99 of 100 cases, and exact for no more values than that size. Quantiles
    are null without values.
    """
    def at(share: float) -> Column:
        some = F.kll_sketch_get_n_double("spread") > 0
        return F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col("spread")), F.lit(float(share))))

    return cells.select(*by, "level", "col", "row", "n", "total", "low", "high", F.hll_sketch_estimate("seen").alias("distinct"),
                        F.array(*[at(q) for q in quantiles]).alias("quantiles"))
