"""Density-based clustering.

Cells are so small that all points of one cell are within reach of each other. A cell with
``min_points`` rows therefore needs no pair at all: its points are all core and all in one
cluster. Pairs are formed only for points of thinly filled cells, and between neighbouring
cells where boxes around their points leave the question open.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.planar import dist2, valid_xy
from ..session import cut
from .components import components
from .pairs import SPLIT_ROWS, _shifted, attach, hot_groups, split_join

CELL = ["_c0", "_c1"]
# Sub-cells per side of a cell, for the boxes.
SUB = 4


def _meet(thin: DataFrame, others: DataFrame, eps2: float, split_rows: int) -> DataFrame:
    """Rows of ``thin`` with each row of ``others`` (columns b*) within reach."""
    near = list(itertools.product(range(-2, 3), repeat=2))
    spread = _shifted(thin, 2, near).drop("_o")
    split = hot_groups(spread.groupBy(*CELL).agg(F.count("*").alias("_nl")),
                     others.groupBy(*CELL).agg(F.count("*").alias("_nr")), CELL, split_rows)
    return split_join(spread, others, CELL, split, dist2("x", "y", "bx", "by") <= F.lit(eps2))


def _cell_links(core: DataFrame, nodes: DataFrame, eps: float, side: float, split_rows: int) -> DataFrame:
    """(a, b): links between cells, named by ``_cell``, that hold a pair of core points within
    reach. Cells that boxes alone have tied together, if over others, need no such link."""
    eps2 = eps * eps
    sub = [F.floor(F.col(c) / F.lit(side / SUB)).alias(s) for c, s in (("x", "_s0"), ("y", "_s1"))]
    core = core.select("x", "y", "_cell", *CELL, *sub)
    boxes = core.groupBy("_cell", *CELL, "_s0", "_s1").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    half = [o for o in itertools.product(range(-2, 3), repeat=2) if o > (0, 0)]
    a = _shifted(boxes.toDF("a", *CELL, "_as0", "_as1", "ax0", "ax1", "ay0", "ay1"), 2, half).drop("_o")
    b = boxes.toDF("b", *["_r" + c for c in CELL], "_bs0", "_bs1", "bx0", "bx1", "by0", "by1")
    # At most SUB**2 boxes per cell on either side.
    met = a.join(b, [F.col(c) == F.col("_r" + c) for c in CELL])

    def gap(lo: str, hi: str) -> tuple[Column, Column]:
        near = F.greatest(F.col("a" + lo) - F.col("b" + hi), F.col("b" + lo) - F.col("a" + hi), F.lit(0.0))
        far = F.greatest(F.col("a" + hi) - F.col("b" + lo), F.col("b" + hi) - F.col("a" + lo))
        return near, far

    (nx, fx), (ny, fy) = gap("x0", "x1"), gap("y0", "y1")
    judged = cut(met.select("a", "b", "_as0", "_as1", "_bs0", "_bs1",
                            ((nx * nx + ny * ny) <= F.lit(eps2 * (1 + 1e-9))).alias("may"),
                            ((fx * fx + fy * fy) <= F.lit(eps2 * (1 - 1e-9))).alias("must"))
                 .where("may"))
    sure = judged.where("must").select("a", "b").distinct()
    tied = cut(components(nodes, sure))
    open_pairs = (judged.join(tied.toDF("a", "_ca"), "a").join(tied.toDF("b", "_cb"), "b")
                  .where("_ca <> _cb").drop("_ca", "_cb"))
    left = core.select(F.col("x").alias("ax"), F.col("y").alias("ay"), "_s0", "_s1")
    right = core.select(F.col("x").alias("bx"), F.col("y").alias("by"), "_s0", "_s1")
    first = open_pairs.withColumnsRenamed({"_as0": "_s0", "_as1": "_s1"}).join(
        left, ["_s0", "_s1"]).select("a", "b", "ax", "ay", F.col("_bs0").alias("_s0"),
                                     F.col("_bs1").alias("_s1"))
    keys = ["_s0", "_s1"]
    split = hot_groups(first.groupBy(*keys).agg(F.count("*").alias("_nl")),
                     right.groupBy(*keys).agg(F.count("*").alias("_nr")), keys, split_rows)
    found = split_join(first, right, keys, split, dist2("ax", "ay", "bx", "by") <= F.lit(eps2))
    return sure.unionByName(found.select("a", "b").distinct())


def dbscan(points: DataFrame, key: str, xy: tuple[str, str], eps: float, min_points: int,
           split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(key, cluster, core). A row is core with ``min_points`` rows within ``eps``, itself
    included. ``cluster`` is the smallest core key of the cluster and null for noise; a
    border row within reach of several clusters joins the smallest."""
    eps2 = float(eps) * float(eps)
    side = eps / math.sqrt(2) * (1 - 1e-9)
    x, y = xy
    spots = (points.where(valid_xy(x, y)).groupBy(F.col(x).alias("x"), F.col(y).alias("y"))
             .agg(F.count("*").alias("n"), F.min(key).alias("low")))
    spots = cut(spots.select("*", F.floor(F.col("x") / F.lit(side)).alias("_c0"),
                             F.floor(F.col("y") / F.lit(side)).alias("_c1")))
    totals = spots.groupBy(*CELL).agg(F.sum("n").alias("_total"))
    weighed = cut(attach(spots, totals, [(c, c) for c in CELL], split_rows=split_rows))
    thin = weighed.where(F.col("_total") < min_points).drop("_total")
    dense = weighed.where(F.col("_total") >= min_points)
    others = spots.select(F.col("x").alias("bx"), F.col("y").alias("by"),
                          F.col("n").alias("bn"), *CELL)
    counted = cut(_meet(thin, others, eps2, split_rows).groupBy("x", "y", "n", "low").agg(
        (F.sum("bn") >= min_points).alias("core")))
    cells = [F.floor(F.col(c) / F.lit(side)).alias(k) for c, k in zip("xy", CELL)]
    core = dense.select("x", "y", "low", *CELL).unionByName(
        counted.where("core").select("x", "y", "low", *cells))
    named = core.groupBy(*CELL).agg(F.min("low").alias("_cell"))
    core = cut(attach(core, named, [(c, c) for c in CELL], split_rows=split_rows))
    nodes = cut(core.select(F.col("_cell").alias("node")).distinct())
    grouped = components(nodes, _cell_links(core, nodes, eps, side, split_rows))
    core = cut(attach(core, grouped, [("_cell", "node")], split_rows=split_rows).select(
        "x", "y", *CELL, F.col("component").alias("cluster")))
    border = _meet(
        counted.where(~F.col("core")).select("x", "y", *cells),
        core.toDF("bx", "by", *CELL, "cluster"), eps2, split_rows).groupBy("x", "y").agg(
        F.min("cluster").alias("cluster"))
    placed = core.select("x", "y", "cluster", F.lit(True).alias("core")).unionByName(
        border.select("x", "y", "cluster", F.lit(False).alias("core")))
    placed = placed.toDF("_x", "_y", "cluster", "core")
    return attach(points, placed, [(x, "_x"), (y, "_y")], "left", split_rows).select(
        key, "cluster", F.coalesce("core", F.lit(False)).alias("core"))
