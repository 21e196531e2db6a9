"""Sums over the neighbourhood of every row, without listing the neighbours.

Rows at one position have the same neighbours, so they are first added up: n rows, s the
sum of their values and q the sum of squares. Everything else works on positions, and a
position that holds a third of all rows is one row here.

Where positions are thin on the ground they meet in a grid join. Where a cell is crowded,
forming its pairs would cost the square of its positions although only sums are wanted.
There cells meet cells: boxes around their positions show that all pairs of two cells fall
in one distance class, in which case the cells' sums are enough, or that none is near.
Cells in doubt are halved and only the last doubtful few compare positions. All tests are
exact; the boxes decide nothing within rounding of a radius.

Narrow distance classes leave nearly all cells in doubt until they hold a few positions. So
their pairs are compared as arrays within tasks, up to a number of pairs that is still less
work than the rounds of halving.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.planar import dist2, valid_xy
from ..session import cut
from . import tiles
from .pairs import SPLIT_ROWS, WIDEN, attach, meeting_pairs, within_distance, work_tasks

# Above this many positions in a cell, cells meet cells.
CROWDED = 256
# unless the whole table gives no more pairs of positions than this.
CHEAP_PAIRS = 100_000_000
# Up to this many, pairs of positions are compared as arrays rather than cells be halved, for distance classes.
TILED_PAIRS = 1e12
# Two cells with at most this many pairs of positions compare them.
LEAF_PAIRS = 4096
MAX_LEVEL = 60
SUMS = ("n", "s", "q")


def positions(points: DataFrame, xy: tuple[str, str], value: str | None = None) -> DataFrame:
    """(x, y, n, s, q) per distinct position, written once because it is read repeatedly."""
    v = F.lit(0.0) if value is None else F.col(value)
    rows = points.where(valid_xy(*xy)).select(F.col(xy[0]).alias("x"), F.col(xy[1]).alias("y"),
                                              v.alias("v"))
    return cut(rows.where(F.col("v").isNotNull()).groupBy("x", "y").agg(
        F.count("*").alias("n"), F.sum("v").alias("s"),
        F.sum(F.col("v") * F.col("v")).alias("q")))


class _Level(NamedTuple):
    spots: DataFrame     # positions with their cell (c0, c1)
    settled: DataFrame   # (a0, a1, a_*, b_*, class): all pairs of two cells in one class
    leaves: DataFrame    # (a0, a1, b0, b1): cells whose positions have to be compared
    work: float          # pairs of positions in them


def _in_cells(spots: DataFrame, side: float) -> DataFrame:
    return spots.select("x", "y", *SUMS, F.floor(F.col("x") / F.lit(side)).alias("c0"),
                        F.floor(F.col("y") / F.lit(side)).alias("c1"))


def _nodes(spots: DataFrame, prefix: str) -> DataFrame:
    nodes = spots.groupBy("c0", "c1").agg(
        *[F.sum(c).alias(f"{prefix}_{c}") for c in SUMS], F.count("*").alias(f"{prefix}_m"),
        F.min("x").alias(f"{prefix}_x0"), F.max("x").alias(f"{prefix}_x1"),
        F.min("y").alias(f"{prefix}_y0"), F.max("y").alias(f"{prefix}_y1"))
    return nodes.withColumnsRenamed({"c0": f"{prefix}0", "c1": f"{prefix}1"})


def _judged(pairs: DataFrame, edges2: Sequence[float]) -> DataFrame:
    """Pairs of cells that may be near, with the distance classes of their nearest and
    farthest points. Class k lies between the k-th and the next radius."""
    near2, far2 = F.lit(0.0), F.lit(0.0)
    for axis in "xy":
        a0, a1, b0, b1 = (F.col(f"{p}_{axis}{e}") for p in "ab" for e in "01")
        near = F.greatest(a0 - b1, b0 - a1, F.lit(0.0))
        far = F.greatest(a1 - b0, b1 - a0)
        near2, far2 = near2 + near * near, far2 + far * far

    def above(d2: Column) -> Column:
        return sum(((d2 > F.lit(e)).cast("int") for e in edges2), F.lit(0))

    kept = [f"{p}{c}" for p in "ab" for c in ("0", "1", "_n", "_s", "_q", "_m")]
    out = pairs.select(*kept, above(near2 * F.lit(1 - 1e-9)).alias("class"),
                       above(far2 * F.lit(1 + 1e-9)).alias("_far"))
    return out.where(F.col("class") < len(edges2))


def _levels(spots: DataFrame, radii: Sequence[float]) -> Iterator[_Level]:
    edges2 = [r * r for r in radii]
    side = radii[-1] * WIDEN
    around = list(itertools.product((-1, 0, 1), repeat=2))
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around])
    spots = cut(_in_cells(spots, side))
    a = _nodes(spots, "a").select("*", F.explode(shifts).alias("_o"))
    b = _nodes(spots, "b")
    pairs = a.join(b, (F.col("a0") + F.col("_o.i") == F.col("b0"))
                   & (F.col("a1") + F.col("_o.j") == F.col("b1")))
    for level in range(MAX_LEVEL + 1):
        judged = cut(_judged(pairs, edges2))
        doubtful = judged.where(F.col("class") != F.col("_far"))
        small = F.col("a_m") * F.col("b_m") <= LEAF_PAIRS
        if level == MAX_LEVEL:
            small = F.lit(True)
        cells = ["a0", "a1", "b0", "b1"]
        found = doubtful.agg(F.sum(F.when(small, F.col("a_m") * F.col("b_m"))).alias("work"),
                             F.count_if(~small).alias("large")).first()
        yield _Level(spots, judged.where(F.col("class") == F.col("_far")),
                     doubtful.where(small).select(*cells), found.work)
        if not found.large:
            return
        large = doubtful.where(~small).select(*cells)
        # Doubt is mutual, so the first cells of the pairs are all the cells in doubt.
        open_cells = large.select(F.col("a0").alias("c0"), F.col("a1").alias("c1")).distinct()
        side /= 2
        spots = cut(_in_cells(spots.join(open_cells, ["c0", "c1"], "left_semi"), side))
        halves = [_nodes(spots, p) for p in "ab"]
        for p, half in zip("ab", halves):
            half = half.select("*", F.shiftright(f"{p}0", 1).alias(f"_{p}0"),
                               F.shiftright(f"{p}1", 1).alias(f"_{p}1"))
            large = large.withColumnsRenamed({f"{p}0": f"_up{p}0", f"{p}1": f"_up{p}1"}).join(
                half, (F.col(f"_up{p}0") == F.col(f"_{p}0")) & (F.col(f"_up{p}1") == F.col(f"_{p}1")))
        pairs = large


def _compared(level: _Level) -> DataFrame:
    """All pairs of positions of the cells in doubt, as a_* and b_*."""
    sides = {p: level.spots.withColumnsRenamed(
        {"x": f"{p}_x", "y": f"{p}_y", "c0": f"_{p}0", "c1": f"_{p}1",
         **{c: f"{p}_{c}" for c in SUMS}}) for p in "ab"}
    out = level.leaves
    tasks = work_tasks(out.sparkSession, level.work)
    if tasks is not None:
        # By the first cell, so that its sums come together in one task.
        out = out.repartition(tasks, "a0", "a1")
    for p in "ba":
        out = out.join(sides[p], (F.col(f"{p}0") == F.col(f"_{p}0")) & (F.col(f"{p}1") == F.col(f"_{p}1")))
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _crowd_pairs(spots: DataFrame, side: float, crowded: int) -> float:
    """Pairs of positions where comparing them row by row would cost more than other ways, else 0."""
    counts = _in_cells(spots, side).groupBy("c0", "c1").count()
    load = counts.agg(F.max("count").alias("most"), F.sum(
        F.col("count").cast("double") * F.col("count") * 9).alias("pairs")).first()
    return load.pairs if (load.most or 0) > crowded and load.pairs > CHEAP_PAIRS else 0.0


def position_sums(spots: DataFrame, radius: float, split_rows: int = SPLIT_ROWS,
                  crowded: int = CROWDED) -> DataFrame:
    """Adds (n_in, s_in, q_in) over all positions within the radius, the own one included."""
    radius = float(radius)
    if not _crowd_pairs(spots, radius * WIDEN, crowded):
        b = spots.toDF("_bx", "_by", "_bn", "_bs", "_bq")
        near = within_distance(spots, b, radius, ("x", "y"), ("_bx", "_by"), split_rows=split_rows)
        # All copies of a position meet it in the same task, so this adds up before the shuffle.
        return near.groupBy(*spots.columns).agg(
            *[F.sum(f"_b{c}").alias(f"{c}_in") for c in SUMS])
    parts = []
    for level in _levels(spots, [radius]):
        sums = [F.sum(f"b_{c}").alias(f"{c}_in") for c in SUMS]
        settled = level.settled.groupBy(F.col("a0").alias("_a0"), F.col("a1").alias("_a1")).agg(*sums)
        whole = attach(level.spots, settled, [("c0", "_a0"), ("c1", "_a1")], split_rows=split_rows)
        near = _compared(level).where(dist2("a_x", "a_y", "b_x", "b_y") <= F.lit(radius * radius))
        parts += [whole.select(*spots.columns, *[f"{c}_in" for c in SUMS]),
                  near.groupBy(*[F.col(f"a_{c}").alias(c) for c in spots.columns]).agg(*sums)]
    return _union(parts).groupBy(*spots.columns).agg(*[F.sum(f"{c}_in").alias(f"{c}_in") for c in SUMS])


def _compared_classes(radius: float, classes: int, class_of: Callable[[np.ndarray], np.ndarray]):
    """(class, pairs, spread) of the pairs of a cell's own positions and those after them by (x, y)."""
    def task(group: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y, n, s, q, own = [group.column(c).to_numpy() for c in ("x", "y", *SUMS, "_own")]
        order = np.lexsort((y, x))
        x, y, n, s, q, own = (v[order] for v in (x, y, n, s, q, own))
        pairs, spread = [0] * classes, np.zeros(classes)
        for tile in tiles.together(x, y, np.flatnonzero(own)):
            around = tiles.within_reach(x, y, tile, radius)
            around = around[np.searchsorted(around, tile.min(), "right"):]
            step = tiles.BLOCK // len(tile)
            for a in range(0, len(around), step):
                others = around[a:a + step]
                dx, dy = x[tile][:, None] - x[others], y[tile][:, None] - y[others]
                at = np.minimum(class_of(dx * dx + dy * dy), classes).astype(np.int64)
                if others[0] <= tile.max():
                    at[others <= tile[:, None]] = classes
                n_a, s_a, q_a = (v[tile][:, None] for v in (n, s, q))
                part = q_a * n[others] - 2 * s_a * s[others] + n_a * q[others]
                met = np.bincount(at.ravel(), (n_a * n[others]).ravel(), classes + 1)
                pairs = [p + int(m) for p, m in zip(pairs, met)]
                spread += np.bincount(at.ravel(), part.ravel(), classes + 1)[:classes]
        yield pa.RecordBatch.from_arrays([pa.array(range(classes), pa.int64()), pa.array(pairs, pa.int64()), pa.array(spread)],
                                         ["class", "pairs", "spread"])

    return task


def class_sums(spots: DataFrame, radii: Sequence[float], class_of: Callable[[Column], Column],
               split_rows: int = SPLIT_ROWS, crowded: int = CROWDED,
               array_class: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(class, pairs, spread) over unordered pairs of rows at different or equal positions.

    ``pairs`` counts them and ``spread`` adds the squared differences of their values.
    ``class_of`` turns a squared distance into a class below len(radii); the classes must
    change at the radii only, and pairs of higher class are left out. ``array_class`` is the
    same function of an array; crowds are halved down to a few positions without it.
    """
    last = len(radii)
    pairs = F.col("a_n") * F.col("b_n")
    spread = (F.col("a_q") * F.col("b_n") - 2 * F.col("a_s") * F.col("b_s")
              + F.col("a_n") * F.col("b_q"))
    d2 = dist2("a_x", "a_y", "b_x", "b_y")
    total = [F.sum("pairs").alias("pairs"), F.sum("spread").alias("spread")]
    measured = [class_of(d2).cast("long").alias("class"), pairs.alias("pairs"), spread.alias("spread")]
    same = spots.select(F.lit(0).cast("long").alias("class"),
                        F.expr("n * (n - 1) div 2").alias("pairs"),
                        (F.col("n") * F.col("q") - F.col("s") * F.col("s")).alias("spread")).where("pairs > 0")
    load = _crowd_pairs(spots, radii[-1] * WIDEN, crowded)
    if not load:
        order = (F.col("a_x") < F.col("b_x")) | ((F.col("a_x") == F.col("b_x"))
                                                 & (F.col("a_y") < F.col("b_y")))
        met = meeting_pairs(spots, ("x", "y"), radii[-1], order, split_rows)
        parts = [met.select(*measured).where(F.col("class") < last), same]
        return _union(parts).groupBy("class").agg(*total)
    if array_class is not None and load <= TILED_PAIRS:
        plain = spots.select(*[F.col(c).cast("long" if c == "n" else "double").alias(c) for c in ("x", "y", *SUMS)])
        met = tiles.each(plain, radii[-1], split_rows, _compared_classes(radii[-1], last, array_class),
                         "class long, pairs long, spread double")
        return met.where("pairs > 0").unionByName(same).groupBy("class").agg(*total)
    # Both orders of each pair come up here, and every row also meets itself.
    rows = spots.agg(F.sum("n").alias("n")).select(
        F.lit(0).cast("long").alias("class"), (-F.col("n")).alias("pairs"), F.lit(0.0).alias("spread"))
    parts = [rows]
    for level in _levels(spots, radii):
        parts += [level.settled.select(F.col("class").cast("long").alias("class"),
                                       pairs.alias("pairs"), spread.alias("spread")),
                  _compared(level).select(*measured).where(F.col("class") < last)]
    both = _union([p.groupBy("class").agg(*total) for p in parts]).groupBy("class").agg(*total)
    return both.where("pairs > 0").select("class", F.expr("pairs div 2").alias("pairs"),
                                          (F.col("spread") / 2).alias("spread"))


def sums_within(points: DataFrame, xy: tuple[str, str], radius: float, value: str | None = None,
                split_rows: int = SPLIT_ROWS, crowded: int = CROWDED) -> DataFrame:
    """Points with ``degree``, the number of other rows within the radius, and ``lag``, the
    sum of their values (zero without a value column)."""
    own = F.lit(0.0) if value is None else F.col(value)
    sums = position_sums(positions(points, xy, value), radius, split_rows, crowded).select(
        F.col("x").alias("_sx"), F.col("y").alias("_sy"), "n_in", "s_in")
    met = attach(points, sums, list(zip(xy, ("_sx", "_sy"))), split_rows=split_rows)
    return met.select(*points.columns, (F.col("n_in") - 1).alias("degree"),
                      (F.col("s_in") - own).alias("lag"))
