"""Exact k nearest neighbours.

A search radius is found for every query before any pair is formed. Points are counted in
a pyramid of grids, each level halving the cell, and levels finer than the usual are added
only where a cell is still crowded. The finest block of cells around a query that holds k
points bounds the distance to its k-th neighbour; the candidates are all points within
that bound, and the k nearest of them are kept. Nothing is capped: a query in a sparse
region simply gets a wider radius.

Points at one position are alike for every query, so only as many of them as could be
returned, the ones with the smallest keys, take part. Queries at one position are
answered once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions.planar import dist2
from ..functions.sphere import RADIUS, haversine, unit_vector
from ..session import cut
from .pairs import SPLIT_ROWS, attach, hot_groups, split_join

MAX_LEVEL = 40
# A cell with more points than this many times k gets a finer level.
CROWDED = 4


class _Frame:
    """The cube that holds all points, cut into 2**level cells per side."""

    def __init__(self, points: DataFrame, names: Sequence[str]):
        row = points.agg(F.count("*").alias("n"),
                         *[F.min(c).alias("low_" + c) for c in names],
                         *[F.max(c).alias("high_" + c) for c in names]).first()
        self.n = row["n"]
        self.names = list(names)
        if self.n:
            self.low = [row["low_" + c] for c in names]
            self.high = [row["high_" + c] for c in names]
            span = max(h - lo for lo, h in zip(self.low, self.high))
            scale = max(abs(v) for v in self.low + self.high)
            self.span = max(span * (1 + 1e-9), scale * 1e-9, 1e-300)

    def cell(self, axis: int, at: Column, level: Column | int) -> Column:
        """Cell index, clamped to the cube so that outside queries use its rim."""
        count = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
        index = F.floor((at - F.lit(self.low[axis])) / F.lit(self.span) * count)
        return F.greatest(F.lit(0).cast("long"), F.least(index, count.cast("long") - 1))

    def cells(self, level: Column | int, prefix: str = "_c") -> list[Column]:
        return [self.cell(i, F.col(c), level).alias(f"{prefix}{i}")
                for i, c in enumerate(self.names)]

    def size(self, level: Column) -> Column:
        return F.lit(self.span) / F.pow(F.lit(2.0), level)


def _pyramid(points: DataFrame, frame: _Frame, k: int) -> tuple[DataFrame, int]:
    """(level, cell, n) for all levels down to the usual one, and below it where crowded."""
    dims = len(frame.names)
    keys = [f"_c{i}" for i in range(dims)]
    crowded = CROWDED * k
    level = max(0, math.ceil(math.log(max(frame.n / k, 1), 4)))
    rest = points.select(*frame.names)
    counts = cut(rest.groupBy(*frame.cells(level)).agg(F.count("*").alias("n")))
    layers = [counts.select(F.lit(level).alias("_level"), *keys, "n")]
    upper = counts
    for above in range(level - 1, -1, -1):
        upper = upper.groupBy(*[F.shiftright(c, 1).alias(c) for c in keys]).agg(F.sum("n").alias("n"))
        layers.append(upper.select(F.lit(above).alias("_level"), *keys, "n"))
    while level < MAX_LEVEL:
        hot = counts.where(F.col("n") > crowded)
        if hot.isEmpty():
            break
        inside = rest.select(*frame.names, *frame.cells(level)).join(hot.select(*keys), keys, "left_semi")
        rest = cut(inside.select(*frame.names))
        # Two levels at a time: the level between is summed from the finer one.
        level += 2
        counts = cut(rest.groupBy(*frame.cells(level)).agg(F.count("*").alias("n")))
        between = counts.groupBy(*[F.shiftright(c, 1).alias(c) for c in keys]).agg(F.sum("n").alias("n"))
        layers += [between.select(F.lit(level - 1).alias("_level"), *keys, "n"),
                   counts.select(F.lit(level).alias("_level"), *keys, "n")]
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out, level


def _bounded(queries: DataFrame, points: DataFrame, frame: _Frame, k: int,
             slack: float, split_rows: int) -> DataFrame:
    """Queries with ``_reach``, no less than the distance to their k-th nearest point."""
    dims = len(frame.names)
    keys = [f"_c{i}" for i in range(dims)]
    pyramid, deepest = _pyramid(points, frame, k)
    around = F.array(*[F.struct(*[F.lit(o[i]).alias(f"o{i}") for i in range(dims)])
                       for o in itertools.product((-1, 0, 1), repeat=dims)])
    blocks = (pyramid.select("_level", "n", *keys, F.explode(around).alias("_o"))
              .groupBy("_level", *[(F.col(f"_c{i}") + F.col(f"_o.o{i}")).alias(f"_c{i}")
                                   for i in range(dims)])
              .agg(F.sum("n").alias("n")).where(F.col("n") >= min(k, frame.n)).drop("n"))
    fine = [f"_f{i}" for i in range(dims)]
    placed = queries.select("*", *frame.cells(deepest, "_f"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("_level")
    depth = F.lit(deepest) - F.col("_level")
    asked = placed.select(*fine).distinct().select(*fine, levels).select(
        *fine, "_level", *[F.floor(F.col(f) / F.pow(F.lit(2.0), depth)).alias(c)
                           for f, c in zip(fine, keys)])
    best = (asked.join(blocks, ["_level", *keys]).groupBy(*fine)
            .agg(F.max("_level").alias("_best")))
    far2 = F.lit(0.0)
    side = frame.size(F.col("_best"))
    for i, c in enumerate(frame.names):
        own = F.floor(F.col(fine[i]) / F.pow(F.lit(2.0), F.lit(deepest) - F.col("_best")))
        low = F.lit(frame.low[i]) + (own - 1) * side
        off = F.greatest(F.abs(F.col(c) - low), F.abs(low + 3 * side - F.col(c)))
        far2 = far2 + off * off
    reach = F.sqrt(far2) * F.lit(1 + 1e-9) + F.lit(frame.span * 1e-12 + slack)
    return attach(placed, best, [(f, f) for f in fine], split_rows=split_rows).select(
        *queries.columns, "_best", reach.alias("_reach"))


def _candidates(queries: DataFrame, points: DataFrame, names: Sequence[str],
                found: Sequence[str], k: int, slack: float, split_rows: int) -> DataFrame:
    """(query columns, point columns, _d2) with at least the k nearest of every query.

    ``queries`` are distinct positions under ``names``; ``points`` have theirs in ``found``.
    """
    dims = len(names)
    at = points.withColumnsRenamed(dict(zip(found, names)))
    frame = _Frame(at, names)
    if not frame.n:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema.fields]
        return queries.where(F.lit(False)).select("*", *nothing, F.lit(0.0).alias("_d2"))
    bounded = cut(_bounded(queries, at, frame, k, slack, split_rows))
    keys = ["_level", *[f"_c{i}" for i in range(dims)]]
    # Cells twice as wide as those of the block: the reach then covers few of them.
    level = F.greatest(F.col("_best") - 1, F.lit(0))
    wanted = bounded.select("*", level.alias("_level"))
    side = frame.size(F.col("_level"))
    for i, c in enumerate(names):
        span = F.sequence(*[frame.cell(i, F.col(c) + s * F.col("_reach"), F.col("_level"))
                            for s in (-1, 1)])
        wanted = wanted.select("*", F.explode(span).alias(f"_c{i}"))
    gap2 = F.lit(0.0)
    for i, c in enumerate(names):
        low = F.lit(frame.low[i]) + F.col(f"_c{i}") * side
        gap = F.greatest(low - F.col(c), F.col(c) - (low + side), F.lit(0.0))
        gap2 = gap2 + gap * gap
    margin = F.lit(1 + 1e-9) * F.col("_reach") + F.lit(frame.span * 1e-12)
    wanted = wanted.where(gap2 <= margin * margin).drop("_best")
    # At most one row per level.
    used = sorted(r[0] for r in bounded.select(level.alias("_level")).distinct().collect())
    copies = points.select("*", F.explode(F.array(*[F.lit(v) for v in used])).alias("_level"))
    copies = copies.select("*", *[frame.cell(i, F.col(c), F.col("_level")).alias(f"_c{i}")
                                  for i, c in enumerate(found)])
    split = hot_groups(wanted.groupBy(*keys).agg(F.count("*").alias("_nl")),
                     copies.groupBy(*keys).agg(F.count("*").alias("_nr")), keys, split_rows)
    d2 = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(names, found)),
             F.lit(0.0))
    met = split_join(wanted, copies, keys, split, d2 <= F.col("_reach") * F.col("_reach"))
    return met.drop("_reach").withColumn("_d2", d2)


def _search(queries: DataFrame, points: DataFrame, k: int, query_key: str, point_key: str,
            names: list[str], found: list[str], lonlat: bool, other_than_self: bool,
            split_rows: int) -> DataFrame:
    wide = k + 1 if other_than_self else k
    spots = queries.select(*names).where(_known(names)).distinct()
    alike = W.partitionBy(*found).orderBy(point_key)
    slim = (points.where(_known(found)).select(point_key, *found)
            .withColumn("_copy", F.row_number().over(alike))
            .where(F.col("_copy") <= wide).drop("_copy"))
    if lonlat:
        at, goal = [["_u0", "_u1", "_u2"], ["_v0", "_v1", "_v2"]]
        spots = spots.select("*", *[u.alias(a) for a, u in zip(at, unit_vector(*names))])
        slim = slim.select("*", *[u.alias(a) for a, u in zip(goal, unit_vector(*found))])
        # Ranking is by whole millimetres, so that rounding in the sine can not decide.
        slack = 2e-3 / RADIUS
        distance = F.round(haversine(*names, *found), 3)
    else:
        at, goal, slack = names, found, 0.0
        distance = F.sqrt(dist2(*names, *found))
    near = _candidates(spots, cut(slim), at, goal, wide, slack, split_rows)
    order = [F.col("_rank_by"), F.col(point_key)]
    near = near.select(*names, point_key, distance.alias("distance"),
                       (distance if lonlat else F.col("_d2")).alias("_rank_by"))
    nearest = (near.withColumn("_at", F.row_number().over(W.partitionBy(*names).orderBy(*order)))
               .where(F.col("_at") <= wide))
    answers = cut(nearest.groupBy(*[F.col(c).alias("_q_" + c) for c in names]).agg(
        F.collect_list(F.struct(point_key, "distance", "_rank_by", "_at")).alias("_found")))
    out = attach(queries, answers, [(c, "_q_" + c) for c in names], split_rows=split_rows)
    out = out.select(*queries.columns, F.explode("_found").alias("_f")).select(
        *queries.columns, "_f.*")
    if other_than_self:
        out = (out.where(F.col(query_key) != F.col(point_key))
               .withColumn("_at", F.row_number().over(W.partitionBy(query_key).orderBy(*order)))
               .where(F.col("_at") <= k))
    return out.select(*queries.columns, point_key, "distance", F.col("_at").alias("rank"))


def _known(names: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in names:
        ok = ok & (F.abs(F.coalesce(F.col(c), F.lit(float("nan")))) < F.lit(float("inf")))
    return ok


def nearest(queries: DataFrame, points: DataFrame, k: int, query_key: str, point_key: str,
            query_xy: tuple[str, str], point_xy: tuple[str, str],
            split_rows: int = SPLIT_ROWS) -> DataFrame:
    """The k nearest points of every query: query columns, point key, distance, rank.

    Ties go to the smaller point key. Column names of the two sides must differ.
    """
    return _search(queries, points, k, query_key, point_key, list(query_xy), list(point_xy),
                   False, False, split_rows)


def nearest_others(points: DataFrame, k: int, key: str, xy: tuple[str, str],
                   split_rows: int = SPLIT_ROWS) -> DataFrame:
    """The k nearest other rows of the same table, as (i, j, distance, rank)."""
    left = points.select(F.col(key).alias("i"), *[F.col(c).alias("_q" + s)
                                                  for c, s in zip(xy, "xy")])
    right = points.select(F.col(key).alias("j"), *[F.col(c).alias("_p" + s)
                                                   for c, s in zip(xy, "xy")])
    out = _search(left, right, k, "i", "j", ["_qx", "_qy"], ["_px", "_py"], False, True, split_rows)
    return out.select("i", "j", "distance", "rank")


def nearest_metres(queries: DataFrame, points: DataFrame, k: int, query_key: str,
                   point_key: str, query_lonlat: tuple[str, str],
                   point_lonlat: tuple[str, str], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """As ``nearest``, by great-circle distance in metres to the millimetre."""
    return _search(queries, points, k, query_key, point_key, list(query_lonlat),
                   list(point_lonlat), True, False, split_rows)
