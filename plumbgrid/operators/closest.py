"""The k closest pairs of two tables, over all rows.

Counting comes before pairing. If the cells of a grid hold k pairs in which no distance is
above d, then so is none of the k closest, whatever lies elsewhere. Finer and finer grids lower
that bound while they still hold k pairs; only then are pairs within it formed, and each task
keeps k of them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from .pairs import _finite, within_distance

# Cells per axis of a grid to those of the next coarser one.
FINER = 4
# Steps per doubling in which the distances within cells are counted.
STEPS = 16
MAX_ROUNDS = 40
SLACK = 1 + 2.0 ** -20


def _points(rows: DataFrame, key: str, xy: tuple[str, str], names: tuple[str, str, str], k: int) -> DataFrame:
    """(key, x, y) with at most the k smallest keys of a position: of equally distant pairs the
    smallest keys come first, so no other row can be in the result."""
    at = [F.col(c) for c in xy]
    clean = rows.where(_finite(at)).select(F.col(key).alias(names[0]), *[
        # One zero: -0.0 and 0.0 are one position.
        (c.cast("double") + F.lit(0.0)).alias(n) for c, n in zip(at, names[1:])])
    nth = F.row_number().over(W.partitionBy(*names[1:]).orderBy(F.col(names[0]).asc_nulls_last()))
    return clean.select("*", nth.alias("_nth")).where(F.col("_nth") <= k).drop("_nth")


def _cells(points: DataFrame, x: str, y: str, side: str, corner: tuple[float, float], cell: float) -> DataFrame:
    return points.groupBy(*[F.floor((F.col(c) - F.lit(o)) / F.lit(cell)).alias(n)
                            for c, o, n in zip((x, y), corner, ("_c", "_r"))]).agg(
        F.count("*").alias(f"n{side}"), F.min(x).alias(f"x0{side}"), F.max(x).alias(f"x1{side}"),
        F.min(y).alias(f"y0{side}"), F.max(y).alias(f"y1{side}"))


def distance_bound(a: DataFrame, b: DataFrame, k: int) -> float | None:
    """A distance that k pairs of (ax, ay) and (bx, by) do not exceed, or None without a pair.

    If there are fewer pairs than k, one that none exceeds.
    """
    sides = [p.agg(F.min(s + "x"), F.max(s + "x"), F.min(s + "y"), F.max(s + "y")).first() for p, s in ((a, "a"), (b, "b"))]
    if sides[0][0] is None or sides[1][0] is None:
        return None
    low = [min(s[i] for s in sides) for i in (0, 2)]
    high = [max(s[i] for s in sides) for i in (1, 3)]
    bound = math.hypot(high[0] - low[0], high[1] - low[1])
    cell = max(high[0] - low[0], high[1] - low[1]) * SLACK / FINER
    for _ in range(MAX_ROUNDS):
        if not cell or not math.isfinite(cell) or bound == 0:
            break
        both = _cells(a, "ax", "ay", "a", tuple(low), cell).join(_cells(b, "bx", "by", "b", tuple(low), cell), ["_c", "_r"])
        dx = F.greatest(F.col("x1a") - F.col("x0b"), F.col("x1b") - F.col("x0a"))
        dy = F.greatest(F.col("y1a") - F.col("y0b"), F.col("y1b") - F.col("y0a"))
        far = F.sqrt(dx * dx + dy * dy)
        step = F.when(far > 0, F.ceil(F.log2(far) * STEPS))
        # A row per step of distance, a few thousand at most whatever the tables hold.
        counts = both.groupBy(step.alias("step")).agg(
            F.sum(F.col("na").cast("double") * F.col("nb")).alias("pairs"), F.max(far).alias("far")).collect()
        held, found = 0.0, None
        for row in sorted(counts, key=lambda r: -math.inf if r.step is None else r.step):
            held += row.pairs
            if held >= k:
                found = row.far
                break
        if found is None:
            break
        bound = min(bound, found)
        cell /= FINER
    return bound


def closest_pairs(left: DataFrame, right: DataFrame, k: int, left_key: str, right_key: str,
                  left_xy: tuple[str, str], right_xy: tuple[str, str]) -> DataFrame:
    """(left_key, right_key, distance, rank) of the k pairs with the least planar distance; equally
    distant ones by left, then right key. All pairs if there are fewer. Rows with a null, NaN or
    infinite coordinate are in none."""
    if left_key == right_key:
        raise ValueError("the keys need different names")
    a = _points(left, left_key, left_xy, (left_key, "ax", "ay"), k)
    b = _points(right, right_key, right_xy, (right_key, "bx", "by"), k)
    bound = distance_bound(a, b, k)
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    if not bound:
        near = a.join(b, (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")))
    else:
        near = within_distance(a, b, bound * SLACK, ("ax", "ay"), ("bx", "by"))
    order = ["_d2", left_key, right_key]
    best = near.select(left_key, right_key, d2.alias("_d2")).orderBy(*order).limit(k)
    # k rows, by what was asked for.
    rank = F.row_number().over(W.orderBy(*order))
    return best.select(left_key, right_key, F.sqrt("_d2").alias("distance"), rank.alias("rank"))
