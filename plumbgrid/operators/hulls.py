"""Convex hull per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.planar import valid_xy
from ..session import cut
from .pairs import attach

PARTS = 64


def _chain(xy: np.ndarray) -> np.ndarray:
    """One side of the hull of points in (x, y) order, by the monotone chain."""
    kept: list = []
    for p in xy:
        while len(kept) > 1:
            (ax, ay), (bx, by) = kept[-2], kept[-1]
            if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                break
            kept.pop()
        kept.append((p[0], p[1]))
    return np.array(kept)


def hull_corners(xy: np.ndarray) -> np.ndarray:
    """Corners counter-clockwise from the lowest x; none lies between two others."""
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy
    return np.concatenate([_chain(xy)[:-1], _chain(xy[::-1])[:-1]])


# Directions whose outermost points make the inner octagon, counter-clockwise.
OUTWARD = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
# Groups up to which the octagons, of sixteen numbers each, are sent to every executor.
SMALL_GROUPS = 50_000
SLACK = 1e-9


def outer(rows: DataFrame, by: str) -> DataFrame:
    """Rows (by, x, y) without those well inside the octagon of their group's outermost points.

    No corner of the hull is inside it, and in a crowd nearly everything else is; this is one
    aggregate and a filter in generated code, so that few points come to Python.
    """
    here = F.struct("x", "y")
    corners = cut(rows.groupBy(F.col(by).alias("_by")).agg(
        F.array(*[F.max_by(here, F.col("x") * dx + F.col("y") * dy) for dx, dy in OUTWARD]).alias("_ring")))
    if corners.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS:
        met = rows.join(F.broadcast(corners), F.col(by).eqNullSafe(F.col("_by")), "left")
    else:
        met = attach(rows, corners, [(by, "_by")], "left")
    inside, edges = F.lit(True), F.lit(0)
    for i in range(len(OUTWARD)):
        a, b = F.col("_ring")[i], F.col("_ring")[(i + 1) % len(OUTWARD)]
        dx, dy, px, py = b["x"] - a["x"], b["y"] - a["y"], F.col("x") - a["x"], F.col("y") - a["y"]
        slack = F.lit(SLACK) * (F.abs(dx) + F.abs(dy)) * (F.abs(px) + F.abs(py))
        inside = inside & ((dx * py - dy * px > slack) | ((dx == 0) & (dy == 0)))
        edges = edges + F.when((dx == 0) & (dy == 0), 0).otherwise(1)
    return met.where(~F.coalesce(inside & (edges > 0), F.lit(False))).select(by, "x", "y")


def _labelled(by: str, group: object, corners: np.ndarray) -> pd.DataFrame:
    """Corners with their group; an unknown group is null, not NaN."""
    name = None if pd.isna(group) else group
    return pd.DataFrame({by: pd.Series([name] * len(corners), dtype=object), "x": corners[:, 0], "y": corners[:, 1]})


def convex_hulls(points: DataFrame, by: str, xy: tuple[str, str]) -> DataFrame:
    """(by, seq, x, y): the corners of the hull of each group.

    Groups shrink before they meet: points within an octagon go first (``outer``), each task
    reduces its batches to their corners, then up to 64 parts per group are reduced, and only
    their corners come together.
    """
    rows = outer(points.where(valid_xy(*xy)).select(by, F.col(xy[0]).alias("x"), F.col(xy[1]).alias("y")), by)
    schema = f"{by} {dict(rows.dtypes)[by]}, x double, y double"

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for group, part in batch.groupby(by, dropna=False):
                xy_part = part[["x", "y"]].to_numpy()
                if group in held:
                    xy_part = np.concatenate([held[group], xy_part])
                held[group] = hull_corners(xy_part)
            if len(held) > 10_000:
                yield from _flush(held)
                held = {}
        yield from _flush(held)

    def _flush(held: dict) -> Iterator[pd.DataFrame]:
        for group, corners in held.items():
            yield _labelled(by, group, corners)

    def reduce_part(part: pd.DataFrame) -> pd.DataFrame:
        return _labelled(by, part[by].iloc[0], hull_corners(part[["x", "y"]].to_numpy()))

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        out = reduce_part(part)
        out.insert(1, "seq", np.arange(len(out), dtype="int32"))
        return out

    partial = rows.mapInPandas(shrink, schema)
    part = F.pmod(F.xxhash64("x", "y"), F.lit(PARTS)).alias("part")
    fewer = partial.groupBy(by, part).applyInPandas(reduce_part, schema)
    return fewer.groupBy(by).applyInPandas(finish, f"{by} {dict(rows.dtypes)[by]}, seq int, x double, y double")
