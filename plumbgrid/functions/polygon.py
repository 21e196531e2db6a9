"""Crossing tests between a point and polygon edges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .planar import ColumnOrName, col


def upward(x1: ColumnOrName, y1: ColumnOrName, x2: ColumnOrName,
           y2: ColumnOrName) -> tuple[Column, Column, Column, Column]:
    """The edge with its lower end first."""
    x1, y1, x2, y2 = (col(c) for c in (x1, y1, x2, y2))
    up = y1 <= y2
    return (F.when(up, x1).otherwise(x2), F.when(up, y1).otherwise(y2),
            F.when(up, x2).otherwise(x1), F.when(up, y2).otherwise(y1))


def crosses_upward(px: ColumnOrName, py: ColumnOrName, x1: ColumnOrName, y1: ColumnOrName,
                   x2: ColumnOrName, y2: ColumnOrName) -> Column:
    """``crosses`` for an edge known to have its lower end first."""
    px, py, x1, y1, x2, y2 = (col(c) for c in (px, py, x1, y1, x2, y2))
    meets = F.when(y1 < y2, px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    return (y1 <= py) & (py < y2) & F.coalesce(meets, F.lit(False))


def crosses(px: ColumnOrName, py: ColumnOrName, x1: ColumnOrName, y1: ColumnOrName,
            x2: ColumnOrName, y2: ColumnOrName) -> Column:
    """True when a ray from the point towards +x meets the edge.

    Half-open in y. The lower end is always taken first, so an edge shared by two
    zones gives the same answer for both and tilings neither overlap nor leave gaps.
    """
    return crosses_upward(px, py, *upward(x1, y1, x2, y2))


def crossings(px: ColumnOrName, py: ColumnOrName, edges: ColumnOrName,
              test=crosses) -> Column:
    """Number of edges in ARRAY<STRUCT<x1,y1,x2,y2>> that the ray meets."""
    hit = F.filter(col(edges), lambda e: test(px, py, e["x1"], e["y1"], e["x2"], e["y2"]))
    return F.size(hit)


def inside(px: ColumnOrName, py: ColumnOrName, edges: ColumnOrName) -> Column:
    """Even-odd containment for a polygon held as a value."""
    return crossings(px, py, edges) % 2 == 1
