"""Crossings of the segments of two tables.

Every segment is a row in each grid cell it passes, and segments meet in cells. A pair that
shares several cells is reported by the one that holds their crossing point, so no pair has to
be made distinct afterwards. Cells that hold much of either table are cut into blocks
(``pairs.split_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .pairs import SPLIT_ROWS, WIDEN, _finite, disjoint, hot_groups, split_join

Ends = tuple[str, str, str, str]


def _span(lo: Column, hi: Column, cell: float) -> Column:
    return F.sequence(F.floor(lo / F.lit(cell)), F.floor(hi / F.lit(cell)))


def rastered(segments: DataFrame, ends: Ends, cell: float) -> DataFrame:
    """Segments in each cell (_row, _col) they pass, and in some they only come close to.

    Within a row of cells a segment covers a range of columns, widened by a millionth of a
    cell, so that a rounded crossing point is always in a cell of both its segments.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ends)
    slack = F.lit(cell * (WIDEN - 1))
    rows = segments.where(_finite([x1, y1, x2, y2])).select("*", F.explode(_span(
        F.least(y1, y2) - slack, F.greatest(y1, y2) + slack, cell)).alias("_row"))
    low = F.greatest(F.least(y1, y2), F.col("_row") * F.lit(cell) - slack)
    high = F.least(F.greatest(y1, y2), (F.col("_row") + 1) * F.lit(cell) + slack)

    def x_at(y: Column) -> Column:
        share = F.when(y2 == y1, 0.0).otherwise((y - y1) / F.nullif(y2 - y1, F.lit(0.0)))
        return x1 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (x2 - x1)

    flat = y1 == y2
    first = F.when(flat, F.least(x1, x2)).otherwise(F.least(x_at(low), x_at(high)))
    last = F.when(flat, F.greatest(x1, x2)).otherwise(F.greatest(x_at(low), x_at(high)))
    return rows.select("*", F.explode(_span(first - slack, last + slack, cell)).alias("_col"))


def _turn(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def meeting_point(a: Ends, b: Ends) -> tuple[Column, Column, Column]:
    """Whether two segments share a point, and its x and y.

    Segments on one line share the point where their overlap starts, in (x, y) order.
    """
    ax, ay, aX, aY = (F.col(c) for c in a)
    bx, by, bX, bY = (F.col(c) for c in b)
    t1, t2 = _turn(bx, by, bX, bY, ax, ay), _turn(bx, by, bX, bY, aX, aY)
    t3, t4 = _turn(ax, ay, aX, aY, bx, by), _turn(ax, ay, aX, aY, bX, bY)
    line = (t1 == 0) & (t2 == 0) & (t3 == 0) & (t4 == 0)
    apart = (F.signum(t1) * F.signum(t2) > 0) | (F.signum(t3) * F.signum(t4) > 0)

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    begin = F.greatest(F.least(point(ax, ay), point(aX, aY)), F.least(point(bx, by), point(bX, bY)))
    end = F.least(F.greatest(point(ax, ay), point(aX, aY)), F.greatest(point(bx, by), point(bX, bY)))
    share = F.when(t1 == t2, 0.0).otherwise(t1 / F.nullif(t1 - t2, F.lit(0.0)))
    meets = F.when(line, begin <= end).otherwise(~apart)
    return (meets, F.when(line, begin["x"]).otherwise(ax + share * (aX - ax)),
            F.when(line, begin["y"]).otherwise(ay + share * (aY - ay)))


def crossing(left: DataFrame, right: DataFrame, left_ends: Ends, right_ends: Ends, cell: float,
             at: tuple[str, str] = ("x", "y"), split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Pairs of segments that share a point, ends included, with that point as ``at``.

    A segment with a null, NaN or infinite end meets nothing; one whose ends are equal is a
    point. A segment is copied to about its length over ``cell`` cells.
    """
    disjoint(left, right)
    keys = ["_row", "_col"]
    near, far = rastered(left, left_ends, cell), rastered(right, right_ends, cell)
    split = hot_groups(near.groupBy(*keys).agg(F.count("*").alias("_nl")), far.groupBy(*keys).agg(F.count("*").alias("_nr")),
                       keys, split_rows)
    far = far.withColumns({"_cr": F.col("_row"), "_cc": F.col("_col")})
    meets, x, y = meeting_point(left_ends, right_ends)
    here = (F.floor(x / F.lit(cell)) == F.col("_cc")) & (F.floor(y / F.lit(cell)) == F.col("_cr"))
    met = split_join(near, far, keys, split, meets & here)
    return met.select(*left.columns, *right.columns, x.alias(at[0]), y.alias(at[1]))
