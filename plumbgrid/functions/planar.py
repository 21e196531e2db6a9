"""Column expressions on planar coordinates. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_xy(x: ColumnOrName, y: ColumnOrName) -> Column:
    """True when both coordinates are present and finite; never null."""
    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return finite(col(x)) & finite(col(y))


def dist2(x1: ColumnOrName, y1: ColumnOrName, x2: ColumnOrName, y2: ColumnOrName) -> Column:
    """Squared distance. Predicates compare this with a squared radius, so no root is taken."""
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return dx * dx + dy * dy


def distance(x1: ColumnOrName, y1: ColumnOrName, x2: ColumnOrName, y2: ColumnOrName) -> Column:
    return F.sqrt(dist2(x1, y1, x2, y2))


def in_box(x: ColumnOrName, y: ColumnOrName, box: tuple[float, float, float, float]) -> Column:
    """Half-open box (x_min, y_min, x_max, y_max); plain ranges, so stored columns push it down."""
    x0, y0, x1, y1 = box
    return (col(x) >= x0) & (col(x) < x1) & (col(y) >= y0) & (col(y) < y1)
