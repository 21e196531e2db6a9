"""Grid addresses as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .planar import ColumnOrName, col


def square_cell(x: ColumnOrName, y: ColumnOrName, size: float) -> tuple[Column, Column]:
    """(column, row) of the half-open square cell."""
    return F.floor(col(x) / F.lit(float(size))), F.floor(col(y) / F.lit(float(size)))


def hex_cell(x: ColumnOrName, y: ColumnOrName, size: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon with circumradius ``size``.

    The fractional address is rounded in cube coordinates, and the coordinate with
    the largest rounding error is restored from the other two.
    """
    fx = (col(x) * F.lit(math.sqrt(3) / 3) - col(y) / F.lit(3.0)) / F.lit(float(size))
    fz = (col(y) * F.lit(2.0) / F.lit(3.0)) / F.lit(float(size))
    fy = -fx - fz
    rx, ry, rz = (F.floor(c + F.lit(0.5)) for c in (fx, fy, fz))
    ex, ey, ez = F.abs(rx - fx), F.abs(ry - fy), F.abs(rz - fz)
    q = F.when((ex > ey) & (ex > ez), -ry - rz).otherwise(rx)
    r = F.when((ez >= ex) & (ez >= ey), -rx - ry).otherwise(rz)
    return q, r


def hex_centre(q: ColumnOrName, r: ColumnOrName, size: float) -> tuple[Column, Column]:
    s = float(size)
    return (col(q) + col(r) / F.lit(2.0)) * F.lit(s * math.sqrt(3)), col(r) * F.lit(1.5 * s)
