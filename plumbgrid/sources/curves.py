"""Points stored along a Hilbert curve, and boxes read as ranges of it.

A table written in order of one coordinate prunes boxes that are narrow in that one only, and a
table of tiles has as many files as tiles. Along the curve places that are close stay close in
the file, so the least and greatest key of a row group say where it lies, and a box is a few
ranges of keys. Parquet drops the row groups outside of them before reading.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.planar import ColumnOrName, col, in_box, valid_xy

KEY = "curve_key"
# Ranges that a box is read as at most; more of them read fewer rows that are not in it.
RANGES = 48
ROW_GROUP_BYTES = 16 << 20


class Curve(NamedTuple):
    """A curve through 2 ** bits by 2 ** bits cells over a box (x_min, y_min, x_max, y_max)."""

    box: tuple[float, float, float, float]
    bits: int = 20

    def cell(self, x: ColumnOrName, y: ColumnOrName) -> tuple[Column, Column]:
        """The cell of a point; points outside the box belong to the nearest cell at its border."""
        x0, y0, x1, y1 = self.box
        top = (1 << self.bits) - 1

        def place(c: Column, low: float, high: float) -> Column:
            at = F.floor((c - F.lit(low)) / F.lit((high - low) / (top + 1)))
            return F.when(c < low, 0).when(c >= high, top).otherwise(F.greatest(F.lit(0), F.least(F.lit(top), at))).cast("long")

        return place(col(x), x0, x1), place(col(y), y0, y1)

    def key(self, x: ColumnOrName, y: ColumnOrName) -> Column:
        """The place of a point along the curve.

        Each bit of the cell, from the highest, picks one of four quarters in the order the curve
        takes them; within the first and the last quarter the curve is turned.
        """
        cx, cy = self.cell(x, y)
        last = F.lit((1 << self.bits) - 1).cast("long")
        steps = F.array(*[F.lit(1 << b).cast("long") for b in reversed(range(self.bits))])
        start = F.struct(cx.alias("x"), cy.alias("y"), F.lit(0).cast("long").alias("d"))

        def step(a: Column, s: Column) -> Column:
            right, up = a["x"].bitwiseAND(s) > 0, a["y"].bitwiseAND(s) > 0
            quarter = F.when(~right & ~up, 0).when(~right, 1).when(up, 2).otherwise(3)
            turned_x = F.when(up, a["x"]).when(right, last - a["y"]).otherwise(a["y"])
            turned_y = F.when(up, a["y"]).when(right, last - a["x"]).otherwise(a["x"])
            return F.struct(turned_x.alias("x"), turned_y.alias("y"), (a["d"] * 4 + quarter).cast("long").alias("d"))

        return F.aggregate(steps, start, step, lambda a: a["d"])

    def cell_of(self, x: float, y: float) -> tuple[int, int]:
        """As ``cell``, of a corner of a box."""
        x0, y0, x1, y1 = self.box
        top = (1 << self.bits) - 1

        def place(c: float, low: float, high: float) -> int:
            if c < low:
                return 0
            return top if c >= high else max(0, min(top, int((c - low) // ((high - low) / (top + 1)))))

        return place(x, x0, x1), place(y, y0, y1)

    def ranges(self, box: tuple[float, float, float, float], most: int = RANGES) -> list[tuple[int, int]]:
        """Ranges of keys, ends included, that hold every point of a box, and some others.

        Quarters that lie partly in the box are divided, the largest first, while the parts are
        not too many; quarters in a row along the curve make one range.
        """
        (low_x, low_y), (high_x, high_y) = self.cell_of(box[0], box[1]), self.cell_of(box[2], box[3])
        # Neighbouring cells as well, so that rounding of a cell's border loses nothing.
        low_x, low_y, high_x, high_y = low_x - 1, low_y - 1, high_x + 1, high_y + 1
        if box[0] >= box[2] or box[1] >= box[3]:
            return []
        size = 1 << self.bits
        whole: list[tuple[int, int]] = []
        # (-side, first key, x, y, turn): turn maps the curve's own quarters to places.
        part = [(-size, 0, 0, 0, (0, 0))]
        while part and len(whole) + len(part) < most:
            side, first, x, y, (flip, swap) = heapq.heappop(part)
            half = -side // 2
            if not half:
                whole.append((first, first))
                continue
            for quarter, (qx, qy) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0))):
                # The quarter in the frame of this square, then in that of the box.
                px, py = (qy, qx) if swap else (qx, qy)
                if flip:
                    px, py = 1 - px, 1 - py
                nx, ny = x + px * half, y + py * half
                start = first + quarter * half * half
                if nx > high_x or ny > high_y or nx + half - 1 < low_x or ny + half - 1 < low_y:
                    continue
                if nx >= low_x and ny >= low_y and nx + half - 1 <= high_x and ny + half - 1 <= high_y:
                    whole.append((start, start + half * half - 1))
                    continue
                turn = (flip, swap)
                if quarter == 0:
                    turn = (flip, 1 - swap)
                elif quarter == 3:
                    turn = (1 - flip, 1 - swap)
                heapq.heappush(part, (-half, start, nx, ny, turn))
        whole += [(first, first + side * side - 1) for side, first, *_ in part]
        out: list[tuple[int, int]] = []
        for first, last in sorted(whole):
            if out and out[-1][1] + 1 >= first:
                out[-1] = (out[-1][0], last)
            else:
                out.append((first, last))
        return out


def write_curve(points: DataFrame, path: str, xy: tuple[str, str], curve: Curve, files: int | None = None,
                row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write points with a finite position in the order of the curve, in ``files`` ranges of it.

    Ranges are equally large whatever the crowds, for a crowded place is many keys; only points
    of one cell can not be divided.
    """
    kept = points.where(valid_xy(*xy)).select("*", curve.key(*xy).alias(KEY))
    files = files or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (kept.repartitionByRange(files, KEY).sortWithinPartitions(KEY).write
     .option("parquet.block.size", row_group_bytes).parquet(path))


def read_curve(spark: SparkSession, path: str, xy: tuple[str, str], curve: Curve,
               box: tuple[float, float, float, float] | None = None, most: int = RANGES) -> DataFrame:
    """Points of a table written by ``write_curve``, those of a half-open box if one is given."""
    rows = spark.read.parquet(path)
    if box is None:
        return rows.drop(KEY)
    held = F.lit(False)
    for first, last in curve.ranges(box, most):
        held = held | F.col(KEY).between(first, last)
    return rows.where(held).where(in_box(*xy, box)).drop(KEY)
