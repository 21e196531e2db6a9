"""Meetings of two streams: fixes of one near fixes of the other in place and time.

A join of two streams keeps what may still find a partner. Here both sides have a watermark and
the condition bounds the difference in time, so state ends: a row is kept until the other
side's watermark is past its reach. The key of the state is a cell of place and time, which
spreads a crowded place over its hours and tests neighbours only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import from_micros, has_zone, to_micros
from ..functions.planar import dist2
from ..operators.pairs import WIDEN, _finite, _own_cell, _reached, disjoint

AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def meetings(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, left_xy: tuple[str, str],
             right_xy: tuple[str, str], radius: float, seconds: float, delay: str) -> DataFrame:
    """Pairs of rows at most ``radius`` apart in place and ``seconds`` in time, with ``distance``.

    Works on streams and on tables. Of a stream, rows that come later than ``delay`` behind
    the newest of their side may be dropped. A row without a time or a finite position meets
    nothing. The cells of the right side are those copied, so it should be the smaller stream.
    """
    disjoint(left, right)
    zoned = [has_zone(left, left_ts), has_zone(right, right_ts)]
    width, cell = max(1, round(seconds * 1_000_000)), radius * WIDEN

    def timed(rows: DataFrame, ts: str, zone: bool, xy: Sequence[str], name: str) -> DataFrame:
        moment = F.timestamp_micros(to_micros(F.col(ts), zone)).alias(name)
        kept = rows.where(F.col(ts).isNotNull() & _finite([F.col(c) for c in xy]))
        # The moment takes the place of the time column, from which it is restored after the join.
        return kept.select(*[c for c in rows.columns if c != ts], moment).withWatermark(name, delay)

    def micros(name: str) -> Column:
        return F.unix_micros(F.col(name))

    a, b = timed(left, left_ts, zoned[0], left_xy, "_lt"), timed(right, right_ts, zoned[1], right_xy, "_rt")
    near = _own_cell(a, [F.col(c) for c in left_xy], cell).select("*", F.floor(micros("_lt") / F.lit(width)).alias("_w"))
    slots = F.sequence(F.floor((micros("_rt") - width) / F.lit(width)), F.floor((micros("_rt") + width) / F.lit(width)))
    far = _reached(b, [F.col(c) for c in right_xy], cell, AROUND).drop("_o").select("*", F.explode(slots).alias("_w"))
    far = far.withColumnsRenamed({k: "_r" + k for k in ("_c0", "_c1", "_w")})
    reach = f"INTERVAL '{width / 1_000_000:.6f}' SECOND"
    d2 = dist2(*left_xy, *right_xy)
    met = near.join(far, (F.col("_c0") == F.col("_r_c0")) & (F.col("_c1") == F.col("_r_c1")) & (F.col("_w") == F.col("_r_w"))
                    & F.expr(f"_lt >= _rt - {reach} AND _lt <= _rt + {reach}")
                    & (d2 <= F.lit(float(radius) * float(radius))))

    def restored(rows: DataFrame, ts: str, name: str, zone: bool) -> list[Column]:
        return [from_micros(micros(name), zone).alias(ts) if c == ts else F.col(c) for c in rows.columns]

    return met.select(*restored(left, left_ts, "_lt", zoned[0]), *restored(right, right_ts, "_rt", zoned[1]),
                      F.sqrt(d2).alias("distance"))
