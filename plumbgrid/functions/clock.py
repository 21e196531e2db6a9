"""Time differences that do not depend on the session's time zone.

Timestamps without a zone are differenced as they stand; a cast to an instant would move
those that fall in a gap of the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EPOCH = "1970-01-01 00:00:00"


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from one timestamp to another of the same type."""
    gap = end - start
    day, hour, minute, second = (F.date_part(F.lit(u), gap) for u in ("DAY", "HOUR", "MINUTE", "SECOND"))
    minutes = (day.cast("long") * 24 + hour) * 60 + minute
    return minutes * 60_000_000 + (second * 1_000_000).cast("long")


def seconds_between(start: Column, end: Column) -> Column:
    return micros_between(start, end) / F.lit(1e6)


def has_zone(df: DataFrame, ts: str) -> bool:
    return dict(df.dtypes)[ts] == "timestamp"


def to_micros(ts: Column, zoned: bool) -> Column:
    """Microseconds since the epoch; timestamps without a zone are read as UTC."""
    if zoned:
        return F.unix_micros(ts)
    return micros_between(F.lit(EPOCH).cast("timestamp_ntz"), ts)


def from_micros(micros: Column, zoned: bool) -> Column:
    if zoned:
        return F.timestamp_micros(micros)
    seconds = micros.cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
