"""Alarms of a stream: an object has stayed in one zone for some time.

State is one small row per object that is inside a zone, and the fixes newer than the
watermark. Both end by themselves: timers in event time raise an alarm when its moment has
come without a further fix, and clear an object that is outside or has fallen silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.clock import from_micros, has_zone, to_micros
from ..operators.tracks import running_total, with_previous

ALARMS = "k long, zone long, since long"


class Dwell(StatefulProcessor):
    """The state of one object: where it is since when, and fixes that wait for the watermark."""

    def __init__(self, stay: int, silence: int) -> None:
        self.stay, self.silence = stay, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "zone long, since long, seen long, alarmed boolean")
        self.waiting = handle.getListState("waiting", "us long, tie long, inside boolean, zone long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        self.waiting.appendList(list(new[["us", "tie", "inside", "zone"]].itertuples(index=False, name=None)))
        yield self.advanced(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.advanced(key[0], timerValues.getCurrentWatermarkInMs())

    def advanced(self, key: int, watermark: int) -> pd.DataFrame:
        """Take the fixes that the watermark has passed in order of time, then set the next timer."""
        reached, alarms = watermark * 1000, []
        held = sorted(self.waiting.get())
        ready, rest = [x for x in held if x[0] < reached], [x for x in held if x[0] >= reached]
        at = tuple(self.now.get()) if self.now.exists() else None

        def ended(until: int) -> None:
            """Raise the alarm of a stay that lasts until then, if it is due and not raised."""
            nonlocal at
            if at and not at[3] and until >= at[1] + self.stay:
                alarms.append((key, at[0], at[1]))
                at = (*at[:3], True)

        for us, _, inside, zone in ready:
            if at and us - at[2] > self.silence:
                ended(at[2] + self.silence)
                at = None
            elif at and not (inside and zone == at[0]):
                ended(us)
                at = None
            if inside:
                at = (zone, at[1], us, at[3]) if at else (zone, us, us, False)
        if at:
            ended(min(reached - 1, at[2] + self.silence))
            if at[2] + self.silence < reached:
                at = None
        self.now.update(at) if at else self.now.clear()
        self.waiting.put(rest) if rest else self.waiting.clear()
        moments = [x[0] for x in rest[:1]] + ([at[2] + self.silence] if at else []) + (
            [at[1] + self.stay] if at and not at[3] else [])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if moments:
            self.handle.registerTimer(max(min(moments) // 1000 + 1, watermark + 1))
        return pd.DataFrame(alarms, columns=["k", "zone", "since"])

    def close(self) -> None:
        pass


def dwell_alarms_live(fixes: DataFrame, key: str, ts: str, tie: str, zone: str, seconds: float, silence: float,
                      delay: str) -> DataFrame:
    """(key, zone, since, alarm) of a stream, as ``dwell_alarms`` gives for a table.

    An alarm comes once the watermark has passed its moment. Fixes may arrive out of order up to
    ``delay``; later ones are dropped. ``key``, ``tie`` and ``zone`` are integers, ``zone`` is
    null outside every zone. Runs on the RocksDB state store (``run_available(..., timers=True)``).
    """
    zoned = has_zone(fixes, ts)
    micros = to_micros(F.col(ts), zoned)
    sent = fixes.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("k"), F.timestamp_micros(micros).alias("ts"), micros.alias("us"),
        F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("tie"), F.col(zone).isNotNull().alias("inside"),
        F.coalesce(F.col(zone).cast("long"), F.lit(0)).alias("zone"))
    stay = round(seconds * 1_000_000)
    out = sent.withWatermark("ts", delay).groupBy("k").transformWithStateInPandas(
        Dwell(stay, round(silence * 1_000_000)), ALARMS, "Append", "EventTime")
    return out.select(F.col("k").alias(key), F.col("zone").alias(zone), from_micros(F.col("since"), zoned).alias("since"),
                      from_micros(F.col("since") + stay, zoned).alias("alarm"))


def dwell_alarms(fixes: DataFrame, key: str, ts: str, tie: str, zone: str, seconds: float, silence: float,
                 bucket: str = "day") -> DataFrame:
    """(key, zone, since, alarm): stays in one zone that last ``seconds``, and when they had.

    A stay starts with a fix in a zone and ends with the next fix elsewhere, or ``silence``
    seconds after its last fix where none comes sooner. The end itself counts as inside.
    """
    rows = fixes.where(F.col(key).isNotNull()).select(key, ts, tie, zone)
    zoned = has_zone(fixes, ts)
    us = to_micros(F.col(ts), zoned)
    moved = with_previous(rows, key, ts, tie, [ts, zone], bucket)
    quiet, stay = round(silence * 1_000_000), round(seconds * 1_000_000)
    gap = us - to_micros(F.col("prev_" + ts), zoned)
    breaks = F.coalesce(gap > quiet, F.lit(True)) | ~F.col(zone).eqNullSafe(F.col("prev_" + zone))
    runs = running_total(moved, key, ts, tie, breaks.cast("long"), "_run").groupBy(key, "_run").agg(
        F.min(us).alias("_since"), F.max(us).alias("_seen"), F.max(zone).alias(zone))
    # One row per stay; the next stay's start is where this one ends, unless silence came first.
    following = F.lead("_since").over(W.partitionBy(key).orderBy("_run"))
    ended = F.least(F.col("_seen") + quiet, F.coalesce(following, F.col("_seen") + quiet))
    return runs.select(key, zone, "_since", ended.alias("_ended")).where(
        F.col(zone).isNotNull() & (F.col("_ended") >= F.col("_since") + stay)).select(
        key, zone, from_micros(F.col("_since"), zoned).alias("since"), from_micros(F.col("_since") + stay, zoned).alias("alarm"))
