"""Moving objects: steps between successive fixes, and stays.

A window over a whole object would put one object's fixes in one task, and one object may
own a large share of the table. Here windows run over (object, time bucket); what crosses
a bucket boundary is carried by a small table with one row per object and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions.clock import seconds_between
from ..functions.sphere import haversine


def _bucketed(rows: DataFrame, ts: str, bucket: str) -> DataFrame:
    return rows.withColumn("_bucket", F.date_trunc(bucket, ts))


def with_previous(rows: DataFrame, key: str, ts: str, tie: str, columns: Sequence[str],
                  bucket: str = "day") -> DataFrame:
    """Rows with ``prev_*`` of the preceding row of the same key in (ts, tie) order.

    Leaves the rows partitioned by (key, _bucket).
    """
    kept = F.struct(*[F.col(c).alias(c) for c in columns])
    within = W.partitionBy(key, "_bucket").orderBy(ts, tie)
    placed = _bucketed(rows, ts, bucket).select(
        "*", F.lag(kept).over(within).alias("_before"),
        F.lead(F.lit(1)).over(within).isNull().alias("_is_last"))
    # The last row of every bucket, handed to the key's next bucket that has rows.
    handed = placed.where("_is_last").select(
        F.col(key).alias("_k"), F.col("_bucket").alias("_b"),
        F.lag(kept).over(W.partitionBy(key).orderBy("_bucket")).alias("_carried"))
    met = placed.join(handed, (F.col(key).eqNullSafe(F.col("_k")))
                      & (F.col("_bucket") == F.col("_b")), "left")
    before = F.coalesce("_before", "_carried")
    return met.select(*rows.columns, "_bucket",
                      *[before[c].alias("prev_" + c) for c in columns])


def running_total(rows: DataFrame, key: str, ts: str, tie: str, value: Column,
                  name: str) -> DataFrame:
    """Running sum per key over rows that carry ``_bucket``, bucket by bucket."""
    within = (W.partitionBy(key, "_bucket").orderBy(ts, tie)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    valued = rows.withColumn("_v", value)
    totals = valued.groupBy(F.col(key).alias("_k"), F.col("_bucket").alias("_b")).agg(
        F.sum("_v").alias("_t"))
    earlier = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_k", "_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"))
    met = (valued.withColumn("_run", F.sum("_v").over(within))
           .join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b"))))
    return met.select(*rows.columns, (F.col("_run") + F.col("_off")).alias(name))


def steps(fixes: DataFrame, key: str, ts: str, tie: str, lonlat: tuple[str, str],
          bucket: str = "day") -> DataFrame:
    """Fixes with ``metres``, ``seconds`` and ``speed`` since the preceding one; null for the
    first, and no speed when no time has passed."""
    out = with_previous(fixes, key, ts, tie, [ts, *lonlat], bucket)
    lon, lat = lonlat
    gap = seconds_between(F.col("prev_" + ts), F.col(ts))
    moved = haversine("prev_" + lon, "prev_" + lat, lon, lat)
    out = out.select(*fixes.columns, "_bucket", moved.alias("metres"), gap.alias("seconds"))
    return out.withColumn("speed", F.col("metres") / F.nullif("seconds", F.lit(0.0)))


def stays(fixes: DataFrame, key: str, ts: str, tie: str, lonlat: tuple[str, str],
          metres: float, max_gap: float, min_seconds: float, bucket: str = "day") -> DataFrame:
    """(key, stay, n, started, ended, lon, lat): runs of successive fixes, each within
    ``metres`` and ``max_gap`` seconds of the one before, lasting ``min_seconds`` or more.

    ``stay`` numbers the runs of a key from 1, the short ones included.
    """
    lon, lat = lonlat
    moved = steps(fixes.select(key, ts, tie, lon, lat), key, ts, tie, lonlat, bucket)
    breaks = F.coalesce((F.col("metres") > metres) | (F.col("seconds") > max_gap), F.lit(True))
    runs = running_total(moved, key, ts, tie, breaks.cast("long"), "stay")
    out = runs.groupBy(key, "stay").agg(
        F.count("*").alias("n"), F.min(ts).alias("started"), F.max(ts).alias("ended"),
        F.avg(lon).alias("lon"), F.avg(lat).alias("lat"))
    lasted = seconds_between(F.col("started"), F.col("ended"))
    return out.where(lasted >= min_seconds)


def zone_changes(fixes: DataFrame, key: str, ts: str, tie: str, zone: str,
                 bucket: str = "day") -> DataFrame:
    """(key, ts, tie, left_zone, entered_zone) wherever the zone differs from that of the
    preceding fix. ``zone`` is null outside every zone; an object starts outside."""
    out = with_previous(fixes.select(key, ts, tie, zone), key, ts, tie, [zone], bucket)
    before, now = F.col("prev_" + zone), F.col(zone)
    return out.where(~before.eqNullSafe(now)).select(
        key, ts, tie, before.alias("left_zone"), now.alias("entered_zone"))
