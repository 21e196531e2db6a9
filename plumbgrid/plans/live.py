"""Streaming queries, run to the end of the events file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import zones
from ..sources import tables as t
from ..streaming import dwell, live, meetings
from .geometry import CELL
from .moving import LOCATED_SQL, LONLAT, located
from .registry import query


# Files a micro-batch takes, so that state holds what the watermark's delay asks for and not a backlog.
FILES_PER_TRIGGER = 16


def event_stream(spark, folder, kind=None):
    """The events as a stream, or those of one kind, whether the table is one file or a folder of files.

    A pattern stands for either; the stream then lists what it matches."""
    schema = t.table(spark, folder, "events").schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER)
    events = files.parquet(f"{folder}/events.parque[t]")
    return t.located_events(events if kind is None else events.where(F.col("event_type") == kind))


# Windows and fixes the final watermark has passed: it trails the newest fix by two hours,
# in whole milliseconds.
CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM v)"


@query("windowed_cells", f"""WITH {t.V_SQL}
SELECT date_trunc('day', ts) + to_hours(6 * CAST(hour(ts) // 6 AS BIGINT)) AS started,
  CAST(floor(lon / 30e0) AS BIGINT) AS col, CAST(floor(lat / 30e0) AS BIGINT) AS row,
  count(*) AS n FROM v GROUP BY 1, 2, 3 HAVING started + INTERVAL 6 HOUR <= {CLOSED}""")
def windowed_cells(spark, folder):
    """Fixes per six hours and thirty degree cell."""
    counts = live.windowed_cells(event_stream(spark, folder), "ts", LONLAT, 30.0, "6 hours", "2 hours")
    return live.run_available(counts, "windowed-cells")


@query("geofence_stream", f"""WITH {LOCATED_SQL}
SELECT user_id, ts, event_id, was AS left_zone, zone_id AS entered_zone FROM moved
WHERE was IS DISTINCT FROM zone_id AND ts < {CLOSED}""")
def geofence_stream(spark, folder):
    """Where users enter and leave zones, from a stream."""
    edges = zones.ring_edges(t.nation_rings(spark, folder))
    fixes = live.with_zone(event_stream(spark, folder), edges, CELL, LONLAT)
    changes = live.zone_changes_live(fixes, "user_id", "ts", "event_id", "zone_id", "2 hours")
    return live.run_available(changes, "geofence")


# An object seen in a zone counts as there for six hours after; eight hours raise an alarm.
STAY, SILENCE = 28_800.0, 21_600.0
DWELL_SQL = f"""{LOCATED_SQL},
  cut AS (SELECT *, lag(ts) OVER w AS ts0 FROM moved WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  run AS (SELECT *, sum(CASE WHEN ts0 IS NULL OR ts - ts0 > INTERVAL 6 HOUR OR zone_id IS DISTINCT FROM was THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM cut),
  stay AS (SELECT user_id, run, max(zone_id) AS zone_id, min(ts) AS since, max(ts) AS seen FROM run GROUP BY user_id, run),
  ends AS (SELECT *, least(seen + INTERVAL 6 HOUR, coalesce(lead(since) OVER (PARTITION BY user_id ORDER BY run),
    seen + INTERVAL 6 HOUR)) AS ended FROM stay)
SELECT user_id, zone_id, since, since + INTERVAL 8 HOUR AS alarm FROM ends
WHERE zone_id IS NOT NULL AND ended >= since + INTERVAL 8 HOUR"""


@query("dwell_alarms", f"WITH {DWELL_SQL}")
def dwell_alarms(spark, folder):
    """Users that stay in one zone for eight hours."""
    return dwell.dwell_alarms(located(spark, folder), "user_id", "ts", "event_id", "zone_id", STAY, SILENCE)


@query("dwell_alarms_stream", f"WITH {DWELL_SQL} AND since + INTERVAL 8 HOUR < {CLOSED}")
def dwell_alarms_stream(spark, folder):
    """The same from a stream, by timers."""
    edges = zones.ring_edges(t.nation_rings(spark, folder))
    fixes = live.with_zone(event_stream(spark, folder), edges, CELL, LONLAT)
    alarms = dwell.dwell_alarms_live(fixes, "user_id", "ts", "event_id", "zone_id", STAY, SILENCE, "2 hours")
    return live.run_available(alarms, "dwell", timers=True)


@query("stream_meetings", f"""WITH {t.V_SQL}, k AS (SELECT v.*, event_type FROM v JOIN events USING (event_id))
SELECT a.event_id AS buy_id, b.event_id AS view_id, a.ts AS buy_ts, b.ts AS view_ts,
  round(sqrt((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)), 6) AS distance
FROM k a JOIN k b ON a.event_type = 'purchase' AND b.event_type = 'view'
  AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000
  AND (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) <= 100""")
def stream_meetings(spark, folder):
    """Purchases and views within ten degrees and an hour of each other, from two streams."""
    buys = event_stream(spark, folder, "purchase").select(F.col("event_id").alias("buy_id"), F.col("ts").alias("buy_ts"), "lon", "lat")
    views = event_stream(spark, folder, "view").select(
        F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"), F.col("lon").alias("v_lon"), F.col("lat").alias("v_lat"))
    met = meetings.meetings(buys, views, "buy_ts", "view_ts", LONLAT, ("v_lon", "v_lat"), 10.0, 3600.0, "2 hours")
    out = met.select("buy_id", "view_id", "buy_ts", "view_ts", F.round("distance", 6).alias("distance"))
    return live.run_available(out, "meetings")
