"""Joins by time and by crossing: as-of, overlapping intervals, crossing segments, closest pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import micros_between
from ..operators import asof, closest, crossings, intervals, tracks, zones
from ..sources import tables as t
from .moving import LONLAT, STEP_SQL
from .neighbours import rounded
from .registry import query

HALF_DAY = 43_200.0


def _kind(spark, folder, kind):
    return t.located_events(t.table(spark, folder, "events").where(F.col("event_type") == kind))


@query("asof_view", f"""WITH {t.V_SQL}, k AS (SELECT v.*, event_type FROM v JOIN events USING (event_id)),
  met AS (SELECT p.event_id, p.user_id, p.ts, b.event_id AS view_id, b.ts AS view_ts, b.lon, b.lat,
    row_number() OVER (PARTITION BY p.event_id ORDER BY b.ts DESC, b.event_id DESC) AS nth
    FROM k p LEFT JOIN k b ON b.event_type = 'view' AND b.user_id = p.user_id AND b.ts <= p.ts
      AND epoch_us(p.ts) - epoch_us(b.ts) <= 43200000000 WHERE p.event_type = 'purchase')
SELECT event_id, user_id, ts, view_id, view_ts, round(lon, 6) AS view_lon, round(lat, 6) AS view_lat FROM met WHERE nth = 1""")
def asof_view(spark, folder):
    """Where the user of each purchase was last seen viewing, in the twelve hours before it."""
    buys = _kind(spark, folder, "purchase").select("event_id", "user_id", "ts")
    views = _kind(spark, folder, "view").toDF("view_id", "v_user", "view_ts", "view_lon", "view_lat")
    out = asof.asof(buys, views, [("user_id", "v_user")], "ts", "view_ts", "view_id",
                    ["view_id", "view_ts", "view_lon", "view_lat"], tolerance=HALF_DAY)
    return rounded(out, 6, "view_lon", "view_lat")


# An office of nation n opens at n % 12 o'clock for 2 + n % 7 hours, on 31 days.
FIRST_DAY, DAYS = "2024-01-01", 31


def opening_times(spark, folder):
    """(office, opens, closes): one row per nation and day."""
    key = F.col("n_nationkey").cast("long")
    days = t.table(spark, folder, "nation").select(key.alias("office"), F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))).alias("d"))
    opens = F.lit(FIRST_DAY).cast("timestamp_ntz") + F.make_dt_interval(F.col("d"), (F.col("office") % 12).cast("int"))
    return days.select("office", opens.alias("opens"), (opens + F.make_dt_interval(
        F.lit(0), (F.col("office") % 7 + 2).cast("int"))).alias("closes"))


@query("stays_in_hours", f"""WITH {t.V_SQL}, {STEP_SQL}, run AS (
  SELECT *, sum(CASE WHEN metres > 1000 OR seconds > 43200 OR metres IS NULL THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stay FROM step),
  s AS (SELECT user_id, CAST(stay AS BIGINT) AS stay, min(ts) AS started, max(ts) AS ended FROM run GROUP BY user_id, stay
    HAVING (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 >= 3600),
  o AS (SELECT CAST(n_nationkey AS BIGINT) AS office, TIMESTAMP '{FIRST_DAY}' + to_days(CAST(d AS INTEGER)) + to_hours(n_nationkey % 12) AS opens
    FROM nation, (SELECT unnest(range(0, {DAYS})) AS d)),
  h AS (SELECT office, opens, opens + to_hours(office % 7 + 2) AS closes FROM o)
SELECT user_id, stay, office, CAST(sum(epoch_us(least(ended, closes)) - epoch_us(greatest(started, opens))) AS BIGINT) AS micros
FROM s JOIN h ON started < closes AND opens < ended GROUP BY user_id, stay, office""")
def stays_in_hours(spark, folder):
    """How long each office was open while a user stayed in one place."""
    stays = tracks.stays(t.tracks(spark, folder), "user_id", "ts", "event_id", LONLAT, 1000.0, HALF_DAY, 3600.0)
    met = intervals.overlapping(stays.select("user_id", "stay", "started", "ended"), opening_times(spark, folder),
                                ("started", "ended"), ("opens", "closes"))
    shared = micros_between(F.greatest("started", "opens"), F.least("ended", "closes"))
    return met.groupBy("user_id", "stay", "office").agg(F.sum(shared).alias("micros"))


def turn_sql(a: str, b: str, p: str) -> str:
    """Twice the signed area of three points, each named by the columns of its x and y."""
    (ax, ay), (bx, by), (px, py) = (x.split() for x in (a, b, p))
    return f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


@query("border_crossings", f"""WITH {t.V_SQL}, {t.rings_sql()},
  s AS (SELECT event_id, lag(lon) OVER w AS ax, lag(lat) OVER w AS ay, lon AS cx, lat AS cy
    FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  j AS (SELECT s.*, z.*, {turn_sql("x1 y1", "x2 y2", "ax ay")} AS t1, {turn_sql("x1 y1", "x2 y2", "cx cy")} AS t2,
    {turn_sql("ax ay", "cx cy", "x1 y1")} AS t3, {turn_sql("ax ay", "cx cy", "x2 y2")} AS t4 FROM s, z WHERE ax IS NOT NULL),
  m AS (SELECT *, t1 = 0 AND t2 = 0 AND t3 = 0 AND t4 = 0 AS line,
    greatest(least([ax, ay], [cx, cy]), least([x1, y1], [x2, y2])) AS lo,
    least(greatest([ax, ay], [cx, cy]), greatest([x1, y1], [x2, y2])) AS hi FROM j)
SELECT event_id, zone_id, seq, round(CASE WHEN line THEN lo[1] ELSE ax + CASE WHEN t1 = t2 THEN 0 ELSE t1 / (t1 - t2) END * (cx - ax) END, 6) AS x,
  round(CASE WHEN line THEN lo[2] ELSE ay + CASE WHEN t1 = t2 THEN 0 ELSE t1 / (t1 - t2) END * (cy - ay) END, 6) AS y
FROM m WHERE CASE WHEN line THEN lo <= hi ELSE NOT (sign(t1) * sign(t2) > 0 OR sign(t3) * sign(t4) > 0) END""")
def border_crossings(spark, folder):
    """Where the straight way between successive fixes meets the border of a zone."""
    moved = tracks.with_previous(t.tracks(spark, folder), "user_id", "ts", "event_id", LONLAT)
    steps = moved.where(F.col("prev_lon").isNotNull()).select("event_id", F.col("prev_lon").alias("ax"),
                                                              F.col("prev_lat").alias("ay"), F.col("lon").alias("cx"), F.col("lat").alias("cy"))
    edges = zones.ring_edges(t.nation_rings(spark, folder)).select("zone_id", "seq", "x1", "y1", "x2", "y2")
    out = crossings.crossing(steps, edges, ("ax", "ay", "cx", "cy"), ("x1", "y1", "x2", "y2"), 4.0)
    return rounded(out.select("event_id", "zone_id", "seq", "x", "y"), 6, "x", "y")


@query("closest_pairs_of_labels", f"""WITH {t.E_SQL}, d AS (SELECT a.vec_id AS i, b.vec_id AS j,
  (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM e a, e b WHERE a.label = 0 AND b.label = 1)
SELECT i, j, round(sqrt(d2), 9) AS distance, CAST(row_number() OVER (ORDER BY d2, i, j) AS INTEGER) AS rank
FROM d QUALIFY rank <= 25""")
def closest_pairs_of_labels(spark, folder):
    """The 25 closest pairs of points with label 0 and with label 1."""
    points = t.embedding_points(spark, folder)
    zero = points.where("label = 0").select(F.col("vec_id").alias("i"), "x", "y")
    one = points.where("label = 1").select(F.col("vec_id").alias("j"), "x", "y")
    return rounded(closest.closest_pairs(zero, one, 25, "i", "j", ("x", "y"), ("x", "y")), 9, "distance")


@query("closest_orders", f"""WITH {t.O_SQL}, {t.S_SQL}, d AS (SELECT o_orderkey, s_suppkey,
  (o.lon - s.lon) * (o.lon - s.lon) + (o.lat - s.lat) * (o.lat - s.lat) AS d2 FROM o, s WHERE abs(o.lon - s.lon) < 3)
SELECT o_orderkey, s_suppkey, round(sqrt(d2), 6) AS degrees,
  CAST(row_number() OVER (ORDER BY d2, o_orderkey, s_suppkey) AS INTEGER) AS rank FROM d QUALIFY rank <= 300""")
def closest_orders(spark, folder):
    """The 300 closest pairs of an order and a supplier, on the map."""
    out = closest.closest_pairs(t.orders(spark, folder), t.suppliers(spark, folder), 300, "o_orderkey", "s_suppkey",
                                LONLAT, LONLAT)
    return rounded(out.withColumnRenamed("distance", "degrees"), 6, "degrees")
