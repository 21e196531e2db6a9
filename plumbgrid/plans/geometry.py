"""Points, boxes, zones and containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planar, polygon, sphere
from ..operators import dissolve, zones
from ..session import scratch_path
from ..sources import curves, tables as t
from .registry import query

# Grid width in degrees for the zone joins, and the box of the box filters.
CELL = 9.0
BOX = (-60.0, -30.0, 45.5, 40.25)
CROSS = """(least(z.y1, z.y2) <= p.lat AND p.lat < greatest(z.y1, z.y2) AND
   p.lon < (CASE WHEN z.y1 <= z.y2 THEN z.x2 - z.x1 ELSE z.x1 - z.x2 END)
     * (p.lat - least(z.y1, z.y2)) / (greatest(z.y1, z.y2) - least(z.y1, z.y2))
     + CASE WHEN z.y1 <= z.y2 THEN z.x1 ELSE z.x2 END)"""


def inside_sql(points: str, key: str) -> str:
    """CTE ``hit(key, zone_id)`` by brute force."""
    return f"""hit AS (SELECT p.{key} AS {key}, z.zone_id FROM {points} p, z
                WHERE z.y1 <> z.y2 AND {CROSS}
                GROUP BY p.{key}, z.zone_id HAVING count(*) % 2 = 1)"""


@query("point_validation", f"""WITH {t.E_SQL}
SELECT label, count(*) AS n, count(*) FILTER (isfinite(x) AND isfinite(y)) AS n_valid,
  count(*) FILTER (x * 1000 >= -180 AND x * 1000 < 180 AND y * 1000 BETWEEN -90 AND 90) AS n_lonlat
FROM e GROUP BY label""")
def point_validation(spark, folder):
    points = t.embedding_points(spark, folder)
    lon, lat = F.col("x") * 1000, F.col("y") * 1000
    return points.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(planar.valid_xy("x", "y")).alias("n_valid"),
        F.count_if(sphere.valid_lonlat(lon, lat)).alias("n_lonlat"))


@query("planar_distance", f"""WITH {t.E_SQL}
SELECT vec_id, round(sqrt((x - 0.1e0) * (x - 0.1e0) + (y + 0.05e0) * (y + 0.05e0)), 9) AS d FROM e""")
def planar_distance(spark, folder):
    return t.embedding_points(spark, folder).select("vec_id", F.round(planar.distance(
        "x", "y", F.lit(0.1), F.lit(-0.05)), 9).alias("d"))


HAVERSINE = """2 * 6371008.8e0 * asin(sqrt(least(1e0,
   pow(sin((radians(s.lat) - radians(c.lat)) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat))
   * pow(sin((radians(s.lon) - radians(c.lon)) / 2), 2))))"""


@query("haversine_haul", f"""WITH {t.C_SQL}, {t.S_SQL}
SELECT o_orderkey, l_linenumber, l_suppkey, round({HAVERSINE} / 1000, 2) AS km
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN c ON o_custkey = c_custkey
JOIN s ON l_suppkey = s_suppkey""")
def haversine_haul(spark, folder):
    """How far each order line travels, from its supplier to its customer."""
    lines = t.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = t.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    buyers = t.customers(spark, folder).select("c_custkey", "lon", "lat")
    sellers = t.suppliers(spark, folder).select(
        "s_suppkey", F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"))
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
            .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("o_orderkey", "l_linenumber", "l_suppkey", F.round(
                sphere.haversine("lon", "lat", "s_lon", "s_lat") / 1000, 2).alias("km")))


@query("bearing_destination", f"""WITH {t.C_SQL}, leg AS (
  SELECT c_custkey, radians(lon) AS l1, radians(lat) AS p1, radians(35e0) AS a,
    (500000 + c_custkey % 1000) / 6371008.8e0 AS arc FROM c), there AS (
  SELECT *, asin(sin(p1) * cos(arc) + cos(p1) * sin(arc) * cos(a)) AS p2 FROM leg), wrapped AS (
  SELECT *, degrees(l1 + atan2(sin(a) * sin(arc) * cos(p1),
     cos(arc) - sin(p1) * (sin(p1) * cos(arc) + cos(p1) * sin(arc) * cos(a)))) AS raw FROM there),
  back AS (SELECT *, CASE WHEN raw >= 180 THEN raw - 360 WHEN raw < -180 THEN raw + 360
     ELSE raw END AS lon2 FROM wrapped), home AS (
  SELECT *, degrees(atan2(sin(l1 - radians(lon2)) * cos(p1),
     cos(p2) * sin(p1) - sin(p2) * cos(p1) * cos(l1 - radians(lon2)))) AS b FROM back)
SELECT c_custkey, round(lon2, 6) AS lon2, round(degrees(p2), 6) AS lat2,
  round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 5) AS way_back FROM home""")
def bearing_destination(spark, folder):
    points = t.customers(spark, folder)
    lon2, lat2 = sphere.destination("lon", "lat", 35.0, 500000 + F.col("c_custkey") % 1000)
    moved = points.select("c_custkey", "lon", "lat", lon2.alias("lon2"), lat2.alias("lat2"))
    return moved.select("c_custkey", F.round("lon2", 6).alias("lon2"),
                        F.round("lat2", 6).alias("lat2"),
                        F.round(sphere.bearing("lon2", "lat2", "lon", "lat"), 5).alias("way_back"))


@query("box_filter", f"""WITH {t.O_SQL}
SELECT o_orderkey, lon, lat FROM o
WHERE lon >= {BOX[0]} AND lon < {BOX[2]} AND lat >= {BOX[1]} AND lat < {BOX[3]}""")
def box_filter(spark, folder):
    points = t.orders(spark, folder)
    return points.where(planar.in_box("lon", "lat", BOX)).select("o_orderkey", "lon", "lat")


@query("zone_edges", f"WITH {t.rings_sql()} SELECT zone_id, seq, x1, y1, x2, y2 FROM z")
def zone_edges(spark, folder):
    return zones.ring_edges(t.nation_rings(spark, folder))


@query("zone_measures", f"""WITH {t.rings_sql()}, m AS (
  SELECT zone_id, sum(x1 * y2 - x2 * y1) / 2 AS a,
    sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS perimeter,
    sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my
  FROM z GROUP BY zone_id)
SELECT zone_id, round(abs(a), 6) AS area, round(perimeter, 6) AS perimeter,
  round(mx / (6 * a), 6) AS cx, round(my / (6 * a), 6) AS cy FROM m""")
def zone_measures(spark, folder):
    out = zones.zone_measures(zones.ring_edges(t.nation_rings(spark, folder)))
    return out.select("zone_id", *[F.round(c, 6).alias(c)
                                   for c in ("area", "perimeter", "cx", "cy")])


@query("group_extents", f"""WITH {t.O_SQL}
SELECT o_orderpriority, min(lon) AS x_min, min(lat) AS y_min, max(lon) AS x_max,
  max(lat) AS y_max, count(*) AS n FROM o GROUP BY 1""")
def group_extents(spark, folder):
    return zones.extents(t.orders(spark, folder), "lon", "lat", "o_orderpriority")


@query("point_in_polygon", f"""WITH {t.O_SQL}, {t.rings_sql()}, {inside_sql('o', 'o_orderkey')}
SELECT o_orderkey, zone_id FROM hit""")
def point_in_polygon(spark, folder):
    edges = zones.ring_edges(t.nation_rings(spark, folder))
    points = t.orders(spark, folder).select("o_orderkey", "lon", "lat")
    return zones.locate(points, edges, CELL, ("lon", "lat")).select("o_orderkey", "zone_id")


@query("polygon_values", f"""WITH {t.C_SQL}, {t.rings_sql()}, {inside_sql('c', 'c_custkey')}
SELECT c_custkey, hit.zone_id FROM hit JOIN c USING (c_custkey)
WHERE hit.zone_id = c.c_nationkey""")
def polygon_values(spark, folder):
    """Customers inside the zone of their own nation, with the zone held as a value."""
    shapes = (zones.ring_edges(t.nation_rings(spark, folder)).groupBy("zone_id")
              .agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges")))
    own = t.customers(spark, folder).join(shapes, F.col("zone_id") == F.col("c_nationkey"))
    return own.where(polygon.inside("lon", "lat", "edges")).select("c_custkey", "zone_id")


@query("within_zones", f"""WITH {t.C_SQL}, {t.rings_sql()}, {inside_sql('c', 'c_custkey')}
SELECT c_custkey, c_mktsegment FROM c WHERE c_custkey IN (SELECT c_custkey FROM hit)""")
def within_zones(spark, folder):
    edges = zones.ring_edges(t.nation_rings(spark, folder))
    points = t.customers(spark, folder).select("c_custkey", "c_mktsegment", "lon", "lat")
    found = zones.locate(points, edges, CELL, ("lon", "lat"), how="left_semi", key="c_custkey")
    return found.select("c_custkey", "c_mktsegment")


@query("outside_zones", f"""WITH {t.C_SQL}, {t.rings_sql()}, {inside_sql('c', 'c_custkey')}
SELECT c_custkey, c_mktsegment FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM hit)""")
def outside_zones(spark, folder):
    edges = zones.ring_edges(t.nation_rings(spark, folder))
    points = t.customers(spark, folder).select("c_custkey", "c_mktsegment", "lon", "lat")
    found = zones.locate(points, edges, CELL, ("lon", "lat"), how="left_anti", key="c_custkey")
    return found.select("c_custkey", "c_mktsegment")


@query("zonal_balance", f"""WITH {t.C_SQL}, {t.rings_sql()}, {inside_sql('c', 'c_custkey')}
SELECT zones.zone_id, count(c_custkey) AS n, round(sum(c_acctbal), 4) AS total,
  round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high
FROM (SELECT DISTINCT zone_id FROM z) zones LEFT JOIN (hit JOIN c USING (c_custkey))
ON zones.zone_id = hit.zone_id GROUP BY zones.zone_id""")
def zonal_balance(spark, folder):
    """Customers and their balance per zone."""
    edges = zones.ring_edges(t.nation_rings(spark, folder))
    points = t.customers(spark, folder).select("c_acctbal", "lon", "lat")
    out = zones.zonal_stats(points, edges, CELL, ("lon", "lat"), "c_acctbal")
    return out.select("zone_id", "n", F.round("total", 4).alias("total"),
                      F.round("mean", 6).alias("mean"), "low", "high")


# Twenty bits an axis: cells of about forty metres at the equator.
WORLD = curves.Curve((-180.0, -90.0, 180.0, 90.0))
HARBOUR = (-12.5, 30.0, 41.0, 47.25)


@query("curve_box", f"""WITH {t.O_SQL}
SELECT o_orderkey, o_totalprice, lon, lat FROM o WHERE lon >= -12.5 AND lon < 41 AND lat >= 30 AND lat < 47.25""")
def curve_box(spark, folder):
    """Orders in a box, read from a table along the curve."""
    path = scratch_path(spark, "curve")
    orders = t.orders(spark, folder).select("o_orderkey", "o_totalprice", "lon", "lat")
    curves.write_curve(orders, path, ("lon", "lat"), WORLD)
    return curves.read_curve(spark, path, ("lon", "lat"), WORLD, HARBOUR)


@query("region_borders", f"""WITH {t.rings_sql()}, e AS (SELECT n_regionkey AS region, [x1, y1] AS a, [x2, y2] AS b
    FROM z JOIN nation ON n_nationkey = zone_id),
  p AS (SELECT DISTINCT region, unnest([a, b]) AS p FROM e),
  c AS (SELECT e.region, a, b, p, lead(p) OVER (PARTITION BY e.region, a, b ORDER BY CASE WHEN a < b THEN p ELSE [-p[1], -p[2]] END) AS q
    FROM e JOIN p ON p.region = e.region AND (b[1] - a[1]) * (p[2] - a[2]) - (b[2] - a[2]) * (p[1] - a[1]) = 0
      AND p >= least(a, b) AND p <= greatest(a, b)),
  s AS (SELECT region, least(p, q) AS lo, greatest(p, q) AS hi, CASE WHEN p < q THEN 1 ELSE -1 END AS way FROM c WHERE q IS NOT NULL),
  k AS (SELECT region, lo, hi, sum(way) > 0 AS ahead FROM s GROUP BY region, lo, hi HAVING count(*) % 2 = 1)
SELECT region, CASE WHEN ahead THEN lo[1] ELSE hi[1] END AS x1, CASE WHEN ahead THEN lo[2] ELSE hi[2] END AS y1,
  CASE WHEN ahead THEN hi[1] ELSE lo[1] END AS x2, CASE WHEN ahead THEN hi[2] ELSE lo[2] END AS y2 FROM k""")
def region_borders(spark, folder):
    """The borders of regions, from the zones of their nations."""
    edges = zones.ring_edges(t.nation_rings(spark, folder))
    regions = t.table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("zone_id"), F.col("n_regionkey").alias("region"))
    return dissolve.dissolve(dissolve.grouped(edges, regions, "zone_id", "region"), "region", CELL)
