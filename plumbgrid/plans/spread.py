"""Grids, densities and point patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids, patterns
from ..sources import tables as t
from .neighbours import rounded
from .registry import query

XY = ("x", "y")
LONLAT = ("lon", "lat")
RADII = (0.01, 0.02, 0.05, 0.1)


@query("square_counts", f"""WITH {t.O_SQL}
SELECT CAST(floor(lon / 15e0) AS BIGINT) AS col, CAST(floor(lat / 15e0) AS BIGINT) AS row,
  count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o GROUP BY 1, 2""")
def square_counts(spark, folder):
    return grids.square_counts(t.orders(spark, folder), LONLAT, 15.0,
                               F.round(F.sum("o_totalprice"), 2).alias("total"))


def hex_sql(x: str, y: str, size: str) -> str:
    fx = f"(({x} * (sqrt(3e0) / 3e0) - {y} / 3e0) / {size})"
    fz = f"(({y} * 2e0 / 3e0) / {size})"
    return f"""h1 AS (SELECT *, {fx} AS fx, {fz} AS fz, -{fx} - {fz} AS fy FROM o),
  h2 AS (SELECT *, floor(fx + 0.5e0) AS rx, floor(fy + 0.5e0) AS ry, floor(fz + 0.5e0) AS rz FROM h1),
  h3 AS (SELECT *, abs(rx - fx) AS ex, abs(ry - fy) AS ey, abs(rz - fz) AS ez FROM h2),
  h AS (SELECT *, CAST(CASE WHEN ex > ey AND ex > ez THEN -ry - rz ELSE rx END AS BIGINT) AS q,
    CAST(CASE WHEN ex > ey AND ex > ez THEN rz WHEN ey > ez THEN rz ELSE -rx - ry END AS BIGINT)
      AS r FROM h3)"""


@query("hex_counts", f"""WITH {t.O_SQL}, {hex_sql('lon', 'lat', '7e0')}
SELECT q, r, count(*) AS n, round((q + r / 2e0) * (7e0 * sqrt(3e0)), 6) AS cx,
  round(r * 10.5e0, 6) AS cy FROM h GROUP BY q, r""")
def hex_counts(spark, folder):
    return rounded(grids.hex_counts(t.orders(spark, folder), LONLAT, 7.0), 6, "cx", "cy")


@query("density", f"""WITH {t.E_SQL}, c AS (
  SELECT vec_id, x, y, col, unnest(range(CAST(floor((y - 0.05e0) / 0.02e0) AS BIGINT),
      CAST(floor((y + 0.05e0) / 0.02e0) AS BIGINT) + 1)) AS row FROM (
    SELECT *, unnest(range(CAST(floor((x - 0.05e0) / 0.02e0) AS BIGINT),
      CAST(floor((x + 0.05e0) / 0.02e0) AS BIGINT) + 1)) AS col FROM e)), d AS (
  SELECT col, row, pow(x - (col + 0.5e0) * 0.02e0, 2) + pow(y - (row + 0.5e0) * 0.02e0, 2) AS d2
  FROM c)
SELECT col, row, round(sum(pow(1 - d2 / 0.0025e0, 2)) * 3 / (pi() * 0.0025e0), 6) AS density
FROM d WHERE d2 < 0.0025e0 GROUP BY col, row""")
def density(spark, folder):
    return rounded(grids.density(t.embedding_points(spark, folder), XY, 0.02, 0.05), 6, "density")


GRID_SQL = """box AS (SELECT floor(min(x) / 0.1e0) AS c0, floor(max(x) / 0.1e0) AS c1,
    floor(min(y) / 0.1e0) AS r0, floor(max(y) / 0.1e0) AS r1 FROM e),
  cols AS (SELECT unnest(range(CAST(c0 AS BIGINT), CAST(c1 AS BIGINT) + 1)) AS col FROM box),
  rws AS (SELECT unnest(range(CAST(r0 AS BIGINT), CAST(r1 AS BIGINT) + 1)) AS row FROM box),
  grid AS (SELECT col, row, (col + 0.5e0) * 0.1e0 AS cx, (row + 0.5e0) * 0.1e0 AS cy FROM cols, rws)"""


@query("inverse_distance", f"""WITH {t.EV_SQL}, {GRID_SQL}, d AS (
  SELECT col, row, v, vec_id, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM grid, e),
  r AS (SELECT *, row_number() OVER (PARTITION BY col, row ORDER BY d2, vec_id) AS k FROM d)
SELECT col, row, round(coalesce(avg(v) FILTER (d2 = 0),
  sum(v / d2) FILTER (d2 > 0) / sum(1 / d2) FILTER (d2 > 0)), 9) AS estimate
FROM r WHERE k <= 6 GROUP BY col, row""")
def inverse_distance(spark, folder):
    points = t.valued_points(spark, folder)
    return rounded(grids.inverse_distance(points, "vec_id", XY, "v", 0.1, 6), 9, "estimate")


@query("centres", f"""WITH {t.EV_SQL}, s AS (
  SELECT label, count(*) AS n, avg(x) AS x_mean, avg(y) AS y_mean,
    sum((v + 1) * x) / sum(v + 1) AS xw, sum((v + 1) * y) / sum(v + 1) AS yw,
    var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM e GROUP BY label)
SELECT label, n, round(x_mean, 9) AS x_mean, round(y_mean, 9) AS y_mean,
  round(xw, 9) AS x_weighted, round(yw, 9) AS y_weighted,
  round(sqrt(vx + vy), 9) AS standard_distance,
  round(sqrt((vx + vy) / 2 + sqrt(pow((vx - vy) / 2, 2) + c * c)), 9) AS major,
  round(sqrt((vx + vy) / 2 - sqrt(pow((vx - vy) / 2, 2) + c * c)), 9) AS minor,
  round(degrees(atan2(c, (vx - vy) / 2) / 2), 6) AS angle FROM s""")
def centres(spark, folder):
    points = t.valued_points(spark, folder).withColumn("w", F.col("v") + 1)
    out = patterns.centres(points, XY, "w", "label")
    return rounded(rounded(out, 9, "x_mean", "y_mean", "x_weighted", "y_weighted",
                           "standard_distance", "major", "minor"), 6, "angle")


@query("quadrat_test", f"""WITH {t.O_SQL}, b AS (
  SELECT CAST((floor(max(lon) / 10e0) - floor(min(lon) / 10e0) + 1)
    * (floor(max(lat) / 10e0) - floor(min(lat) / 10e0) + 1) AS BIGINT) AS cells FROM o), g AS (
  SELECT count(*) AS n FROM o GROUP BY floor(lon / 10e0), floor(lat / 10e0)), s AS (
  SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * n) AS n2 FROM g)
SELECT cells, n, round((n2 * cells / CAST(n AS DOUBLE) - n) / (cells - 1), 8) AS ratio,
  round(n2 * cells / CAST(n AS DOUBLE) - n, 6) AS chi2 FROM b, s""")
def quadrat_test(spark, folder):
    out = patterns.quadrat_test(t.orders(spark, folder), LONLAT, 10.0)
    return rounded(rounded(out, 8, "ratio"), 6, "chi2")


@query("nearest_index", f"""WITH {t.E_SQL}, d AS (
  SELECT min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d
  FROM e a, e b WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id),
  s AS (SELECT count(*) AS n, avg(d) AS o FROM d),
  b AS (SELECT (max(x) - min(x)) * (max(y) - min(y)) AS a FROM e)
SELECT n, round(o, 9) AS observed, round(0.5e0 / sqrt(n / a), 9) AS expected,
  round(o / (0.5e0 / sqrt(n / a)), 8) AS ratio,
  round((o - 0.5e0 / sqrt(n / a)) / (sqrt((4 - pi()) / (4 * pi())) / sqrt(n * n / a)), 7) AS z
FROM s, b""")
def nearest_index(spark, folder):
    out = patterns.nearest_index(t.embedding_points(spark, folder), "vec_id", XY)
    return rounded(rounded(rounded(out, 9, "observed", "expected"), 8, "ratio"), 7, "z")


@query("ripley", f"""WITH {t.E_SQL}, p AS (
  SELECT (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
  FROM e a, e b WHERE a.vec_id <> b.vec_id),
  s AS (SELECT count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM e),
  r(radius) AS (VALUES (0.01e0), (0.02e0), (0.05e0), (0.1e0)),
  k AS (SELECT radius, (SELECT count(*) FROM p WHERE d2 <= radius * radius) AS pairs FROM r)
SELECT radius, pairs, round(area * pairs / (n * (n - 1)), 9) AS k,
  round(sqrt(area * pairs / (n * (n - 1)) / pi()), 9) AS l FROM k, s""")
def ripley(spark, folder):
    return rounded(patterns.ripley(t.embedding_points(spark, folder), XY, RADII), 9, "k", "l")
