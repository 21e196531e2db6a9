"""Clusters, hulls and permutation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, colocation, hulls, permutations
from ..sources import tables as t
from .neighbours import PAIRS, RADIUS, XY, rounded
from .registry import query

EPS = 0.035


@query("dbscan", f"""WITH RECURSIVE {t.E_SQL},
  near AS (SELECT a.vec_id AS i, b.vec_id AS j FROM e a, e b
    WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.035e0 * 0.035e0),
  core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 6),
  link AS (SELECT i, j FROM near WHERE i IN (FROM core) AND j IN (FROM core)),
  reach(i, j) AS (SELECT i, i FROM core UNION SELECT r.i, l.j FROM reach r JOIN link l ON r.j = l.i),
  label AS (SELECT i, min(j) AS cluster FROM reach GROUP BY i),
  border AS (SELECT near.i, min(cluster) AS cluster FROM near JOIN label ON near.j = label.i
    WHERE near.i NOT IN (FROM core) GROUP BY near.i)
SELECT vec_id, coalesce(label.cluster, border.cluster) AS cluster, label.i IS NOT NULL AS core
FROM e LEFT JOIN label ON label.i = vec_id LEFT JOIN border ON border.i = vec_id""")
def dbscan(spark, folder):
    return clusters.dbscan(t.embedding_points(spark, folder), "vec_id", XY, EPS, 6)


@query("convex_hulls", f"""WITH {t.E_SQL}, side AS (
  SELECT a.label, a.vec_id AS i, b.vec_id AS j FROM e a, e b
  WHERE a.label = b.label AND a.vec_id <> b.vec_id AND NOT EXISTS (
    SELECT 1 FROM e c WHERE c.label = a.label
      AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0))
SELECT label, x, y FROM e WHERE vec_id IN (SELECT i FROM side)""")
def convex_hulls(spark, folder):
    return hulls.convex_hulls(t.embedding_points(spark, folder), "label", XY).select("label", "x", "y")


DRAWN_SQL = f"""{t.EV_SQL}, {PAIRS}, rep(rep) AS (SELECT unnest(range(1, 20))),
  base AS (SELECT vec_id, v - m AS z, row_number() OVER (ORDER BY vec_id) AS k FROM e, m),
  draw AS (SELECT rep, vec_id, row_number() OVER (PARTITION BY rep ORDER BY
    CAST('0x' || substr(md5(rep || ':' || vec_id), 1, 15) AS BIGINT), vec_id) AS k FROM e, rep),
  given AS (SELECT rep, draw.vec_id, z FROM draw JOIN base USING (k)
    UNION ALL SELECT 0, vec_id, z FROM base)"""


@query("global_test", f"""WITH {DRAWN_SQL}, stat AS (SELECT a.rep,
    any_value(n) / CAST(count(*) AS DOUBLE) * sum(a.z * b.z) / any_value(q) AS i,
    (any_value(n) - 1) * sum((a.z - b.z) * (a.z - b.z)) / (2e0 * count(*) * any_value(q)) AS c
    FROM w JOIN given a ON a.vec_id = w.i JOIN given b ON b.vec_id = w.j AND a.rep = b.rep, m, q
    GROUP BY a.rep),
  own AS (SELECT i AS i0, c AS c0 FROM stat WHERE rep = 0),
  s AS (SELECT CAST(count(*) FILTER (rep > 0 AND i >= i0) AS INTEGER) AS big,
    CAST(count(*) FILTER (rep > 0 AND c <= c0) AS INTEGER) AS small FROM stat, own)
SELECT n, round(i0, 9) AS moran_i, round(c0, 9) AS geary_c, 19 AS replicates,
  big AS moran_as_large, small AS geary_as_small, (big + 1) / 20e0 AS moran_p,
  (small + 1) / 20e0 AS geary_p FROM s, own, m""")
def global_test(spark, folder):
    """Moran's I and Geary's C against 19 permutations."""
    out = permutations.global_test(t.valued_points(spark, folder), "vec_id", XY, "v", RADIUS, 19)
    return rounded(out, 9, "moran_i", "geary_c")


@query("local_test", f"""WITH {DRAWN_SQL}, lag AS (
  SELECT given.rep, given.vec_id, any_value(given.z) AS z, count(w.j) AS d,
    coalesce(sum(b.z), 0) AS lag FROM given LEFT JOIN w ON w.i = given.vec_id
    LEFT JOIN given b ON b.vec_id = w.j AND b.rep = given.rep GROUP BY given.rep, given.vec_id),
  own AS (SELECT vec_id, z AS z0, d, lag AS lag0 FROM lag WHERE rep = 0)
SELECT vec_id, any_value(own.d) AS degree,
  CASE WHEN any_value(own.d) > 0 THEN (count(*) FILTER (lag * z0 >= lag0 * z0) + 1) / 20e0 END AS local_p,
  (count(*) FILTER (lag + z >= lag0 + z0) + 1) / 20e0 AS hot_p
FROM lag JOIN own USING (vec_id) WHERE rep > 0 GROUP BY vec_id""")
def local_test(spark, folder):
    """Local Moran and Getis-Ord statistics against 19 permutations."""
    return permutations.local_test(t.valued_points(spark, folder), "vec_id", XY, "v", RADIUS, 19)


@query("colocations", f"""WITH {t.E_SQL}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, CAST(a.label AS VARCHAR) AS ti, CAST(b.label AS VARCHAR) AS tj
    FROM e a JOIN e b ON CAST(a.label AS VARCHAR) < CAST(b.label AS VARCHAR)
      AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.03e0 * 0.03e0),
  x AS (SELECT [ti, tj] AS types, [i, j] AS points FROM p UNION ALL
    SELECT [a.ti, a.tj, b.tj], [a.i, a.j, b.j] FROM p a JOIN p b ON a.j = b.i JOIN p c ON c.i = a.i AND c.j = b.j),
  n AS (SELECT CAST(label AS VARCHAR) AS t, count(*) AS total FROM e GROUP BY 1),
  u AS (SELECT types, t, count(DISTINCT point) AS used FROM (SELECT types, unnest(types) AS t, unnest(points) AS point FROM x) GROUP BY types, t),
  s AS (SELECT types, min(used / total) AS participation FROM u JOIN n USING (t) GROUP BY types),
  k AS (SELECT types, count(*) AS instances FROM x GROUP BY types)
SELECT array_to_string(types, ' ') AS types, CAST(len(types) AS INTEGER) AS size, instances, round(participation, 9) AS participation
FROM s JOIN k USING (types) WHERE participation >= 0.2""")
def colocations(spark, folder):
    """Two or three labels that occur together."""
    out = colocation.colocations(t.embedding_points(spark, folder), "vec_id", "label", XY, 0.03, 0.2, 3)
    return rounded(out.withColumn("types", F.array_join("types", " ")), 9, "participation")
