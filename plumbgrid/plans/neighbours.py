"""Spatial weights and autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import autocorr, weights
from ..sources import tables as t
from .registry import query

RADIUS = 0.05
XY = ("x", "y")
NEAR = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.05e0 * 0.05e0"
PAIRS = f"""w AS (SELECT a.vec_id AS i, b.vec_id AS j, a.v AS vi, b.v AS vj FROM e a, e b
             WHERE a.vec_id <> b.vec_id AND {NEAR}),
  m AS (SELECT avg(v) AS m, count(*) AS n FROM e),
  q AS (SELECT sum((v - m) * (v - m)) AS q FROM e, m),
  degree AS (SELECT i, count(*) AS d FROM w GROUP BY i)"""


def rounded(df, places, *names):
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


@query("band_weights", f"""WITH {t.EV_SQL}, {PAIRS}
SELECT i, j, round(1e0 / d, 12) AS w FROM w JOIN degree USING (i)""")
def band_weights(spark, folder):
    return weights.band_weights(t.embedding_points(spark, folder), "vec_id", XY, RADIUS, True, places=12)


@query("nearest_weights", f"""WITH {t.E_SQL}, r AS (SELECT a.vec_id AS i, b.vec_id AS j,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY
    (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.vec_id) AS k
  FROM e a, e b WHERE a.vec_id <> b.vec_id)
SELECT i, j, 1e0 / 4e0 AS w FROM r WHERE k <= 4""")
def nearest_weights(spark, folder):
    return weights.nearest_weights(t.embedding_points(spark, folder), "vec_id", XY, 4, True)


@query("moran", f"""WITH {t.EV_SQL}, {PAIRS}
SELECT any_value(m.n) AS n, CAST(count(*) AS DOUBLE) AS weight_sum,
  round(any_value(m.n) * 1e0 / count(*) * sum((vi - m) * (vj - m)) / any_value(q), 9) AS moran_i,
  round(-1e0 / (any_value(m.n) - 1), 9) AS expected_i FROM w, m, q""")
def moran(spark, folder):
    out = autocorr.moran(t.valued_points(spark, folder), XY, "v", RADIUS)
    return rounded(out, 9, "moran_i", "expected_i")


@query("moran_standardised", f"""WITH {t.EV_SQL}, {PAIRS}
SELECT any_value(m.n) AS n, round(sum(1e0 / d), 6) AS weight_sum,
  round(any_value(m.n) / sum(1e0 / d) * sum((vi - m) * (vj - m) / d) / any_value(q), 9) AS moran_i,
  round(-1e0 / (any_value(m.n) - 1), 9) AS expected_i FROM w JOIN degree USING (i), m, q""")
def moran_standardised(spark, folder):
    out = autocorr.moran(t.valued_points(spark, folder), XY, "v", RADIUS, True)
    return rounded(rounded(out, 9, "moran_i", "expected_i"), 6, "weight_sum")


@query("geary", f"""WITH {t.EV_SQL}, {PAIRS}
SELECT any_value(m.n) AS n, CAST(count(*) AS DOUBLE) AS weight_sum,
  round((any_value(m.n) - 1) * sum((vi - vj) * (vi - vj)) / (2e0 * count(*) * any_value(q)), 9)
    AS geary_c FROM w, m, q""")
def geary(spark, folder):
    out = autocorr.geary(t.valued_points(spark, folder), XY, "v", RADIUS)
    return rounded(out, 9, "geary_c")


@query("local_moran", f"""WITH {t.EV_SQL}, {PAIRS}, near AS (
  SELECT vec_id, v, count(w.i) AS d, sum(vj - m) AS lag FROM m, e LEFT JOIN w ON w.i = vec_id
  GROUP BY vec_id, v)
SELECT vec_id, d AS degree, round((v - m) * (lag / d) / (q / n), 8) AS local_i,
  CASE WHEN v - m >= 0 THEN 'H' ELSE 'L' END
    || CASE WHEN lag >= 0 THEN 'H' WHEN lag < 0 THEN 'L' END AS quadrant FROM near, m, q""")
def local_moran(spark, folder):
    out = autocorr.local_moran(t.valued_points(spark, folder), "vec_id", XY, "v", RADIUS)
    return rounded(out, 8, "local_i")


@query("hot_spots", f"""WITH {t.EV_SQL}, {PAIRS}, near AS (
  SELECT vec_id, v, count(w.i) AS d, coalesce(sum(vj - m), 0) + any_value(v - m) AS lag
  FROM m, e LEFT JOIN w ON w.i = vec_id GROUP BY vec_id, v)
SELECT vec_id, d AS degree, round(lag / (sqrt(q / n)
  * sqrt((n * (d + 1) - (d + 1) * (d + 1)) * 1e0 / (n - 1))), 8) AS gi_star FROM near, m, q""")
def hot_spots(spark, folder):
    out = autocorr.hot_spots(t.valued_points(spark, folder), "vec_id", XY, "v", RADIUS)
    return rounded(out, 8, "gi_star")


@query("variogram", f"""WITH {t.EV_SQL}, p AS (
  SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d,
    (a.v - b.v) * (a.v - b.v) AS s FROM e a, e b WHERE a.vec_id < b.vec_id)
SELECT CAST(floor(d / 0.02e0) AS BIGINT) AS bin, count(*) AS pairs,
  round(sum(s) / (2 * count(*)), 9) AS gamma
FROM p WHERE floor(d / 0.02e0) < 8 GROUP BY 1""")
def variogram(spark, folder):
    out = autocorr.variogram(t.valued_points(spark, folder), XY, "v", 0.02, 8)
    return rounded(out, 9, "gamma")
