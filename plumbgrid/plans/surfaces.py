"""Rasters, made from orders on a five degree grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids, rasters, zones
from ..sources import tables as t
from .geometry import CELL, CROSS
from .neighbours import rounded
from .registry import query

SIZE = 5.0
R_SQL = f"""{t.O_SQL}, g AS (SELECT CAST(floor(lon / 5e0) AS BIGINT) AS col,
    CAST(floor(lat / 5e0) AS BIGINT) AS row, count(*) AS n, sum(o_totalprice) AS total
    FROM o GROUP BY 1, 2),
  cells AS (SELECT 'count' AS band, row, col, CAST(n AS DOUBLE) AS value FROM g
    UNION ALL SELECT 'total', row, col, total FROM g)"""


def order_raster(spark, folder):
    counts = grids.square_counts(t.orders(spark, folder), ("lon", "lat"), SIZE,
                                 F.sum("o_totalprice").alias("total"))
    bands = F.array(F.struct(F.lit("count").alias("band"), F.col("n").cast("double").alias("value")),
                    F.struct(F.lit("total").alias("band"), F.col("total").alias("value")))
    return counts.select(F.explode(bands).alias("b"), "row", "col").select(
        "b.band", "row", "col", "b.value")


@query("raster_local", f"""WITH {R_SQL}
SELECT a.row, a.col, round(b.value / a.value, 7) AS value FROM cells a JOIN cells b
  ON a.row = b.row AND a.col = b.col AND a.band = 'count' AND b.band = 'total'""")
def raster_local(spark, folder):
    out = rasters.combine_bands(order_raster(spark, folder), ("count", "total"),
                                lambda n, total: total / n)
    return rounded(out, 7, "value")


@query("raster_focal", f"""WITH {R_SQL}
SELECT a.band, a.row, a.col, count(*) AS n, round(avg(b.value), 6) AS mean,
  round(min(b.value), 3) AS low, round(max(b.value), 3) AS high
FROM cells a JOIN cells b ON a.band = b.band AND b.row BETWEEN a.row - 1 AND a.row + 1
  AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.band, a.row, a.col""")
def raster_focal(spark, folder):
    return rounded(rounded(rasters.focal(order_raster(spark, folder)), 6, "mean"), 3, "low", "high")


@query("raster_focal_wide", f"""WITH {R_SQL}
SELECT a.band, a.row, a.col, count(*) AS n, round(sum(b.value), 2) AS total,
  round(min(b.value), 3) AS low, round(max(b.value), 3) AS high
FROM cells a JOIN cells b ON a.band = b.band AND b.row BETWEEN a.row - 6 AND a.row + 6
  AND b.col BETWEEN a.col - 6 AND a.col + 6 GROUP BY a.band, a.row, a.col""")
def raster_focal_wide(spark, folder):
    """Over windows of 13 by 13 cells, from summed-area tables."""
    out = rasters.focal(order_raster(spark, folder), 6)
    return out.select("band", "row", "col", "n", F.round(F.col("mean") * F.col("n"), 2).alias("total"),
                      F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


@query("raster_coarsen", f"""WITH {R_SQL}
SELECT band, CAST(floor(row / 3e0) AS BIGINT) AS row, CAST(floor(col / 3e0) AS BIGINT) AS col,
  round(avg(value), 6) AS value, count(*) AS n FROM cells GROUP BY 1, 2, 3""")
def raster_coarsen(spark, folder):
    return rounded(rasters.coarsen(order_raster(spark, folder), 3), 6, "value")


@query("raster_zonal", f"""WITH {R_SQL}, {t.rings_sql()},
  p AS (SELECT *, (col + 0.5e0) * 5 AS lon, (row + 0.5e0) * 5 AS lat FROM cells),
  hit AS (SELECT p.band, p.row, p.col, any_value(p.value) AS value, z.zone_id FROM p, z
    WHERE z.y1 <> z.y2 AND {CROSS} GROUP BY p.band, p.row, p.col, z.zone_id
    HAVING count(*) % 2 = 1)
SELECT zone_id, band, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 3) AS low,
  round(max(value), 3) AS high FROM hit GROUP BY zone_id, band""")
def raster_zonal(spark, folder):
    edges = zones.ring_edges(t.nation_rings(spark, folder))
    out = rasters.zonal(order_raster(spark, folder), edges, SIZE, CELL)
    return rounded(rounded(out, 6, "mean"), 3, "low", "high")
