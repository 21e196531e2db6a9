"""Reading points from files, and a tiled layout that box queries can prune."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.planar import in_box, valid_xy
from ..functions.sphere import valid_lonlat
from ..operators.zones import ring_edges


def read_points(spark: SparkSession, path: str, file_format: str, schema: str | T.StructType,
                xy: tuple[str, str], geographic: bool = False, **options: str) -> DataFrame:
    """Points from any file format Spark reads; rows without a usable position are left out.

    The schema is given rather than inferred, so nothing is read twice.
    """
    ok = valid_lonlat(*xy) if geographic else valid_xy(*xy)
    return spark.read.schema(schema).format(file_format).options(**options).load(path).where(ok)


def read_rings(spark: SparkSession, path: str, zone: str = "zone_id") -> DataFrame:
    """An edge table from JSON lines of {zone, ring: [{x, y}, ...]}."""
    schema = f"{zone} long, ring array<struct<x: double, y: double>>"
    return ring_edges(spark.read.schema(schema).json(path), zone)


def write_tiled(points: DataFrame, path: str, xy: tuple[str, str], tile: float,
                mode: str = "errorifexists") -> None:
    """Parquet in one folder per square tile, with rows near each other in the same file.

    Tiles differ in size; the rebalance hint merges small ones into one task and splits
    large ones over several.
    """
    size = F.lit(float(tile))
    tiles = [F.floor(F.col(c) / size).alias(n) for c, n in zip(xy, ("tile_col", "tile_row"))]
    (points.where(valid_xy(*xy)).select("*", *tiles).hint("rebalance", "tile_col", "tile_row")
     .sortWithinPartitions("tile_col", "tile_row", *xy)
     .write.mode(mode).partitionBy("tile_col", "tile_row").parquet(path))


def read_tiled(spark: SparkSession, path: str, xy: tuple[str, str], tile: float,
               box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Points of a tiled folder, optionally in a half-open box: folders outside it are not
    listed as input, and row groups outside it are skipped."""
    points = spark.read.parquet(path)
    if box is None:
        return points.drop("tile_col", "tile_row")
    low = [math.floor(v / tile) for v in box[:2]]
    high = [math.floor(v / tile) for v in box[2:]]
    return points.where(
        F.col("tile_col").between(low[0], high[0]) & F.col("tile_row").between(low[1], high[1])
        & in_box(*xy, box)).drop("tile_col", "tile_row")
