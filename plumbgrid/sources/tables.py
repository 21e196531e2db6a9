"""Located tables derived from the given ones.

None of the given tables has a coordinate column, so positions are computed from keys
(or read from the first elements of an embedding). ``*_SQL`` holds the same derivation
as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def key_lon(key: Column) -> Column:
    return ((key * 7919) % 36000) / F.lit(100.0) - F.lit(180.0)


def key_lat(key: Column) -> Column:
    return ((key * 104729) % 17000) / F.lit(100.0) - F.lit(85.0)


def lonlat_sql(key: str) -> str:
    return (f"(({key} * 7919) % 36000) / 1e2 - 18e1 AS lon, "
            f"(({key} * 104729) % 17000) / 1e2 - 85e0 AS lat")


def embedding_points(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, label, x, y): the first two embedding elements."""
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"))


E_SQL = """e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x,
                CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"""


def valued_points(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, label, x, y, v): as above, with the third element as a measurement."""
    return table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
        F.col("embedding")[2].cast("double").alias("v"))


EV_SQL = """e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x,
                 CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS v
                 FROM embeddings)"""


def customers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment",
        key_lon(key).alias("lon"), key_lat(key).alias("lat"))


C_SQL = (f"c AS (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, "
         f"{lonlat_sql('c_custkey')} FROM customer)")


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        "s_suppkey", "s_nationkey", "s_acctbal",
        key_lon(key).alias("lon"), key_lat(key).alias("lat"))


S_SQL = (f"s AS (SELECT s_suppkey, s_nationkey, s_acctbal, {lonlat_sql('s_suppkey')} "
         f"FROM supplier)")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
        key_lon(key).alias("lon"), key_lat(key).alias("lat"))


O_SQL = (f"o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, "
         f"{lonlat_sql('o_orderkey')} FROM orders)")


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, user_id, ts, lon, lat): every user stands still for six hours at a time,
    then moves a little, in steps that follow from the clock and the user."""
    return located_events(table(spark, folder, "events"))


def located_events(events: DataFrame) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    slot = day * 4 + F.floor(F.hour("ts") / F.lit(6))
    user = F.col("user_id")
    east = (slot * 31 + user * 17) % 40
    north = (slot * 13 + user * 29) % 30
    return events.select(
        "event_id", "user_id", "ts",
        (((user * 7919) % 30000) / F.lit(100.0) - F.lit(150.0) + east / F.lit(20.0)).alias("lon"),
        (((user * 104729) % 12000) / F.lit(100.0) - F.lit(60.0) + north / F.lit(20.0)).alias("lat"))


V_SQL = """slots AS (SELECT event_id, user_id, ts,
                   datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 4
                     + hour(ts) // 6 AS slot FROM events),
       v AS (SELECT event_id, user_id, ts,
               ((user_id * 7919) % 30000) / 1e2 - 15e1
                 + ((slot * 31 + user_id * 17) % 40) / 2e1 AS lon,
               ((user_id * 104729) % 12000) / 1e2 - 6e1
                 + ((slot * 13 + user_id * 29) % 30) / 2e1 AS lat
             FROM slots)"""


# The corners of the L-shaped zone inside its 72 x 34 degree tile.
L_RING = ((0, 0), (72, 0), (72, 10), (20, 10), (20, 34), (0, 34))
TILE_RING = ((0, 0), (72, 0), (72, 34), (0, 34))


def nation_rings(spark: SparkSession, folder: str, ring=L_RING) -> DataFrame:
    """(zone_id, ring): one ring of corners per nation, in a 5 by 5 arrangement."""
    key = F.col("n_nationkey").cast("long")
    x0 = (key % 5) * 72 - F.lit(180.0)
    y0 = F.floor(key / F.lit(5)) * 34 - F.lit(85.0)
    corners = F.array(*[F.struct((x0 + F.lit(float(dx))).alias("x"),
                                 (y0 + F.lit(float(dy))).alias("y")) for dx, dy in ring])
    return table(spark, folder, "nation").select(key.alias("zone_id"), corners.alias("ring"))


def rings_sql(ring=L_RING) -> str:
    """CTE ``z(zone_id, seq, x1, y1, x2, y2)``: the edges of the same rings."""
    rows = ", ".join(f"({i}, {float(ring[i][0])}, {float(ring[i][1])}, "
                     f"{float(ring[(i + 1) % len(ring)][0])}, "
                     f"{float(ring[(i + 1) % len(ring)][1])})" for i in range(len(ring)))
    return f"""tile AS (SELECT CAST(n_nationkey AS BIGINT) AS zone_id,
                 (n_nationkey % 5) * 72 - 18e1 AS x0,
                 floor(n_nationkey / 5e0) * 34 - 85e0 AS y0 FROM nation),
       corner(seq, dx1, dy1, dx2, dy2) AS (VALUES {rows}),
       z AS (SELECT zone_id, CAST(seq AS INTEGER) AS seq, x0 + dx1 AS x1, y0 + dy1 AS y1,
                x0 + dx2 AS x2, y0 + dy2 AS y2 FROM tile, corner)"""
