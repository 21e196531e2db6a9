"""Streams of fixes: counts per cell and time window, and zone changes per object."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.cells import square_cell
from ..functions.clock import from_micros, has_zone, to_micros
from ..functions.planar import valid_xy
from ..functions.polygon import crosses_upward, crossings
from ..operators.zones import zone_cover
from ..session import cut, scratch_path


def windowed_cells(fixes: DataFrame, ts: str, xy: tuple[str, str], size: float, window: str,
                   delay: str) -> DataFrame:
    """(started, col, row, n) per time window and square cell. State holds one count per open
    window and cell; windows older than the watermark are emitted once and forgotten."""
    col, row = square_cell(*xy, size)
    zoned = has_zone(fixes, ts)
    instant = F.timestamp_micros(to_micros(F.col(ts), zoned))
    return (fixes.where(valid_xy(*xy)).select(instant.alias("_ts"), col.alias("col"), row.alias("row"))
            .withWatermark("_ts", delay).groupBy(F.window("_ts", window).alias("_w"), "col", "row")
            .agg(F.count("*").alias("n"))
            .select(from_micros(F.unix_micros("_w.start"), zoned).alias("started"), "col", "row", "n"))


def with_zone(fixes: DataFrame, edges: DataFrame, cell: float, xy: tuple[str, str],
              zone: str = "zone_id") -> DataFrame:
    """Fixes with the zone that holds them, null outside; the smallest where zones overlap.

    One row per fix before and after, without a regrouping, so it serves streams and
    tables alike: the cells of all zones become a table that Spark broadcasts when its file
    size allows and shuffles otherwise.
    """
    cover = zone_cover(edges, cell, zone)
    whole = cover.groupBy("_c0", "_c1", "_zone").agg(
        F.flatten(F.collect_list("_edges")).alias("_edges"),
        F.bool_or(F.col("_edges").isNull()).alias("_inner"))
    cells = cut(whole.groupBy("_c0", "_c1").agg(F.array_sort(F.collect_list(
        F.struct("_zone", "_inner", "_edges"))).alias("_zones")))
    cells = cells.withColumnsRenamed({"_c0": "_r0", "_c1": "_r1"})
    ok = valid_xy(*xy)
    placed = fixes.select("*", *[F.when(ok, F.floor(F.col(c) / F.lit(cell))).alias(k)
                                 for c, k in zip(xy, ("_c0", "_c1"))])
    met = placed.join(cells, (F.col("_c0") == F.col("_r0")) & (F.col("_c1") == F.col("_r1")), "left")
    holds = F.filter("_zones", lambda z: z["_inner"] | (
        crossings(xy[0], xy[1], z["_edges"], crosses_upward) % 2 == 1))
    return met.select(*fixes.columns, F.get(holds, F.lit(0))["_zone"].alias(zone))


def zone_changes_live(fixes: DataFrame, key: str, ts: str, tie: str, zone: str,
                      delay: str) -> DataFrame:
    """Zone changes of a stream, as ``zone_changes`` gives for a table.

    Fixes may arrive out of order: each waits in its object's state until the watermark has
    passed it, and only then is compared with the one before. Later ones are dropped, so a
    reversed pair of changes can not be emitted. Null zones travel as the flag ``inside``.
    """
    types = dict(fixes.dtypes)
    if {types[key], types[tie], types[zone]} - {"bigint", "int"}:
        raise ValueError("key, tie breaker and zone must be integers")
    zoned = has_zone(fixes, ts)
    micros = to_micros(F.col(ts), zoned)
    sent = fixes.select(F.col(key).cast("long").alias("k"), F.timestamp_micros(micros).alias("ts"),
                        F.col(tie).cast("long").alias("tie"), F.col(zone).isNotNull().alias("inside"),
                        F.coalesce(F.col(zone).cast("long"), F.lit(0)).alias("zone"),
                        micros.alias("us"))
    schema = "k long, us long, tie long, was_inside boolean, was long, inside boolean, zone long"
    held = "inside boolean, zone long, us array<long>, tie array<long>, ins array<boolean>, zones array<long>"
    out = sent.withWatermark("ts", delay).groupBy("k").applyInPandasWithState(
        _advance, schema, held, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("k").alias(key), from_micros(F.col("us"), zoned).alias(ts), F.col("tie").alias(tie),
                      F.when(F.col("was_inside"), F.col("was")).alias("left_zone"),
                      F.when(F.col("inside"), F.col("zone")).alias("entered_zone"))


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    inside, zone, *waiting = state.get if state.exists else (False, 0, [], [], [], [])
    names = ["us", "tie", "inside", "zone"]
    parts = [pd.DataFrame(dict(zip(names, [list(w) for w in waiting])))]
    if not state.hasTimedOut:
        parts += [batch[names] for batch in batches]
    rows = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)
    watermark = state.getCurrentWatermarkMs()
    ready = rows[rows["us"] < watermark * 1000].sort_values(["us", "tie"])
    rest = rows[rows["us"] >= watermark * 1000]
    if len(ready):
        ready = ready.assign(was_inside=ready["inside"].shift(fill_value=inside),
                             was=ready["zone"].shift(fill_value=zone), k=key[0])
        changed = (ready["inside"] != ready["was_inside"]) | (ready["zone"] != ready["was"])
        inside, zone = bool(ready["inside"].iloc[-1]), int(ready["zone"].iloc[-1])
        yield ready.loc[changed, ["k", "us", "tie", "was_inside", "was", "inside", "zone"]]
    state.update((inside, zone, *[rest[n].tolist() for n in names]))
    if len(rest):
        state.setTimeoutTimestamp(max(int(rest["us"].min()) // 1000 + 1, watermark + 1))


STORE = "spark.sql.streaming.stateStore.providerClass"
# Fixed value: the state store that keeps timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, name: str, timers: bool = False) -> DataFrame:
    """Run a stream over what its source holds now; the rows it has emitted, as a table.

    ``timers`` names the state store that operators with timers need, for this stream only.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(STORE, None)
    if timers:
        spark.conf.set(STORE, ROCKS)
    try:
        (stream.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", path + "-progress").outputMode("append")
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        if timers:
            spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return spark.read.schema(stream.schema).parquet(path)
