"""Joins between rows that lie near each other.

A distance condition alone plans as a product of the two tables. Here both sides get
the address of a grid cell at least one radius wide, one side is copied to the
neighbouring cells its radius reaches, and the join is an equi-join on the address
followed by the exact distance test.

A cell may hold a large share of either table. Cells above ``split_rows`` are found by
counting per cell beforehand, and such a cell becomes a block of (left part, right part)
keys, each with at most about ``split_rows`` rows of either side, so no single task gets
the whole cell. Every pair still meets under exactly one key.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.planar import dist2
from ..functions.sphere import chord, haversine, unit_vector

# Cells are a little wider than the radius, so that rounding in the address can not
# push an accepted pair more than one cell apart.
WIDEN = 1 + 2.0 ** -20
SPLIT_ROWS = 20_000
# Up to this many hot cells are sent to every executor (a few hundred kilobytes);
# beyond it they are joined like any other table.
HOT_BROADCAST = 10_000
# Pairs one task should test, and the most tasks a join is given for that reason.
TASK_PAIRS = 100_000_000
MAX_TASKS = 200_000
# A right side of no more rows than this, copies to neighbouring cells included, is sent to the
# left, which then is not shuffled and has no hot cells.
SMALL_ROWS = 50_000


def disjoint(left: DataFrame, right: DataFrame) -> None:
    shared = sorted(set(left.columns) & set(right.columns))
    if shared:
        raise ValueError(f"rename these columns on one side first: {shared}")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _finite(at: Sequence[Column]) -> Column:
    ok = F.lit(True)
    for c in at:
        ok = ok & (F.abs(F.coalesce(c, F.lit(float("nan")))) < F.lit(float("inf")))
    return ok


def _own_cell(df: DataFrame, at: Sequence[Column], cell: float) -> DataFrame:
    ok = _finite(at)
    return df.select("*", *[F.when(ok, F.floor(c / F.lit(cell))).alias(f"_c{i}")
                            for i, c in enumerate(at)])


def _shifted(df: DataFrame, dims: int, offsets: Sequence[tuple[int, ...]]) -> DataFrame:
    """Copy each row, keyed by its own cell, to the given neighbouring cells."""
    table = F.array(*[F.struct(*[F.lit(o[i]).alias(f"o{i}") for i in range(dims)])
                      for o in offsets])
    out = df.select("*", F.explode(table).alias("_o"))
    rest = [c for c in df.columns if c not in {f"_c{i}" for i in range(dims)}]
    return out.select(*rest, "_o", *[(F.col(f"_c{i}") + F.col(f"_o.o{i}")).alias(f"_c{i}")
                                     for i in range(dims)])


def _reached(df: DataFrame, at: Sequence[Column], cell: float,
             offsets: Sequence[tuple[int, ...]]) -> DataFrame:
    """Rows copied to every listed neighbour that lies within one cell width of them."""
    dims = len(at)
    parts = [F.col(f"_f{i}") for i in range(dims)]
    own = _own_cell(df.where(_finite(at)), at, cell).select(
        "*", *[(c / F.lit(cell) - F.floor(c / F.lit(cell))).alias(f"_f{i}")
               for i, c in enumerate(at)])
    gap2 = F.lit(0.0)
    for i, part in enumerate(parts):
        step = F.col(f"_o.o{i}")
        gap = F.when(step == 0, 0.0).when(step < 0, part).otherwise(1.0 - part)
        gap2 = gap2 + gap * gap
    out = _shifted(own, dims, offsets).where(gap2 <= 1.0)
    return out.drop(*[f"_f{i}" for i in range(dims)])


class Split(NamedTuple):
    """How to run a join whose groups differ in size."""

    hot: DataFrame | None   # (keys, _sl, _sr): parts of the left and right side of large groups
    tasks: int | None       # partitions for the join, where its work asks for more than usual


def work_tasks(spark: SparkSession, work: float | None) -> int | None:
    """Partitions for a join that tests ``work`` pairs, or None if the usual number will do.

    Spark sizes tasks by bytes read, and a join may test many pairs per byte.
    """
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = math.ceil((work or 0) / TASK_PAIRS)
    return min(tasks, MAX_TASKS) if tasks > usual or (work or 0) > TASK_PAIRS else None


def hot_groups(left_counts: DataFrame, right_counts: DataFrame, keys: list[str],
               split_rows: int) -> Split:
    """Measure the groups of a join from their sizes (keys, _nl) and (keys, _nr).

    Further columns of the left sizes stay with the large groups."""
    spark = left_counts.sparkSession
    sizes = left_counts.join(right_counts, keys)
    large = (F.col("_nl") > split_rows) | (F.col("_nr") > split_rows)
    total = sizes.agg(F.sum(F.col("_nl").cast("double") * F.col("_nr")).alias("work"),
                      F.count_if(large).alias("hot")).first()
    tasks = work_tasks(spark, total.work)
    if not total.hot:
        return Split(None, tasks)
    hot = sizes.where(large).select(
        *keys, F.ceil(F.col("_nl") / split_rows).cast("int").alias("_sl"),
        F.ceil(F.col("_nr") / split_rows).cast("int").alias("_sr"),
        *[c for c in left_counts.columns if c not in {*keys, "_nl"}])
    if total.hot <= HOT_BROADCAST:
        hot = F.broadcast(spark.createDataFrame(hot.collect(), hot.schema))
    return Split(hot, tasks)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], split: Split | None,
               condition: Column, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` plus ``condition``, with the hot groups cut into blocks.

    Rows choose their part by a hash of their contents, not at random, so that a task
    run again after an executor is lost makes the same choice. For other than inner joins
    only the left side is cut: each left row has to see the whole right group.
    """
    on = list(keys)
    hot, tasks = split or (None, None)
    if hot is not None:
        left_parts = F.coalesce(F.col("_sl"), F.lit(1))
        right_parts = F.coalesce(F.col("_sr"), F.lit(1)) if how == "inner" else F.lit(1)
        left_part = F.pmod(F.xxhash64(*left.columns), left_parts).cast("int").alias("_i")
        right_part = F.pmod(F.xxhash64(*right.columns), right_parts).cast("int").alias("_j")
        every_left = F.explode(F.sequence(F.lit(0), left_parts - 1)).alias("_i")
        every_right = F.explode(F.sequence(F.lit(0), right_parts - 1)).alias("_j")
        left = left.join(hot, keys, "left").select(*left.columns, left_part, every_right)
        right = right.join(hot, keys, "left").select(*right.columns, right_part, every_left)
        on += ["_i", "_j"]
    if tasks is not None:
        left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
    right = right.withColumnsRenamed({k: "_r" + k for k in on})
    match = condition
    for k in on:
        match = (F.col(k) == F.col("_r" + k)) & match
    return left.join(right, match, how).drop(*on, *["_r" + k for k in on])


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[tuple[str, str]],
           how: str = "inner", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Join rows to a table with at most one row per key, inner or left.

    ``keys`` pairs column names of the two sides; those of the table are dropped. A key
    that holds a large share of the rows is cut up, and its table row copied.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    left = rows.select("*", *[F.col(k).alias(n) for (k, _), n in zip(keys, names)])
    right = table.withColumnsRenamed({k: n for (_, k), n in zip(keys, names)})
    counts = left.groupBy(*names).agg(F.count("*").alias("_nl")).where(F.col("_nl") > split_rows)
    single = counts.select(*names, F.lit(1).cast("long").alias("_nr"))
    split = hot_groups(counts, single, names, split_rows)
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    out = split_join(left.where(known), right, names, split, F.lit(True), how)
    if how == "left":
        # Rows with an unknown key match nothing; together they could be one large key.
        out = out.unionByName(left.where(~known).drop(*names), allowMissingColumns=True)
    return out


def grid_join(left: DataFrame, right: DataFrame, left_at: Sequence[Column],
              right_at: Sequence[Column], reach: float, condition: Column,
              how: str = "inner", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Join rows whose positions differ by at most ``reach`` and that meet ``condition``.

    Positions are two or three expressions. The right side is the one copied, so it
    should be the smaller. Rows without a finite position match nothing.
    """
    disjoint(left, right)
    dims = len(left_at)
    keys = [f"_c{i}" for i in range(dims)]
    cell = reach * WIDEN
    around = list(itertools.product((-1, 0, 1), repeat=dims))
    every = _own_cell(left, left_at, cell)
    near = every.where(F.col("_c0").isNotNull())
    far = _reached(right, right_at, cell, around)
    left_counts = near.groupBy(*keys).agg(F.count("*").alias("_nl"))
    right_counts = (_shifted(_own_cell(right, right_at, cell).groupBy(*keys)
                             .agg(F.count("*").alias("_n")), dims, around)
                    .groupBy(*keys).agg(F.sum("_n").alias("_nr")))
    split = hot_groups(left_counts, right_counts, keys, split_rows)
    far = far.drop("_o")
    if (right_counts.agg(F.sum("_nr")).first()[0] or 0) <= SMALL_ROWS:
        if split.tasks and near.rdd.getNumPartitions() < split.tasks:
            near = near.repartition(split.tasks)
        split, far = None, F.broadcast(far)
    out = split_join(near, far, keys, split, condition, how)
    if how == "left_anti":
        # Rows without a position would otherwise share one key.
        out = out.unionByName(every.where(F.col("_c0").isNull()).drop(*keys))
    return out


def within_distance(left: DataFrame, right: DataFrame, radius: float,
                    left_xy: tuple[str, str], right_xy: tuple[str, str],
                    how: str = "inner", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Pairs at planar distance <= radius, with a ``distance`` column for inner joins.

    ``how`` may be inner, left_semi (rows of the left within reach of any right row) or
    left_anti (rows within reach of none).
    """
    d2 = dist2(*left_xy, *right_xy)
    if how != "inner":
        right = right.select(*right_xy).distinct()
    out = grid_join(left, right, [F.col(c) for c in left_xy], [F.col(c) for c in right_xy],
                    radius, d2 <= F.lit(float(radius) * float(radius)), how, split_rows)
    return out.withColumn("distance", F.sqrt(d2)) if how == "inner" else out


def within_metres(left: DataFrame, right: DataFrame, metres: float,
                  left_lonlat: tuple[str, str], right_lonlat: tuple[str, str],
                  how: str = "inner", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Pairs at great-circle distance <= metres, with a ``metres`` column for inner joins.

    Cells are cubes around the unit sphere. A cheap chord test runs before the exact one.
    """
    reach = max(chord(metres) * WIDEN + 1e-12, 1e-8)
    if how != "inner":
        right = right.select(*right_lonlat).distinct()

    def placed(df: DataFrame, lonlat: tuple[str, str], name: str) -> DataFrame:
        return df.select("*", *[u.alias(f"{name}{i}")
                                for i, u in enumerate(unit_vector(*lonlat))])

    spots = [[F.col(f"{n}{i}") for i in range(3)] for n in ("_u", "_v")]
    chord2 = sum(((a - b) * (a - b) for a, b in zip(*spots)), F.lit(0.0))
    exact = haversine(*left_lonlat, *right_lonlat)
    out = grid_join(placed(left, left_lonlat, "_u"), placed(right, right_lonlat, "_v"),
                    *spots, reach,
                    (chord2 <= F.lit(reach * reach)) & (exact <= F.lit(float(metres))),
                    how, split_rows)
    out = out.drop(*[f"{n}{i}" for n in ("_u", "_v") for i in range(3)])
    return out.withColumn("metres", exact) if how == "inner" else out


def close_metres(left: DataFrame, right: DataFrame, left_key: str, right_key: str, metres: float,
                 left_lonlat: tuple[str, str], right_lonlat: tuple[str, str],
                 split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Pairs of keys of two tables at great-circle distance <= metres, as (left_key, right_key, metres).

    The same pairs as ``within_metres`` gives, listed in tasks: rows of the left at one position
    are compared once, and follow one another so that what they share takes little room in a file.
    """
    from . import tiles  # which uses the cells of this module

    around = list(itertools.product((-1, 0, 1), repeat=3))
    keys = ["_c0", "_c1", "_c2"]
    cell = max(chord(metres) * WIDEN + 1e-12, 1e-8) * WIDEN

    def placed(df: DataFrame, key: str, name: str, lonlat: tuple[str, str]) -> DataFrame:
        at = [F.col(c).cast("double").alias(n) for c, n in zip(lonlat, ("lon", "lat"))]
        return df.select(F.col(key).alias(name), *at).where(_finite([F.col(c) for c in lonlat]))

    near, far = placed(left, left_key, "i", left_lonlat), placed(right, right_key, "j", right_lonlat)
    at = list(unit_vector("lon", "lat"))
    own, reached = _own_cell(near, at, cell), _reached(far, at, cell, around).drop("_o")
    spots = own.groupBy(*keys, "lon", "lat").agg(F.count("*").alias("_n"))
    left_counts = spots.groupBy(*keys).agg(F.sum("_n").alias("_nl"), F.max("_n").alias("_most"))
    right_counts = (_shifted(_own_cell(far, at, cell).groupBy(*keys).agg(F.count("*").alias("_n")), 3, around)
                    .groupBy(*keys).agg(F.sum("_n").alias("_nr")))
    split = hot_groups(left_counts, right_counts, keys, split_rows)
    return tiles.each_block(own, reached, keys, split, float(metres), (left_key, right_key))


def meeting_pairs(rows: DataFrame, xy: tuple[str, str], radius: float, order: Column,
                  split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Each unordered pair of distinct rows within the radius, once.

    Columns come out as ``a_*`` and ``b_*``. A row is copied to itself and four of its
    eight neighbours only: of two rows in different cells, one reaches the other.
    ``order`` is a condition on (a_*, b_*) that holds one way round for rows of one cell.
    """
    half = [(0, 0), (1, 0), (1, 1), (0, 1), (-1, 1)]
    keys = ["_c0", "_c1"]
    a, b = prefixed(rows, "a_"), prefixed(rows, "b_")
    a_xy, b_xy = [[F.col(p + c) for c in xy] for p in ("a_", "b_")]
    cell = radius * WIDEN
    near = _own_cell(a, a_xy, cell).where(F.col("_c0").isNotNull())
    far = _reached(b, b_xy, cell, half).withColumn(
        "_same", (F.col("_o.o0") == 0) & (F.col("_o.o1") == 0)).drop("_o")
    counts = near.groupBy(*keys).agg(F.count("*").alias("_nl"))
    reached = (_shifted(counts.withColumnRenamed("_nl", "_n"), 2, half)
               .groupBy(*keys).agg(F.sum("_n").alias("_nr")))
    split = hot_groups(counts, reached, keys, split_rows)
    near_enough = dist2(*a_xy, *b_xy) <= F.lit(float(radius) * float(radius))
    return split_join(near, far, keys, split, near_enough & (~F.col("_same") | order)).drop("_same")


def close_pairs(points: DataFrame, key: str, xy: tuple[str, str], radius: float,
                split_rows: int = SPLIT_ROWS, both: bool = False) -> DataFrame:
    """Unordered pairs of one table as (i, j, distance) with i < j.

    With ``both``, the join of the table with itself: pairs each way round, and every row
    with itself, equal or null keys or not. Pairs are listed in tasks, by tiles of rows that lie together.
    """
    from . import tiles  # which uses the cells of this module

    rows = points.select(F.col(key).alias("i"), *[F.col(c).cast("double").alias(n)
                                                  for c, n in zip(xy, ("x", "y"))])
    kind = rows.schema["i"].dataType.simpleString()
    return tiles.each(rows, float(radius), split_rows, tiles.listed(float(radius), both),
                      f"i {kind}, j {kind}, distance double")
