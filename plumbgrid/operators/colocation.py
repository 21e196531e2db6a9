"""Types of points that occur together, by participation index.

An instance of a set of types is one point of each, all within a radius of each other. A type
takes part with the share of its points that are in some instance, and the set's index is the
least of these shares. A larger set can not have a larger index, so sets grow one type at a
time from those that reach the threshold, and instances of others are never formed.

There are as many instances as the density allows, to the power of their size, and only their
number and the points in them are wanted. So no table of instances is written: points at one
position and of one type are one row with a count, each cell gets the points its radius reaches,
and a task counts the instances whose first point lies in the cell by products of the tables of
who is near whom, a tile at a time. What leaves a task is a number per set and, per
position, the sets it takes part in.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.planar import valid_xy
from ..session import cut
from .pairs import SPLIT_ROWS, WIDEN, _own_cell, _reached, _shifted

FOUND = "set int, instances long, x double, y double, t int, n long, word int, bits long"
# Sets per word of a position's mask; positions of a tile; triples of positions one group should test.
WORD, TILE, GROUP_WORK = 62, 1024, 1e12


def _candidates(known: set[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Sets of one type more all of whose parts are known."""
    out = []
    for a, b in itertools.product(known, repeat=2):
        if a[:-1] == b[:-1] and a[-1] < b[-1]:
            whole = (*a, b[-1])
            if all(whole[:i] + whole[i + 1:] in known for i in range(len(whole))):
                out.append(whole)
    return sorted(out)


class _Cell:
    """The instances of ``sets`` whose first point is one of the cell's own."""

    def __init__(self, x, y, t, n, own, radius: float, sets: dict[tuple[int, ...], int]):
        order = np.lexsort((x, t))
        self.x, self.y, self.t, self.n, self.own = (v[order] for v in (x, y, t, n, own))
        self.limit, self.radius = radius * radius, radius
        starts = np.flatnonzero(np.r_[True, self.t[1:] != self.t[:-1]])
        self.of = {int(self.t[a]): (a, b) for a, b in zip(starts, np.r_[starts[1:], len(x)])}
        # By all types but the last two, which are settled together.
        self.heads: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
        for s in sets:
            if all(k in self.of for k in s):
                self.heads.setdefault(s[:max(1, len(s) - 2)], []).append(s)
        self.sets = sets
        self.found = {s: 0 for group in self.heads.values() for s in group}
        self.used = {s: [np.zeros(self.of[k][1] - self.of[k][0], bool) for k in s] for s in self.found}

    def near(self, rows, columns):
        dx = self.x[rows][:, None] - self.x[columns]
        dy = self.y[rows][:, None] - self.y[columns]
        return dx * dx + dy * dy <= self.limit

    def marked(self, s, at: int, points) -> None:
        self.used[s][at][points - self.of[s[at]][0]] = True

    def run(self) -> None:
        mine = np.flatnonzero(self.own)
        for tile in self.tiles(mine):
            # Points out of reach of the whole tile are in no instance with its points.
            x, y = self.x[tile], self.y[tile]
            reach = self.radius * WIDEN
            at = np.flatnonzero((self.x >= x.min() - reach) & (self.x <= x.max() + reach)
                                & (self.y >= y.min() - reach) & (self.y <= y.max() + reach))
            edges = np.searchsorted(self.t[at], list(self.of)), np.searchsorted(self.t[at], list(self.of), "right")
            part = {k: at[a:b] for k, a, b in zip(self.of, *edges)}
            starts: dict[tuple[int, ...], np.ndarray] = {}
            for k in {h[0] for h in self.heads}:
                starts[(k,)] = tile[self.t[tile] == k]
            heads = sorted(self.heads)
            if len(heads[0]) == 1:
                self.settle([(h, starts[h][:, None]) for h in heads if len(starts[h])], part)
            else:
                for h in heads:
                    for points in self.grown(h, starts[h[:1]][:, None], part):
                        self.settle([(h, points)], part)

    def tiles(self, points) -> Iterator[np.ndarray]:
        """Points that lie together, at most TILE of them."""
        if len(points) > TILE:
            x, y = self.x[points], self.y[points]
            along = np.argsort(x if np.ptp(x) >= np.ptp(y) else y, kind="stable")
            for half in (along[:len(along) // 2], along[len(along) // 2:]):
                yield from self.tiles(np.sort(points[half]))
        elif len(points):
            yield points

    def grown(self, head, points, part) -> Iterator[np.ndarray]:
        """Instances of ``head`` that start with the given ones, a bounded number at a time."""
        size = points.shape[1]
        if size == len(head):
            if len(points):
                yield points
            return
        others = part[head[size]]
        step = max(1, TILE * TILE // max(1, len(others)))
        for a in range(0, len(points), step):
            some = points[a:a + step]
            near = self.all_near(some, others)
            row, col = np.nonzero(near)
            for b in range(0, len(row), TILE):
                yield from self.grown(head, np.c_[some[row[b:b + TILE]], others[col[b:b + TILE]]], part)

    def all_near(self, points, others):
        near = self.near(points[:, 0], others)
        for i in range(1, points.shape[1]):
            near &= self.near(points[:, i], others)
        return near

    def settle(self, rows, part) -> None:
        """Count what instances of heads, (head, points) each, give with the last types."""
        ends: dict[tuple[int, ...], list[int]] = {}
        for i, (head, _) in enumerate(rows):
            for s in self.heads[head]:
                ends.setdefault(s[len(head):], []).append(i)
        table: dict[tuple[int, int], np.ndarray] = {}

        def near_of(i: int, kind: int):
            if (i, kind) not in table:
                table[i, kind] = self.all_near(rows[i][1], part[kind])
            return table[i, kind]

        for end, which in ends.items():
            if not all(len(part[k]) for k in end):
                continue
            sets = [(*rows[i][0], *end) for i in which]
            starts = np.cumsum([0] + [len(rows[i][1]) for i in which])
            first = np.concatenate([near_of(i, end[0]) for i in which])
            if len(end) == 1:
                self.add(sets, rows, which, starts, first.astype(np.int64), part[end[0]], 1)
                continue
            q, r = part[end[0]], part[end[1]]
            last = np.concatenate([near_of(i, end[1]) for i in which])
            # Numbers below 2 ** 24 are exact in single precision.
            weights = self.n[r]
            kind = np.float32 if weights.sum() < 1 << 24 else np.float64
            left, counted = first.astype(kind), last * weights.astype(kind)
            for a in range(0, len(q), TILE):
                some = q[a:a + TILE]
                met = np.zeros((len(first), len(some)), kind)
                for b in range(0, len(r), TILE):
                    met += counted[:, b:b + TILE] @ self.near(r[b:b + TILE], some).astype(kind)
                met *= left[:, a:a + TILE]
                self.add(sets, rows, which, starts, met.astype(np.int64), some, len(rows[0][0]))
            # Points of the last type: only those not known yet.
            known = np.logical_and.reduce([self.used[s][-1][r - self.of[end[1]][0]] for s in sets])
            for b in range(0, len(r), TILE):
                open_ = np.flatnonzero(~known[b:b + TILE]) + b
                if len(open_):
                    met = np.zeros((len(first), len(open_)), np.float32)
                    for a in range(0, len(q), TILE):
                        met += first[:, a:a + TILE].astype(np.float32) @ self.near(q[a:a + TILE], r[open_]).astype(np.float32)
                    hit = (met > 0) & last[:, open_]
                    for s, a, e in zip(sets, starts, starts[1:]):
                        self.marked(s, len(s) - 1, r[open_][hit[a:e].any(0)])

    def add(self, sets, rows, which, starts, met, columns, at: int) -> None:
        """Instances per (row, column); the columns' points are the ``at``-th of the sets."""
        per_row = met @ self.n[columns]
        for s, i, a, e in zip(sets, which, starts, starts[1:]):
            points = rows[i][1]
            self.found[s] += int((per_row[a:e] * np.prod(self.n[points], axis=1)).sum())
            self.marked(s, at, columns[met[a:e].any(0)])
            hit = points[per_row[a:e] > 0]
            for j in range(points.shape[1]):
                self.marked(s, j, hit[:, j])

    def table(self) -> pa.Table:
        out: list[list] = [[] for _ in range(8)]

        def put(size, *columns):
            for have, c in zip(out, columns):
                have.append(np.full(size, c) if np.isscalar(c) else c)

        words: dict[int, np.ndarray] = {}
        for s, instances in self.found.items():
            if instances:
                put(1, self.sets[s], instances, np.nan, np.nan, -1, 0, -1, 0)
                word, bit = divmod(self.sets[s], WORD)
                mask = words.setdefault(word, np.zeros(len(self.x), np.int64))
                for k, used in zip(s, self.used[s]):
                    a, b = self.of[k]
                    mask[a:b][used] |= np.int64(1) << np.int64(bit)
        for word, mask in words.items():
            at = np.flatnonzero(mask)
            put(len(at), -1, 0, self.x[at], self.y[at], self.t[at], self.n[at], word, mask[at])
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in FOUND.split(", ")]
        return pa.table({name: pa.array(np.concatenate(c) if c else [], kind) for name, c, kind in zip(names, out, kinds)})


def _counted(radius: float, sets: dict[tuple[int, ...], int]):
    def task(group: pa.Table) -> pa.Table:
        cell = _Cell(*[group.column(c).to_numpy() for c in ("x", "y", "t", "n", "_own")], radius, sets)
        if cell.heads:
            cell.run()
        return cell.table()

    return task


def _neighbourhoods(spots: DataFrame, radius: float, split_rows: int) -> DataFrame:
    """(x, y, t, n, _own, _c0, _c1, _i): the points of each cell, in parts, and all that they may reach.

    A cell is cut into parts where its work, own positions times the square of those around, asks for it."""
    keys, around = ["_c0", "_c1"], list(itertools.product((-1, 0, 1), repeat=2))
    at, cell = [F.col("x"), F.col("y")], radius * WIDEN
    counts = _own_cell(spots, at, cell).groupBy(*keys).agg(F.count("*").alias("_n"))
    reached = _shifted(counts, 2, around).groupBy(*keys).agg(F.sum("_n").alias("_m"))
    parts = counts.join(reached, keys).select(*keys, F.greatest(
        F.ceil(F.col("_n") / split_rows), F.ceil(F.least(F.col("_n") * F.pow("_m", F.lit(2.0)) / GROUP_WORK, F.col("_n").cast("double")))).cast("int").alias("_parts"))
    copies = _reached(spots, at, cell, around).withColumn("_home", (F.col("_o.o0") == 0) & (F.col("_o.o1") == 0)).drop("_o")
    every = copies.join(parts, keys).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    own = F.col("_home") & (F.pmod(F.xxhash64("x", "y", "t"), F.col("_parts")) == F.col("_i"))
    return every.select("x", "y", "t", "n", own.alias("_own"), *keys, "_i")


def colocations(points: DataFrame, key: str, kind: str, xy: tuple[str, str], radius: float, least: float, largest: int,
                split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(types, size, instances, participation): sets of two to ``largest`` types with an index of at least ``least``.

    ``key`` is unique. Points without a type or a finite position take part in nothing and
    count in no share. Types come as strings in ascending order. The number of types is
    meant to be small: they and their sets are listed on the driver.
    """
    spark, radius = points.sparkSession, float(radius)
    rows = points.where(F.col(kind).isNotNull() & valid_xy(*xy)).select(
        F.col(kind).cast("string").alias("type"), F.col(xy[0]).cast("double").alias("x"), F.col(xy[1]).cast("double").alias("y"))
    found_spots = cut(rows.groupBy("x", "y", "type").agg(F.count("*").alias("n")))
    totals = {r.type: r.total for r in found_spots.groupBy("type").agg(F.sum("n").alias("total")).collect()}
    names = sorted(totals)
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(names)), "t int, type string"))
    spots = _neighbourhoods(found_spots.join(numbers, "type").select("x", "y", "t", "n"), radius, split_rows)
    number = {name: i for i, name in enumerate(names)}
    result = spark.createDataFrame([], "types array<string>, size int, instances long, participation double")
    wanted, size = list(itertools.combinations(names, 2)), 2
    while wanted and size <= largest:
        sets = {tuple(number[k] for k in w): i for i, w in enumerate(wanted)}
        out = cut(spots.groupBy("_c0", "_c1", "_i").applyInArrow(_counted(radius, sets), FOUND))
        instances = {r.set: r.n for r in out.where("set >= 0").groupBy("set").agg(F.sum("instances").alias("n")).collect()}
        masks = out.where("set < 0").groupBy("x", "y", "t", "word").agg(F.max("n").alias("n"), F.bit_or("bits").alias("bits"))
        bit = masks.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))).where(F.expr("shiftright(bits, _b) & 1 = 1"))
        used = bit.groupBy((F.col("word") * WORD + F.col("_b")).alias("set"), "t").agg(F.sum("n").alias("used")).collect()
        share = dict.fromkeys(instances, 1.0)
        for r in used:
            share[r.set] = min(share[r.set], r.used / totals[names[r.t]])
        kept = [i for i in sorted(share) if share[i] >= least]
        result = result.unionByName(spark.createDataFrame([(list(wanted[i]), size, instances[i], share[i]) for i in kept], result.schema))
        wanted = _candidates({wanted[i] for i in kept})
        size += 1
    return result
