"""As-of joins, interval joins, crossings and closest pairs by brute force."""

import datetime as dt
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plumbgrid.operators import asof, closest, crossings, intervals

START = dt.datetime(2024, 3, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def asof_tables(spark, seed, n=150, zone="timestamp_ntz"):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    lefts = [(i, rng.choice(keys), 1, at(rng.randrange(0, 400_000, 50)) if rng.random() > .05 else None) for i in range(n)]
    rights = [(rng.choice(keys), 1, at(rng.randrange(0, 400_000, 50)) if rng.random() > .05 else None, j, rng.choice([None, j])) for j in range(n)]
    lefts += [(900, "hot", 2, at(10)), (901, "none", 1, at(10))]
    rights += [("hot", 1, at(77_000), 800, 1), ("hot", 1, at(77_000), 801, None), ("hot", 1, at(-9_000_000), 802, 5)]
    lefts += [(902, "hot", 1, at(77_000)), (903, "hot", 1, at(77_000)), (904, "late", 1, at(0))]
    a = spark.createDataFrame(lefts, f"i int, k string, m int, t {zone}").repartition(3)
    b = spark.createDataFrame(rights, f"rk string, rm int, rt {zone}, j int, v int").repartition(2)
    return lefts, rights, a, b


def asof_plain(lefts, rights, tolerance, strict):
    out = set()
    for i, k, m, t in lefts:
        fits = [(rt, j, v) for rk, rm, rt, j, v in rights if None not in (k, t, rk, rt) and (rk, rm) == (k, m)
                and (rt < t if strict else rt <= t)]
        best = max(fits, default=None, key=lambda x: x[:2])
        if best and tolerance is not None and (t - best[0]).total_seconds() > tolerance:
            best = None
        out.add((i, *(best or (None, None, None))))
    return out


@pytest.mark.parametrize("tolerance, strict, rows", [(None, False, 1_000_000), (5_000, False, 1_000_000), (None, True, 1_000_000),
                                                     (20_000, True, 3), (None, False, 1)])
def test_asof(spark, monkeypatch, tolerance, strict, rows):
    monkeypatch.setattr(asof, "FAN", 3)
    lefts, rights, a, b = asof_tables(spark, 4)
    keys = [("k", "rk"), ("m", "rm")]
    args = dict(tolerance=tolerance, strict=strict, bucket_rows=rows)
    got = [tuple(r) for r in asof.asof(a, b, keys, "t", "rt", "j", ["rt", "j", "v"], **args).select("i", "rt", "j", "v").collect()]
    want = asof_plain(lefts, rights, tolerance, strict)
    assert len(got) == len(lefts) and set(got) == want
    inner = asof.asof(a, b, keys, "t", "rt", "j", ["j"], how="inner", **args)
    assert {(r.i, r.j) for r in inner.collect()} == {(i, j) for i, _, j, _ in want if j is not None}


def test_asof_of_nothing_and_of_clashes(spark):
    _, _, a, b = asof_tables(spark, 5, 10, "timestamp")
    none = asof.asof(a, b.limit(0), [("k", "rk")], "t", "rt", "j", ["j"]).collect()
    assert len(none) == 15 and all(r.j is None for r in none)
    assert asof.asof(a.limit(0), b, [("k", "rk")], "t", "rt", "j", ["j"]).count() == 0
    with pytest.raises(ValueError):
        asof.asof(a, b.withColumnRenamed("v", "i"), [("k", "rk")], "t", "rt", "j", ["i"])
    with pytest.raises(ValueError):
        asof.asof(a, b.withColumn("rt", F.col("rt").cast("timestamp_ntz")), [("k", "rk")], "t", "rt", "j", ["j"])


def test_asof_windows_hold_one_bucket(spark):
    """No window is over the whole object: each has the bucket among its keys."""
    _, _, a, b = asof_tables(spark, 6)
    plan = asof.asof(a, b, [("k", "rk")], "t", "rt", "j", ["j"])._jdf.queryExecution().optimizedPlan().toString()
    upto = [line for line in plan.splitlines() if "Window [last" in line and "_row" not in line.split("Window")[0]]
    assert upto and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("split_rows", [20_000, 3])
def test_intervals(spark, split_rows):
    rng = random.Random(8)

    def made(n):
        out = []
        for i in range(n):
            s = rng.choice([rng.randrange(-5_000, 5_000), 100])
            length = rng.choice([0, -3, 1, 7, 8, 9, 63, 64, 65, 500, 4_000, 10 ** 9])
            out.append((i, rng.choice(["x", "x", "y", None]), s, s + length if rng.random() > .05 else None))
        return out

    lefts, rights = made(150), made(120)
    a = spark.createDataFrame(lefts, "i int, p string, s long, e long").repartition(3)
    b = spark.createDataFrame(rights, "j int, q string, rs long, re long").repartition(2)

    def meets(x, y):
        return None not in (x[3], y[3]) and max(x[2], y[2]) < min(x[3], y[3])

    got = [(r.i, r.j) for r in intervals.overlapping(a, b, ("s", "e"), ("rs", "re"), split_rows=split_rows).collect()]
    assert sorted(got) == sorted((x[0], y[0]) for x in lefts for y in rights if meets(x, y))
    keyed = intervals.overlapping(a, b, ("s", "e"), ("rs", "re"), [("p", "q")], split_rows)
    assert sorted((r.i, r.j) for r in keyed.collect()) == sorted(
        (x[0], y[0]) for x in lefts for y in rights if meets(x, y) and x[1] is not None and x[1] == y[1])
    assert keyed.columns == [*a.columns, *b.columns]


def test_intervals_of_times(spark):
    rows = [(1, at(0), at(60)), (2, at(59), at(61)), (3, at(60), at(60)), (4, None, at(9))]
    a = spark.createDataFrame(rows, "i int, s timestamp, e timestamp")
    b = a.toDF("j", "rs", "re")
    got = {(r.i, r.j) for r in intervals.overlapping(a, b, ("s", "e"), ("rs", "re")).collect()}
    assert got == {(1, 1), (2, 2), (1, 2), (2, 1)}
    assert intervals.overlapping(a, b.limit(0), ("s", "e"), ("rs", "re")).count() == 0
    with pytest.raises(ValueError):
        intervals.overlapping(a.withColumn("s", F.lit("x")), b, ("s", "e"), ("rs", "re"))


def test_a_long_interval_is_not_cut_up(spark):
    """A year among minutes is two rows a level, not one per minute."""
    a = spark.createDataFrame([(0, 0, 1 << 45)], "i int, s long, e long")
    b = spark.range(500).select(F.col("id").alias("j"), (F.col("id") * 60_000_000).alias("rs"), (F.col("id") * 60_000_000 + 9).alias("re"))
    levels = intervals._copies(a.withColumn("_n", intervals._level(F.col("e") - F.col("s")).cast("int")), [0, 1, 2], "s", "e", "_n")
    assert levels.count() <= 2
    assert intervals.overlapping(a, b, ("s", "e"), ("rs", "re")).count() == 500


def shares(a, b):
    """Whether two segments of rational ends share a point."""
    def turn(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    (a1, a2), (b1, b2) = [((Fraction(s[0]), Fraction(s[1])), (Fraction(s[2]), Fraction(s[3]))) for s in (a, b)]
    t = [turn(b1, b2, a1), turn(b1, b2, a2), turn(a1, a2, b1), turn(a1, a2, b2)]
    if not any(t):
        return max(min(a1, a2), min(b1, b2)) <= min(max(a1, a2), max(b1, b2))
    return t[0] * t[1] <= 0 and t[2] * t[3] <= 0


@pytest.mark.parametrize("cell, split_rows, grid", [(1.0, 20_000, True), (0.3, 2, True), (7.0, 20_000, False), (0.9, 5, False)])
def test_crossings(spark, cell, split_rows, grid):
    """On whole and half numbers every test is exact: ends, corners, overlaps and points included."""
    rng = random.Random(3)

    def number():
        return rng.randrange(-8, 9) / 2 if grid else rng.uniform(-5, 5)

    def made(n):
        out = [(i, *[number() for _ in range(4)]) for i in range(n)]
        out += [(n + i, x, y, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 2.0), (number(), number())])]
        out += [(n + 4, -9.0, 0.0, 9.0, 0.0), (n + 5, 0.0, 9.0, 0.0, -9.0), (n + 6, -9.0, -9.0, 9.0, 9.0)]
        return out

    lefts, rights = made(70), made(60)
    odd = [(900, None, 0.0, 1.0, 1.0), (901, float("nan"), 0.0, 1.0, 1.0), (902, float("inf"), 0.0, 1.0, 1.0)]
    a = spark.createDataFrame(lefts + odd, "i int, x1 double, y1 double, x2 double, y2 double").repartition(2)
    b = spark.createDataFrame(rights + odd, "j int, u1 double, v1 double, u2 double, v2 double").repartition(2)
    got = crossings.crossing(a, b, ("x1", "y1", "x2", "y2"), ("u1", "v1", "u2", "v2"), cell, split_rows=split_rows).collect()
    want = sorted((s[0], z[0]) for s in lefts for z in rights if shares(s[1:], z[1:]))
    assert sorted((r.i, r.j) for r in got) == want
    for r in got:
        for x1, y1, x2, y2 in ((r.x1, r.y1, r.x2, r.y2), (r.u1, r.v1, r.u2, r.v2)):
            length = math.hypot(x2 - x1, y2 - y1)
            off = abs((x2 - x1) * (r.y - y1) - (y2 - y1) * (r.x - x1)) / length if length else math.hypot(r.x - x1, r.y - y1)
            assert off < 1e-9 and min(x1, x2) - 1e-9 <= r.x <= max(x1, x2) + 1e-9 and min(y1, y2) - 1e-9 <= r.y <= max(y1, y2) + 1e-9


def closest_plain(a, b, k):
    pairs = sorted(((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2, p[0], q[0]) for p in a for q in b)
    return [(i, j, r) for r, (_, i, j) in enumerate(pairs[:k], 1)]


@pytest.mark.parametrize("shape, k", [("spread", 7), ("spread", 3_000), ("crowd", 40), ("one place", 5), ("line", 1), ("lattice", 40)])
def test_closest_pairs(spark, shape, k):
    rng = random.Random(k)

    def place(i):
        if shape == "crowd":
            return (rng.gauss(0, 1e-6), rng.gauss(0, 1e-6)) if i % 3 else (rng.uniform(-9, 9), rng.uniform(-9, 9))
        if shape == "one place":
            return (0.0, -0.0) if i % 2 else (0.0, 0.0)
        if shape == "line":
            return 5.0, rng.uniform(0, 1)
        return (rng.randrange(4) / 2, rng.randrange(4) / 2) if shape == "lattice" else (rng.uniform(-9, 9), rng.uniform(-9, 9))

    a, b = [[(i, *place(i)) for i in range(n)] for n in (45, 55)]
    left = spark.createDataFrame(a + [(99, None, 1.0), (98, float("nan"), 0.0)], "i int, x double, y double").repartition(3)
    right = spark.createDataFrame(b + [(99, float("inf"), 1.0)], "j int, x double, y double")
    got = closest.closest_pairs(left, right, k, "i", "j", ("x", "y"), ("x", "y"))
    assert sorted((r["rank"], r.i, r.j) for r in got.collect()) == [(r, i, j) for i, j, r in closest_plain(a, b, k)]


def test_the_bound_shrinks(spark):
    """Far fewer pairs are formed than a product has, and k of them at least."""
    rng = random.Random(1)
    a = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(2_000)], "i int, ax double, ay double")
    b = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(2_000)], "j int, bx double, by double")
    bound = closest.distance_bound(a, b, 50)
    near = sum((p.ax - q.bx) ** 2 + (p.ay - q.by) ** 2 <= bound ** 2 for p in a.collect() for q in b.collect())
    assert 50 <= near < 20_000
    assert closest.distance_bound(a.limit(0), b, 5) is None
    assert closest.closest_pairs(a.limit(0), b, 5, "i", "j", ("ax", "ay"), ("bx", "by")).count() == 0
