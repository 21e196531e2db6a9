"""Neighbourhood sums, autocorrelation, patterns, clusters and hulls with copies and crowds."""

import math
import random

import brute
import numpy as np
import pytest
from test_pairs import crowd

from plumbgrid.operators import (autocorr, clusters, components, grids, hulls, patterns,
                                 permutations, sums, weights)

XY = ("x", "y")


@pytest.fixture(scope="module")
def points():
    return [(i, x, y, float((i * 37) % 11) - 2.5) for i, x, y in crowd(6, 180)]


@pytest.fixture(scope="module")
def frame(spark, points):
    return spark.createDataFrame(points, "id long, x double, y double, v double").cache()


@pytest.mark.parametrize("radius,split_rows,crowded,leaf", [
    *[(r, *x) for r in (0.0004, 0.6) for x in ((9, 256, 4096), (20_000, 3, 40), (9, 0, 1))],
    (0.05, 20_000, 256, 4096), (0.05, 9, 0, 1), (0.6, 20_000, 256, 4096)])
def test_sums(frame, points, radius, split_rows, crowded, leaf, monkeypatch):
    monkeypatch.setattr(sums, "LEAF_PAIRS", leaf)
    monkeypatch.setattr(sums, "CHEAP_PAIRS", 0)
    value = {p[0]: p[3] for p in points}
    degree, lag = dict.fromkeys(value, 0), dict.fromkeys(value, 0.0)
    for a, b in brute.near(points, radius):
        degree[a] += 1
        lag[a] += value[b]
    for r in sums.sums_within(frame, XY, radius, "v", split_rows, crowded).collect():
        assert r.degree == degree[r.id] and r.lag == pytest.approx(lag[r.id], abs=1e-9)


def matrix(points, radius):
    w = np.zeros((len(points), len(points)))
    for a, b in brute.near(points, radius):
        w[a, b] = 1
    z = np.array([p[3] for p in points])
    return w, z - z.mean()


@pytest.mark.parametrize("standardise", [False, True])
def test_moran_and_geary(frame, points, standardise):
    w, z = matrix(points, 0.3)
    if standardise:
        w = w / np.maximum(w.sum(axis=1, keepdims=True), 1)
    n, total = len(z), w.sum()
    got = autocorr.moran(frame, XY, "v", 0.3, standardise).first()
    assert got.weight_sum == pytest.approx(total)
    assert got.moran_i == pytest.approx(n / total * (z @ w @ z) / (z @ z))
    spread = (w * (z[:, None] - z[None, :]) ** 2).sum()
    assert autocorr.geary(frame, XY, "v", 0.3, standardise).first().geary_c == pytest.approx(
        (n - 1) * spread / (2 * total * (z @ z)))


def test_local_statistics(frame, points):
    w, z = matrix(points, 0.3)
    degree = w.sum(axis=1)
    for r in autocorr.local_moran(frame, "id", XY, "v", 0.3).collect():
        if degree[r.id] == 0:
            assert r.local_i is None and r.quadrant is None
        else:
            expected = z[r.id] * (w[r.id] @ z) / degree[r.id] / (z @ z / len(z))
            assert r.local_i == pytest.approx(expected, abs=1e-9)
    n = len(z)
    for r in autocorr.hot_spots(frame, "id", XY, "v", 0.3).collect():
        k = degree[r.id] + 1
        scale = math.sqrt(z @ z / n) * math.sqrt((n * k - k * k) / (n - 1))
        assert r.gi_star == pytest.approx((w[r.id] @ z + z[r.id]) / scale, abs=1e-9)


@pytest.mark.parametrize("crowded,leaf", [(256, 4096), (2, 30), (0, 1)])
def test_variogram_and_ripley_count_copies(frame, points, crowded, leaf, monkeypatch):
    monkeypatch.setattr(sums, "LEAF_PAIRS", leaf)
    monkeypatch.setattr(sums, "CHEAP_PAIRS", 0)
    found = {r.bin: (r.pairs, r.gamma) for r in autocorr.variogram(
        frame, XY, "v", 0.25, 4, crowded=crowded).collect()}
    bins = {}
    for a in points:
        for b in points:
            if a[0] < b[0]:
                lag = math.floor(math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) / 0.25)
                if lag < 4:
                    bins.setdefault(lag, []).append((a[3] - b[3]) ** 2)
    assert {k: v[0] for k, v in found.items()} == {k: len(v) for k, v in bins.items()}
    for lag, squares in bins.items():
        assert found[lag][1] == pytest.approx(sum(squares) / (2 * len(squares)))
    radii = [0.0002, 0.0007, 0.1, 1.0]
    for r in patterns.ripley(frame, XY, radii, crowded=crowded).collect():
        assert r.pairs == len(brute.near(points, r.radius))


@pytest.mark.parametrize("tiled", [1e12, 0])
def test_classes_of_a_crowd_are_compared_in_one_pass(frame, points, tiled, monkeypatch):
    from plumbgrid.operators import tiles

    monkeypatch.setattr(sums, "LEAF_PAIRS", 30)
    monkeypatch.setattr(sums, "CHEAP_PAIRS", 0)
    monkeypatch.setattr(sums, "TILED_PAIRS", tiled, raising=False)
    monkeypatch.setattr(tiles, "PART_PAIRS", 100)
    monkeypatch.setattr(tiles, "BLOCK", 640)
    written = []
    monkeypatch.setattr(sums, "cut", lambda df, cut=sums.cut: written.append(1) or cut(df))
    radii = [0.0002, 0.0007, 0.1, 1.0]
    for r in patterns.ripley(frame, XY, radii, 11, crowded=2).collect():
        assert r.pairs == len(brute.near(points, r.radius))
    assert (len(written) == 1) == (tiled > 0)
    found = {r.bin: r.pairs for r in autocorr.variogram(frame, XY, "v", 0.25, 4, 11, crowded=2).collect()}
    assert sum(found.values()) == sum(a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) < 1 for a in points for b in points)


def test_weights(frame, points):
    near = brute.near(points, 0.3)
    degree = {}
    for a, _ in near:
        degree[a] = degree.get(a, 0) + 1
    got = {(r.i, r.j): r.w for r in weights.band_weights(frame, "id", XY, 0.3, True, 11).collect()}
    assert set(got) == near and all(w == pytest.approx(1 / degree[i]) for (i, _), w in got.items())


@pytest.mark.parametrize("eps,min_points,split_rows",
                         [(0.3, 5, 20_000), (0.3, 5, 8), (0.0004, 4, 8), (0.6, 12, 20_000), (0.2, 1, 30)])
def test_dbscan(frame, points, eps, min_points, split_rows):
    got = clusters.dbscan(frame, "id", XY, eps, min_points, split_rows)
    assert {tuple(r) for r in got.collect()} == brute.dbscan(points, eps, min_points)


def test_dbscan_on_touching_blobs(spark):
    """Two crowded cells whose only near pair lies at their facing rims."""
    spots = [(i, 0.001 * i, 0.0) for i in range(40)] + [(100 + i, 1.0 + 0.001 * i, 0.0) for i in range(40)]
    df = spark.createDataFrame(spots, "id long, x double, y double")
    for eps in (0.9605, 0.9615):
        got = {tuple(r) for r in clusters.dbscan(df, "id", XY, eps, 5).collect()}
        assert got == brute.dbscan(spots, eps, 5)


def test_components_of_paths_and_stars(spark):
    import random
    names = list(range(400))
    random.Random(3).shuffle(names)
    path, star = names[:200], names[200:390]
    edges = list(zip(path, path[1:])) + [(star[0], s) for s in star[1:]]
    got = components.components(spark.createDataFrame([(n,) for n in names], "node long"),
                                spark.createDataFrame(edges, "a long, b long"))
    root = {n: n for n in names}
    root.update(dict.fromkeys(path, min(path)) | dict.fromkeys(star, min(star)))
    assert {r.node: r.component for r in got.collect()} == root


def test_components_of_ordered_reversed_and_zigzag_paths(spark):
    n = 300
    zigzag = [i // 2 if i % 2 == 0 else n - 1 - i // 2 for i in range(n)]
    for k, path in enumerate((list(range(n)), list(range(n))[::-1], zigzag)):
        nodes = spark.createDataFrame([(v,) for v in path] + [(n + 5,)], "node long")
        edges = spark.createDataFrame(list(zip(path, path[1:])) + [(3, 3), (4, 5), (5, 4)], "a long, b long")
        got = {r.node: r.component for r in components.components(nodes, edges).collect()}
        assert got == dict.fromkeys(range(n), 0) | {n + 5: n + 5}, k


def test_dbscan_of_a_line_is_one_cluster(spark):
    rows = [(i, float(i), 0.0) for i in range(40)]
    got = clusters.dbscan(spark.createDataFrame(rows, "id long, x double, y double"), "id", XY, 1.0, 2)
    assert {r.cluster for r in got.collect()} == {0}


def test_hulls(spark):
    square = [(1, float(x), float(y)) for x in range(5) for y in range(5)] * 3
    rows = square + [(2, 1.0, 1.0)] * 4 + [(3, 0.0, 0.0), (3, 1.0, 1.0), (3, 2.0, 2.0), (3, None, 1.0)]
    df = spark.createDataFrame(rows, "g long, x double, y double").repartition(7)
    got = {}
    for r in hulls.convex_hulls(df, "g", XY).orderBy("g", "seq").collect():
        got.setdefault(r.g, []).append((r.x, r.y))
    assert got == {1: [(0, 0), (4, 0), (4, 4), (0, 4)], 2: [(1, 1)], 3: [(0, 0), (2, 2)]}


def test_index_and_permutation(spark, frame, points):
    numbered = permutations.with_index(frame.select("id", "v").repartition(5), "v", "id")
    got = [(r.v, r.id) for r in numbered.orderBy("index").collect()]
    assert got == sorted((p[3], p[0]) for p in points)
    assert sorted(r["index"] for r in numbered.collect()) == list(range(len(points)))
    drawn = permutations.permuted(frame, "id", "v", 6).collect()
    assert len(drawn) == len(points)
    for r in range(6):
        assert sorted(d["values"][r] for d in drawn) == sorted(p[3] for p in points)
    test = permutations.global_test(frame, "id", XY, "v", 0.3, 6).first()
    assert test.moran_i == pytest.approx(autocorr.moran(frame, XY, "v", 0.3).first().moran_i)
    w, _ = matrix(points, 0.3)
    z = np.array([p[3] for p in points]) - np.mean([p[3] for p in points])
    draws = {d.id: d["values"] for d in drawn}
    stats = []
    for r in range(6):
        v = np.array([draws[p[0]][r] for p in points])
        v = v - v.mean()
        stats.append(len(v) / w.sum() * (v @ w @ v) / (v @ v))
    assert test.moran_as_large == sum(s >= len(z) / w.sum() * (z @ w @ z) / (z @ z) for s in stats)
    assert test.geary_c == pytest.approx(autocorr.geary(frame, XY, "v", 0.3).first().geary_c)
    local = permutations.local_test(frame, "id", XY, "v", 0.3, 6).collect()
    lags = [w @ (np.array([draws[p[0]][r] for p in points]) - np.mean([p[3] for p in points]))
            for r in range(6)]
    far = [r for r in local if abs((w @ z)[r.id]) > 1e-6 and abs(z[r.id]) > 1e-6 and r.degree]
    for r in far:
        beats = sum(lag[r.id] * z[r.id] >= (w @ z)[r.id] * z[r.id] - 1e-9 for lag in lags)
        assert r.local_p == pytest.approx((beats + 1) / 7, abs=1e-9)
    assert len(local) == len(points) and len(far) > 20


def test_local_test_counts_ties(spark):
    rows = [(i, float(i % 9), float(i // 9), float(i % 3 == 0 or i % 7 == 1)) for i in range(63)]
    df = spark.createDataFrame(rows, "id long, x double, y double, v double")
    draws = {d.id: d["values"] for d in permutations.permuted(df, "id", "v", 19).collect()}
    got = {r.id: r for r in permutations.local_test(df, "id", XY, "v", 1.0, 19).collect()}
    for i, x, y, v in rows:
        near = [j for j, a, b, _ in rows if (a - x) ** 2 + (b - y) ** 2 <= 1]
        own = sum(rows[j][3] for j in near)
        hot = sum(sum(draws[j][r] for j in near) >= own for r in range(19))
        assert got[i].hot_p == pytest.approx((hot + 1) / 20), i


def test_statistics_leave_out_rows_without_position_or_value(spark, points):
    bad = [(900, None, 0.1, 1000.0), (901, float("nan"), 0.1, 1000.0), (902, 0.1, float("inf"), 1000.0),
           (903, 0.1, 0.1, float("nan")), (904, 0.1, 0.1, None)]
    rows = [tuple(p[:4]) for p in points]
    schema = "id long, x double, y double, v double"
    clean, dirty = [spark.createDataFrame(r, schema) for r in (rows, rows + bad)]
    for run in (lambda d: autocorr.moran(d, XY, "v", 0.3), lambda d: autocorr.geary(d, XY, "v", 0.3)):
        assert list(run(dirty).first()) == pytest.approx(list(run(clean).first()))
    gi = [{r.id: r.gi_star for r in autocorr.hot_spots(d, "id", XY, "v", 0.3).collect()} for d in (clean, dirty)]
    assert {k: pytest.approx(v) for k, v in gi[0].items()} == gi[1]
    test = permutations.global_test(dirty, "id", XY, "v", 0.3, 3).first()
    assert test.moran_i == pytest.approx(autocorr.moran(dirty, XY, "v", 0.3).first().moran_i)


def test_grid_is_complete_and_quadrats_count_the_empty(frame, points):
    cells = {(r.col, r.row) for r in grids.grid_centres(frame, XY, 0.5).collect()}
    cols = [math.floor(p[1] / 0.5) for p in points]
    rows = [math.floor(p[2] / 0.5) for p in points]
    assert cells == {(c, r) for c in range(min(cols), max(cols) + 1)
                     for r in range(min(rows), max(rows) + 1)}
    counts = {}
    for cell in zip(cols, rows):
        counts[cell] = counts.get(cell, 0) + 1
    full = np.array([counts.get(c, 0) for c in cells])
    got = patterns.quadrat_test(frame, XY, 0.5).first()
    assert got.cells == len(cells) and got.ratio == pytest.approx(full.var(ddof=1) / full.mean())


def test_inverse_distance_at_a_point(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, 7.0), (2, 0.5, 0.5, 9.0), (3, 2.0, 1.6, 1.0)],
                               "id long, x double, y double, v double")
    got = {(r.col, r.row): r.estimate for r in grids.inverse_distance(df, "id", XY, "v", 1.0, 3).collect()}
    assert got[0, 0] == 8.0 and len(got) == 6


def test_cells_near_points_only(spark):
    """A stray point a billion cells away adds its own surroundings; estimates stay those of the whole grid."""
    rng = random.Random(12)
    spots = [(i, rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(0, 9)) for i in range(25)] + [(99, 1e9, -1e9, 4.0), (98, None, 1.0, 1.0)]
    df = spark.createDataFrame(spots, "id long, x double, y double, v double")
    got = {(r.col, r.row): r.estimate for r in grids.inverse_distance(df, "id", XY, "v", 1.0, 3, reach=1).collect()}
    known = [p for p in spots if p[1] is not None]
    assert set(got) == {(int(p[1] // 1) + a, int(p[2] // 1) + b) for p in known for a in (-1, 0, 1) for b in (-1, 0, 1)}
    whole = grids.inverse_distance(df.where("id < 98"), "id", XY, "v", 1.0, 3)
    for r in whole.where("col between 2 and 3 and row between 2 and 3").collect():
        if (r.col, r.row) in got:
            assert got[r.col, r.row] == pytest.approx(r.estimate)
