"""Zones: boundaries, holes, crowded cells and large rings."""

import math
import random

import brute
import pytest
from pyspark.sql import Row

from plumbgrid.functions import planar, polygon, sphere
from plumbgrid.operators import zones
from plumbgrid.streaming.live import with_zone


def edge_rows(zone, ring, start=0):
    return [(zone, start + i, *map(float, ring[i]), *map(float, ring[(i + 1) % len(ring)]))
            for i in range(len(ring))]


def star(cx, cy, radius, corners, seed):
    rng = random.Random(seed)
    return [(cx + radius * (0.4 + 0.6 * rng.random()) * math.cos(2 * math.pi * i / corners),
             cy + radius * (0.4 + 0.6 * rng.random()) * math.sin(2 * math.pi * i / corners))
            for i in range(corners)]


@pytest.fixture(scope="module")
def shapes():
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    beside = [(4, 0), (8, 1), (8, 4), (4, 4)]
    slanted = [(8, 1), (12, 0), (11, 7), (8, 4)]
    rows = edge_rows(1, square) + edge_rows(1, [(1, 1), (1, 3), (3, 3), (3, 1)], 4)
    rows += edge_rows(2, beside) + edge_rows(3, slanted)
    rows += edge_rows(4, star(5, 5, 6, 60, 3)) + edge_rows(5, [(20, 20), (21, 20), (20.5, 21)])
    return rows


@pytest.fixture(scope="module")
def spots():
    rng = random.Random(8)
    grid = [(x / 2, y / 2) for x in range(-2, 26) for y in range(-4, 24)]
    return [(i, *p) for i, p in enumerate(grid + [(rng.uniform(-2, 13), rng.uniform(-2, 12))
                                                  for _ in range(300)] + [(2.5, 0.5)] * 60)]


EDGES = "zone_id long, seq int, x1 double, y1 double, x2 double, y2 double"
POINTS = "id long, x double, y double"


def expected(spots, shapes):
    zone_edges = {}
    for zone, _, *e in shapes:
        zone_edges.setdefault(zone, []).append(e)
    return {(p[0], z) for p in spots for z, e in zone_edges.items() if brute.inside(p[1], p[2], e)}


@pytest.mark.parametrize("cell", [0.5, 1.0, 3.7, 50.0])
def test_locate_at_every_grid(spark, shapes, spots, cell):
    found = zones.locate(spark.createDataFrame(spots, POINTS), spark.createDataFrame(shapes, EDGES),
                         cell, ("x", "y"))
    rows = [(r.id, r.zone_id) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected(spots, shapes)


def test_locate_without_broadcast_in_parts(spark, shapes, spots, monkeypatch):
    """Shuffled by cell, with crowded cells and rings cut up."""
    monkeypatch.setattr(zones, "CHUNK_EDGES", 3)
    found = zones.locate(spark.createDataFrame(spots, POINTS), spark.createDataFrame(shapes, EDGES),
                         2.0, ("x", "y"), split_rows=10, broadcast_bytes=0)
    rows = [(r.id, r.zone_id) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected(spots, shapes)


def test_semi_and_anti_cover_all(spark, shapes, spots):
    points = spark.createDataFrame([*spots, (9001, None, 1.0), (9002, float("nan"), 1.0)], POINTS)
    edges = spark.createDataFrame(shapes, EDGES)
    inside = {i for i, _ in expected(spots, shapes)}
    semi = zones.locate(points, edges, 1.0, ("x", "y"), how="left_semi", key="id")
    anti = zones.locate(points, edges, 1.0, ("x", "y"), how="left_anti", key="id")
    assert sorted(r.id for r in semi.collect()) == sorted(inside)
    outside = ({p[0] for p in spots} | {9001, 9002}) - inside
    assert sorted(r.id for r in anti.collect()) == sorted(outside)


def test_tiles_share_no_point(spark):
    """On a tiling with slanted shared edges every point falls in exactly one tile."""
    rng = random.Random(4)
    corner = {(i, j): (i + rng.uniform(-.3, .3) * (0 < i < 4), j + rng.uniform(-.3, .3) * (0 < j < 4))
              for i in range(5) for j in range(5)}
    rows = []
    for i in range(4):
        for j in range(4):
            rows += edge_rows(i * 4 + j, [corner[i, j], corner[i + 1, j], corner[i + 1, j + 1],
                                          corner[i, j + 1]])
    spots = [(n, *corner[n % 4, n // 4]) for n in range(16)]
    spots += [(100 + n, rng.uniform(0, 4), rng.uniform(0, 4)) for n in range(400)]
    found = zones.locate(spark.createDataFrame(spots, POINTS), spark.createDataFrame(rows, EDGES),
                         0.8, ("x", "y"))
    assert sorted(r.id for r in found.collect()) == sorted(s[0] for s in spots)


def test_with_zone_takes_the_smallest(spark, shapes, spots):
    points = spark.createDataFrame([*spots, (9001, None, 1.0)], POINTS)
    out = with_zone(points, spark.createDataFrame(shapes, EDGES), 1.0, ("x", "y")).collect()
    best = {}
    for i, z in expected(spots, shapes):
        best[i] = min(z, best.get(i, z))
    assert {r.id: r.zone_id for r in out} == {**{s[0]: None for s in spots}, 9001: None, **best}


def test_polygon_value_and_empty_zone(spark, shapes, spots):
    points = spark.createDataFrame(spots, POINTS)
    edges = spark.createDataFrame(shapes, EDGES)
    held = edges.where("zone_id = 1").selectExpr("collect_list(struct(x1, y1, x2, y2)) AS edges")
    inside = points.join(held).where(polygon.inside("x", "y", "edges"))
    assert {r.id for r in inside.collect()} == {i for i, z in expected(spots, shapes) if z == 1}
    stats = zones.zonal_stats(points, edges, 1.0, ("x", "y"), "id").where("zone_id = 5").first()
    assert stats.n == 0 and stats.total is None


def test_measures_of_a_ring_with_a_hole(spark, shapes):
    row = zones.zone_measures(spark.createDataFrame(shapes, EDGES)).where("zone_id = 1").first()
    assert row == Row(zone_id=1, area=12.0, perimeter=24.0, cx=2.0, cy=2.0)


def test_closing_edge(spark):
    rings = spark.createDataFrame([(1, [Row(x=0., y=0.), Row(x=1., y=0.), Row(x=1., y=1.)])],
                                  "zone_id long, ring array<struct<x: double, y: double>>")
    assert [tuple(r) for r in zones.ring_edges(rings).orderBy("seq").collect()] == edge_rows(
        1, [(0, 0), (1, 0), (1, 1)])


def test_points_are_not_shuffled(spark, shapes, spots):
    found = zones.locate(spark.createDataFrame(spots, POINTS), spark.createDataFrame(shapes, EDGES),
                         1.0, ("x", "y"))
    text = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text and "EvalPython" not in text


def test_validity_is_never_null(spark):
    rows = [(None, 1.0), (float("nan"), 1.0), (1.0, float("inf")), (1.0, 2.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert [r[0] for r in df.select(planar.valid_xy("x", "y")).collect()] == [False, False, False, True]


def test_unknown_positions_have_no_distance(spark):
    df = spark.createDataFrame([(None, 1.0)], "lon double, lat double")
    lon2, lat2 = sphere.destination("lon", "lat", 90.0, 1000.0)
    row = df.select(sphere.haversine("lon", "lat", "lat", "lat"), sphere.bearing("lat", "lat", "lon", "lat"),
                    lon2, planar.distance("lon", "lat", "lat", "lat")).first()
    assert list(row) == [None] * 4


def test_detailed_zones_keep_equal_points(spark):
    import math
    inside = [(0.1, 0.1, 1.0)] * 2 + [(-0.2, 0.3, 2.0)] * 3 + [(0.5, -0.5, 9.0), (2.0, 0.0, 5.0)]
    points = spark.createDataFrame(inside, "x double, y double, v double")
    for n in (500, 2000):
        ring = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
        rings = spark.createDataFrame([(1, [dict(x=a, y=b) for a, b in ring])],
                                      "zone_id int, ring array<struct<x:double,y:double>>")
        row = zones.zonal_stats(points, zones.ring_edges(rings), 4.0, ("x", "y"), "v").first()
        assert (row.n, row.total) == (6, 17.0), n


def test_parts_of_a_zone_with_many_rings_are_bounded(spark):
    rings = [(1, [dict(x=a + u, y=b + w) for u, w in ((0.1, 0.1), (0.3, 0.1), (0.2, 0.3))])
             for a in range(40) for b in range(25)]
    edges = zones.ring_edges(spark.createDataFrame(rings, "zone_id int, ring array<struct<x:double,y:double>>"))
    cover = zones.zone_cover(edges, 1000.0)
    from pyspark.sql import functions as F
    assert cover.agg(F.max(F.size("_edges"))).first()[0] <= 2 * zones.CHUNK_EDGES


def test_extents_leave_out_unknown_positions(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0), (None, 4.0)], "x double, y double")
    assert tuple(zones.extents(df, "x", "y").first()) == (1.0, 2.0, 1.0, 2.0, 1)
