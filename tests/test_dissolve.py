"""Unions of zones: what the border encloses, and how it runs."""

import random

import pytest

from brute import inside
from plumbgrid.operators import dissolve

EDGES = "zone int, land string, x1 double, y1 double, x2 double, y2 double"


def box_edges(zone, land, x0, y0, x1, y1):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return [(zone, land, *map(float, ring[i]), *map(float, ring[(i + 1) % 4])) for i in range(4)]


def halved(box, rng, depth):
    """A tiling of a box by cuts at random places, so that corners lie within others' edges."""
    x0, y0, x1, y1 = box
    if depth == 0 or (x1 - x0 < 2 and y1 - y0 < 2):
        return [box]
    if x1 - x0 >= y1 - y0:
        m = rng.randrange(x0 + 1, x1)
        return halved((x0, y0, m, y1), rng, depth - 1) + halved((m, y0, x1, y1), rng, depth - 1)
    m = rng.randrange(y0 + 1, y1)
    return halved((x0, y0, x1, m), rng, depth - 1) + halved((x0, m, x1, y1), rng, depth - 1)


@pytest.mark.parametrize("seed, cell", [(1, 3.0), (2, 50.0), (3, 0.7)])
def test_unions(spark, seed, cell):
    rng = random.Random(seed)
    tiles = [(i, rng.choice(["p", "q", "r", None]), *b) for i, b in enumerate(halved((-8, -8, 9, 12), rng, 6))]
    edges = [e for z in tiles for e in box_edges(*z)]
    rng.shuffle(edges)
    bad = [(900, "p", None, 0.0, 1.0, 1.0), (901, "p", float("nan"), 0.0, 1.0, 1.0), (902, "p", 2.0, 2.0, 2.0, 2.0)]
    got = dissolve.dissolve(spark.createDataFrame(edges + bad, EDGES).repartition(3), "land", cell).collect()
    for land in "pqr":
        border = [(r.x1, r.y1, r.x2, r.y2) for r in got if r.land == land]
        mine = [z for z in tiles if z[1] == land]
        for x in range(-9, 10):
            for y in range(-9, 13):
                held = any(z[2] <= x < z[4] and z[3] <= y < z[5] for z in mine)
                assert inside(x + 0.25, y + 0.5, border) == held
        # Rings that run one way keep their area, and every corner is left as often as entered.
        assert sum(a * d - c * b for a, b, c, d in border) / 2 == sum((z[4] - z[2]) * (z[5] - z[3]) for z in mine)
        assert sorted((a, b) for a, b, _, _ in border) == sorted((c, d) for _, _, c, d in border)
    assert {r.land for r in got} == {"p", "q", "r"}


def test_one_zone_and_none(spark):
    one = spark.createDataFrame(box_edges(1, "a", 0, 0, 2, 1), EDGES)
    assert {tuple(r)[1:] for r in dissolve.dissolve(one, "land", 1.0).collect()} == {e[2:] for e in box_edges(1, "a", 0, 0, 2, 1)}
    assert dissolve.dissolve(one.limit(0), "land", 1.0).count() == 0
    named = dissolve.grouped(one.drop("land"), spark.createDataFrame([(1, "b")], "zone int, land string"), "zone", "land")
    assert {r.land for r in dissolve.dissolve(named, "land", 1.0).collect()} == {"b"}
