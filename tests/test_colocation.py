"""Sets of types that occur together, by listing every instance."""

import itertools
import math
import random

import pytest

from plumbgrid.operators import colocation

POINTS = "id long, kind string, x double, y double"


def plain(rows, radius, least, largest):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and math.isfinite(r[2]) and math.isfinite(r[3])]
    near = {(a[0], b[0]) for a in rows for b in rows if (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= radius * radius}
    of = {}
    for r in rows:
        of.setdefault(r[1], []).append(r[0])
    out = {}
    for size in range(2, largest + 1):
        for types in itertools.combinations(sorted(of), size):
            found = [()]
            for t in types:
                found = [(*f, p) for f in found for p in of[t] if all((q, p) in near for q in f)]
            if found:
                share = min(len({f[i] for f in found}) / len(of[t]) for i, t in enumerate(types))
                if share >= least:
                    out[types] = (size, len(found), pytest.approx(share))
    return out


@pytest.mark.parametrize("least, largest, split_rows", [(0.3, 4, 20_000), (0.0, 3, 20_000), (0.15, 5, 3), (1.0, 4, 20_000)])
def test_colocations(spark, least, largest, split_rows):
    rng = random.Random(9)
    rows, k = [], 0
    for _ in range(25):  # places where most of a, b, c, and some others are
        x, y = rng.uniform(0, 20), rng.uniform(0, 20)
        for kind, p in (("a", .9), ("b", .8), ("c", .8), ("d", .3), ("e", .2)):
            if rng.random() < p:
                k += 1
                rows.append((k, kind, x + rng.uniform(-.4, .4), y + rng.uniform(-.4, .4)))
    rows += [(500, None, 1.0, 1.0), (501, "a", None, 1.0), (502, "b", math.nan, 1.0), (503, "z", 99.0, 99.0), (504, "a", rows[0][2], rows[0][3])]
    got = colocation.colocations(spark.createDataFrame(rows, POINTS).repartition(3), "id", "kind", ("x", "y"), 1.0, least, largest, split_rows)
    assert {tuple(r.types): (r.size, r.instances, r.participation) for r in got.collect()} == plain(rows, 1.0, least, largest)


def test_no_points(spark):
    assert colocation.colocations(spark.createDataFrame([], POINTS), "id", "kind", ("x", "y"), 1.0, 0.1, 3).count() == 0


def test_sets_grow_from_known_parts_only():
    assert colocation._candidates({("a", "b"), ("a", "c"), ("b", "c"), ("b", "d")}) == [("a", "b", "c")]
    assert colocation._candidates(set()) == []


def test_what_is_written_grows_with_the_points(spark, monkeypatch):
    """A crowd of many instances, half of it copies: no table of pairs or instances is stored."""
    rng = random.Random(4)
    rows = [(i, "abcd"[i % 4], *((5.0, 5.0) if i % 2 else (rng.uniform(4, 6), rng.uniform(4, 6)))) for i in range(120)]
    written = []

    def counted(df, cut=colocation.cut):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(colocation, "cut", counted)
    monkeypatch.setattr(colocation, "TILE", 32, raising=False)
    got = colocation.colocations(spark.createDataFrame(rows, POINTS), "id", "kind", ("x", "y"), 1.0, 0.1, 4, 50)
    assert {tuple(r.types): (r.size, r.instances, r.participation) for r in got.collect()} == plain(rows, 1.0, 0.1, 4)
    assert max(written) <= 20 * len(rows)
