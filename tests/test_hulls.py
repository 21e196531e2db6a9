"""What goes before the hull is made, and that no corner does."""

import random

import numpy as np
import pytest

from plumbgrid.operators import hulls

POINTS = "g string, x double, y double"


def cloud(seed):
    rng = random.Random(seed)
    rows = [("crowd", rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(2_000)]
    rows += [("ring", float(np.cos(k)), float(np.sin(k))) for k in range(300)]
    rows += [("grid", float(x), float(y)) for x in range(12) for y in range(12)]
    rows += [("line", float(k), 2.0 * k) for k in range(50)] + [("one", 1.0, 1.0)] * 5 + [("two", 0.0, 0.0), ("two", 1.0, 0.5)]
    return rows + [(None, rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(200)] + [("far", 1e9 + rng.random(), 1e9 + rng.random()) for _ in range(300)]


@pytest.mark.parametrize("groups", [50_000, 2])
def test_no_corner_is_dropped(spark, monkeypatch, groups):
    monkeypatch.setattr(hulls, "SMALL_GROUPS", groups)
    rows = cloud(1)
    df = spark.createDataFrame(rows, POINTS).repartition(4)
    kept = hulls.outer(df, "g").collect()
    assert len([r for r in kept if r.g == "crowd"]) < 600 and len([r for r in kept if r.g == "grid"]) < 144
    got = {}
    for r in hulls.convex_hulls(df, "g", ("x", "y")).orderBy("seq").collect():
        got.setdefault(r.g, []).append((r.x, r.y))
    for g in {r[0] for r in rows}:
        want = hulls.hull_corners(np.array([r[1:] for r in rows if r[0] == g]))
        assert got[g] == [tuple(c) for c in want.tolist()]
