"""Windows of rasters by brute force: sparse cells, borders of tiles, odd values."""

import math
import random

import pytest

from plumbgrid.operators import rasters

CELLS = "band string, row int, col int, value double"


def plain(rows, reach):
    out = {}
    rows = [r for r in rows if r[3] is not None]
    for band, r, c, _ in rows:
        near = [v for b, y, x, v in rows if b == band and abs(y - r) <= reach and abs(x - c) <= reach]
        known = [v for v in near if not math.isnan(v)]
        out[band, r, c] = (len(near), math.fsum(near) / len(near) if all(map(math.isfinite, near)) else sum(near) / len(near),
                           min(known, default=math.nan), math.nan if len(known) < len(near) else max(known))
    return out


@pytest.mark.parametrize("reach, tile", [(0, 4), (1, 4), (2, 4), (3, 5), (7, 4), (2, 256)])
@pytest.mark.parametrize("odd", [False, True])
def test_focal(spark, reach, tile, odd):
    rng = random.Random(reach)
    special = [math.nan, math.inf, -math.inf] if odd else []
    rows = [(b, rng.randrange(-9, 9), rng.randrange(-9, 9), rng.choice(special) if special and rng.random() < .05 else rng.uniform(-5, 5))
            for b in ("a", "b", None) for _ in range(60)]
    rows += [("a", 0, 0, None), ("a", 10 ** 6, -10 ** 6, 4.0), ("a", 0, 1, 2.0), ("a", 0, 1, 3.0)]
    cells = spark.createDataFrame(rows, CELLS).repartition(3)
    got = {(r.band, r.row, r.col): (r.n, r["mean"], r.low, r.high) for r in rasters.focal_tiles(cells, reach, tile).collect()}
    want = plain(rows, reach)
    assert got.keys() == want.keys()
    for k, (n, *values) in want.items():
        assert got[k][0] == n and list(got[k][1:]) == pytest.approx(values, nan_ok=True, abs=1e-12)
    if reach <= 1 and not odd:
        copied = {(r.band, r.row, r.col): (r.n, r["mean"], r.low, r.high) for r in rasters.focal(cells, reach).collect()}
        assert copied.keys() == got.keys() and all(copied[k] == pytest.approx(got[k]) for k in got)


def test_far_sums_cost_no_digits(spark):
    rows = [("a", 0, c, 1e15 if c < 256 else 0.1) for c in range(600)]
    got = rasters.focal(spark.createDataFrame(rows, CELLS), 3).where("col > 520").collect()
    assert all(r["mean"] == pytest.approx(0.1, rel=1e-12) for r in got) and len(got) == 79


def test_nothing(spark):
    assert rasters.focal(spark.createDataFrame([], CELLS), 5).count() == 0
