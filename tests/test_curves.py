"""The curve by its definition, ranges of boxes, and what a read leaves out."""

import glob
import random

import pyarrow.parquet as pq
import pytest

from plumbgrid.sources.curves import KEY, Curve, read_curve, write_curve


def cells_along(bits):
    """Cells of the curve in order, by joining four turned copies of the smaller one."""
    if not bits:
        return [(0, 0)]
    small, half = cells_along(bits - 1), 1 << bits - 1
    return ([(y, x) for x, y in small] + [(x, y + half) for x, y in small] + [(x + half, y + half) for x, y in small]
            + [(2 * half - 1 - y, half - 1 - x) for x, y in small])


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_keys_follow_the_curve(spark, bits):
    n = 1 << bits
    order = cells_along(bits)
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(order, order[1:]))
    curve = Curve((-1.0, 2.0, 3.0, 10.0), bits)
    rows = [(-1.0 + (x + 0.5) * 4 / n, 2.0 + (y + 0.5) * 8 / n, order.index((x, y))) for x in range(n) for y in range(n)]
    rows += [(-99.0, -99.0, order.index((0, 0))), (99.0, 99.0, order.index((n - 1, n - 1)))]
    got = spark.createDataFrame(rows, "x double, y double, want long").withColumn("d", curve.key("x", "y")).collect()
    assert all(r.d == r.want for r in got)


@pytest.mark.parametrize("most", [1, 8, 48, 5_000])
def test_ranges_hold_the_box(most):
    rng = random.Random(most)
    curve = Curve((0.0, 0.0, 32.0, 32.0), 5)
    order = cells_along(5)
    for _ in range(40):
        x0, y0 = rng.uniform(-3, 33), rng.uniform(-3, 33)
        box = (x0, y0, x0 + rng.uniform(0, 20), y0 + rng.uniform(0, 20))
        found = curve.ranges(box, most)
        assert len(found) <= most + 3 and all(b[0] > a[1] + 1 for a, b in zip(found, found[1:]))
        inside = {k for k, (x, y) in enumerate(order) if x + 1 > box[0] and x < box[2] and y + 1 > box[1] and y < box[3]}
        held = {k for first, last in found for k in range(first, last + 1)}
        assert inside <= held
        if most == 5_000:
            around = {k for k, (x, y) in enumerate(order) if x + 3 > box[0] and x - 2 < box[2] and y + 3 > box[1] and y - 2 < box[3]}
            assert held <= around or box[2] > 32 or box[3] > 32 or min(box) < 0
    assert curve.ranges((1.0, 1.0, 1.0, 5.0)) == []


def test_a_box_reads_few_row_groups(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.uniform(0, 100), rng.uniform(0, 100), "x" * 40) for i in range(20_000)]
    rows += [(20_000 + i, 50.0, 50.0, "crowd") for i in range(5_000)] + [(-1, None, 1.0, ""), (-2, float("nan"), 1.0, "")]
    curve, path = Curve((0.0, 0.0, 100.0, 100.0), 16), str(tmp_path / "points")
    points = spark.createDataFrame(rows, "id long, x double, y double, pad string")
    write_curve(points, path, ("x", "y"), curve, files=12, row_group_bytes=4_096)
    assert read_curve(spark, path, ("x", "y"), curve).count() == 25_000
    for box in ((10.0, 20.0, 18.5, 26.0), (49.0, 49.0, 50.5, 50.5), (-5.0, -5.0, 3.0, 3.0), (97.0, 97.0, 200.0, 200.0), (0.0, 50.0, 100.0, 50.2)):
        found = read_curve(spark, path, ("x", "y"), curve, box)
        want = {i for i, x, y, _ in rows if x is not None and box[0] <= x < box[2] and box[1] <= y < box[3]}
        assert {r.id for r in found.collect()} == want and found.columns == points.columns
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        assert f"GreaterThanOrEqual({KEY}" in plan
    groups = [g for f in glob.glob(path + "/*.parquet") for g in
              [pq.ParquetFile(f).metadata.row_group(i) for i in range(pq.ParquetFile(f).metadata.num_row_groups)]]
    column = [groups[0].column(i).path_in_schema for i in range(groups[0].num_columns)].index(KEY)
    stats = [(g.column(column).statistics.min, g.column(column).statistics.max) for g in groups]
    ranges = curve.ranges((10.0, 20.0, 18.5, 26.0))
    needed = [s for s in stats if any(s[0] <= last and s[1] >= first for first, last in ranges)]
    assert len(stats) >= 12 and len(needed) <= len(stats) / 4
