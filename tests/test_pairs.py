"""Distance joins and nearest neighbours: edges of the domain, copies, crowded cells, plans."""

import random

import brute
import pytest

from plumbgrid.operators import nearest, pairs


def table(spark, points, names="id long, x double, y double"):
    return spark.createDataFrame(points, names)


def crowd(seed=1, n=240):
    """A third of the rows at one position, a third in one tiny cluster, the rest anywhere."""
    rng = random.Random(seed)
    spots = [(0.5, 0.5)] * (n // 3)
    spots += [(2 + rng.random() * 1e-3, 2 + rng.random() * 1e-3) for _ in range(n // 3)]
    spots += [(rng.random() * 4 - 1, rng.random() * 4 - 1) for _ in range(n - len(spots))]
    rng.shuffle(spots)
    return [(i, x, y) for i, (x, y) in enumerate(spots)]


@pytest.mark.parametrize("split_rows", [20_000, 7])
@pytest.mark.parametrize("radius", [0.05, 0.3])
def test_join_matches_brute_force(spark, split_rows, radius):
    points = crowd()
    left = table(spark, points)
    right = left.toDF("id2", "x2", "y2")
    found = pairs.within_distance(left, right, radius, ("x", "y"), ("x2", "y2"),
                                  split_rows=split_rows)
    rows = [(r.id, r.id2) for r in found.collect() if r.id != r.id2]
    assert len(rows) == len(set(rows)) and set(rows) == brute.near(points, radius)


@pytest.mark.parametrize("split_rows", [20_000, 7])
def test_close_pairs_once(spark, split_rows):
    points = crowd(2)
    found = pairs.close_pairs(table(spark, points), "id", ("x", "y"), 0.2, split_rows)
    rows = [(r.i, r.j) for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(a, b) for a, b in brute.near(points, 0.2) if a < b}


@pytest.mark.parametrize("split_rows", [20_000, 5])
def test_semi_and_anti_split_the_left(spark, split_rows):
    points = [*crowd(3), (900, None, 1.0), (901, float("nan"), 1.0), (902, float("inf"), 1.0)]
    left, right = table(spark, points), table(spark, [(0, 0.5, 0.5), (1, 9.0, 9.0), (2, None, 0.0)])
    right = right.toDF("id2", "x2", "y2")
    args = (left, right, 0.25, ("x", "y"), ("x2", "y2"))
    inside = {p[0] for p in points if p[1] is not None
              and (p[1] - 0.5) ** 2 + (p[2] - 0.5) ** 2 <= 0.0625}
    semi = [r.id for r in pairs.within_distance(*args, "left_semi", split_rows).collect()]
    anti = [r.id for r in pairs.within_distance(*args, "left_anti", split_rows).collect()]
    assert sorted(semi) == sorted(inside)
    assert sorted(anti) == sorted({p[0] for p in points} - inside)


def test_cell_edges(spark):
    """Distances that equal the radius exactly, at multiples of it, on both sides of zero."""
    points = [(i, (i - 60) * 0.05, 0.0) for i in range(121)]
    found = pairs.close_pairs(table(spark, points), "id", ("x", "y"), 0.05)
    assert {(r.i, r.j) for r in found.collect()} == {
        (a, b) for a, b in brute.near(points, 0.05) if a < b}


def test_sphere_edges(spark):
    """The antimeridian, both poles, coincident points and radii from a metre to half way."""
    spots = [(0, -180.0, 0.0), (1, 179.999995, 0.0), (2, 10.0, 90.0), (3, -120.0, 90.0),
             (4, 33.0, 89.9999), (5, 0.0, -90.0), (6, 12.0, 12.0), (7, 12.0, 12.0),
             (8, -180.0, -45.0), (9, 175.0, -47.0), (10, 12.000005, 12.0)]
    left = table(spark, spots, "id long, lon double, lat double")
    right = left.toDF("id2", "lon2", "lat2")
    for metres in (1.0, 100.0, 500_000.0, 9e6, 19e6):
        found = pairs.within_metres(left, right, metres, ("lon", "lat"), ("lon2", "lat2"))
        expected = {(a[0], b[0]) for a in spots for b in spots
                    if brute.haversine(a[1], a[2], b[1], b[2]) <= metres}
        assert {(r.id, r.id2) for r in found.collect()} == expected


@pytest.mark.parametrize("k", [1, 5])
def test_nearest_with_copies_and_clusters(spark, k):
    points = crowd(4)
    found = nearest.nearest_others(table(spark, points), k, "id", ("x", "y"), split_rows=50)
    assert {(r.i, r.j, r.rank) for r in found.collect()} == brute.nearest(points, points, k, True)


def test_nearest_from_outside_and_with_few_points(spark):
    queries = [(0, 100.0, -50.0), (1, 0.0, 0.0), (2, -1e6, 3.0), (3, None, 1.0)]
    points = [(0, 1.0, 1.0), (1, 1.0, 1.0), (2, -3.0, 4.0)]
    right = table(spark, points).toDF("p", "px", "py")
    for k in (1, 2, 7):
        found = nearest.nearest(table(spark, queries), right, k, "id", "p", ("x", "y"), ("px", "py"))
        assert {(r.id, r.p, r.rank) for r in found.collect()} == brute.nearest(queries[:3], points, k)
    none = nearest.nearest(table(spark, queries), right.limit(0), 2, "id", "p", ("x", "y"), ("px", "py"))
    assert none.count() == 0


def test_nearest_on_one_spot(spark):
    points = [(i, 3.0, 3.0) for i in range(20)]
    found = nearest.nearest_others(table(spark, points), 2, "id", ("x", "y"))
    assert {(r.i, r.j, r.rank) for r in found.collect()} == brute.nearest(points, points, 2, True)


def test_nearest_metres_over_the_pole(spark):
    rng = random.Random(5)
    points = [(i, rng.uniform(-180, 180), rng.uniform(80, 90)) for i in range(60)]
    left = table(spark, points, "id long, lon double, lat double")
    found = nearest.nearest_metres(left, left.toDF("p", "plon", "plat"), 3, "id", "p",
                                   ("lon", "lat"), ("plon", "plat"))
    expected = set()
    for a in points:
        order = sorted((round(brute.haversine(a[1], a[2], b[1], b[2]), 3), b[0]) for b in points)
        expected |= {(a[0], key, rank) for rank, (_, key) in enumerate(order[:3], 1)}
    assert {(r.id, r.p, r.rank) for r in found.collect()} == expected


def test_attach_splits_hot_keys(spark):
    rows = spark.createDataFrame([(i, 1 if i < 50 else i) for i in range(60)], "i long, k long")
    names = spark.createDataFrame([(1, "a"), (55, "b")], "key long, name string")
    found = {(r.i, r.k, r.name) for r in pairs.attach(rows, names, [("k", "key")], "left", 4).collect()}
    assert len(found) == 60 and sum(n == "a" for *_, n in found) == 50
    assert pairs.attach(rows, names, [("k", "key")], split_rows=4).count() == 51


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_plans_are_equi_joins(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SMALL_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = table(spark, crowd())
        right = left.toDF("id2", "x2", "y2")
        flat = plan(pairs.within_distance(left, right, 0.1, ("x", "y"), ("x2", "y2"), split_rows=9))
        round_ = plan(pairs.within_metres(left, right, 9e3, ("x", "y"), ("x2", "y2")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for text in (flat, round_):
        assert "SortMergeJoin" in text
        assert "CartesianProduct" not in text and "NestedLoop" not in text and "EvalPython" not in text


def test_small_sides_are_sent_without_a_shuffle(spark, monkeypatch):
    left = spark.range(3000).selectExpr("id", "id % 50 * 1.0 as x", "id % 7 * 1.0 as y")
    left = left.unionByName(spark.createDataFrame([(-1, None, 1.0)], "id long, x double, y double"))
    right = spark.range(40).selectExpr("id as r", "id * 1.0 as u", "id % 7 * 1.0 as v")
    monkeypatch.setattr(pairs, "TASK_PAIRS", 10)
    seen = {}
    for rows in (50_000, 0):
        monkeypatch.setattr(pairs, "SMALL_ROWS", rows)
        for how in ("inner", "left_semi", "left_anti"):
            out = pairs.within_distance(left, right, 1.0, ("x", "y"), ("u", "v"), how)
            plan = out._jdf.queryExecution().executedPlan().toString()
            if how == "inner":
                assert ("hashpartitioning" in plan) == (rows == 0)
            got = sorted(map(str, out.select("id").collect()))
            assert seen.setdefault(how, got) == got
    assert "Row(id=-1)" in seen["left_anti"] and len(seen["left_semi"]) + len(seen["left_anti"]) == 3001


def test_band_weights_of_a_crowd_make_no_row_per_tested_pair(spark, monkeypatch):
    from plumbgrid.operators import tiles, weights

    points = crowd(8)
    frame = table(spark, points)
    monkeypatch.setattr(tiles, "BLOCK", 50)
    for split_rows in (20_000, 7):
        out = weights.band_weights(frame, "id", ("x", "y"), 0.3, True, split_rows, places=3)
        found = brute.near(points, 0.3)
        degree = {i: sum(a == i for a, _ in found) for i, _ in found}
        assert {(r.i, r.j): r.w for r in out.collect()} == {(i, j): round(1 / degree[i], 3) for i, j in found}
        text = plan(out)
        assert "MapInArrow" in text and "_ix" not in text
    assert weights.band_weights(frame.limit(0), "id", ("x", "y"), 0.3).count() == 0


def written(frame, folder):
    """Bytes per row of each column, as Parquet."""
    import pyarrow.parquet as pq

    frame.write.parquet(str(folder))
    sizes, rows = {}, 0
    for path in folder.glob("*.parquet"):
        meta = pq.ParquetFile(path).metadata
        rows += meta.num_rows
        for group in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(group).column(c)
                sizes[column.path_in_schema] = sizes.get(column.path_in_schema, 0) + column.total_compressed_size
    return {name: size / rows for name, size in sizes.items()}


def test_keys_of_close_pairs_take_little_room(spark, tmp_path):
    """A point's pairs with a tile lie together, so that keys repeat and are not most of what is written."""
    rng = random.Random(9)
    points = [(i, rng.random(), rng.random()) for i in range(3000)]
    rng.shuffle(points)
    size = written(pairs.close_pairs(table(spark, points), "id", ("x", "y"), 0.3), tmp_path / "pairs")
    assert size["i"] + size["j"] < 1.0


def test_close_pairs_of_equal_and_unknown_keys(spark):
    """i < j holds for no equal or null keys, in one cell or two; keys may be texts."""
    points = [("a", 0.1, 0.1), ("a", 0.1, 0.1), ("a", 0.35, 0.1), (None, 0.1, 0.1), ("b", 0.2, 0.1), ("c", None, 0.1)]
    frame = table(spark, points, "id string, x double, y double")
    for split_rows in (20_000, 1):
        found = pairs.close_pairs(frame, "id", ("x", "y"), 0.3, split_rows).collect()
        assert sorted((r.i, r.j) for r in found) == [("a", "b")] * 3


def test_pairs_both_ways_are_the_join_with_itself(spark, monkeypatch):
    """Copies of rows, equal and null keys, cells in parts; rows without a position meet nothing, not even themselves."""
    from plumbgrid.operators import tiles

    points = [*crowd(10), *crowd(11, 30)] + [(7, 0.5, 0.5)] * 3 + [(None, 0.5, 0.5)] * 2 + [(None, 0.1, 0.2), (900, None, 1.0)]
    points += [(901, float("nan"), 1.0), (902, float("inf"), 1.0), (903, 0.0, 0.0), (903, -0.0, 0.0), (904, 50.0, 50.0)]
    located = [p for p in points if p[1] is not None and abs(p[1]) < float("inf")]
    expected = sorted((str(a[0]), str(b[0])) for a in located for b in located
                      if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.3 * 0.3)
    for split_rows, tile, block in ((20_000, 256, 4_096), (7, 20, 30)):
        monkeypatch.setattr(tiles, "PAIR_TILE", tile)
        monkeypatch.setattr(tiles, "PAIR_BLOCK", block)
        found = pairs.close_pairs(table(spark, points), "id", ("x", "y"), 0.3, split_rows, both=True).collect()
        assert sorted((str(r.i), str(r.j)) for r in found) == expected
        assert {r.distance for r in found if r.i == 904} == {0.0}


def test_distances_of_the_planar_join_are_written_about_once(spark, tmp_path):
    """The two rows of a pair lie together, so that a file holds their distance once and a little more."""
    from plumbgrid.plans import QUERIES

    rng = random.Random(12)
    spots = [(i, [rng.random() * 0.2, rng.random() * 0.2], 0) for i in range(2000)]
    rng.shuffle(spots)
    spark.createDataFrame(spots, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    size = written(QUERIES["planar_distance_join"](spark, str(tmp_path)), tmp_path / "pairs")
    assert size["distance"] < 6.0


def test_listed_sphere_matches_brute_force(spark, monkeypatch):
    """Copies, a crowd, edges of the sphere, unknown positions and keys, blocks and batches of a few rows."""
    from plumbgrid.operators import tiles

    rng = random.Random(14)
    spots = [("a", -180.0, 0.0), ("b", 179.999995, 0.0), ("c", 10.0, 90.0), ("d", -120.0, 90.0), ("e", 0.0, -90.0), (None, 12.0, 12.0)]
    spots += [("copy", 12.0, 12.0)] * 3 + [("zero", 0.0, 0.0), ("zero", -0.0, 0.0), ("n", None, 1.0), ("n", 5.0, float("nan")), ("n", float("inf"), 1.0)]
    spots += [(f"r{k}", *at) for at in [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(25)] for k in range(3)]
    spots += [(f"h{k}", 33.0, -45.0) for k in range(40)]
    others = [(n, *s[1:]) for n, s in enumerate(spots)]
    left = table(spark, spots, "who string, lon double, lat double")
    right = table(spark, others, "id2 int, lon2 double, lat2 double")

    def located(rows):
        return [r for r in rows if r[1] is not None and r[2] is not None and abs(r[1]) < 1e9 and abs(r[2]) < 1e9]

    for split_rows, (piece, copies, batch, tested) in ((20_000, (128, 64, 131_072, 1_000_000)), (9, (3, 4, 7, 50))):
        for name, value in (("PIECE", piece), ("COPIES", copies), ("BATCH", batch), ("SPOT_PAIRS", tested)):
            monkeypatch.setattr(tiles, name, value)
        for metres in (1.0, 2e6, 3e7):
            found = pairs.close_metres(left, right, "who", "id2", metres, ("lon", "lat"), ("lon2", "lat2"), split_rows)
            expected = sorted((str(a[0]), b[0]) for a in located(spots) for b in located(others)
                              if brute.haversine(a[1], a[2], b[1], b[2]) <= metres)
            rows = found.collect()
            assert sorted((str(r.who), r.id2) for r in rows) == expected
            assert all(0 <= r.metres <= metres for r in rows)
    assert pairs.close_metres(left.limit(0), right, "who", "id2", 1e6, ("lon", "lat"), ("lon2", "lat2")).count() == 0


def test_rows_at_one_position_share_what_the_spherical_join_writes(spark, tmp_path):
    """Customers whose keys differ by 612,000 are at one position; each list of suppliers is written about once."""
    from plumbgrid.plans import QUERIES

    customers = [(k + 612_000 * c, 0, 0.0, "") for c in range(9) for k in range(300)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(
        str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k, 0, 0.0) for k in range(8000)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(
        str(tmp_path / "supplier.parquet"))
    size = written(QUERIES["spherical_distance_join"](spark, str(tmp_path)), tmp_path / "pairs")
    assert sum(size.values()) < 2.0


def test_keys_of_pairs_both_ways_take_little_room(spark, tmp_path):
    """A point's pairs with a tile are mostly all of it, in an order that repeats from point to point."""
    rng = random.Random(15)
    points = [(i, rng.random() * 0.3, rng.random() * 0.3) for i in range(4000)]
    rng.shuffle(points)
    size = written(pairs.close_pairs(table(spark, points), "id", ("x", "y"), 0.1, both=True), tmp_path / "pairs")
    assert size["i"] + size["j"] < 0.6
