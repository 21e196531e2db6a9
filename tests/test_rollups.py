"""Cells rolled up from stored sketches against the points themselves."""

import math
import random

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from plumbgrid.operators import rollups
from plumbgrid.plans import QUERIES, SQL

POINTS = "kind string, x double, y double, who string, v double"


def made(n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.gauss(0, 3), rng.gauss(0, 3), f"u{rng.randrange(9_000)}", rng.gauss(10, 4)) for _ in range(n)]
    return rows + [("a", 0.1, 0.1, None, None), ("b", 0.1, 0.1, "u1", math.nan), ("a", 0.1, 0.2, "u1", math.inf),
                   ("a", None, 1.0, "x", 1.0), ("a", math.nan, 1.0, "x", 1.0), ("c", 500.0, 500.0, None, None)]


def plain(rows, size, by):
    out = {}
    for r in rows:
        if r[1] is not None and math.isfinite(r[1]):
            out.setdefault((*[r[0]][:by], math.floor(r[1] / size), math.floor(r[2] / size)), []).append(r)
    return out


@pytest.mark.parametrize("by", [0, 1])
def test_levels_are_those_of_the_points(spark, by):
    rows = made(20_000)
    points = spark.createDataFrame(rows, POINTS).repartition(6)
    names = ["kind"][:by]
    cells = rollups.summed_cells(points, ("x", "y"), 0.5, "who", "v", "kind").cache()
    base = rollups.rolled_up(cells.withColumn("level", F.lit(-1)), *names, factor=1)
    got = rollups.estimates(rollups.pyramid(base, 5, *names), [0.0, 0.1, 0.5, 0.9, 1.0], *names).collect()
    for level in range(6):
        want = plain(rows, 0.5 * 2 ** level, by)
        mine = {(*[r[n] for n in names], r.col, r.row): r for r in got if r.level == level}
        assert mine.keys() == want.keys()
        for key, inside in want.items():
            r, values = mine[key], sorted(x[4] for x in inside if x[4] is not None and math.isfinite(x[4]))
            who = {x[3] for x in inside if x[3] is not None}
            assert r.n == len(inside) and (r.low, r.high) == ((values[0], values[-1]) if values else (None, None))
            assert r.total == (pytest.approx(math.fsum(values)) if values else None)
            exact = len(who) < 300
            assert r.distinct == len(who) if exact else abs(r.distinct - len(who)) <= 5 * rollups.distinct_error() * len(who)
            if not values:
                assert r.quantiles == [None] * 5
            for share, q in zip((0.0, 0.1, 0.5, 0.9, 1.0), r.quantiles if values else ()):
                low, high = sum(v < q for v in values), sum(v <= q for v in values)
                slack = 0.03 * len(values) if len(values) > 150 else 0
                assert low - slack <= share * len(values) <= high + slack


def test_nothing_and_one_cell(spark):
    none = spark.createDataFrame([], POINTS)
    assert rollups.pyramid(rollups.summed_cells(none, ("x", "y"), 1.0, "who", "v"), 2).count() == 0
    one = rollups.summed_cells(spark.createDataFrame([("a", -0.5, 3.0, "u", 2.0)], POINTS), ("x", "y"), 1.0, "who", "v")
    assert [(r.level, r.col, r.row, r.distinct) for r in rollups.estimates(rollups.pyramid(one, 2), [0.5]).orderBy("level").collect()] == [
        (0, -1, 3, 1), (1, -1, 1, 1), (2, -1, 0, 1)]


def test_a_sketch_has_a_bounded_size(spark):
    crowd = spark.range(200_000).select(F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), F.col("id").alias("who"), (F.col("id") % 977).alias("v"))
    r = rollups.summed_cells(crowd, ("x", "y"), 1.0, "who", "v").select("n", F.octet_length("seen").alias("s"), F.octet_length("spread").alias("q")).first()
    assert r.n == 200_000 and r.s <= 8_192 and r.q <= 16_384


@pytest.mark.parametrize("by", [0, 1])
def test_exact_distinct_counts(spark, by):
    rows = made(20_000)
    names = ["kind"][:by]
    got = rollups.distinct_levels(spark.createDataFrame(rows, POINTS).repartition(6), ("x", "y"), 0.5, "who", 5, *names).collect()
    for level in range(6):
        want = {k: len({x[3] for x in inside} - {None}) for k, inside in plain(rows, 0.5 * 2 ** level, by).items()}
        mine = {(*[r[n] for n in names], r.col, r.row): r["distinct"] for r in got if r.level == level}
        assert mine == {k: n for k, n in want.items() if n}
        assert level < 5 or max(mine.values()) > 2_000


def test_query_counts_many_users_exactly(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) MINUTE AS ts, i % 4001 AS user_id,
        'a' AS event_type, (i % 997) / 1e2 AS value, '{{}}' AS props FROM range(9000) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert compare.difference(spark, con, QUERIES["cell_rollup"], SQL["cell_rollup"], str(tmp_path)) is None
