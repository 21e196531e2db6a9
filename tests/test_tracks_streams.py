"""Tracks across bucket boundaries, and streams with late and unordered rows."""

import datetime as dt
import random

import pytest

from plumbgrid.operators import tracks
from plumbgrid.sources import files
from plumbgrid.streaming import live

START = dt.datetime(2024, 3, 1)
FIXES = "user long, ts timestamp_ntz, id long, lon double, lat double"


def walk(seed, users=3, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(users * n):
        user = 0 if rng.random() < 0.4 else rng.randrange(users)
        ts = START + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 9, 30))
        out.append((user, ts, i, rng.choice([0.0, 0.0, 1.0]), 0.0))
    return out


def by_user(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("bucket", ["hour", "day", "year"])
def test_steps_do_not_depend_on_the_bucket(spark, bucket):
    rows = walk(1)
    got = {r.id: (r.metres, r.seconds) for r in tracks.steps(
        spark.createDataFrame(rows, FIXES), "user", "ts", "id", ("lon", "lat"), bucket).collect()}
    assert len(got) == len(rows)
    for fixes in by_user(rows).values():
        assert got[fixes[0][2]] == (None, None)
        for a, b in zip(fixes, fixes[1:]):
            assert got[b[2]][1] == (b[1] - a[1]).total_seconds()
            assert (got[b[2]][0] > 0) == (a[3] != b[3])


def test_clock_ignores_the_session_zone(spark):
    """Times in the gap and in the repeated hour of a zone with daylight saving."""
    from plumbgrid.functions import clock
    from pyspark.sql import functions as F
    times = [dt.datetime(2024, 3, 10, 1, 59, 59, 5), dt.datetime(2024, 3, 10, 2, 30, 0, 123456),
             dt.datetime(2024, 11, 3, 1, 30), dt.datetime(1969, 12, 31, 23, 59, 59, 999999)]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(t, START) for t in times], "ts timestamp_ntz, base timestamp_ntz")
        us = clock.to_micros(F.col("ts"), False)
        rows = df.select("ts", us.alias("us"), clock.from_micros(us, False).alias("back"),
                         clock.seconds_between(F.col("base"), F.col("ts")).alias("gap")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for r in rows:
        assert r.us == (r.ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        assert r.back == r.ts and r.gap == (r.ts - START).total_seconds()


@pytest.mark.parametrize("bucket", ["hour", "day"])
def test_stays(spark, bucket):
    rows = walk(2)
    got = {(r.user, r.stay, r.n, r.started, r.ended) for r in tracks.stays(
        spark.createDataFrame(rows, FIXES), "user", "ts", "id", ("lon", "lat"),
        10.0, 6 * 3600.0, 3600.0, bucket).collect()}
    expected = set()
    for user, fixes in by_user(rows).items():
        runs = []
        for f in fixes:
            near = runs and runs[-1][-1][3] == f[3] and (
                f[1] - runs[-1][-1][1]).total_seconds() <= 6 * 3600
            if near:
                runs[-1].append(f)
            else:
                runs.append([f])
        for number, run in enumerate(runs, 1):
            if (run[-1][1] - run[0][1]).total_seconds() >= 3600:
                expected.add((user, number, len(run), run[0][1], run[-1][1]))
    assert got == expected and got


def stream_of(spark, tmp_path, batches, schema):
    """A file stream that reads one batch of rows per step, in order."""
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_zone_changes_wait_for_late_rows(spark, tmp_path):
    """The second batch holds a row from between two of the first, within the delay; the
    third one far too late."""
    def at(minutes):
        return START + dt.timedelta(minutes=minutes)
    schema = "user long, ts timestamp_ntz, id long, zone long"
    batches = [[(1, at(0), 1, 5), (1, at(30), 3, 5), (2, at(10), 4, None)],
               [(1, at(20), 2, None), (1, at(90), 5, 6)],
               [(1, at(300), 6, None), (2, at(301), 7, 8)],
               [(1, at(1), 9, 7), (1, at(900), 8, 8), (2, at(900), 10, 8)]]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = stream_of(spark, tmp_path, batches, schema)
    out = live.run_available(live.zone_changes_live(stream, "user", "ts", "id", "zone", "1 hour"), "t")
    got = {tuple(r) for r in out.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {(1, at(0), 1, None, 5), (1, at(20), 2, 5, None), (1, at(30), 3, None, 5),
                   (1, at(90), 5, 5, 6), (1, at(300), 6, 6, None), (2, at(301), 7, None, 8)}
    kept = [r for b in batches for r in b if r[2] not in (9, 8, 10)]
    batch = tracks.zone_changes(spark.createDataFrame(kept, schema), "user", "ts", "id", "zone")
    assert {tuple(r) for r in batch.collect()} == got


def test_windows_close_behind_the_watermark(spark, tmp_path):
    def at(minutes):
        return START + dt.timedelta(minutes=minutes)
    schema = "ts timestamp_ntz, x double, y double"
    batches = [[(at(1), 0.5, 0.5), (at(59), 0.6, 0.1), (at(61), 0.5, 0.5)], [(at(50), 0.2, 0.2)],
               [(at(200), 5.0, 5.0)], [(at(210), 5.0, 5.0)], [(at(3), 0.1, 0.1)]]
    stream = stream_of(spark, tmp_path, batches, schema)
    out = live.run_available(live.windowed_cells(stream, "ts", ("x", "y"), 1.0, "1 hour", "30 minutes"), "t")
    assert {tuple(r) for r in out.collect()} == {(at(0), 0, 0, 3), (at(60), 0, 0, 1)}


def test_tiled_files_are_pruned(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(500)] + [(999, None, 1.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    path = str(tmp_path / "tiles")
    files.write_tiled(points, path, ("x", "y"), 20.0)
    assert files.read_tiled(spark, path, ("x", "y"), 20.0).count() == 500
    box = (-10.0, 0.0, 25.5, 40.0)
    found = files.read_tiled(spark, path, ("x", "y"), 20.0, box)
    assert {r.id for r in found.collect()} == {
        i for i, x, y in rows[:-1] if -10 <= x < 25.5 and 0 <= y < 40}
    text = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(tile_col" in text
    assert "GreaterThanOrEqual(x,-10.0)" in text and "LessThan(y,40.0)" in text
    assert found.select("id")._jdf.queryExecution().simpleString().count("ReadSchema") == 1


def test_points_and_rings_from_text(spark, tmp_path):
    csv = tmp_path / "p.csv"
    csv.write_text("id,lon,lat\n1,10,20\n2,180,20\n3,-180,-90\n4,,5\n")
    points = files.read_points(spark, str(csv), "csv", "id long, lon double, lat double",
                               ("lon", "lat"), geographic=True, header="true")
    assert sorted(r.id for r in points.collect()) == [1, 3]
    rings = tmp_path / "z.json"
    rings.write_text('{"zone_id": 4, "ring": [{"x": 0, "y": 0}, {"x": 1, "y": 0}, {"x": 0, "y": 1}]}\n')
    assert files.read_rings(spark, str(rings)).count() == 3
