"""Dwell alarms and meetings of streams, with unordered and late rows."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbgrid.streaming import dwell, live, meetings
from test_tracks_streams import START, stream_of

FIXES = "user long, ts timestamp_ntz, id long, zone long"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture
def two_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def plain_alarms(rows, stay, silence):
    """(user, zone, since) in minutes, one fix after the other."""
    out, users = set(), {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[2])):
        users.setdefault(r[0], []).append(r)
    for user, fixes in users.items():
        i = 0
        while i < len(fixes):
            j = i
            while j + 1 < len(fixes) and fixes[j + 1][3] == fixes[i][3] and fixes[j + 1][1] - fixes[j][1] <= silence:
                j += 1
            end = fixes[j][1] + silence
            if j + 1 < len(fixes):
                end = min(end, fixes[j + 1][1])
            if fixes[i][3] is not None and end >= fixes[i][1] + stay:
                out.add((user, fixes[i][3], fixes[i][1]))
            i = j + 1
    return out


def walked(seed, n=300):
    rng, out = random.Random(seed), []
    for i in range(n):
        out.append((rng.choice([1, 1, 1, 2, 3, None]), at(rng.randrange(0, 6_000, 10)), i, rng.choice([5, 5, 5, 6, None])))
    return out


@pytest.mark.parametrize("stay, silence, bucket", [(60, 200, "day"), (120, 60, "hour"), (0, 30, "day")])
def test_alarms_of_a_table(spark, stay, silence, bucket):
    rows = walked(2)
    got = dwell.dwell_alarms(spark.createDataFrame(rows, FIXES), "user", "ts", "id", "zone", stay * 60, silence * 60, bucket).collect()
    want = plain_alarms(rows, dt.timedelta(minutes=stay), dt.timedelta(minutes=silence))
    assert {(r.user, r.zone, r.since) for r in got} == want and len(got) == len(want)
    assert all(r.alarm == r.since + dt.timedelta(minutes=stay) for r in got)


def test_alarms_of_a_stream(spark, tmp_path, two_tasks):
    """Batches that overlap in time by less than the delay, then what is far too late."""
    rows = sorted((r for r in walked(7, 200) if r[0] is not None), key=lambda r: r[1])
    parts = [rows[k:k + 50] for k in range(0, 200, 50)]
    for a, b in zip(parts, parts[1:]):
        a[-4:], b[:4] = b[:4], a[-4:]
    end = [(9, at(20_000), 900, None)], [(1, at(5), 901, 6), (9, at(20_001), 902, None)]
    out = live.run_available(dwell.dwell_alarms_live(
        stream_of(spark, tmp_path, [*parts, *end], FIXES), "user", "ts", "id", "zone", 3_600, 12_000, "10 hours"), "t", timers=True)
    got = [tuple(r) for r in out.collect()]
    want = plain_alarms(rows, dt.timedelta(hours=1), dt.timedelta(minutes=200))
    assert set(got) == {(u, z, s, s + dt.timedelta(hours=1)) for u, z, s in want} and len(got) == len(want)


def state_rows(query_progress):
    return [s["numRowsTotal"] for s in query_progress["stateOperators"]]


def run(stream, tmp_path, name, timers=False):
    """Rows a stream has emitted, and the rows of its state after the last batch."""
    spark = stream.sparkSession
    if timers:
        spark.conf.set(live.STORE, live.ROCKS)
    try:
        query = (stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option(
            "checkpointLocation", str(tmp_path / (name + "-p"))).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.unset(live.STORE)
    rows = spark.read.schema(stream.schema).parquet(str(tmp_path / name)).collect()
    return rows, sum(state_rows(json.loads(query.lastProgress.json) if hasattr(query.lastProgress, "json") else query.lastProgress))


def test_state_of_silent_objects_ends(spark, tmp_path, two_tasks):
    """A hundred objects are seen once each; long after, nothing of them is kept."""
    seen = [(k, at(k % 7), k, 5 if k % 2 else None) for k in range(100)]
    later = [[(500, at(10_000 + 100 * i), 1_000 + i, None)] for i in range(3)]
    rows, left = run(dwell.dwell_alarms_live(stream_of(spark, tmp_path, [seen, *later], FIXES), "user", "ts", "id", "zone",
                                             1_800, 3_600, "10 minutes"), tmp_path, "silent", timers=True)
    assert {r.user for r in rows} == {k for k in range(100) if k % 2} and len(rows) == 50
    assert left <= 6


MEET = "id long, ts timestamp_ntz, x double, y double"


def met(a, b, radius, seconds):
    return {(p[0], q[0]) for p in a for q in b if None not in (p[1], q[1], p[2], q[2]) and abs((p[1] - q[1]).total_seconds()) <= seconds
            and math.hypot(p[2] - q[2], p[3] - q[3]) <= radius}


def named(df, prefix):
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def test_meetings_of_tables(spark):
    rng = random.Random(5)

    def made(n):
        return [(i, None if i == 3 else at(rng.randrange(-500, 500)), None if i == 4 else rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(n)]

    a, b = made(150), made(120)
    got = meetings.meetings(named(spark.createDataFrame(a, MEET), "a_"), named(spark.createDataFrame(b, MEET), "b_"), "a_ts", "b_ts",
                            ("a_x", "a_y"), ("b_x", "b_y"), 0.7, 3_600, "1 hour").collect()
    pairs = [(r.a_id, r.b_id) for r in got]
    assert set(pairs) == met(a, b, 0.7, 3_600) and len(pairs) == len(set(pairs)) > 50
    times = {p[0]: p[1] for p in a}
    assert all(r.a_ts == times[r.a_id] and r.distance == pytest.approx(math.hypot(r.a_x - r.b_x, r.a_y - r.b_y)) for r in got)


def test_meetings_of_streams(spark, tmp_path, two_tasks):
    """Partners come in different batches; a row behind the watermark finds none, and state ends."""
    lefts = [[(1, at(0), 0.0, 0.0), (2, at(9), 5.0, 5.0)], [(3, at(30), 0.0, 0.1)], [(4, at(5_000), 0.0, 0.0)], [(6, at(5_020), 8.0, 0.0)], [(5, at(12), 0.0, 0.0)]]
    rights = [[(10, at(20), 0.1, 0.0), *[(100 + i, at(i % 10), 50.0 + i, 9.0) for i in range(200)]], [(11, at(8), 5.1, 5.0), (12, at(300), 0.0, 0.0)], [(13, at(5_001), 9.0, 9.0)], [(14, at(5_002), 0.3, 0.0)], [(15, at(5_003), 7.0, 7.0)]]
    (tmp_path / "l").mkdir(), (tmp_path / "r").mkdir()
    a = named(stream_of(spark, tmp_path / "l", lefts, MEET), "a_")
    b = named(stream_of(spark, tmp_path / "r", rights, MEET), "b_")
    out = meetings.meetings(a, b, "a_ts", "b_ts", ("a_x", "a_y"), ("b_x", "b_y"), 0.5, 1_800, "60 minutes")
    rows, left = run(out, tmp_path, "meet")
    assert sorted((r.a_id, r.b_id) for r in rows) == [(1, 10), (2, 11), (3, 10), (4, 14)]
    assert {(r.a_id, r.b_id): (r.a_ts, r.b_ts) for r in rows}[2, 11] == (at(9), at(8))
    # What is left are copies of the last rows to the cells and hours they reach, and none of the 200.
    assert left <= 100
