"""Joins of intervals that overlap.

Intervals are put on levels by length: the buckets of a level are at least as wide as its
intervals, so an interval lies in two of them at most, and is a row in each. To meet longer
ones it is copied to the buckets that it touches on each longer level the other table uses,
again two at most. Two intervals so meet on the level of the longer one only, and the bucket
that holds the start of their overlap reports them, so each pair comes once.

A long interval is never cut into many short pieces, and a short one never meets what is far
away. Buckets that hold much of either table are cut into blocks (``pairs.split_join``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import has_zone, to_micros
from .pairs import SPLIT_ROWS, disjoint, hot_groups, split_join

# Buckets of a level are this many times as wide as those of the one below, a power of two.
STEP_BITS = 3
LEVELS = 21


def _ends(rows: DataFrame, names: tuple[str, str]) -> list[Column]:
    """Both ends as whole numbers: microseconds, or the integers they are."""
    types = [dict(rows.dtypes)[n] for n in names]
    if types[0] != types[1]:
        raise ValueError("both ends of an interval must have one type")
    if types[0].startswith("timestamp"):
        return [to_micros(F.col(n), has_zone(rows, n)) for n in names]
    if types[0] in ("tinyint", "smallint", "int", "bigint"):
        return [F.col(n).cast("long") for n in names]
    raise ValueError("ends of intervals must be timestamps or integers")


def _bucket(at: Column, level: Column) -> Column:
    """Bucket of a whole number, rounded down, on a level whose buckets are 2 ** (3 level) wide."""
    return F.call_function("shiftright", at, (level * STEP_BITS).cast("int"))


def _level(length: Column) -> Column:
    """The lowest level whose buckets are at least as wide as the interval."""
    out = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        out = F.when(length <= F.lit(1 << (STEP_BITS * k)), k).otherwise(out)
    return out


def _copies(rows: DataFrame, levels: Sequence[int], start: str, end: str, own: str) -> DataFrame:
    """Rows in each bucket they touch on their own level and on the longer ones of ``levels``.

    ``_home`` says whether the level is the row's own.
    """
    wanted = F.array_union(F.filter(F.array(*[F.lit(k) for k in levels]).cast("array<int>"), lambda k: k > F.col(own)),
                           F.array(own))
    spread = rows.select("*", F.explode(wanted).alias("_at"))
    first, last = _bucket(F.col(start), F.col("_at")), _bucket(F.col(end) - 1, F.col("_at"))
    return spread.select("*", (F.col("_at") == F.col(own)).alias("_home"), F.explode(F.sequence(first, last)).alias("_bucket"))


def overlapping(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str],
                on: Sequence[tuple[str, str]] = (), split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Pairs of rows whose intervals share a moment and whose ``on`` columns are equal.

    Intervals hold their start and not their end; one that ends before it starts, or at its
    start, holds nothing, and neither does one with a null end. Null keys match nothing.
    """
    disjoint(left, right)

    def placed(rows: DataFrame, ends: tuple[str, str], names: Sequence[str], s: str) -> DataFrame:
        a, b = _ends(rows, ends)
        ok = F.coalesce(a < b, F.lit(False))
        for n in names:
            ok = ok & F.col(n).isNotNull()
        return rows.where(ok).select("*", a.alias(f"_s{s}"), b.alias(f"_e{s}"), _level(b - a).cast("int").alias(f"_n{s}"),
                                     *[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)])

    a, b = placed(left, left_ends, [x for x, _ in on], "a"), placed(right, right_ends, [y for _, y in on], "b")
    levels = [sorted(r[0] for r in rows.select(n).distinct().collect()) for rows, n in ((a, "_na"), (b, "_nb"))]
    keys = [f"_k{i}" for i in range(len(on))] + ["_at", "_bucket", "_lane"]
    # Two lanes: the left row at home with right rows as long or shorter, and the other way round.
    lane_a = F.when(F.col("_home"), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    lane_b = F.when(F.col("_home"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    near = _copies(a, levels[1], "_sa", "_ea", "_na").select("*", F.explode(lane_a).alias("_lane")).drop("_home")
    far = _copies(b, levels[0], "_sb", "_eb", "_nb").select("*", F.explode(lane_b).alias("_lane")).drop("_home")
    split = hot_groups(near.groupBy(*keys).agg(F.count("*").alias("_nl")), far.groupBy(*keys).agg(F.count("*").alias("_nr")),
                       keys, split_rows)
    far = far.withColumns({"_ra": F.col("_at"), "_rb": F.col("_bucket")})
    begins = F.greatest("_sa", "_sb")
    met = split_join(near, far, keys, split, (begins < F.least("_ea", "_eb")) & (_bucket(begins, F.col("_ra")) == F.col("_rb")))
    return met.select(*left.columns, *right.columns)
