"""As-of join: for each row of one table, the latest row of another at or before it.

A window over a whole object would put one object in one task. Rows meet in windows over
(object, time bucket) instead; what an object's earlier buckets have to say is one row per
bucket, handed on and added to the bucket as its first row. Handing on works the same way
over groups of buckets, so no window holds more than ``FAN`` of them either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec, Window as W, functions as F

from ..functions.clock import has_zone, to_micros
from .pairs import disjoint

# Buckets of an object that are handed on in one window.
FAN = 4096
# Rows of an object in one bucket above which buckets are made narrower, 16 times at once.
BUCKET_ROWS = 1_000_000
DAY = 86_400_000_000


def _earlier(*part: str) -> WindowSpec:
    return W.partitionBy(*part).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)


def carried(lasts: DataFrame) -> DataFrame:
    """(_k, _b, _before): the latest ``_v`` that is not null of an object's earlier buckets.

    Takes one row (_k, _b, _v) per object and bucket; buckets are numbered in order of time.
    """
    group = F.floor(F.col("_b") / F.lit(FAN))
    spread = lasts.groupBy("_k").agg((F.max(group) - F.min(group)).alias("n"))
    if not spread.agg(F.max("n")).first()[0]:
        return lasts.select("_k", "_b", F.last("_v", True).over(_earlier("_k")).alias("_before"))
    placed = lasts.withColumn("_g", group)
    near = placed.select("_k", "_b", "_g", F.last("_v", True).over(_earlier("_k", "_g")).alias("_near"))
    newest = F.max(F.when(F.col("_v").isNotNull(), F.struct("_b", "_v")))
    groups = placed.groupBy("_k", "_g").agg(newest.alias("_m")).select(
        "_k", F.col("_g").alias("_b"), F.col("_m")["_v"].alias("_v"))
    far = carried(groups).select(F.col("_k").alias("_fk"), F.col("_b").alias("_fb"), F.col("_before").alias("_far"))
    return near.join(far, (F.col("_k") == F.col("_fk")) & (F.col("_g") == F.col("_fb")), "left").select(
        "_k", "_b", F.coalesce("_near", "_far").alias("_before"))


def bucket_width(times: DataFrame, rows: int = BUCKET_ROWS) -> int:
    """Microseconds of a bucket, a day at most, so that no object has more than ``rows`` of its
    (_k, _us) in one; one instant is never divided."""
    width = DAY
    while width > 1:
        sizes = times.groupBy("_k", F.floor(F.col("_us") / F.lit(width))).count()
        if (sizes.agg(F.max("count")).first()[0] or 0) <= rows:
            break
        width = max(1, width // 16)
    return width


def asof(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], left_ts: str, right_ts: str,
         tie: str, columns: Sequence[str], tolerance: float | None = None, strict: bool = False,
         how: str = "left", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows of ``left`` with ``columns`` of the latest row of ``right`` that has the same keys and
    is not later, or earlier only if ``strict``.

    Of right rows at one instant the one with the largest ``tie`` counts. One that is more than
    ``tolerance`` seconds older does not. Without any, the columns are null, or the row is left
    out if ``how`` is inner. A null key or time matches nothing. ``columns`` may name
    ``right_ts``; none may be a column of ``left``.
    """
    disjoint(left, right.select(*columns))
    if has_zone(left, left_ts) != has_zone(right, right_ts):
        raise ValueError("both times need a zone, or neither")

    def known(names: Sequence[str]) -> Column:
        ok = F.lit(True)
        for n in names:
            ok = ok & F.col(n).isNotNull()
        return ok

    def placed(rows: DataFrame, names: Sequence[str], ts: str, *more: Column) -> DataFrame:
        micros = to_micros(F.col(ts), has_zone(rows, ts))
        return rows.where(known([*names, ts])).select(
            F.struct(*[F.col(n).alias(f"k{i}") for i, n in enumerate(names)]).alias("_k"), micros.alias("_us"), *more)

    lefts, rights = [a for a, _ in keys], [b for _, b in keys]
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(left.columns)])
    us = to_micros(F.col(right_ts), has_zone(right, right_ts))
    value = F.struct(us.alias("us"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    a = placed(left, lefts, left_ts, row.alias("_row"))
    b = placed(right, rights, right_ts, F.col(tie).alias("_tie"), value.alias("_v"))
    width = bucket_width(a.select("_k", "_us").unionByName(b.select("_k", "_us")), bucket_rows)
    bucket = F.floor(F.col("_us") / F.lit(width)).alias("_b")
    a, b = a.select("*", bucket), b.select("*", bucket)
    # One row per object and bucket: the latest right row there, or none where only left rows are.
    lasts = b.groupBy("_k", "_b").agg(F.max(F.struct("_us", "_tie", "_v")).alias("_m")).select("_k", "_b", F.col("_m")["_v"].alias("_v"))
    needed = a.select("_k", "_b", F.lit(None).cast(lasts.schema["_v"].dataType).alias("_v")).dropDuplicates(["_k", "_b"])
    both = lasts.unionByName(needed).groupBy("_k", "_b").agg(F.max("_v").alias("_v"))
    handed = carried(both).where(F.col("_before").isNotNull()).select("_k", "_b", F.col("_before").alias("_v"))

    def lane(rows: DataFrame, side: int) -> DataFrame:
        return rows.select("*", F.lit(side).alias("_side"))

    met = (lane(handed, 0).unionByName(lane(b, 2), allowMissingColumns=True)
           .unionByName(lane(a, 1 if strict else 3), allowMissingColumns=True))
    upto = W.partitionBy("_k", "_b").orderBy("_us", "_side", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = met.select("_row", "_us", F.last("_v", True).over(upto).alias("_v")).where(F.col("_row").isNotNull())
    if tolerance is not None:
        recent = F.col("_us") - F.col("_v.us") <= F.lit(round(tolerance * 1_000_000))
        found = found.withColumn("_v", F.when(recent, F.col("_v")))
    if how == "inner":
        found = found.where(F.col("_v").isNotNull())
    elif how != "left":
        raise ValueError("how is left or inner")
    out = found.select(*[F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(left.columns)],
                       *[F.col("_v")[f"v{i}"].alias(c) for i, c in enumerate(columns)])
    if how == "left":
        alone = left.where(~known([*lefts, left_ts]))
        out = out.unionByName(alone, allowMissingColumns=True)
    return out
