"""Permutation tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..session import cut
from .autocorr import centred
from .pairs import SPLIT_ROWS, attach, within_distance

# Sums that differ by less than this share of their size are equal but for rounding.
TIE = 1e-9


def with_index(rows: DataFrame, *order: Column | str, name: str = "index") -> DataFrame:
    """Rows numbered from 0 in the given order, without bringing them to one task.

    A distributed sort numbers rows within its partitions; the partitions' sizes, one row
    each, give the offsets. The sorted rows are written first so that both see one sort.
    """
    mask = F.lit((1 << 33) - 1)
    placed = cut(rows.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(mask).alias("_at")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return placed.join(offsets, "_part").select(
        *rows.columns, (F.col("_off") + F.col("_at")).alias(name))


def shuffle_key(replicate: Column, key: Column) -> Column:
    """A fixed pseudo-random order per replicate: the first 60 bits of an MD5 digest."""
    text = F.concat_ws(":", replicate.cast("string"), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def permuted(points: DataFrame, key: str, value: str, replicates: int) -> DataFrame:
    """(key, values): for each row, the value it gets in every replicate, as an array."""
    rows = points.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    base = with_index(rows, "_k", name="_rank").select("_rank", "_v")
    total = rows.agg(F.count("*").alias("n")).scalar()
    copies = rows.select("_k", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_rep"))
    copies = copies.withColumn("_h", shuffle_key(F.col("_rep"), F.col("_k")))
    ranked = with_index(copies, "_rep", "_h", "_k", name="_global")
    ranked = ranked.select("_k", "_rep", (F.col("_global") - (F.col("_rep") - 1) * total).alias("_rank"))
    drawn = ranked.join(base, "_rank").groupBy("_k").agg(
        F.array_sort(F.collect_list(F.struct("_rep", "_v"))).alias("_drawn"))
    return drawn.select(F.col("_k").alias(key), F.col("_drawn._v").alias("values"))


def _replicated(points: DataFrame, key: str, xy: tuple[str, str], value: str,
                replicates: int) -> DataFrame:
    """(key, x, y, z): the centred values of each row, the given one first, then one per
    replicate."""
    rows = cut(centred(points, value, xy).select(key, *xy, "_z"))
    drawn = permuted(rows, key, "_z", replicates)
    return cut(rows.join(drawn, key).select(
        F.col(key).alias("key"), F.col(xy[0]).alias("x"), F.col(xy[1]).alias("y"),
        F.concat(F.array("_z"), "values").alias("z")))


def _spots(rows: DataFrame, width: range) -> DataFrame:
    """Positions with the number of their rows and, per replicate, the sums of their values
    and squares."""
    at = [F.col("z")[r] for r in width]
    sums = rows.groupBy("x", "y").agg(
        F.count("*").alias("n"), *[F.sum(z).alias(f"s{r}") for r, z in zip(width, at)],
        *[F.sum(z * z).alias(f"q{r}") for r, z in zip(width, at)])
    return cut(sums.select("x", "y", "n", F.array(*[f"s{r}" for r in width]).alias("s"),
                           F.array(*[f"q{r}" for r in width]).alias("q")))


def _met(spots: DataFrame, radius: float, split_rows: int) -> DataFrame:
    return within_distance(spots, spots.toDF("bx", "by", "bn", "bs", "bq"), radius,
                           ("x", "y"), ("bx", "by"), split_rows=split_rows)


def global_test(points: DataFrame, key: str, xy: tuple[str, str], value: str, radius: float,
                replicates: int, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """One row (n, moran_i, geary_c, replicates, moran_as_large, geary_as_small, moran_p,
    geary_p): both statistics with binary weights against permutations of the values.

    Every position carries its sums for all replicates, so pairs are formed once.
    """
    width = range(replicates + 1)
    spots = _spots(_replicated(points, key, xy, value, replicates), width)
    sums = _met(spots, radius, split_rows).agg(
        F.sum(F.col("n") * F.col("bn")).alias("met"),
        F.array(*[F.sum(F.col("s")[r] * F.col("bs")[r]) for r in width]).alias("cross"),
        F.array(*[F.sum(F.col("q")[r] * F.col("bn")) for r in width]).alias("square"))
    base = spots.agg(F.sum("n").alias("n"), F.sum(F.col("q")[0]).alias("q"))
    out = sums.select("met", "cross", "square",
                      *[base.select(c).scalar().alias(c) for c in ("n", "q")])
    # Every row has met itself as well.
    pairs, n, q = F.col("met") - F.col("n"), F.col("n"), F.col("q")
    moran = F.transform("cross", lambda c: n / pairs * (c - q) / q)
    geary = F.zip_with("square", "cross", lambda s, c: (n - 1) * (s - c) / (pairs * q))
    out = out.select("n", moran.alias("i"), geary.alias("c"))

    def share(name: str, beats) -> Column:
        drawn = F.slice(name, 2, replicates)
        return F.size(F.filter(drawn, lambda v: beats(v, F.col(name)[0])))

    def slack(v: Column, own: Column) -> Column:
        return F.lit(TIE) * (F.abs(v) + F.abs(own)) + F.lit(TIE * 1e-3)

    large = share("i", lambda v, own: v >= own - slack(v, own))
    small = share("c", lambda v, own: v <= own + slack(v, own))
    return out.select(
        "n", F.col("i")[0].alias("moran_i"), F.col("c")[0].alias("geary_c"),
        F.lit(replicates).alias("replicates"), large.alias("moran_as_large"),
        small.alias("geary_as_small"), ((large + 1) / (replicates + 1)).alias("moran_p"),
        ((small + 1) / (replicates + 1)).alias("geary_p"))


def local_test(points: DataFrame, key: str, xy: tuple[str, str], value: str, radius: float,
               replicates: int, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(key, degree, local_p, hot_p): for each row, the share of permutations in which its
    product with the sum of its neighbours (local Moran), and the sum over its neighbours
    and itself (Getis-Ord), is as large as the given one.

    For the product the row keeps its own value while its neighbours' are permuted.
    """
    width = range(replicates + 1)
    rows = _replicated(points, key, xy, value, replicates)
    near = _met(_spots(rows, width), radius, split_rows).groupBy(
        F.col("x").alias("_x"), F.col("y").alias("_y")).agg(
        F.sum("bn").alias("_n"), F.array(*[F.sum(F.col("bs")[r]) for r in width]).alias("_sum"))
    met = attach(rows, near, [("x", "_x"), ("y", "_y")], split_rows=split_rows)
    met = met.select("key", (F.col("_n") - 1).alias("degree"), F.col("z")[0].alias("own"), "_sum",
                     F.zip_with("_sum", "z", lambda s, z: s - z).alias("_lag"),
                     (F.lit(TIE) * F.col("_n") * F.array_max(F.transform("z", F.abs))).alias("_slack"))
    hot = F.size(F.filter(F.slice("_sum", 2, replicates), lambda v: v >= F.col("_sum")[0] - F.col("_slack")))
    local = F.size(F.filter(F.slice("_lag", 2, replicates), lambda v: (v - F.col("_lag")[0]) * F.signum("own")
                            >= -F.col("_slack")))
    return met.select(F.col("key").alias(key), "degree",
                      F.when(F.col("degree") > 0, (local + 1) / (replicates + 1)).alias("local_p"),
                      ((hot + 1) / (replicates + 1)).alias("hot_p"))
