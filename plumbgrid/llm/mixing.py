"""Mixing sources to target weights by temperature, in SQL functions only.

A source's weight is its share of all tokens to the power of an exponent, normalised: 1 keeps
the shares, 0 gives all sources the same. The exponent is bisected until the weights meet a
target entropy or a limit to how often a source is repeated. The weights are then realised
under a token budget: a source's documents are dealt to blocks by hash, every epoch takes the
blocks in an order of its own, and the last epoch stops in the block where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgrid.llm.text import words
from plumbgrid.session import cut

#: Parts into which a step of the bisection cuts its interval, and steps: 16**8 = 2**32.
PARTS, STEPS = 16, 8
#: Tokens of a block, and blocks of a source at most (its blocks grow beyond that).
BLOCK_TOKENS, MOST_BLOCKS = 200_000, 4096


def token_counts(docs: DataFrame) -> DataFrame:
    """source and tokens (words), by partial sums before the shuffle; a null source is a source."""
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens"))


def sized(docs: DataFrame) -> DataFrame:
    """`docs` with tokens, the number of words of text (0 for null)."""
    return docs.withColumn("tokens", F.size(words(F.col("text"))).cast("bigint"))


def weighed(sources: DataFrame, exponent: Column) -> DataFrame:
    """`sources` per exponent in the column of that name, with share and weight."""
    total = F.sum("tokens").over(Window.partitionBy("exponent"))
    powered = sources.withColumn("exponent", exponent).withColumn("share", F.col("tokens") / total).withColumn(
        "_p", F.pow("share", "exponent"))
    return powered.withColumn("weight", F.col("_p") / F.sum("_p").over(Window.partitionBy("exponent"))).drop("_p")


def bisected(sources: DataFrame, entropy: float | None, repeats: float | None, budget: float,
             cover: bool = False) -> float:
    """The exponent between 0 and 1 that meets the target.

    `entropy`: the largest exponent whose weights have at least that share of the greatest
    possible entropy. `repeats`: the least exponent by which no source is repeated more often
    within the budget, or with `cover` within the least budget that takes every source whole at
    that exponent. With both, the one that repeats less. If no exponent in between meets
    it, the nearest end. Each step is one aggregate over sources times PARTS.
    """
    def search(good: Column, rising: bool) -> float:
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            step = (high - low) / PARTS
            grid = F.explode(F.array(*[F.lit(low + step * i) for i in range(PARTS + 1)]))
            tried = weighed(sources, grid).groupBy("exponent").agg(good.alias("good")).where("good")
            best = tried.agg((F.min if rising else F.max)("exponent")).first()[0]
            if best is None:
                return high if rising else low
            low, high = (max(low, best - step), best) if rising else (best, min(high, best + step))
        return high if rising else low

    found = []
    if entropy is not None:
        size = F.greatest(F.log(F.count("*").cast("double")), F.lit(1e-300))
        reached = -F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.log("weight")).otherwise(0.0)) / size
        found.append(search(reached >= F.lit(entropy * (1 - 1e-12)), rising=False))
    if repeats is not None:
        taken = F.max(F.col("tokens") / F.col("weight")) if cover else F.lit(float(budget))
        most = F.max(F.col("weight") / F.col("tokens")) * taken
        found.append(search(most <= F.lit(float(repeats)), rising=True))
    return max(found, default=1.0)


def plan(docs: DataFrame, entropy: float | None, repeats: float | None, budget: float | None,
         cover: bool) -> DataFrame:
    """source, tokens, share, weight, exponent, wanted (tokens), blocks: one row per source.

    Sources without a token have no weight and are left out.
    """
    sources = cut(token_counts(docs).where("tokens > 0"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    limit = float(total if budget is None else budget)
    exponent = bisected(sources, entropy, repeats, limit, cover)
    planned = weighed(sources, F.lit(exponent))
    if cover:
        # The least budget that takes every document of every source once.
        limit = planned.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    blocks = F.least(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.lit(MOST_BLOCKS).cast("bigint"))
    # A token is left for rounding, so that a source to be taken whole is.
    return planned.withColumn("wanted", F.floor(F.col("weight") * limit * (1 + 1e-9) + 1e-6).cast("bigint")).withColumn(
        "blocks", blocks)


def mixed(docs: DataFrame, entropy: float | None = None, repeats: float | None = None,
          budget: float | None = None, cover: bool = False, seed: int = 7) -> DataFrame:
    """The rows of `docs` (all its columns) as the mixture takes them, with _tokens, _weight,
    _epoch (0 for a first time) and _order (where the row's block stands in its epoch).

    A row appears once per epoch that takes it: epochs are whole but the last of each source,
    which takes blocks in its order and, of the block in which the source's tokens run out,
    documents in an order by hash as long as they fit. `budget` counts tokens (words), by default
    those of `docs`; with `cover` it is the least by which every row with a word is taken, and `repeats` holds for that.

    Rows without a word or a text are taken by no source. A null source is a source of its own.
    Equal rows stand or fall together where a block is cut. An empty table gives no rows.
    Columns of `docs` with one of the four names are replaced.
    """
    own = ["_tokens", "_weight", "_epoch", "_order"]
    columns = [c for c in docs.columns if c not in own]
    docs = docs.select(F.struct(*columns).alias("_row"), "source", "doc_id", F.col("text").cast("string").alias("text"))
    plans = cut(plan(sized(docs).select("source", "tokens"), entropy, repeats, budget, cover))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    hashed = sized(docs).withColumnsRenamed({"tokens": "_tokens"}).where("_tokens > 0").withColumn("_key", key)
    # One row per source: its size is bounded by what `plan` has counted and bisected over.
    about = F.broadcast(plans.select(
        F.col("source").alias("_source"), F.col("tokens").alias("_all"), F.col("weight").alias("_weight"),
        F.col("wanted").alias("_wanted"), F.col("blocks").alias("_blocks")))
    dealt = hashed.join(about, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_block", F.pmod(F.col("_key"), F.col("_blocks"))).withColumn(
        "_whole", F.floor(F.col("_wanted") / F.col("_all")).cast("int"))
    # The part of an epoch: blocks in the order of that epoch, up to the one that runs over.
    sums = dealt.groupBy("_source", "_block", "_whole", F.expr("_wanted - _whole * _all").alias("_left")).agg(
        F.sum("_tokens").alias("_held"))
    turn = F.xxhash64(F.lit(seed), F.col("_source"), F.col("_block"), F.col("_whole"))
    in_turn = Window.partitionBy("_source").orderBy(turn, "_block")
    ran = cut(sums.withColumn("_before", F.coalesce(
        F.sum("_held").over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_before < _left"))
    part = ran.select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), "_before", "_left", "_held")
    # At most MOST_BLOCKS small rows per source.
    taken = dealt.join(F.broadcast(part) if part.limit(200_001).count() <= 200_000 else part,
                       F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left")
    # Only one block per source is cut; its documents are ordered and summed.
    split = cut(dealt.select("_source", "_block", "_key", "_tokens").join(
        F.broadcast(part.where("_before + _held > _left").withColumnsRenamed({"_s": "_s2", "_b": "_b2"})),
        F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("_block") == F.col("_b2"))))
    upto = Window.partitionBy("_source").orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = split.withColumn("_sum", F.sum("_tokens").over(upto)).where("_before + _sum <= _left").groupBy("_source").agg(
        F.max("_key").alias("_last"))
    taken = taken.join(F.broadcast(edge.withColumnRenamed("_source", "_s3")),
                       F.col("_source").eqNullSafe(F.col("_s3")), "left")
    inside = F.col("_b").isNotNull() & ((F.col("_before") + F.col("_held") <= F.col("_left"))
                                        | F.coalesce(F.col("_key") <= F.col("_last"), F.lit(False)))
    times = F.col("_whole") + F.when(inside, F.lit(1)).otherwise(F.lit(0))
    repeated = taken.withColumn("_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(
        F.array().cast("array<int>"))))
    order = F.xxhash64(F.lit(seed), F.col("_source"), F.col("_block"), F.col("_epoch"))
    return repeated.select(*[F.col("_row")[c].alias(c) for c in columns], "_tokens", "_weight", "_epoch",
                           order.alias("_order"))
