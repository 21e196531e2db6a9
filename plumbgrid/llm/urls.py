"""URL filters: given rules first, and association rules mined from labelled URLs for the rest.

A URL becomes a set of tokens (labels of its host, pieces of its path, keys of its query). The
URLs that a given rule decides are the labelled ones; frequent token sets among them are mined
by FP-growth, and those that go along with one label by enough confidence and support become
rules. A mined rule is posted under its rarest token; a URL meets the rules posted under its
tokens, and the one with the highest confidence decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgrid.llm.text import small_or_shuffled
from plumbgrid.operators.pairs import attach
from plumbgrid.session import cut

#: Share of labelled URLs that a rule's tokens must be in, and of those its label must have.
SUPPORT, CONFIDENCE = 0.002, 0.8
#: Labelled rows that a rule's tokens are in at least, however few there are.
LEAST_ROWS = 3
#: Groups of tokens, and judged token sets, up to which they may be broadcast (a few hundred bytes each).
SMALL_CLASSES, SMALL_SETS = 20_000, 40_000
#: Marks of the labels among the tokens.
LABEL = "label="
DEFAULT = "allow"


@dataclass(frozen=True)
class Given:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


#: The given rules (host, then the path after its slash).
GIVEN = (Given("net", "", "block"), Given("example.net", "en/", "allow"),
         Given("example.com", "de/", "block"), Given("org", "fr/", "allow"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, given: tuple[Given, ...] = GIVEN) -> Column:
    """The longest given rule that fits, as a struct of rule and verdict, else null.

    A rule fits its host and all subdomains if the path starts with the rule's. Longest counts
    the characters of the rule's name; ties go to the first in order of names.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(given, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & F.startswith(path, F.lit("/" + rule.path))
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: host labels, path pieces (digits as one class), query keys."""
    def named(prefix: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(prefix), v))

    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda pair: F.split(pair, "=")[0])
    pieces = F.split(F.regexp_replace(path, r"[0-9]+", "0"), r"/")
    return F.array_distinct(F.concat(named("h:", F.split(host, r"\.")), named("p:", pieces), named("q:", keys)))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, floor: int = LEAST_ROWS) -> DataFrame:
    """tokens (array), verdict, confidence, n: association rules from `labelled` (tokens, verdict).

    Rules of every size, pruned by support (`floor` rows at least) and confidence, and where a
    set with one token less says the same with at least as much confidence. What can be in no
    rule that stays is not mined: tokens that are not frequent; tokens of one verdict only, which
    are rules by themselves; and of tokens that stand in the same rows, all but one, for which
    the others are put in afterwards. So one long URL, or a thousand copies of it, is one item.
    Without labelled rows there are no rules.
    """
    spark = labelled.sparkSession
    schema = "tokens array<string>, verdict string, confidence double, n bigint"
    labelled = cut(labelled.select("tokens", "verdict"))
    total = labelled.count()
    if not total:
        return spark.createDataFrame([], schema)
    least = max(floor, int(support * total))
    # A token's rows by two sums of hashes of what they hold; equal rows are one and the same.
    row = [F.xxhash64(F.lit(i), F.array_sort("tokens"), "verdict").cast("decimal(20,0)") for i in range(2)]
    posts = labelled.select(F.explode(F.array_distinct("tokens")).alias("token"), "verdict", *[h.alias(f"_h{i}") for i, h in enumerate(row)])
    common = cut(posts.groupBy("token").agg(
        F.count("*").alias("n"), F.min("verdict").alias("_first"), F.max("verdict").alias("_last"),
        F.sum("_h0").alias("_s0"), F.sum("_h1").alias("_s1")).where(F.col("n") >= least))
    sure = common.where(F.col("_first") == F.col("_last")).select(
        F.array("token").alias("tokens"), F.col("_first").alias("verdict"), F.lit(1.0).alias("confidence"), "n")
    # Of tokens with enough support there are at most (tokens per URL) / support.
    classes = common.where(F.col("_first") != F.col("_last")).groupBy("n", "_s0", "_s1").agg(
        F.min("token").alias("token"), F.array_sort(F.collect_list("token")).alias("_members")).select("token", "_members")
    classes = cut(classes)
    kept = [row.token for row in classes.select("token").orderBy("token").collect()]
    items = labelled.select(F.concat(F.array_intersect("tokens", F.array(*[F.lit(t) for t in kept]).cast("array<string>")),
                                     F.array(F.concat(F.lit(LABEL), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least / total, minConfidence=confidence).fit(cut(items))
    found = cut(model.freqItemsets)
    is_label = F.exists("items", lambda t: t.startswith(LABEL))
    plain = F.filter("items", lambda t: ~t.startswith(LABEL))
    whole = found.where(~is_label).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))
    with_label = found.where(is_label & (F.size("items") > 1)).select(
        F.array_sort(plain).alias("tokens"), F.filter("items", lambda t: t.startswith(LABEL))[0].alias("_l"), "freq")
    rules = cut(with_label.join(whole, "tokens").select(
        "tokens", F.substring("_l", len(LABEL) + 1, 1 << 20).alias("verdict"),
        (F.col("freq") / F.col("n")).alias("confidence"), "n").where(F.col("confidence") >= confidence))
    # A rule falls if one with one token less is as sure of the same.
    shorter = rules.select(F.col("tokens").alias("_short"), F.col("verdict").alias("_v"), F.col("confidence").alias("_c"))
    said = rules.where(F.size("tokens") > 1).select("*", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("tokens")), lambda i: F.filter(
            F.col("tokens"), lambda _, j: j != i - 1))).alias("_short")).join(
        shorter, "_short").where((F.col("_v") == F.col("verdict")) & (F.col("_c") >= F.col("confidence")))
    minimal = rules.join(said.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti")
    # Every way to take one member for each token.
    members = minimal.select("*", F.explode("tokens").alias("token")).join(small_or_shuffled(classes, SMALL_CLASSES), "token").groupBy(
        "tokens", "verdict", "confidence", "n").agg(F.collect_list("_members").alias("_lists"))
    ways = F.aggregate("_lists", F.array(F.array().cast("array<string>")), lambda made, list_: F.flatten(F.transform(
        made, lambda m: F.transform(list_, lambda t: F.array_append(m, t)))))
    return members.select(F.explode(ways).alias("_t"), "verdict", "confidence", "n").select(
        F.array_sort("_t").alias("tokens"), "verdict", "confidence", "n").unionByName(sure)


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """_key, tokens_matched, verdict, confidence: the best mined rule of each row of `urls`
    (_key, tokens) that meets one: highest confidence, then support, then tokens in order."""
    posts = rules.select(F.explode("tokens").alias("token"), F.size("tokens").alias("_size"), F.col("n").alias("_n"),
                         F.struct("tokens", "verdict", "confidence", "n").alias("_rule"))
    seen = cut(posts.groupBy("token").agg(F.count("*").alias("_rules")))
    # Posted under the token that fewest rules hold, so common tokens carry few rules.
    rarest = Window.partitionBy("_rule").orderBy("_rules", "token")
    index = cut(posts.join(seen, "token").withColumn("_r", F.row_number().over(rarest)).where("_r = 1").select(
        "token", "_rule"))
    met = urls.select("_key", "tokens", F.explode("tokens").alias("token")).join(small_or_shuffled(index), "token").where(
        F.size(F.array_except("_rule.tokens", "tokens")) == 0)
    best = met.groupBy("_key").agg(F.min(F.struct(
        -F.col("_rule.confidence"), -F.col("_rule.n"), F.col("_rule.tokens"), F.col("_rule.verdict"))).alias("_best"))
    return best.select("_key", F.col("_best.tokens").alias("tokens_matched"), F.col("_best.verdict").alias("verdict"),
                       (-F.col("_best.col1")).alias("confidence"))


def judge(pages: DataFrame, key: str = "page_id", given: tuple[Given, ...] = GIVEN) -> DataFrame:
    """key, host, path, rule, verdict, tokens_matched, confidence: one row per row of `pages`.

    `pages` needs the columns `key` and url. rule is the name of the given rule that decides, else
    null; then the mined rule in tokens_matched decides, or without one the verdict is DEFAULT.
    Labels are the given rules' verdicts on all rows. Equal URLs are judged once. A null key, and
    rows of one key, are judged like others; a null URL has no tokens; URLs may be of any length.
    Without rows there are none.
    """
    host, path = parts(F.col("url"))
    parsed = pages.select(F.col(key), F.col("url").cast("string").alias("url")).select(
        key, "url", host.alias("host"), path.alias("path"))
    ruled = parsed.select("*", given_rule(F.col("host"), F.col("path"), given).alias("_given"),
                          tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined = mine(ruled.where("_given is not null").select("tokens", F.col("_given.verdict").alias("verdict")))
    open_sets = cut(ruled.where("_given is null").select(F.array_sort("tokens").alias("tokens")).distinct())
    # A set's name is a hash of 256 bits, so rows need not compare their tokens again.
    name = F.sha2(F.array_join("tokens", "\0"), 256)
    found = cut(matched(open_sets.select(name.alias("_key"), "tokens"), mined).withColumnRenamed("verdict", "_mined"))
    rows = ruled.select(F.col(key).alias("_id"), "host", "path", "_given", F.array_sort("tokens").alias("tokens"))
    undecided = rows.where("_given is null").select("_id", "host", "path", name.alias("_name"))
    # Rows that a given rule decides do not take part in the join, and common sets are cut up.
    small = found.limit(SMALL_SETS + 1).count() <= SMALL_SETS
    joined = (undecided.join(F.broadcast(found), F.col("_name") == F.col("_key"), "left") if small
              else attach(undecided, found, [("_name", "_key")], "left"))
    nothing = [F.lit(None).cast("array<string>").alias("tokens_matched"), F.lit(None).cast("double").alias("confidence")]
    decided = rows.where("_given is not null").select(
        "_id", "host", "path", F.col("_given.rule").alias("rule"), F.col("_given.verdict").alias("verdict"), *nothing)
    return joined.select("_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                         F.coalesce("_mined", F.lit(DEFAULT)).alias("verdict"), "tokens_matched", "confidence").unionByName(
        decided).withColumnRenamed("_id", key)
