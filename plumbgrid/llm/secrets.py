"""Secrets by regular expressions over a trigram inverted index, in SQL functions only.

Each rule's expression is read for the strings that any match must hold; their trigrams give a
Boolean query (any of some sets of trigrams, all of a set). The index holds, for the trigrams
that rules ask for, a posting per document. Intersected postings name the documents in which a
rule is verified by its expression; a rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgrid.llm.text import small_or_shuffled
from plumbgrid.session import cut

#: Alternatives of a string that are followed at once, beyond which it is cut there.
MOST_STRINGS = 32
#: Lengths that are summed at once where running sums are taken.
BLOCK = 64


@dataclass(frozen=True)
class Rule:
    """`group` of a match must have `least` characters; `quick` is an expression that any text
    with such a match also matches, for rules that scan every document."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    quick: str = ""


#: The kinds that are always reported, in this order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Runs of 32 or more are the same whether shorter ones are matched and dropped or not matched.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)
#: Further kinds, public formats of tokens and keys.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{24,}"),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

Clauses = frozenset  # of frozensets of trigrams: any set of which all are there


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """Sets of lower-case trigrams, one of which is wholly in any text that matches.

    {frozenset()} holds for every text: the expression has no mandatory trigram.
    """
    always = frozenset([frozenset()])

    def least(query: frozenset) -> frozenset:
        return frozenset(c for c in query if not any(d < c for d in query))

    def both(one: frozenset, two: frozenset) -> frozenset:
        out = least(frozenset(c | d for c in one for d in two))
        return out if len(out) <= MOST_STRINGS else max(one, two, key=lambda q: min(map(len, q)))

    def of_strings(strings: set[str]) -> frozenset:
        return least(frozenset(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings))

    def walk(nodes) -> tuple[set[str] | None, frozenset]:
        """All strings of a finite part (else None), and its query."""
        strings, query, finite = {""}, always, True

        def close() -> None:
            nonlocal strings, query, finite
            query, strings, finite = both(query, of_strings(strings)), {""}, False

        for op, value in nodes:
            name = str(op)
            part: set[str] | None = None
            inner = always
            if name == "LITERAL":
                part = {chr(value).lower()}
            elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in value):
                size = sum(1 if str(o) == "LITERAL" else v[1] - v[0] + 1 for o, v in value)
                if size <= 8:
                    part = {chr(c).lower() for o, v in value
                            for c in ([v] if str(o) == "LITERAL" else range(v[0], v[1] + 1))}
            elif name == "SUBPATTERN":
                part, inner = walk(value[-1])
            elif name == "BRANCH":
                found = [walk(x) for x in value[1]]
                if all(s is not None for s, _ in found):
                    part = set().union(*[s for s, _ in found])
                else:
                    inner = least(frozenset().union(*[q if s is None else of_strings(s) for s, q in found]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, body = value
                some, inner = walk(body)
                inner = inner if low else always
                if some is not None and (low, high) in ((0, 1), (1, 1)):
                    part = some | ({""} if low == 0 else set())
                elif some is not None and low:
                    inner = of_strings(some)
            if part is not None and len(part) * len(strings) <= MOST_STRINGS:
                strings = {s + p for s in strings for p in part}
            else:
                close()
                query = both(query, inner if part is None else of_strings(part))
        return (strings, query) if finite else (None, both(query, of_strings(strings)))

    strings, query = walk(re._parser.parse(pattern))  # noqa: SLF001  the standard library's own reading
    return query if strings is None else of_strings(strings)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, doc_id), for the given lower-case trigrams."""
    wanted = F.array(*[F.lit(t) for t in trigrams]) if trigrams else F.array().cast("array<string>")
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))[0]
    return docs.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and rules, the kinds whose trigram query the document's postings fulfil."""
    spark = docs.sparkSession
    rows = [(r.kind, i, t, len(c)) for r in rules for i, c in enumerate(sorted(map(sorted, trigram_query(r.pattern))))
            for t in c]
    # Bounded by the rules.
    clauses = spark.createDataFrame(rows, "kind string, clause int, trigram string, need int")
    found = postings(docs, sorted({t for _, _, t, _ in rows})).join(F.broadcast(clauses), "trigram")
    return (found.groupBy("doc_id", "kind", "clause", "need").agg(F.count_distinct("trigram").alias("_have"))
            .where("_have = need").groupBy("doc_id").agg(F.collect_set("kind").alias("rules")))


def running(lengths: Column) -> Column:
    """Running sums of an array of numbers, block by block."""
    zero = F.lit(0).cast("bigint")

    def total(values: Column) -> Column:
        return F.aggregate(values, zero, lambda a, b: a + b)

    def of(values: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
        return F.transform(F.array(F.transform(blocks, lambda b: total(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))),
                           lambda sums: F.flatten(F.transform(blocks, lambda b: within(values, sums, b))))[0]

    def within(values: Column, sums: Column, b: Column) -> Column:
        return F.transform(F.array(total(F.slice(sums, F.lit(1), b))), lambda before: F.transform(
            F.slice(values, b * BLOCK + 1, F.lit(BLOCK)),
            lambda _, i: before + total(F.slice(values, b * BLOCK + 1, i + 1))))[0]

    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.array(lengths), of)[0])


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's matches, leftmost and without overlap, in code points.

    A text is what stands between the matches and the matches in turn, so their lengths give
    the places.
    """
    def of(hits: Column) -> Column:
        gaps = F.split(text, rule.pattern, -1)
        lengths = F.zip_with(F.slice(F.transform(gaps, F.length), F.lit(1), F.size(hits)), hits,
                             lambda gap, hit: (gap + F.length(hit)).cast("bigint"))
        placed = F.zip_with(running(lengths), hits, lambda end, hit: F.struct(
            (end - F.length(hit)).alias("start"), end.alias("end")))
        if rule.least <= 1:
            return placed
        long = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
        return F.filter(placed, lambda _, i: F.get(long, i) >= rule.least)

    return F.transform(F.array(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))), of)[0]


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """doc_id, base and spans (array<struct<start, rule, end>>): one row per row of `docs`.

    rule counts `base` and then `more`; base holds the matches of `base` only. Offsets are code
    points, end exclusive. A null text is empty. A row without doc_id has no postings, so every
    rule scans it. Rows of one doc_id share their postings, so some may be verified in vain.
    Other columns are not looked at.
    """
    rules = (*base, *more)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    indexed = tuple(r for r in rules if frozenset() not in trigram_query(r.pattern))
    found = cut(candidates(docs.where("doc_id is not null"), indexed))
    joined = docs.join(small_or_shuffled(found), "doc_id", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def of(number: int) -> Column:
        rule = rules[number]
        if rule in indexed:
            here = F.col("doc_id").isNull() | F.array_contains("rules", rule.kind)
        else:
            here = F.col("text").rlike(rule.quick) if rule.quick else F.lit(True)
        return F.transform(F.when(F.coalesce(here, F.lit(False)), spans(F.col("text"), rule)).otherwise(none),
                           lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("rule"), s["end"].alias("end")))

    each = joined.select("doc_id", *[of(i).alias(f"_r{i}") for i in range(len(rules))])
    return each.select("doc_id", F.array_sort(F.concat(*[f"_r{i}" for i in range(len(base))])).alias("base"),
                       F.array_sort(F.concat(*[f"_r{i}" for i in range(len(rules))])).alias("spans"))


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Counts per base kind, a hash of the base spans, and all spans as text."""
    kinds = F.array(*[F.lit(r.kind) for r in (*base, *more)])

    def joined(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(
            ":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rule"] == number)).cast("bigint").alias(f"n_{base[number].kind}")

    return found.select("doc_id", *[count(i) for i in range(len(base))],
                        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def sql(base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> str:
    """The same for DuckDB, each rule over every document."""
    def one(number: int, rule: Rule) -> str:
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        return (f"SELECT doc_id, {number} AS rule, '{rule.kind}' AS kind, {rule.least} AS least, "
                f"regexp_extract_all(x, {pattern}) AS hits, string_split_regex(x, {pattern}) AS gaps, "
                f"regexp_extract_all(x, {pattern}, {rule.group}) AS vals FROM t")

    rules = (*base, *more)
    counts = ", ".join(f"count(*) FILTER (rule = {i})::BIGINT AS n_{r.kind}" for i, r in enumerate(base))
    names = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in base)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
h AS ({" UNION ALL ".join(one(i, r) for i, r in enumerate(rules))}),
m AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h),
p AS (SELECT doc_id, rule, kind, length(hits[i]) AS n,
             list_sum(list_transform(gaps[1:i], lambda s: length(s)))
             + coalesce(list_sum(list_transform(hits[1:i - 1], lambda s: length(s))), 0) AS s
      FROM m WHERE length(vals[i]) >= least),
a AS (SELECT doc_id, {counts},
             string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, rule) FILTER (rule < {len(base)}) AS b,
             string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, rule) AS spans
      FROM p GROUP BY doc_id)
SELECT t.doc_id, {names}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a ON a.doc_id = t.doc_id
"""
