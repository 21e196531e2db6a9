"""Phrases by a plain count of everything."""

import random
import re
from collections import Counter

import pytest
from plumbgrid.llm import phrases
from pyspark.sql import functions as F
from samples import CLASHING


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", piece) if w] for piece in re.split(r"[.,;:!?\n\x0b\f\r]", low)]


def plain(rows, least, top, held):
    """(lang, rank, phrase, a, l, r, n, score) of all rows (text, lang)."""
    counts, totals, out = {}, Counter(), []
    for text, lang in rows:
        f = counts.setdefault(lang if lang is not None else "und", Counter())
        for words in split(text):
            totals[lang if lang is not None else "und"] += len(words)
            for k in (1, 2, 3):
                f.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        found = []
        for words, a in f.items():
            if len(words) < 2 or a < least:
                continue
            if len(words) == 2 and any(len(x) == 3 and n >= least and 100 * n >= held * a and words in (x[:2], x[1:])
                                       for x, n in f.items()):
                continue
            cuts = [(10 ** 6 * a * a // (f[words[:k]] * f[words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found.append((score, a, " ".join(words), f[words[:k]], f[words[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, totals[lang], s) for i, (s, a, p, l, r) in enumerate(found[:top], 1)]
    return sorted(out)


def rows_of(got):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got)


def texts(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "naïve", "x'y", "a|b", " ", "z" * 40] + [f"w{i}" for i in range(8)]
    fixed = ["one two three four five six", "red green blue", "the end", "same same same same"]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(0, 30)):
            words.append(rng.choice(fixed) if rng.random() < .2 else rng.choice(vocabulary))
            words.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!?"]))
        out.append(("".join(words), rng.choice(["en", "en", "de", None, "x y", ""])))
    return out + [(None, "en"), ("", "de"), (" \t.,", "fr"), ("one two", "rare")]


@pytest.mark.parametrize("seed, least, top, held, small", [(1, 3, 2000, 50, False), (2, 10, 5, 50, True), (3, 1, 2000, 90, True)])
def test_phrases(spark, monkeypatch, seed, least, top, held, small):
    rows = texts(seed)
    if small:  # one document at a time, and a filter that lets most rare words through
        monkeypatch.setattr(phrases, "COUNT_BYTES", 1)
        monkeypatch.setattr(phrases, "FILTER_BITS", 64)
        monkeypatch.setattr(phrases, "CHUNK_BITS", 32)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3).select(
        "*", *[F.lit("other").alias(c) for c in CLASHING])
    assert rows_of(phrases.collocations(docs, least, top, held).collect()) == plain(rows, least, top, held)


def test_paths_are_the_fixed_runs(spark):
    rows = [("one two three four five six, two three x", "en")] * 12 + [("a b c d. a b c e. q a b c", "en")] * 10
    rows += [("same same same same", "en")] * 10
    edges, nodes, words, totals = phrases.graph(spark.createDataFrame(rows, "text string, lang string"))
    got = sorted((" ".join(r.words), r.n) for r in phrases.paths(edges, nodes).collect())
    assert got == sorted([("two three four five six", 12), ("one two three", 12), ("two three x", 12), ("a b c", 30), ("b c d", 10),
                          ("b c e", 10), ("q a b", 10), ("same same same", 20)])
    assert {(r.lang, r.n) for r in totals.collect()} == {("en", 12 * 9 + 10 * 12 + 40)}


def test_long_paths(spark):
    """A passage of many words without punctuation is one path, found in few rounds."""
    passage = [f"v{i}" for i in range(300)]
    rows = [(f"{k} " + " ".join(passage), "en") for k in range(11)]
    edges, nodes, _, _ = phrases.graph(spark.createDataFrame(rows, "text string, lang string"))
    assert [(r.words, r.n) for r in phrases.paths(edges, nodes).collect()] == [(passage, 11)]


def test_counts_past_64_bits(spark):
    """Products of counts are decimals: 10 ** 12 occurrences still give the floor exactly."""
    a, l, r = 10 ** 12 + 7, 3 * 10 ** 12 + 1, 2 * 10 ** 12 + 9
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(
        phrases._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 10 ** 6 * a * a // (l * r)


def test_no_documents(empty):
    assert phrases.collocations(empty).count() == 0
