"""What each stage of the pipeline lets go and keeps, on a small corpus with planted rows."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from plumbgrid.llm import queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def planted(spark, given):
    """Two hundred of the given documents and, by thousands of their ids, rows that a stage has to see."""
    some = [r for r in given.where("length(text) between 400 and 4000").orderBy("doc_id").limit(200).collect()]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id is not null").orderBy("item_id").limit(6).collect()
    rng = random.Random(4)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in some]
    top = max(r[0] for r in rows) + 1

    def add(kind, text, lang="en", source="src1"):
        rows.append((top + kind * 1_000 + len(rows), text, lang, source, len(text) if text is not None else None))

    for r in some[:20]:
        add(1, r.text, r.lang)  # exact copies
    for r in some[20:40]:
        words = r.text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        add(2, " ".join(words), r.lang)  # near copies
    for text in (None, "", "123 456", "!!! ...", " \n"):
        add(3, text)  # without a letter
    for item in items:
        add(4, f"{some[50].text[:300]} {item.text} {some[60].text[:300]}")  # leaks
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema), rows, top


def kind_of(doc_id, top):
    return 0 if doc_id < top else (doc_id - top) // 1_000


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_language_stage(spark, planted):
    docs, rows, top = planted
    out = STAGES["language ID"](spark, docs, SF)
    assert out.columns == docs.columns
    kept = ids(out)
    assert not any(kind_of(d, top) == 3 for d in kept)
    others = [r[0] for r in rows if kind_of(r[0], top) != 3]
    assert len(kept & set(others)) >= 0.98 * len(others)


def shingles(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_near_duplicate_stage(spark, planted):
    docs, rows, top = planted
    kept = ids(STAGES["MinHash near-dedup"](spark, docs, SF))
    sets = {r[0]: shingles(r[1]) for r in rows}
    group = {d: d for d in sets}
    order = sorted(sets)
    for _ in range(8):  # smallest id over links, until nothing changes
        for i, a in enumerate(order):
            for b in order[:i]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    assert kept == {d for d in sets if group[d] == d}
    assert not any(kind_of(d, top) == 1 for d in kept)


def test_decontamination_stage(spark, planted, given):
    docs, rows, top = planted
    kept = ids(STAGES["benchmark decontamination"](spark, docs, SF))
    assert not any(kind_of(d, top) == 4 for d in kept)
    held = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r[0] for r in rows} - kept
    # What goes shares most words of some item; the given rows that do not stay.
    for r in rows:
        words = set((r[1] or "").lower().split())
        if not any(len(set(t.lower().split()) & words) >= 0.6 * len(set(t.lower().split())) for t in held):
            assert r[0] not in gone


def test_mixing_stage(spark, planted):
    docs, rows, _ = planted
    out = STAGES["mixing sources to target weights"](spark, docs, SF)
    times = Counter(r.doc_id for r in out.collect())
    filled = {r[0] for r in rows if r[1] is not None and r[1].split()}
    assert filled <= set(times) and out.columns == docs.columns
    by_source = {}
    for r in rows:
        if r[0] in filled:
            by_source.setdefault(r[3], set()).add(times[r[0]])
    assert all(max(t) - min(t) <= 1 and max(t) <= queries.MIX_REPEATS for t in by_source.values())


def test_token_stage(spark, planted):
    from tokenizers import Tokenizer
    docs, rows, _ = planted
    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    got = {r.doc_id: r for r in STAGES["token-ID / binary output"](spark, docs, SF).collect()}
    import numpy as np
    start = 0
    for d, text, *_ in sorted(rows):
        sent = tokenizer.encode(text or "", add_special_tokens=False).ids + [corpus_pipeline.END_ID]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(sent), zlib.crc32(np.array(sent, "<u4").tobytes()))
        start += len(sent)
    assert len(got) == len(rows)


def test_fingerprint_query_and_what_is_next(spark):
    """The registered query: likeness to the next document is that of the two fingerprints."""
    from plumbgrid.llm import fingerprints
    got = {r.doc_id: r for r in queries.QUERIES["op1_fingerprints"](spark, "/root/testdata/sf0.001").collect()}
    order = sorted(got, reverse=True)
    pairs = [(got[a].fingerprint, got[b].fingerprint, got[a].near_next, got[a].fingerprint, got[a].edited_fingerprint, got[a].near_edited)
             for a, b in zip(order, order[1:] + order[:1])]
    like = spark.createDataFrame(pairs, "a string, b string, want double, c string, d string, edited double").select(
        "want", fingerprints.likeness(F.col("a"), F.col("b")).alias("is"), "edited", fingerprints.likeness(F.col("c"), F.col("d")).alias("is_edited")).collect()
    assert len(got) == 200 and all(r["want"] == r["is"] and r["edited"] == r["is_edited"] for r in like)
