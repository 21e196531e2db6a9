"""Packing into sequences, by a plain best fit and by what has to hold of every packing."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from plumbgrid.llm import bins, queries
from pyspark.sql import functions as F


def plain(lengths, capacity):
    """Best fit, longest first, an item at a time: the room left in each bin, in the order made."""
    rooms, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [b for b, r in enumerate(rooms) if r >= lengths[i]]
        if not fits:
            rooms.append(capacity)
            fits = [len(rooms) - 1]
        best = min(fits, key=lambda b: rooms[b])
        where[i] = best
        rooms[best] -= lengths[i]
    return rooms, where


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_best_fit_is_the_plain_one(lengths):
    where, place = bins.best_fit(np.array(lengths, dtype=np.int64), 24)
    rooms, _ = plain(lengths, 24)
    held = {}
    for i, (b, at) in enumerate(zip(where.tolist(), place.tolist())):
        held.setdefault(b, []).append((at, lengths[i]))
    for parts in held.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= 24
    assert sorted(24 - sum(n for _, n in p) for p in held.values()) == sorted(rooms)


def encoded(rows):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    return [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows]


def check(rows, got, capacity):
    """Every document whole, in gapless sequences of at most the capacity; the number of sequences."""
    want = []
    for doc_id, ids in encoded(rows):
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            want.append((doc_id, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))

    def order(r):
        return tuple((x is not None, x or 0) for x in r)

    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=order) == sorted(want, key=order)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("capacity, group_items", [(2048, 100_000), (64, 40), (7, 100_000), (64, 5)])
def test_sequences(spark, docs, rows, capacity, group_items):
    found = bins.sequences(docs.repartition(12), queries.tokenizer_file(), 0, capacity, group_items=group_items)
    pairs = [(r[0], r[1]) for r in rows]
    got = bins.placed(found).collect()
    n = check(pairs, got, capacity)
    lengths = [r.length for r in got]
    assert n <= len(plain(lengths, capacity)[0]) * 1.05 + 1
    ids = {}
    for doc_id, x in encoded(pairs):
        ids.setdefault(doc_id, []).append(x)
    for r in found.collect():
        assert r.filled == sum(p.length for p in r.pieces) and [p.offset for p in r.pieces] == sorted(p.offset for p in r.pieces)
        for p in r.pieces:
            assert any(np.frombuffer(p.ids, "<u4").tolist() == x[p.start:p.start + p.length] for x in ids[p.doc_id])


def test_documents_that_can_not_be_joined(spark):
    """No two pieces fit together: a level joins nothing and is the last."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), 40).alias("text")).repartition(12)
    got = bins.placed(bins.sequences(docs, queries.tokenizer_file(), 0, 64, group_items=4)).collect()
    assert check([(r, "a " * 40) for r in range(60)], got, 64) == 60


def test_nothing_to_pack(spark, empty):
    assert bins.sequences(empty, queries.tokenizer_file(), 0).count() == 0


def test_registered_packing_is_close_to_the_bound(spark):
    found = queries.QUERIES["op13_best_fit_packing"](spark, "/root/testdata/sf0.01")
    assert set("doc_id piece start length ids_crc32 sequence_id offset".split()) <= set(found.columns)
    got = found.collect()
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    n = check([tuple(r) for r in rows], got, 2048)
    assert n <= -(-sum(r.length for r in got) // 2048) * 1.01 + 1
