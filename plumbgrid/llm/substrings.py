"""Removal of word sequences that an earlier document holds, by recompression.

In rounds, equal symbols in a row and then pairs of a left and a right symbol get one new
symbol each (which symbols are left is a matter of their name and the round). A name is a hash
of what it stands for, so names are the same everywhere without a table of them, and the inner
symbols of equal word sequences are the same wherever these stand.

Each symbol knows the words on which its being there depends. A window of words is represented
by its anchor: of the symbols that depend on words of the window only, one of the highest
level, and there the one with the least name, together with the words it depends on. Equal
windows have equal anchors. So

1. only anchors in two documents matter (`shared`); all other text is done with after one
   count of anchors, about one for five words;
2. windows in a row with one anchor form a stretch, and stretches of equal words are settled as
   a whole: all but the first document's are removed;
3. where one anchor has several different stretches, the first document of each compares its
   windows one by one.

This is exact up to collisions of 64-bit names of anchors and stretches taken together, and of
128-bit names of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgrid.llm.text import (Powers, mix, signed, slices, small_or_shuffled, spans, word_hashes,
                                word_spans)
from plumbgrid.session import cut

#: Rounds of pairs; more have longer symbols, but the anchors of windows then change more often.
#: Runs are joined before the first only: later ones would make symbols depend on more words.
ROUNDS = 2
#: A stretch's first window and its windows (at most 13 of them, for each holds the anchor) in one number.
PACK = 64


def runs(name: np.ndarray, s: np.ndarray, e: np.ndarray, ds: np.ndarray, de: np.ndarray,
         first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal symbols in a row become one. A symbol depends on its neighbours being different."""
    head = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | first[1:]))
    tail = np.append(head[1:], len(name)) - 1
    length = (tail - head + 1).astype(np.uint64)
    last = np.append(first[1:], True)
    return (np.where(length > 1, mix(name[head] + length * np.uint64(0xD6E8FEB86659FD93)), name[head]), s[head], e[tail],
            np.where(first[head], s[head] - 1, ds[head - 1]),
            np.where(last[tail], e[tail] + 1, de[np.minimum(tail + 1, len(name) - 1)]), first[head])


def pairs(name: np.ndarray, s: np.ndarray, e: np.ndarray, ds: np.ndarray, de: np.ndarray,
          first: np.ndarray, number: int) -> tuple[np.ndarray, ...]:
    """A left symbol and a right one after it become one; others depend on a neighbour as well."""
    right = (mix(name + np.uint64(number)) & np.uint64(1)).astype(bool)
    after = np.append(np.arange(1, len(name)), len(name) - 1)
    last = np.append(first[1:], True)
    paired = ~right & right[after] & ~last
    second = np.append(False, paired[:-1])
    alone_left, alone_right = ~right & ~paired, right & ~second
    ds = np.where(alone_right, np.where(first, s - 1, ds[np.arange(len(name)) - 1]), ds)
    new_de = np.where(paired, de[after], np.where(alone_left, np.where(last, e + 1, de[after]), de))
    new_name = np.where(paired, mix(name * np.uint64(0xA0761D6478BD642F) + mix(name[after])), name)
    keep = ~second
    return new_name[keep], s[keep], np.where(paired, e[after], e)[keep], ds[keep], new_de[keep], first[keep]


def anchors(words: np.ndarray, offsets: np.ndarray, window: int, table: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, windows) of each stretch of windows with one anchor, as places in `words`."""
    n = np.diff(offsets)
    fits = np.maximum(n - window + 1, 0)
    if not fits.sum():
        return words[:0], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    p = np.arange(fits.sum()) + np.repeat(offsets[:-1] - np.append(0, np.cumsum(fits)[:-1]), fits)
    at = np.arange(len(words))
    first = np.zeros(len(words), dtype=bool)
    first[offsets[:-1][n > 0]] = True
    level = (words, at, at + 1, at, at + 1, first)
    levels = [level]
    for number in range(1, ROUNDS + 1):
        level = pairs(*(runs(*level) if number == 1 else level), number)
        levels.append(level)
    name = np.zeros(len(p), dtype=np.uint64)
    place = np.full(len(p), -1, dtype=np.int64)
    start, end = np.zeros(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64)
    for number in range(ROUNDS, -1, -1):
        todo = np.flatnonzero(place < 0)
        names, _, _, ds, de, _ = levels[number]
        # Symbols that begin to depend before a word, and that depend on words up to one only.
        before = np.cumsum(np.bincount(np.maximum(ds, 0) + 1, minlength=len(words) + 2))
        before[0] = 0
        until = np.cumsum(np.bincount(de, minlength=len(words) + 2))
        low, high = before[p[todo]], until[p[todo] + window]
        low = low + (ds[0] < 0) * (p[todo] == 0)
        some = high > low
        todo, low, high = todo[some], low[some], high[some]
        if not len(todo):
            continue
        best, which = names[low], low.copy()
        for j in range(1, int((high - low).max())):
            rest = np.flatnonzero(low + j < high)
            other = names[low[rest] + j]
            less = other < best[rest]
            best[rest[less]], which[rest[less]] = other[less], low[rest[less]] + j
        name[todo], place[todo] = best, which * (ROUNDS + 1) + number
        start[todo], end[todo] = ds[which], de[which]
    head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (p[1:] != p[:-1] + 1)))
    n = np.append(head[1:], len(p)) - head
    return mix(name[head]) ^ spans(words, start[head], end[head], table), p[head], n


def stretches(docs: DataFrame, window: int) -> DataFrame:
    """anchor, stretch (a name of its words), doc_id, span (first window * PACK + windows) and
    once (the first with this anchor in its document)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            for start, end in slices(batch.column(1)):
                words, offsets = word_hashes(batch.column(1)[start:end], table)
                name, p, n = anchors(words, offsets, window, table)
                owner = np.searchsorted(offsets, p, side="right") - 1
                once = np.zeros(len(p), dtype=bool)
                order = np.lexsort((p, name, owner))
                new = (name[order][1:] != name[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                once[order[np.append(True, new)[: len(order)]]] = True
                ids = batch.column(0)[start:end].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(name)), pa.array(signed(spans(words, p, p + n - 1 + window, table))),
                     pa.array(ids[owner]), pa.array((p - offsets[owner]) * PACK + n), pa.array(once)],
                    ["anchor", "stretch", "doc_id", "span", "once"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(
        work, "anchor bigint, stretch bigint, doc_id bigint, span bigint, once boolean")


def intervals(found: DataFrame) -> DataFrame:
    """doc_id, parts: the windows of each document's spans as array of start, end, start, end, ...,
    in order and without overlap. A document's spans are as many as its words at most."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for row in batch.column(1).to_pylist():
                packed = np.sort(np.array(row, dtype=np.int64))
                start, end = packed // PACK, packed // PACK + packed % PACK
                reach = np.maximum.accumulate(end)
                new = np.append(True, start[1:] > reach[:-1])
                parts.append(np.stack([start[new], np.append(reach[:-1][new[1:]], reach[-1])], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.int32()))], ["doc_id", "parts"])

    return found.groupBy("doc_id").agg(F.collect_list("span").alias("spans")).mapInArrow(
        work, "doc_id bigint, parts array<int>")


def window_names(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """w1, w2 (a window's name), doc_id, at: the windows of the documents' parts in `wanted`."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            for start, end in slices(batch.column(1)):
                words, offsets = word_hashes(batch.column(1)[start:end], table)
                p, owner = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                for i, row in enumerate(batch.column(2)[start:end].to_pylist()):
                    most = offsets[i + 1] - offsets[i] - window + 1
                    for low, high in zip(row[0::2], row[1::2]):
                        p.append(np.arange(low, min(high, most)) + offsets[i])
                        owner.append(np.full(len(p[-1]), i))
                p, owner = np.concatenate(p), np.concatenate(owner)
                ids = batch.column(0)[start:end].to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(spans(words, p, p + window, table))),
                     pa.array(signed(spans(mix(words), p, p + window, table))),
                     pa.array(ids[owner]), pa.array(p - offsets[owner])], ["w1", "w2", "doc_id", "at"])

    return docs.join(small_or_shuffled(wanted), "doc_id").select("doc_id", "text", "parts").mapInArrow(
        work, "w1 bigint, w2 bigint, doc_id bigint, at bigint")


def repeated(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, span: windows whose words also stand in a document with a smaller doc_id."""
    found = stretches(docs, window)
    shared = found.where("once").groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1")
    found = cut(found.drop("once").join(shared.select("anchor"), "anchor"))
    firsts = found.groupBy("anchor", "stretch").agg(F.min("doc_id").alias("first"))
    many = cut(firsts.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1").select("anchor"))
    judged = cut(found.join(firsts, ["anchor", "stretch"]).select(
        F.when(F.col("doc_id") == F.col("first"), F.col("anchor")).alias("anchor"), "doc_id", "span"))
    whole = judged.where("anchor is null").select("doc_id", "span")
    own = cut(intervals(judged.where("anchor is not null").join(many, "anchor").select("doc_id", "span")))
    # Names are made again rather than kept: most windows meet no other by their first name.
    twice = window_names(docs, own, window).groupBy("w1").agg(F.count("*").alias("_n")).where("_n > 1").select("w1")
    named = cut(window_names(docs, own, window).join(twice, "w1"))
    least = named.groupBy("w1", "w2").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo < _hi")
    single = named.join(least, ["w1", "w2"]).where("doc_id > _lo").select(
        "doc_id", (F.col("at") * PACK + 1).alias("span"))
    return whole.unionByName(single)


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept, one row per row of `docs` (doc_id, text).

    Each word is removed that is covered by a window (`window` words in a row of one document)
    whose words also stand in a document with a smaller doc_id, in the input as it is. kept is
    the other words joined by one space. Words are runs of other than ASCII white space.

    A null text has no words. A row without doc_id keeps all its words and removes none of
    others. Rows of one doc_id do not remove each other's words; what is removed from one of
    them by place is removed from all. Other columns are not looked at.
    """
    if not 1 <= window < PACK:
        raise ValueError(f"window must be from 1 to {PACK - 1} words")
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    lists = cut(intervals(repeated(docs, window)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(1)):
                texts, parts = batch.column(1)[start:end], batch.column(2)[start:end].to_pylist()
                data, s, e, offsets = word_spans(texts)
                raw = data.tobytes()
                count, removed, kept = np.diff(offsets), [], []
                for i, row in enumerate(parts):
                    keep = np.ones(count[i], dtype=bool)
                    for low, high in zip((row or [])[0::2], (row or [])[1::2]):
                        keep[low:high - 1 + window] = False
                    places = np.flatnonzero(keep) + offsets[i]
                    kept.append(b" ".join([raw[a:b] for a, b in zip(s[places].tolist(), e[places].tolist())]).decode())
                    removed.append(count[i] - len(places))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:end], pa.array(count, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.join(small_or_shuffled(lists), "doc_id", "left").select("doc_id", "text", "parts").mapInArrow(
        work, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
