"""Benchmark decontamination by latent semantic retrieval.

Passages of the benchmark become TF-IDF vectors over the benchmark's words, weighted by how many
document passages hold a word, and a distributed randomised SVD gives them a latent space.
A space holds no more benchmark passages than it has dimensions, so it loses nothing of them; a
larger benchmark has several. Every document passage is folded into each space and compared with
every benchmark passage by cosine; close ones are candidates, unless the passage holds too few of
the item's words for any subsequence to count. A candidate counts if the longest common subsequence of the
passage's and the item's words covers enough of the item, or less of it but the item's answer
(its last sentence) as well, so that paraphrases with replaced or moved words are found.

Words outside the benchmark's vocabulary say nothing about an item; they count in the length
of a passage and break subsequences, but have no weight of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgrid.llm.text import Powers, giving_back, slices, small_or_shuffled, word_hashes
from plumbgrid.session import cut

#: Words of a step; passages are WINDOWS steps long and begin at every step. Those of one step are for
#: items of no more words, which would drown in longer ones.
STEP, WINDOWS = 16, (1, 2, 4)
#: Latent dimensions, and so the passages of a space; extra ones while they are searched, power iterations.
RANK, EXTRA, POWER = 160, 16, 2
#: Bits of a word's hash that are looked at before the vocabulary is searched.
FIRST_BITS = 18
#: Cosine above which an item is a candidate for a passage.
COSINE = 0.35
#: Share of an item's words that a common subsequence must cover, alone and with the answer.
COVER, COVER_WITH_ANSWER, ANSWER = 0.7, 0.5, 0.6
#: Items of a benchmark that are searched at once; more take further passes over the documents.
GROUP = 5_000


@dataclass
class Block:
    """Item passages of one space: their vocabulary (sorted word hashes) and latent vectors."""

    vocabulary: np.ndarray
    folded: np.ndarray  # (word, dimension): what one occurrence adds to a passage
    items: np.ndarray  # (item passage, dimension), of length 1
    owner: np.ndarray  # place in the group of each item passage
    held: tuple | None = None  # the items' words by bits of the vocabulary, once they are asked for


@dataclass
class Space:
    """A group of items' passages: their spaces, items' ids, words, and words of the items' answers."""

    blocks: list[Block]
    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]


def answer_of(text: str) -> str:
    """The last sentence of an item, or all of it if it has one only."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    return parts[-1] if parts else ""


def places(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word in the vocabulary, its size for others."""
    out = np.full(len(words), len(vocabulary), dtype=np.int64)
    if len(vocabulary):
        # Most words fail by their first bits already.
        first = np.zeros(1 << FIRST_BITS, dtype=bool)
        first[vocabulary & (len(first) - 1)] = True
        may = np.flatnonzero(first[words & (len(first) - 1)])
        some = words[may]
        at = np.minimum(np.searchsorted(vocabulary, some), len(vocabulary) - 1)
        held = vocabulary[at] == some
        out[may[held]] = at[held]
    return out


def cuts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each step of words, and the text it belongs to; an empty text has none."""
    n = -(-np.diff(offsets) // STEP)
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
    return offsets[:-1][owner] + inside * STEP, owner


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many steps of all documents each word of the vocabulary stands, and all steps."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, steps = Powers(), shared.value, 0
        sums = np.zeros(len(known) + 1, dtype=np.int64)
        for batch in batches:
            for start, end in slices(batch.column(0)):
                words, offsets = word_hashes(batch.column(0)[start:end], table, lower=True)
                at = places(known, words)
                begins, _ = cuts(offsets)
                step = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(words))))
                keep = at < len(known)
                pairs = np.unique(step[keep] * np.int64(len(known) + 1) + at[keep])
                sums += np.bincount(pairs % (len(known) + 1), minlength=len(known) + 1)
                steps += len(begins)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()),
                                          pa.array(np.append(sums[seen], steps), pa.int64())], ["place", "n"])

    rows = docs.where("text is not null").select("text").mapInArrow(work, "place int, n bigint").groupBy("place").agg(
        F.sum("n").alias("n"))
    out, steps = np.zeros(len(vocabulary)), 0
    for row in rows.toLocalIterator():  # as many as the vocabulary at most
        if row.place < 0:
            steps = row.n
        else:
            out[row.place] = row.n
    return out, steps


def svd(rows: DataFrame, size: int, rank: int) -> np.ndarray:
    """Right singular vectors (word, dimension) of the matrix whose rows are places and weights.

    The matrix stays with the tasks: each iteration sends a block of (word, dimension) out and
    adds up the products A'(A block) that come back, one block per task.
    """
    width = min(size, rank + EXTRA)
    block = np.linalg.qr(np.random.default_rng(7).standard_normal((size, width)))[0]
    context = rows.sparkSession.sparkContext
    for _ in range(POWER + 1):
        shared = context.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((size, width))
            for batch in batches:
                for at, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at, weight = np.array(at, dtype=np.int64), np.array(weight)
                    out[at] += weight[:, None] * (weight @ shared.value[at])
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["part"])

        total = np.zeros((size, width))
        for row in rows.select("places", "weights").mapInArrow(work, "part binary").toLocalIterator():
            total += np.frombuffer(row.part).reshape(size, width)
        block = np.linalg.qr(total)[0]
    # The block spans the leading vectors; turn it to them by the last products.
    small = block.T @ total
    left, _, _ = np.linalg.svd(small)
    return (block @ left)[:, :rank]


def space(docs: DataFrame, items: list, rank: int = RANK) -> Space:
    """The latent spaces of `items` (id, text), `rank` passages each, by all documents' frequencies of their words."""
    spark = docs.sparkSession
    table = Powers()
    words, offsets = word_hashes(pa.array([t or "" for _, t in items], pa.string()), table, lower=True)
    ends, at = word_hashes(pa.array([answer_of(t or "") for _, t in items], pa.string()), table, lower=True)
    vocabulary = np.unique(words)
    each = [words[s:e] for s, e in zip(offsets, offsets[1:])]
    held, steps = frequencies(docs, vocabulary)
    idf = np.log((steps + 1) / (held + 0.5)).clip(min=0)
    vectors, item, parts = [], [], []
    for i, own in enumerate(each):
        # Long items are cut like documents, into parts of the longest window; what is left over and
        # short goes with the last.
        size = max(WINDOWS) * STEP
        starts = range(0, max(len(own) - size // 4, 1), size)
        for start, end in zip(starts, [*starts[1:], len(own)]):
            place, count = np.unique(np.searchsorted(vocabulary, own[start:end]), return_counts=True)
            weight = count * idf[place]
            if weight.any():
                vectors.append((place, weight / np.linalg.norm(weight)))
                item.append(i)
                parts.append(own[start:end])
    blocks = []
    # As even as they can be: what a block costs beside its passages is the same for all.
    bounds = np.linspace(0, len(vectors), -(-len(vectors) // rank) + 1).astype(int) if vectors else []
    for low, high in zip(bounds, bounds[1:]):
        part = vectors[low:high]
        own = np.searchsorted(vocabulary, np.unique(np.concatenate(parts[low:high])))
        part = [(np.searchsorted(own, p), w) for p, w in part]
        # As many rows as the block has passages.
        rows = cut(spark.createDataFrame([(p.tolist(), w.tolist()) for p, w in part],
                                         "places array<int>, weights array<double>"))
        basis = svd(rows, len(own), min(rank, len(part)))
        latent = np.array([w @ basis[p] for p, w in part])
        norms = np.linalg.norm(latent, axis=1, keepdims=True)
        blocks.append(Block(vocabulary[own], (idf[own][:, None] * basis).astype(np.float32),
                            (latent / np.maximum(norms, 1e-12)).astype(np.float32), np.arange(low, high)))
    return Space(blocks, [items[i][0] for i in item], parts, [ends[at[i]:at[i + 1]] for i in item])


def common(one: np.ndarray, two: np.ndarray) -> int:
    """Length of the longest common subsequence, a word of `two` at a time on bits of `one`."""
    masks: dict[int, int] = {}
    for i, word in enumerate(one.tolist()):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(one)) - 1
    row = full
    for word in two.tolist():
        meet = row & masks.get(word, 0)
        row = ((row + meet) | (row - meet)) & full
    return len(one) - row.bit_count()


class Held:
    """Upper bounds of how many of an item's words stand in a range of steps, by bits of the vocabulary."""

    def __init__(self, at: np.ndarray, begins: np.ndarray, known: Block, words: list[np.ndarray]) -> None:
        self.width = -(-max(len(known.vocabulary), 1) // 64)
        step = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(at))))
        keep = at < len(known.vocabulary)
        self.levels = [self.bits(step[keep], at[keep], len(begins))]  # level k: of 2**k steps from each
        if known.held is None:  # the same for all texts
            known.held = self.of_items(known, words)
        self.planes, self.row, self.repeats = known.held

    def of_items(self, known: Block, words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        # Plane m has an item's words that stand in it more than m times.
        planes: list[np.ndarray] = []
        items = np.unique(known.owner)
        repeats = np.zeros(len(items), dtype=np.int64)
        for i, item in enumerate(items):
            place, count = np.unique(np.searchsorted(known.vocabulary, words[item]), return_counts=True)
            repeats[i] = (count - 1).sum()
            for m in range(int(count.max(initial=0))):
                if m == len(planes):
                    planes.append(np.zeros((len(items), self.width), dtype=np.uint64))
                planes[m][i] = self.bits(np.zeros((count > m).sum(), dtype=int), place[count > m], 1)[0]
        return planes, np.searchsorted(items, known.owner), repeats

    def bits(self, row: np.ndarray, place: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros(rows * self.width, dtype=np.uint64)
        np.bitwise_or.at(out, row * self.width + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        return out.reshape(rows, self.width)

    def enough(self, first: np.ndarray, last: np.ndarray, passage: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether steps first to last may hold `least` words of the item of each passage."""
        depth = np.frexp((last - first + 1).astype(float))[1] - 1
        for k in range(len(self.levels), depth.max(initial=0) + 1):
            below, half = self.levels[-1], 1 << (k - 1)
            self.levels.append(below.copy())
            self.levels[-1][:-half] |= below[half:]
        out = np.zeros(len(first), dtype=bool)
        for k in np.unique(depth):
            of = np.flatnonzero(depth == k)
            for at in (of[low:low + 4096] for low in range(0, len(of), 4096)):
                there = self.levels[k][first[at]] | self.levels[k][last[at] - (1 << k) + 1]
                item = self.row[passage[at]]
                n = np.bitwise_count(there & self.planes[0][item]).sum(axis=1, dtype=np.int64)
                open_ = np.flatnonzero(n + self.repeats[item] >= least[at])
                n, there, item, at = n[open_], there[open_], item[open_], at[open_]
                for plane in self.planes[1:]:
                    n += np.bitwise_count(there & plane[item]).sum(axis=1, dtype=np.int64)
                out[at] = n >= least[at]
        return out


def retrieved(words: np.ndarray, offsets: np.ndarray, known: Space, cosine: float,
              least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, past last word, item, cosine) of passages and the items near them.

    Without those of which the passage, widened as in `verified`, holds less than the share
    `least` of the item's words.
    """
    begins, owner = cuts(offsets)
    out: list[list[np.ndarray]] = [[np.zeros(0, dtype=int)] for _ in range(4)] + [[np.zeros(0)]]
    # First and last step of each step's text.
    ends = np.searchsorted(owner, owner, side="left"), np.searchsorted(owner, owner, side="right") - 1
    text_end = offsets[1:][owner]
    lengths = np.array([len(w) for w in known.words], dtype=np.int64)
    for block in known.blocks if len(begins) else []:
        at = places(block.vocabulary, words)
        held = Held(at, begins, block, known.words) if least else None
        # Other words, and what a text's last step lacks, add a row of zeros.
        folded = np.vstack([block.folded, np.zeros((1, block.folded.shape[1]), dtype=np.float32)])
        grid = begins[:, None] + np.arange(STEP)
        inside = grid < text_end[:, None]
        grid = np.where(inside, at[np.where(inside, grid, 0)], len(block.vocabulary))
        sums = np.empty((len(begins), folded.shape[1]), dtype=np.float32)
        for low in range(0, len(grid), 1024):
            sums[low:low + 1024] = folded[grid[low:low + 1024]].sum(axis=1)
        for steps in WINDOWS:
            total = sums.copy()
            for k in range(1, steps):
                inside = np.flatnonzero(np.arange(len(begins)) + k <= ends[1])
                total[inside] += sums[inside + k]
            norm = np.linalg.norm(total, axis=1)
            fits = np.flatnonzero(lengths[block.owner] <= STEP) if steps == 1 else np.arange(len(block.owner))
            for low in range(0, len(total), 4096):
                near = total[low:low + 4096] @ block.items[fits].T
                rows, items = np.nonzero(near >= cosine * np.maximum(norm[low:low + 4096], 1e-6)[:, None])
                near, items = near[rows, items], fits[items]
                if held:
                    size = lengths[block.owner[items]]
                    wider = -(-size // STEP)
                    may = held.enough(np.maximum(rows + low - wider, ends[0][rows + low]),
                                      np.minimum(rows + low + steps - 1 + wider, ends[1][rows + low]), items, least * size)
                    rows, items, near = rows[may], items[may], near[may]
                rows_at = rows + low
                for parts, values in zip(out, (owner[rows_at], begins[rows_at],
                                               np.minimum(begins[rows_at] + steps * STEP, text_end[rows_at]),
                                               block.owner[items], near / np.maximum(norm[rows_at], 1e-6))):
                    parts.append(values)
    return tuple(np.concatenate(parts) for parts in out)


def verified(words: np.ndarray, start: int, end: int, first: int, last: int, item: np.ndarray,
             answer: np.ndarray) -> tuple[float, float]:
    """Share of the item, and of its answer, covered by common subsequences with the passage.

    The passage is widened by its text's words on both sides, as far as the item could reach. The
    answer is looked at only where it decides, else its share is 0.
    """
    passage = words[max(first, start - len(item)):min(last, end + len(item))]
    # No subsequence is longer than the words that both hold.
    if np.isin(item, passage).sum() < COVER_WITH_ANSWER * len(item):
        return 0.0, 0.0
    cover = common(item, passage) / max(len(item), 1)
    decides = COVER_WITH_ANSWER <= cover < COVER
    return cover, common(answer, passage) / max(len(answer), 1) if decides else 0.0


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, group: int = GROUP) -> DataFrame:
    """doc_id, item_id, cosine, cover, answer_cover: items that a document holds.

    answer_cover is 0 where the item's cover alone decides.

    `docs` needs doc_id and text, `benchmark` item_id and text; other columns are not looked at.
    One row per document and item that count. Items without a word, null texts and empty tables
    give no rows; rows of one doc_id are searched one by one and give their best. Items without id
    are searched as well and reported with a null item_id, one row per document for all of them.
    An item longer than the passages counts by any of its parts of that length (64 words): cover is
    then the share of that part.

    Items come to the driver in groups of `group` in the order of item_id, so what is broadcast is
    bounded whatever the size of the benchmark; each group is a pass over the documents.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    order = benchmark.where("text is not null").select(F.col("item_id").cast("bigint"), "text").distinct()
    schema = "doc_id bigint, item_id bigint, cosine double, cover double, answer_cover double"
    out, after = docs.sparkSession.createDataFrame([], schema), None
    while True:
        # Those without id come first.
        rest = order if after is None else order.where(
            (F.col("item_id") > after[0] if after[0] is not None else F.col("item_id").isNotNull())
            | (F.col("item_id").eqNullSafe(F.lit(after[0])) & (F.col("text") > after[1])))
        items = [tuple(r) for r in rest.orderBy(F.col("item_id").asc_nulls_first(), "text").limit(group).collect()]
        if not items:
            return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("cover", "answer_cover", "cosine")).alias("_m")).select(
                "doc_id", "item_id", "_m.cosine", "_m.cover", "_m.answer_cover")
        out = out.unionByName(searched(docs, space(docs, items), cosine))
        after = items[-1]


def searched(docs: DataFrame, known: Space, cosine: float) -> DataFrame:
    """The verified items of one group for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(
        ([(b.vocabulary, b.folded, b.items, b.owner) for b in known.blocks], known.ids, known.words, known.answers))

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, *rest = shared.value
        table, own = Powers(), Space([Block(*b) for b in blocks], *rest)
        for batch in batches:
            for start, end in slices(batch.column(1)):
                words, offsets = word_hashes(batch.column(1)[start:end], table, lower=True)
                ids = batch.column(0)[start:end].to_pylist()
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                found = retrieved(words, offsets, own, cosine, COVER_WITH_ANSWER)
                closest = np.argsort(-found[4], kind="stable")
                for text, first, past, item, near in zip(*[x[closest] for x in found]):
                    if best.get((int(text), int(item)), (0.0,))[0] >= COVER:
                        continue  # the same passage in another window, or another place
                    cover, answer = verified(words, first, past, offsets[text], offsets[text + 1],
                                             own.words[item], own.answers[item])
                    if cover >= COVER or (cover >= COVER_WITH_ANSWER and answer >= ANSWER):
                        key = (int(text), int(item))
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (cover, answer, float(near)))
                rows = [(ids[t], own.ids[i], near, cover, answer) for (t, i), (cover, answer, near) in best.items()]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)],
                                                 ["doc_id", "item_id", "cosine", "cover", "answer_cover"])

    return docs.where("text is not null").mapInArrow(
        work, "doc_id bigint, item_id bigint, cosine double, cover double, answer_cover double")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without a leak; rows without doc_id stay."""
    found = cut(leaks(docs, benchmark).select("doc_id").distinct())
    return docs.join(small_or_shuffled(found), "doc_id", "left_anti").select(*docs.columns)
