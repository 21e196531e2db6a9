"""Documents packed into sequences of bounded length, by hierarchical best fit.

1. Every task packs the pieces of its own rows, longest first, each into the fullest sequence
   that still takes it. Nothing is shuffled.
2. Sequences that are nearly full are done. The others go on, whole, as items.
3. Those of several tasks meet in one group of the next level, which packs them the same way;
   groups become fewer from level to level, until one is left or a level joins hardly any.

A sequence that travels carries its pieces, at most one per token of its capacity, so a row is
bounded whatever the corpus. A task holds the pieces of `TASK_ITEMS` rows of its input at most.
Best fit needs no search: lengths are whole numbers, so open sequences are kept by the room
left in them, and all items of one length are placed at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgrid.llm.text import slices
from plumbgrid.llm.tokens import worker_encoder
from plumbgrid.session import cut

#: Tokens of a sequence.
CAPACITY = 2048
#: A sequence with less room than this share of its capacity is done.
SPARE = 1 / 128
#: Groups of one level that meet in a group of the next.
FAN_IN = 8
#: Sequences that a group of a later level packs at once, about; more of them make more groups.
GROUP_ITEMS = 100_000
#: Pieces that a task of the first level packs at once.
TASK_ITEMS = 400_000
#: A level that saves less than this share of its sequences is the last.
LEAST_SAVED = 0.01
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 1 << 22

PIECE = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, ids: binary, offset: bigint>"
SEQUENCES = f"sequence_id bigint, grp int, filled bigint, done boolean, pieces array<{PIECE}>"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item its bin and its place there, by best fit with the longest items first.

    Lengths are 1 to `capacity`; bins are numbered from 0. Of items of one length the earlier
    come first. An item goes to the bin with the least room that takes it, else to a new one.
    """
    order = np.argsort(-lengths, kind="stable")
    where, place = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    rooms: list[list[np.ndarray]] = [[] for _ in range(capacity + 1)]
    made = 0
    sizes, firsts = np.unique(-lengths[order], return_index=True)
    for size, first, last in zip(-sizes, firsts, np.append(firsts[1:], len(order))):
        size, room = int(size), int(size)
        while first < last:
            while room <= capacity and not rooms[room]:
                room += 1
            # A bin that is the best for one item stays so while it takes another of that length.
            each = min(room, capacity) // size
            if room > capacity:
                room = capacity
                bins = np.arange(made, made - (-(last - first) // each))
                made += len(bins)
            else:
                bins = rooms[room].pop()
            used = bins[: -(-(last - first) // each)]
            if len(used) < len(bins):
                rooms[room].append(bins[len(used):])
            items = order[first:min(last, first + len(used) * each)]
            nth = np.arange(len(items))
            where[items] = used[nth // each]
            place[items] = capacity - room + nth % each * size
            full, rest = divmod(len(items), each)
            if full:
                rooms[room - each * size].append(used[:full])
            if rest:
                rooms[room - rest * size].append(used[full:])
            first += len(items)
            room = size
    return where, place


def _sequences(lengths: np.ndarray, contents: pa.StructArray, counts: np.ndarray, capacity: int,
               first_id: int, group: int) -> tuple[pa.RecordBatch, int]:
    """Pack items and return their sequences. An item is `counts` consecutive pieces of `contents`."""
    where, place = best_fit(lengths, capacity)
    order = np.lexsort((place, where))
    sizes = counts[order]
    begins = np.cumsum(counts) - counts
    rows = np.repeat(begins[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    moved = np.repeat(place[order], sizes)
    taken = contents.take(pa.array(rows))
    names = [f.name for f in taken.type]
    offset = pa.array(taken.field("offset").to_numpy() + moved)
    taken = pa.StructArray.from_arrays(
        [offset if n == "offset" else taken.field(n) for n in names], names)
    n = int(where.max()) + 1 if len(where) else 0
    filled = np.bincount(where, weights=lengths, minlength=n).astype(np.int64)
    held = np.bincount(where, weights=counts, minlength=n).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(first_id + np.arange(n)), pa.array(np.full(n, group, dtype=np.int32)), pa.array(filled),
         pa.array(filled > capacity - max(1, int(capacity * SPARE))), pa.ListArray.from_arrays(pa.array(bounds), taken)],
        ["sequence_id", "grp", "filled", "done", "pieces"]), n


def _batches(table: pa.RecordBatch, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, table.num_rows, rows):
        yield table.slice(at, rows)


def cut_pieces(doc_ids: pa.Array, texts: pa.Array, encoder, end_id: int, capacity: int, with_ids: bool) -> pa.StructArray:
    """The pieces of each document: its ids and `end_id`, in parts of `capacity` and a shorter rest."""
    ids, offsets = encoder.encode(texts)
    sizes = np.diff(offsets) + 1
    ids = np.insert(ids, offsets[1:], np.uint32(end_id)).astype("<u4")
    n = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = piece * capacity
    length = np.minimum(sizes[doc] - start, capacity)
    at = (np.cumsum(sizes) - sizes)[doc] + start
    parts = [ids[s:s + m] for s, m in zip(at.tolist(), length.tolist())]
    held = pa.array([p.tobytes() for p in parts], pa.binary()) if with_ids else pa.nulls(len(parts), pa.binary())
    return pa.StructArray.from_arrays(
        [doc_ids.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
         pa.array([zlib.crc32(p) for p in parts], pa.int64()), held, pa.array(np.zeros(len(parts), dtype=np.int64))],
        ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "offset"])


def _first_level(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        group = TaskContext.get().partitionId()
        made, waiting = group << 36, []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal made, waiting
            contents = pa.concat_arrays(waiting)
            lengths = contents.field("length").to_numpy()
            out, n = _sequences(lengths, contents, np.ones(len(lengths), dtype=np.int64), capacity, made, group)
            made, waiting = made + n, []
            yield from _batches(out)

        for batch in batches:
            for first, last in slices(batch.column(1), ENCODE_BYTES):
                part = batch.slice(first, last - first)
                waiting.append(cut_pieces(part.column(0), part.column(1), encoder, end_id, capacity, with_ids))
                if sum(map(len, waiting)) >= TASK_ITEMS:
                    yield from packed()
        if waiting:
            yield from packed()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SEQUENCES)


def _next_level(open_ones: DataFrame, level: int, groups: int, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        # By number, so that a task that runs again packs the same.
        rows = pa.Table.from_batches(held).sort_by("sequence_id").combine_chunks()
        pieces = rows.column("pieces").combine_chunks()
        lengths = rows.column("filled").to_numpy()
        counts = pieces.value_lengths().to_numpy().astype(np.int64)
        out, _ = _sequences(lengths, pieces.flatten(), counts, capacity, (level << 58) + (group << 36), group)
        yield from _batches(out)

    # Numbers hold the group that made a sequence, so a range of them is a run of neighbouring groups.
    return open_ones.repartitionByRange(groups, "sequence_id").mapInArrow(run, SEQUENCES)


def sequences(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = True,
              group_items: int = GROUP_ITEMS) -> DataFrame:
    """Pack all rows of `docs` (doc_id, text): one row per sequence.

    sequence_id (any number), filled (tokens in it), pieces: doc_id, piece, start, length,
    ids_crc32, offset and, if `with_ids`, ids as little-endian unsigned 32-bit integers; by
    offset, without gaps from 0. A document is its ids and `end_id`; longer ones than
    `capacity` are cut into parts of that length and a rest. A null text counts as empty, so
    it is a piece of one token. Rows of one doc_id, or of none, are packed each. Other columns
    are not looked at. `tokenizer` is a file that every executor has.
    """
    made = cut(_first_level(docs, tokenizer, end_id, capacity, with_ids))
    columns = ["sequence_id", "filled", "pieces"]
    groups, level, before, result = made.agg(F.max("grp")).first()[0] or 0, 0, None, None
    groups += 1
    while True:
        n = made.where(~F.col("done")).count()
        if n < 2 or (level and groups == 1) or (before is not None and n > before * (1 - LEAST_SAVED)):
            rest = made.select(*columns)
            return result.unionByName(rest) if result is not None else rest
        done = made.where("done").select(*columns)
        result = result.unionByName(done) if result is not None else done
        groups, level, before = max(-(-groups // FAN_IN), -(-n // group_items)), level + 1, n
        made = cut(_next_level(made.where(~F.col("done")), level, groups, capacity))


def placed(found: DataFrame) -> DataFrame:
    """One row per piece of packed sequences: where each piece of each document lies."""
    return found.select("sequence_id", F.explode("pieces").alias("p")).select(
        "p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
