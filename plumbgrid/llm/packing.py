"""Token ids in fixed-width bit packing.

Every id takes the least number of bits that the vocabulary needs. A table of ids is a folder
of Parquet files; a row is a block of whole documents:

| column | meaning |
| --- | --- |
| shard, block | range of document ids, and number of the block in it; ascending |
| start | ids in the shard before this block |
| n_ids, width | ids in the block, bits of each |
| doc_ids, lengths | the documents of the block in ascending order, and their ids each |
| payload | the packed ids |

64 ids fill `width` little-endian 64-bit words, so that the id at position i lies in group
i // 64 and packing and unpacking are 64 column operations whatever the width.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbgrid.llm.text import giving_back, slices
from plumbgrid.llm.tokens import Encoder, worker_encoder  # noqa: F401
from plumbgrid.session import scratch_path

#: Ids after which a block ends with the document that is being written.
BLOCK_IDS = 1 << 18
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 1 << 22

BLOCKS = ("shard int, block int, start bigint, n_ids bigint, width int, doc_ids array<bigint>, "
          "lengths array<bigint>, payload binary")


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2**width as packed little-endian words; the last group is filled with zeros."""
    groups = np.zeros((-(-len(ids) // 64), 64), dtype=np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    groups = np.ascontiguousarray(groups.T)
    out = np.zeros((width, groups.shape[1]), dtype=np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[word] |= groups[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= groups[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").tobytes()


def unpack(payload: bytes, width: int, start: int, end: int) -> np.ndarray:
    """Ids start to end (exclusive) of a block; reads only the groups that hold them."""
    first, last = start // 64, -(-end // 64)
    words = np.frombuffer(payload, dtype="<u8", count=(last - first) * width, offset=first * width * 8)
    words = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, last - first), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[i] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= words[word + 1] << np.uint64(64 - shift)
        out[i] &= mask
    return out.T.reshape(-1)[start - first * 64:end - first * 64].astype(np.uint32)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Encode `docs` (doc_id, text) and write their ids, each document followed by `end_id`.

    Ascending doc_id, null first; rows of one doc_id by their text, null first. A null text
    counts as empty. `tokenizer` is a file that every executor has.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @giving_back
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        width, end = width_of(max(encoder.vocabulary, end_id + 1)), np.array([end_id], dtype=np.uint32)
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            nonlocal block, start, doc_ids, lengths, held
            ids = np.concatenate(held)
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([width], pa.int32()),
                 pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                 pa.array([pack(ids, width)], pa.binary())],
                ["shard", "block", "start", "n_ids", "width", "doc_ids", "lengths", "payload"])
            block, start = block + 1, start + len(ids)
            doc_ids, lengths, held = [], [], []
            return out

        waiting = 0
        for batch in batches:
            for first, last in slices(batch.column(1), ENCODE_BYTES):
                part = batch.slice(first, last - first)
                ids, offsets = encoder.encode(part.column(1))
                for doc_id, s, e in zip(part.column(0).to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                    held += (ids[s:e], end)
                    doc_ids.append(doc_id)
                    lengths.append(e - s + 1)
                    waiting += lengths[-1]
                    if waiting >= block_ids:
                        yield row()
                        waiting = 0
        if doc_ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    (rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
     .mapInArrow(encode, BLOCKS).write.option("compression", "zstd").parquet(path))


def shard_starts(blocks: DataFrame) -> DataFrame:
    """shard, and the ids of all shards before it; one row per shard written."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    blocks = spark.read.schema(BLOCKS).parquet(path)

    @giving_back
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["width"], 0, row["n_ids"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                sums = [zlib.crc32(ids[s:e]) for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(starts + row["start"], pa.int64()), pa.array(row["lengths"], pa.int64()),
                     pa.array(sums, pa.int64())], ["shard", "doc_id", "_at", "n_tokens", "ids_crc32"])

    found = blocks.select("shard", "start", "n_ids", "width", "doc_ids", "lengths", "payload").mapInArrow(
        decode, "shard int, doc_id bigint, _at bigint, n_tokens bigint, ids_crc32 bigint")
    # One row per shard, so its size is bounded by the number of partitions written.
    return found.join(F.broadcast(shard_starts(blocks)), "shard").select(
        "doc_id", (F.col("_at") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def ids_between(spark: SparkSession, path: str, first: int, last: int) -> np.ndarray:
    """The ids at positions first to last (exclusive) of the whole table, as one array.

    Random access: only blocks that overlap the range are read, and of them only those groups.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    at = F.col("start") + F.col("_before")
    rows = (blocks.join(F.broadcast(shard_starts(blocks)), "shard")
            .where((at < last) & (at + F.col("n_ids") > first))
            .select(at.alias("at"), "n_ids", "width", "payload").orderBy("at").collect())
    parts = [unpack(r.payload, r.width, max(0, first - r.at), min(r.n_ids, last - r.at)) for r in rows]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write `docs` to a new table in the shared folder, and describe it from the files.

    One row per row of `docs`: doc_id, start, n_tokens (with the end id), ids_crc32. Without
    rows there are no files to describe and no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "ids")
    write(docs, path, tokenizer, end_id)
    return documents(spark, path)
