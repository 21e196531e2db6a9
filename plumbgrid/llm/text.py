"""Words, hashes and batches that the operators share.

A word is a maximal run of bytes other than space and the five controls from tab to carriage
return. Tasks get text as Arrow batches and treat a slice of a batch at once, so memory is
bounded by the slice, or by one document where a single document is larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task treats at once.
SLICE_BYTES = 1 << 20
#: Rows up to which a counted side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

#: Bytes above which a word is hashed as a whole.
LONG_WORD = 32

#: An odd base and its inverse for polynomial hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2**64."""
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)
        return self.up, self.down


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: Powers) -> np.ndarray:
    """A hash of values[start:end] for each pair; equal runs have equal hashes anywhere."""
    up, down = table(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text each, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(sizes):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield start, end
        start = end


def giving_back(work: Work) -> Work:
    """`work` of a task; at its end Arrow's free memory goes back, which an idle Python worker would keep."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return run


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and each text's offset; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, word ends, and each text's offset among the words."""
    data, offsets = flat_bytes(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    word = ~IS_SPACE[data]
    first = np.ones(n + 1, dtype=bool)
    first[1:n] = ~word[:-1]
    first[offsets] = True
    starts = np.flatnonzero(word & first[:n])
    ends = np.flatnonzero(word & (first[1:] | np.append(~word[1:], True)[:n])) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array, table: Powers, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word, and each text's offset among the words.

    Polynomials modulo 2**64 have words of some hundred letters on which every base agrees
    (Thue-Morse words), so words over LONG_WORD bytes get a cryptographic hash instead.
    """
    data, starts, ends, offsets = word_spans(texts, lower)
    hashes = spans(data.astype(np.uint64) + np.uint64(1), starts, ends, table)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        name = blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        hashes[i] = int.from_bytes(name, "little")
    return hashes, offsets


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array, in SQL functions; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has been counted and is small; else left to a shuffle.

    Reads at most `rows` + 1 rows. Give it a written table of narrow rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
