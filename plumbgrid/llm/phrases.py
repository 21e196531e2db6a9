"""Collocations from a weighted de Bruijn graph of words.

A text is cut into pieces at punctuation, and a piece into words. A node of the graph is a pair
of neighbouring words, an edge a run of three (the longest grams), weighted by how often it
occurs. Only edges are counted over the corpus, as the grams that start at each word:

- a word whose next two words belong to its piece gives an edge;
- where the piece ends before, or the next node is rare, it gives the shorter gram that is
  left: what the flow out of a node lacks of the node's own count.

So a pair occurs as often as the edges that leave it and its own remainder say, and a word as
often as the grams that start with it. Frequent edges are then compacted: an edge into a node
and one out of it become one path where all of the node's flow takes both. Phrases are read
off the paths, so that what always goes on in the same way is one row.

A word or pair below `least` occurrences is in no phrase, nor is any count of one needed. Which
may reach it is held in a filter of `FILTER_BITS` bits, from counts of their hashes; a rare one
that the filter lets through costs rows and changes nothing, so its size is a bound and not a
limit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgrid.llm.text import LOWER, Powers, flat_bytes, mix, signed, slices, small_or_shuffled, spans
from plumbgrid.session import cut

#: Occurrences that a phrase has at least, and those returned of each language.
LEAST, TOP = 10, 2000
#: A phrase goes if a longer one that holds it has this percentage of its occurrences.
HELD = 50
#: Language of texts without one.
UNKNOWN = "und"
#: Bits of the filter, a power of two: 16 MB for every task, however many words there are.
FILTER_BITS = 1 << 27
#: Bits that a row of the filter's table holds.
CHUNK_BITS = 1 << 15
#: Bytes of text that a task counts at once.
COUNT_BYTES = 1 << 21
#: Groups in which the best of a language are chosen before they meet.
SALTS = 64
#: Grams whose flows a task adds up before it sends them.
FLOW_ROWS = 150_000
#: Words up to which their counts may be broadcast, some thirty bytes each.
SMALL_WORDS = 400_000
#: Text whose grams make a bucket, about: what a task adds up at once.
BUCKET_BYTES = 1 << 22
KIND = np.zeros(256, dtype=np.uint8)  # 0: word, 1: between words, 2: between pieces
KIND[[9, 32]] = 1
KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2


class Slice:
    """The words of a slice of texts: their distinct forms, and which of them stand where."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = flat_bytes(texts)
        data = LOWER[data]
        kind = KIND[data]
        word, n = kind == 0, len(data)
        first = np.zeros(n, dtype=bool)
        first[offsets[:-1][offsets[:-1] < n]] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | first[1:]
        last = word.copy()
        last[:-1] &= ~word[1:] | first[1:]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(starts, offsets)
        # Words are numbered by their bytes; what lies between them is left out.
        pos = np.concatenate([[0], np.cumsum(ends - starts)])
        held = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(pos.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[word]))])
        coded = held.dictionary_encode()
        self.words, self.ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        breaks = np.cumsum(kind == 2, dtype=np.int32)
        piece = breaks[starts] if len(starts) else starts
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.offsets))
        self.doc = doc
        # Whether the next word belongs to the same piece.
        self.joined = np.zeros(len(starts), dtype=bool)
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])

    def hashes(self, table: Powers) -> np.ndarray:
        values = np.frombuffer(self.words.buffers()[2] or b"", dtype=np.uint8) if len(self.words) else np.zeros(0, np.uint8)
        at = np.frombuffer(self.words.buffers()[1], dtype=np.int64)[: len(self.words) + 1] if len(self.words) else np.zeros(1, np.int64)
        return spans(values.astype(np.uint64) + np.uint64(1), at[:-1], at[1:], table)


def _coded_langs(langs: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = langs.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(second))


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n): hashes of the words and pairs of each slice by language, and how often they occur."""
    table = Powers()
    for batch in batches:
        for a, b in slices(batch.column(1), COUNT_BYTES):
            part = batch.slice(a, b - a)
            found = Slice(part.column(1))
            if not len(found.ids):
                continue
            lang, names = _coded_langs(part.column(0))
            size, lang = len(found.words), lang[found.doc]
            hashes, seeds = found.hashes(table), lang_seeds(names)
            words, n_words = _counted(lang * size + found.ids)
            at = np.flatnonzero(found.joined)
            pairs, n_pairs = _counted((lang[at] * size + found.ids[at]) * size + found.ids[at + 1])
            two, second = np.divmod(pairs, size)
            h = np.concatenate([hashes[words % size] ^ seeds[words // size],
                                pair_hashes(hashes[two % size], hashes[second]) ^ seeds[two // size]])
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(np.concatenate([n_words, n_pairs]))], ["h", "n"])


def lang_seeds(names: pa.Array) -> np.ndarray:
    """What tells the hashes of one language from those of another."""
    return np.array([zlib.crc32((x or "").encode()) for x in names.to_pylist()], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def node_filter(texts: DataFrame, least: int) -> np.ndarray:
    """Bits of the hashes that occur `least` times or more, so of every such word and pair."""
    counted = texts.mapInArrow(_hash_rows, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    bit = F.col("h").bitwiseAND(FILTER_BITS - 1)
    # At most FILTER_BITS / CHUNK_BITS rows of CHUNK_BITS bits come to the driver.
    rows = counted.where(F.col("n") >= least).groupBy(F.floor(bit / CHUNK_BITS).alias("chunk")).agg(
        F.bitmap_construct_agg(bit % CHUNK_BITS).alias("bits")).toLocalIterator()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in rows:
        at = row.chunk * CHUNK_BITS // 8
        out[at:at + CHUNK_BITS // 8] = np.frombuffer(row.bits, dtype=np.uint8)[: CHUNK_BITS // 8]
    return out


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _join_words(words: pa.Array, *ids: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*[words.take(pa.array(i)) for i in ids], pa.scalar(b" ", pa.large_binary()))


def grams(texts: DataFrame, known: np.ndarray, buckets: int) -> DataFrame:
    """(lang, gram, size, c): the grams that start at the words of all texts, of three words at most.

    A gram ends before the next word where the piece ends or the pair with it is rare; one that
    starts with a rare word is empty. Grams travel in buckets by their hash, sorted and
    compressed, and a task adds up one bucket at a time.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(known)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = Powers(), shared.value
        for batch in batches:
            for a, b in slices(batch.column(1), COUNT_BYTES):
                part = batch.slice(a, b - a)
                found = Slice(part.column(1))
                if not len(found.ids):
                    continue
                lang, names = _coded_langs(part.column(0))
                lang = lang[found.doc]
                of_words = found.hashes(table)
                hashes, seed = of_words[found.ids], lang_seeds(names)[lang]

                def known_hash(number: np.ndarray, of_words: np.ndarray = of_words) -> np.ndarray:
                    return np.where(number > 0, of_words[number - 1], np.uint64(0))

                often = _held(bits, hashes ^ seed)
                pair = np.zeros(len(hashes), dtype=bool)
                pair[:-1] = found.joined[:-1] & _held(bits, pair_hashes(hashes[:-1], hashes[1:]) ^ seed[:-1])
                # Numbers from 1; 0 stands for what ends a gram.
                one = np.where(often, found.ids + 1, 0)
                two, three = np.zeros_like(one), np.zeros_like(one)
                two[:-1] = np.where(pair[:-1] & (one[:-1] > 0), found.ids[1:] + 1, 0)
                three[:-2] = np.where((two[:-2] > 0) & pair[1:-1], found.ids[2:] + 1, 0)
                size, many = len(found.words) + 1, len(names)
                if size ** 3 * many < 1 << 63:
                    keys, n = _counted(((one * size + two) * size + three) * many + lang)
                    keys, lang = np.divmod(keys, many)
                    keys, three = np.divmod(keys, size)
                    one, two = np.divmod(keys, size)
                else:
                    order = np.lexsort((three, two, one, lang))
                    rows = np.stack([x[order] for x in (one, two, three, lang)])
                    new = np.flatnonzero(np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)))
                    n = np.diff(np.append(new, len(order)))
                    one, two, three, lang = rows[:, new]
                seed = lang_seeds(names)[lang]
                h = pair_hashes(pair_hashes(known_hash(one), known_hash(two)), known_hash(three)) ^ seed
                bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
                held = (one > 0).astype(np.int64) + (two > 0) + (three > 0)
                heads = pa.array([f"{x}\t".encode() for x in names.to_pylist()], pa.large_binary())
                for k in range(4):
                    of = np.flatnonzero(held == k)
                    of = of[np.lexsort((three[of], two[of], one[of], bucket[of]))]
                    if not len(of):
                        continue
                    words = [x[of] - 1 for x in (one, two, three)[:k]]
                    head = heads.take(pa.array(lang[of]))
                    text = pc.binary_join_element_wise(head, _join_words(found.words, *words), pa.scalar(b"", pa.large_binary())) if k else head
                    yield _packed(text, n[of], bucket[of])

    return _summed(texts.mapInArrow(run, "bucket bigint, grams binary"), parts)


def _summed(packed: DataFrame, parts: int) -> DataFrame:
    """(lang, gram, size, c) of packed rows, a bucket at a time."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; those of one are added up at its end."""
        held: list[pa.Table] = []
        at = None
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != at and held:
                    yield from _added(held)
                    held = []
                at = bucket
                held.append(_unpacked(blob))
        if held:
            yield from _added(held)
        held.clear()
        pa.default_memory_pool().release_unused()

    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(
        add, "lang string, gram string, size int, c bigint")


def flows(counted: DataFrame, buckets: int) -> DataFrame:
    """(lang, gram, size, c): what all grams say of their first two words and of their first.

    The flow out of a node and its remainder are the node's count; an empty gram counts the
    words that are in no phrase.
    """
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = Powers(), []

        def packed() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            head = pc.binary_join_element_wise(rows.column("lang"), pa.scalar("\t"), "")
            size = rows.column("size").to_numpy()
            pairs = pc.if_else(pa.array(size == 3), pc.list_element(pc.split_pattern(rows.column("gram"), " ", max_splits=1, reverse=True), 0),
                               rows.column("gram"))
            firsts = pc.list_element(pc.split_pattern(rows.column("gram"), " ", max_splits=1), 0)
            keys = pa.chunked_array([*pc.binary_join_element_wise(head, firsts, "").chunks,
                                     *pc.binary_join_element_wise(head, pairs, "").filter(pa.array(size >= 2)).chunks])
            c = rows.column("c").to_numpy()
            whole = pa.table({"gram": keys, "c": np.concatenate([c, c[size >= 2]])}).group_by("gram").aggregate([("c", "sum")])
            text = whole.column("gram").combine_chunks().cast(pa.large_string()).cast(pa.large_binary())
            data, offsets = flat_bytes(text)
            bucket = mix(spans(data.astype(np.uint64) + np.uint64(1), offsets[:-1], offsets[1:], table)) % np.uint64(buckets)
            whole = pa.table({"gram": text, "c": whole.column("c_sum"), "bucket": pa.array(bucket.astype(np.int64))}).sort_by(
                [("bucket", "ascending"), ("gram", "ascending")]).combine_chunks()
            yield _packed(whole.column("gram").combine_chunks(), whole.column("c").to_numpy(), whole.column("bucket").to_numpy())

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= FLOW_ROWS:
                yield from packed()
                held.clear()
        if held and sum(b.num_rows for b in held):
            yield from packed()

    return _summed(counted.mapInArrow(run, "bucket bigint, grams binary"), parts)


def _packed(texts: pa.LargeBinaryArray, n: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row per bucket: its grams, sorted, compressed with their counts."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")
    sizes, n = np.diff(offsets).astype("<u4"), n.astype("<i8")
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    press = zstandard.ZstdCompressor(level=3)
    blobs = []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]):
        blobs.append(press.compress(b"".join([np.uint32(e - s).tobytes(), sizes[s:e].tobytes(), n[s:e].tobytes(), data[offsets[s]:offsets[e]]])))
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(blobs, pa.binary())], ["bucket", "grams"])


def _unpacked(blob: bytes) -> pa.Table:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    rows = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes = np.frombuffer(raw, "<u4", rows, 4)
    n = np.frombuffer(raw, "<i8", rows, 4 + 4 * rows)
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    text = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(raw[4 + 12 * rows:])])
    return pa.table({"gram": text, "c": n})


def _added(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    whole = pa.concat_tables(tables).group_by("gram").aggregate([("c", "sum")])
    for batch in whole.to_batches(max_chunksize=100_000):
        gram, c = batch.column("gram"), batch.column("c_sum")
        # The words hold no tab, so the last one ends the language.
        parts = pc.split_pattern(gram, "\t", max_splits=1, reverse=True)
        lang, words = pc.list_element(parts, 0), pc.list_element(parts, 1)
        size = np.where(pc.equal(words, "").to_numpy(zero_copy_only=False), 0,
                        pc.count_substring(words, " ").to_numpy(zero_copy_only=False) + 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), words.cast(pa.string()), pa.array(size), c],
                                         ["lang", "gram", "size", "c"])


def bucket_count(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def graph(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written tables: edges (lang, a, b, c, n), nodes (lang, a, b, n), words (lang, word, n) and totals
    (lang, n); of the first three, those that occur `least` times or more."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string"))
    buckets = bucket_count(texts)
    counted = cut(grams(texts, node_filter(texts, least), buckets))
    edges = cut(counted.where((F.col("size") == 3) & (F.col("c") >= least)).select(
        "lang", F.split("gram", " ").alias("w"), F.col("c").alias("n")).select(
        "lang", *[F.col("w")[i].alias(x) for i, x in enumerate("abc")], "n"))
    summed = cut(flows(counted, buckets))
    word = F.split("gram", " ")
    nodes = cut(summed.where((F.col("size") == 2) & (F.col("c") >= least)).select(
        "lang", word[0].alias("a"), word[1].alias("b"), F.col("c").alias("n")))
    words = cut(summed.where((F.col("size") == 1) & (F.col("c") >= least)).select("lang", F.col("gram").alias("word"), F.col("c").alias("n")))
    totals = summed.where("size < 2").groupBy("lang").agg(F.sum("c").alias("n"))
    return edges, nodes, words, totals


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Compacted unary paths: lang, words (three at least) and n, by the longest runs of edges
    between which all of a node's flow passes.

    A node within a path has one edge in and one out with its own count, so no piece starts or
    ends there and no path is a circle. Edges find the first edge of their path by doubling:
    the rounds grow with the logarithm of the longest path, which is within one piece.
    """
    keys = ["lang", "a", "b"]
    into = edges.select("lang", F.col("b").alias("a"), F.col("c").alias("b"), F.col("n").alias("_in"), F.col("a").alias("_from"))
    out = edges.select("lang", "a", "b", F.col("n").alias("_out"), F.col("c").alias("_to"))
    # Edges with a node's whole count: one at most on either side of it.
    joints = cut(nodes.join(into, keys).where(F.col("_in") == F.col("n")).join(out, keys).where(
        F.col("_out") == F.col("n")).select(*keys, "_from", "_to"))
    name = F.concat_ws(" ", "lang", "a", "b", "c")
    before = joints.select(F.concat_ws(" ", "lang", "a", "b", "_to").alias("e"),
                           F.concat_ws(" ", "lang", "_from", "a", "b").alias("p"))
    jumps, more = cut(before.select("e", "p", F.lit(1).alias("d"))), joints.count()
    while more:
        # An edge at distance d of `p`; those whose `p` has an edge before it go on from there.
        ahead = jumps.select(F.col("e").alias("p"), F.col("p").alias("_p"), F.col("d").alias("_d"))
        jumps = cut(jumps.join(ahead, "p", "left").select("e", F.coalesce("_p", "p").alias("p"), (
            F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"), F.col("_p").isNotNull().alias("_more")))
        more, jumps = jumps.where("_more").count(), jumps.drop("_more")
    placed = edges.select("lang", "a", "b", "c", "n", name.alias("e")).join(jumps, "e", "left").select(
        "lang", "n", "a", "b", "c", F.coalesce("p", "e").alias("p"), F.coalesce("d", F.lit(0)).alias("d"))
    parts = F.array_sort(F.collect_list(F.struct("d", "a", "b", "c")))
    return placed.groupBy("lang", "p").agg(F.first("n").alias("n"), parts.alias("x")).select(
        "lang", F.concat(F.array(F.col("x")[0]["a"], F.col("x")[0]["b"]), F.col("x.c")).alias("words"), "n")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) by decimals, exact for counts below 10 ** 16."""
    def wide(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def _counts(table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """A written table of counts with other names, broadcast if it is small."""
    return small_or_shuffled(table.select("lang", *[F.col(c).alias(k) for c, k in zip(table.columns[1:], keys)],
                                          F.col("n").alias(count)), SMALL_WORDS)


def candidates(edges: DataFrame, nodes: DataFrame, words: DataFrame, held: int = HELD) -> DataFrame:
    """Scored phrases of two and three words: lang, phrase, a, l, r, score, and path.

    `path` is the compacted path that holds a phrase of three words. Pairs held by one of
    three, as often as `held` percent, are left out.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"))))
    longest = edges.select("lang", ends.alias("e"), "n").groupBy("lang", "e.a", "e.b").agg(F.max("n").alias("_most"))
    known = cut(nodes.join(longest, ["lang", "a", "b"], "left"))
    # Only nodes at an edge are parts of a phrase of three.
    linked = cut(known.where(F.col("_most").isNotNull()).select(*nodes.columns))
    found = cut(paths(edges, linked))
    runs = found.select("lang", "n", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 3)).alias("i"))
    three = runs.select("lang", *[F.get("words", F.col("i") + k).alias(x) for k, x in enumerate("abc")],
                        F.col("n").alias("f"), F.concat_ws(" ", "words").alias("path"))
    f_ab, f_bc = _counts(linked, ["a", "b"], "f_ab"), _counts(linked, ["b", "c"], "f_bc")
    f_a, f_b, f_c = (_counts(words, [x], f"f_{x}") for x in "abc")
    three = three.join(f_ab, ["lang", "a", "b"]).join(f_bc, ["lang", "b", "c"]).join(f_a, ["lang", "a"]).join(f_c, ["lang", "c"])
    one, two = _score(F.col("f"), F.col("f_a"), F.col("f_bc")), _score(F.col("f"), F.col("f_ab"), F.col("f_c"))
    three = three.select("lang", F.concat_ws(" ", "a", "b", "c").alias("phrase"), F.col("f").alias("a"), "path",
                         F.struct(one.alias("score"), F.lit(1).alias("k"), F.col("f_a").alias("l"), F.col("f_bc").alias("r")).alias("x"),
                         F.struct(two.alias("score"), F.lit(2).alias("k"), F.col("f_ab").alias("l"), F.col("f_c").alias("r")).alias("y"))
    three = three.select("lang", "phrase", "a", "path", F.least("x", "y").alias("x")).select(
        "lang", "phrase", "a", "x.l", "x.r", "x.score", "path")
    pairs = known.where(F.coalesce(F.col("_most") * 100 < F.col("n") * held, F.lit(True)))
    pairs = pairs.join(f_a, ["lang", "a"]).join(f_b, ["lang", "b"]).select(
        "lang", F.concat_ws(" ", "a", "b").alias("phrase"), F.col("n").alias("a"), F.col("f_a").alias("l"),
        F.col("f_b").alias("r"), _score(F.col("n"), F.col("f_a"), F.col("f_b")).alias("score"), F.lit(None).cast("string").alias("path"))
    return three.unionByName(pairs)


def best(scored: DataFrame, top: int) -> DataFrame:
    """The first `top` phrases of each language with their rank; those of SALTS parts meet."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    part = scored.select("*", salt.alias("_salt"))
    part = part.select("*", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)).alias("_r")).where(
        F.col("_r") <= top).drop("_salt", "_r")
    return part.select("*", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint").alias("rank")).where(
        F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, held: int = HELD) -> DataFrame:
    """The strongest phrases of two and three words of each language of `docs` (lang, text).

    lang, rank (from 1), phrase, a (its occurrences), l and r (those of its parts at the cut
    with the lowest score, the first of equal ones), n (words of the language), score and path
    (the longest fixed run of words around a phrase of three). Letters A-Z count as small. Null
    texts have no words, and a null language is `und`. Without words there is no row. Rows of
    one id count each; other columns are not looked at.
    """
    edges, nodes, words, totals = graph(docs, least)
    scored = cut(candidates(edges, nodes, words, held))
    sizes = small_or_shuffled(cut(totals))
    return best(scored, top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path")
