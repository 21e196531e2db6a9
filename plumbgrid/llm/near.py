"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full sets.

1. Each document becomes a set of word shingles, a signature of VALUES minima and a 128-bit
   sum that stands for the set. Documents with equal sets form a class; its smallest id
   represents it from there on.
2. The forest holds every representative under TREES different orders of its signature and
   sorts each order as a whole. Neighbours in a sorted order that share at least DEPTH values
   are candidates; where many documents are alike, neighbours share longer prefixes by
   themselves, so the depth follows the region. At likeness 0.85 two sets miss each other in
   all trees with a chance of about 1e-10.
3. Each document tests its best candidates on full sets, and what is linked is united.
4. Components that still have candidates among each other are searched exactly: documents
   meet on the rarest shingles of their sets, as many as any pair above the threshold must
   share one of (prefix and position bounds), and every pair that meets and whose sets can be
   that close by a bitmap of their elements is confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbgrid.llm.text import Powers, giving_back, mix, signed, slices, small_or_shuffled, spans, word_hashes
from plumbgrid.operators.components import components
from plumbgrid.session import cut

VALUES, TREES, DEPTH = 128, 32, 4
#: Likeness in percent from which so many trees miss a pair with a chance below 1e-5; at 60 it is 1 in 100.
LEAST_PERCENT = 75
#: Candidates that a document tests before the exact search.
BEST = 4
#: Words of 64 bits in which a set is marked; each bit that differs is an element that differs.
MARKS = 16


def shingle_sets(texts: pa.Array, k: int, table: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and each text's offset."""
    words, offsets = word_hashes(texts, table, lower=True)
    n = np.diff(offsets)
    # A text with fewer words than k has them all as one shingle.
    starts = np.arange(len(words))
    owner = np.repeat(np.arange(len(n)), n)
    whole = offsets[1:][owner]
    keep = (starts + k <= whole) | ((starts == offsets[:-1][owner]) & (n[owner] < k))
    starts = starts[keep]
    owner = owner[keep]
    hashes = spans(words, starts, np.minimum(starts + k, offsets[1:][owner]), table)
    bounds = np.searchsorted(owner, np.arange(len(n) + 1))
    parts = [np.unique(hashes[s:e]) for s, e in zip(bounds, bounds[1:])]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else hashes), np.append(0, np.cumsum(sizes))


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(text, VALUES) 16-bit values; texts without shingles have arbitrary ones."""
    out = np.zeros((len(offsets) - 1, VALUES), dtype=np.uint16)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        starts = offsets[:-1][some]
        short = (sets >> np.uint64(32)).astype(np.uint32)
        rng = np.random.default_rng(20240501)
        scale = rng.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
        shift = rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)
        for v in range(VALUES):
            x = short * scale[v] + shift[v]
            low = np.minimum.reduceat(x ^ (x >> np.uint32(15)), starts)
            out[some, v] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (the set as 128 bits), sig; one row per row of `docs`."""
    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            for start, end in slices(batch.column(1)):
                sets, offsets = shingle_sets(batch.column(1)[start:end], k, table)
                n = np.diff(offsets)
                sums = []
                for seed in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
                    total = np.zeros(len(sets) + 1, dtype=np.uint64)
                    np.cumsum(mix(sets ^ seed), dtype=np.uint64, out=total[1:])
                    sums.append(signed(total[offsets[1:]] - total[offsets[:-1]]))
                sig = signatures(sets, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:end], pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]),
                     pa.array([row.tobytes() for row in sig], pa.binary())], ["doc_id", "n", "s1", "s2", "sig"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id bigint, n bigint, s1 bigint, s2 bigint, sig binary")


def forest(reps: DataFrame) -> DataFrame:
    """(a, b, trees, depth), a < b: neighbours in the sorted orders of `reps` (rep, sig).

    Each order is sorted over all tasks by range, so many equal or similar rows spread over
    tasks; neighbours on two sides of a range border are found from the border rows alone.
    """
    spark = reps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(-1, VALUES)
                ids = part.column(0)
                for tree in range(TREES):
                    order = (tree * (VALUES // TREES) + np.arange(3 * 4)) % VALUES
                    label = np.ascontiguousarray(sig[:, order]).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), tree, dtype=np.int32)), *[pa.array(label[:, i]) for i in range(3)],
                         ids], ["tree", "l1", "l2", "l3", "rep"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        names = ["a", "b", "depth", "part", "edge", "tree", "l1", "l2", "l3", "rep"]

        def border(row: np.ndarray, edge: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([part], pa.int32()),
                 pa.array([edge], pa.int32()), pa.array([row[0]], pa.int32()), *[pa.array([v], pa.int64()) for v in row[1:]]],
                names)

        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if last is None:
                yield border(rows[0], 1)
            else:
                rows = np.concatenate([last[None, :], rows])
            one, two = rows[:-1], rows[1:]
            near = (one[:, 0] == two[:, 0]) & (one[:, 1] == two[:, 1]) & (one[:, 4] != two[:, 4])
            one, two = one[near], two[near]
            depth = shared_depth(one[:, 2:4], two[:, 2:4])
            none = pa.nulls(len(one), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(one[:, 4], two[:, 4])), pa.array(np.maximum(one[:, 4], two[:, 4])),
                 pa.array(depth.astype(np.int32)), pa.array(np.full(len(one), part, dtype=np.int32)),
                 pa.array(np.zeros(len(one), dtype=np.int32)), none.cast(pa.int32()), none, none, none, none], names)
            last = rows[-1]
        if last is not None:
            yield border(last, 2)

    labels = ["tree", "l1", "l2", "l3", "rep"]
    found = cut(reps.select("rep", "sig").mapInArrow(plant, "tree int, l1 bigint, l2 bigint, l3 bigint, rep bigint")
                .repartitionByRange(parts, *labels).sortWithinPartitions(*labels)
                .mapInArrow(neighbours, "a bigint, b bigint, depth int, part int, edge int, "
                            "tree int, l1 bigint, l2 bigint, l3 bigint, rep bigint"))
    # Two rows per range.
    borders = found.where("edge > 0").select("*", *[F.lead(c).over(Window.orderBy("part", "edge")).alias(f"_{c}")
                                                    for c in ("edge", "tree", "l1", "rep")])
    bridges = borders.where("edge = 2 and _edge = 1 and tree = _tree and l1 = _l1 and rep <> _rep").select(
        F.least("rep", "_rep").alias("a"), F.greatest("rep", "_rep").alias("b"), F.lit(DEPTH).alias("depth"))
    return found.where("edge = 0").select("a", "b", "depth").unionByName(bridges).groupBy("a", "b").agg(
        F.count("*").alias("trees"), F.max("depth").alias("depth"))


def shared_depth(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """DEPTH and the equal leading 16-bit values behind it."""
    equal = (np.ascontiguousarray(one).view(np.uint16) == np.ascontiguousarray(two).view(np.uint16))
    return DEPTH + np.cumprod(equal.reshape(len(one), 8), axis=1).sum(axis=1)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * |intersection| >= percent * |union| on full sets."""
    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            for start, end in slices(batch.column(2)):
                part = batch.slice(start, end - start)
                (x, at_x), (y, at_y) = [shingle_sets(part.column(c), k, table) for c in (2, 3)]
                good = []
                for i in range(len(part)):
                    one, two = x[at_x[i]:at_x[i + 1]], y[at_y[i]:at_y[i + 1]]
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    good.append(100 * both >= percent * (len(one) + len(two) - both) and both > 0)
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("_x"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("_y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y").mapInArrow(
        work, "a bigint, b bigint")


def open_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """`pairs` between different components, with columns ca and cb."""
    one = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(one, "a").join(two, "b").where("ca <> cb")


def marks(texts: DataFrame, k: int) -> DataFrame:
    """rep and marks: MARKS * 64 bits, the one of each shingle's hash set."""
    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            for start, end in slices(batch.column(1)):
                sets, offsets = shingle_sets(batch.column(1)[start:end], k, table)
                bits = np.zeros((end - start, MARKS * 64), dtype=np.uint8)
                bits[np.repeat(np.arange(end - start), np.diff(offsets)), (sets % np.uint64(MARKS * 64)).astype(int)] = 1
                rows = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:end], pa.array(rows.tolist(), pa.list_(pa.int64()))],
                                                 ["rep", "marks"])

    return texts.select("rep", "text").mapInArrow(work, "rep bigint, marks array<bigint>")


def rare_pairs(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): all pairs of `texts` (rep, component, text) of different components that can
    reach the threshold, by prefixes of their sets in ascending order of frequency and by the
    bits in which their marks differ."""
    @giving_back
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers()
        for batch in batches:
            for start, end in slices(batch.column(2)):
                sets, offsets = shingle_sets(batch.column(2)[start:end], k, table)
                n = np.diff(offsets)
                rep, label = [np.repeat(batch.column(c)[start:end].to_numpy(), n) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep), pa.array(label), pa.array(np.repeat(n, n)), pa.array(signed(sets))],
                    ["rep", "component", "n", "shingle"])

    rows = cut(texts.select("rep", "component", "text").mapInArrow(
        explode, "rep bigint, component bigint, n bigint, shingle bigint"))
    seen = rows.groupBy("shingle").agg(F.count("*").alias("seen"), F.min("component").alias("_lo"),
                                       F.max("component").alias("_hi"))
    # A shingle of one component joins nothing, but it takes its place in the order.
    ranked = rows.join(seen, "shingle").select(
        "rep", "component", "n", "shingle", (F.col("_lo") < F.col("_hi")).alias("_shared"),
        F.row_number().over(Window.partitionBy("rep").orderBy("seen", "shingle")).alias("at"))
    prefix = cut(ranked.where(F.col("_shared") & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
                 .select("rep", "component", "n", "shingle", "at").join(marks(texts, k), "rep"))
    one, two = [prefix.select("shingle", *[F.col(c).alias(f"{c}{i}") for c in ("rep", "component", "n", "at", "marks")])
                for i in (1, 2)]
    least, most = F.least("n1", "n2"), F.greatest("n1", "n2")
    # From this shingle on, at most so many can be shared; below it none is.
    possible = 1 + F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    differ = sum((F.bit_count(F.col("marks1")[i].bitwiseXOR(F.col("marks2")[i])) for i in range(MARKS)), F.lit(0))
    return one.join(two, "shingle").where(
        (F.col("component1") != F.col("component2")) & (F.col("rep1") < F.col("rep2"))
        & (least * 100 >= most * percent)
        & (possible * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent)
        & (differ * (100 + percent) <= (F.col("n1") + F.col("n2")) * (100 - percent))).select(
        F.col("rep1").alias("a"), F.col("rep2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of `docs` (doc_id, text).

    Words are runs of other than ASCII white space, A-Z lower-cased; the set of a text is its
    distinct shingles of `k` words, or all its words as one shingle if it has fewer. Two texts
    are linked if 100 * |intersection| >= percent * |union|. component_id is the smallest
    doc_id that can be reached over links, kept tells whether it is the row's own.

    A null or empty text has 0 shingles and no link. A row without doc_id has no link either,
    its component_id is null and it is kept. Rows of one doc_id count as linked. Other columns
    are not looked at. A `percent` below LEAST_PERCENT is refused, as the forest would miss links.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent must be {LEAST_PERCENT} at least, not {percent}: the forest would miss links")
    sketched = cut(sketch(docs, k))
    sized = sketched.where("n > 0 and doc_id is not null")
    classes = cut(sized.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "sig")).alias("_m"))
                  .select("n", "s1", "s2", F.col("_m.doc_id").alias("rep"), F.col("_m.sig").alias("sig")))
    # Below this size, sets above the threshold are equal.
    least = -(-percent // (100 - percent)) if percent < 100 else 1
    pairs = cut(forest(classes.where(F.col("n") >= least)))
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    texts = cut(docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.col("text").cast("string"))
                .join(small_or_shuffled(ids), "rep"))
    both = pairs.select("a", "b", "trees", "depth", F.explode(F.array("a", "b")).alias("_own"))
    best = Window.partitionBy("_own").orderBy(F.desc("trees"), F.desc("depth"), "a", "b")
    tested = cut(both.select("*", F.row_number().over(best).alias("_r")).where(F.col("_r") <= BEST)
                 .select("a", "b").distinct())
    nodes = ids.withColumnRenamed("rep", "node")
    labels = cut(components(nodes, cut(confirmed(tested, texts, k, percent))))
    # Any pair that is still to be linked shares a region of some tree; along the sorted order
    # between its two there is a step from the one's component into another.
    steps = open_pairs(pairs, labels)
    touched = cut(steps.select(F.explode(F.array("ca", "cb")).alias("component")).distinct())
    members = cut(labels.join(small_or_shuffled(touched), "component").select(F.col("node").alias("rep"), "component"))
    rare = rare_pairs(texts.join(small_or_shuffled(members), "rep"), k, percent)
    more = cut(confirmed(cut(rare.join(tested, ["a", "b"], "left_anti")), texts, k, percent))
    if not more.isEmpty():
        # Components are united by a graph of components, which is much smaller.
        joined = open_pairs(more, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        united = components(touched.withColumnRenamed("component", "node"), joined).toDF("component", "_to")
        labels = cut(labels.join(united, "component", "left").select(
            "node", F.coalesce("_to", "component").alias("component")))
    placed = classes.select("n", "s1", "s2", "rep").join(labels, F.col("rep") == F.col("node"), "left").select(
        "n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    # Null keys never meet; n is above 0 for all classes.
    found = sketched.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("s1")).alias("s1"), "s2").join(
        placed, ["n", "s1", "s2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is not in `gone` (doc_id, a written table)."""
    return docs.join(small_or_shuffled(gone), "doc_id", "left_anti").select(*docs.columns)
