"""Document fingerprints by order MinHash, in SQL functions only.

A text is a sequence of letters: pieces of at most PIECE characters that start at white space
or where the piece before ends. Its k-mers are K letters in a row, and each carries a number:
how many equal k-mers stand before it. Numbered k-mers are hashed to one of SLOTS slots; a slot
takes its TAKE least ones, in the order in which they stand in the text, and hashes them as a
tuple. Two texts are alike by the share of filled slots that agree: moving text around changes
the order in a tuple, repeating it changes the numbers, so the likeness follows edits where the
overlap of k-mer sets would not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgrid.session import cut

PIECE, K, SLOTS, TAKE = 8, 2, 64, 2
#: Bits of a text position and of a slot's rank; with 6 bits of slot they fill 63.
PLACE_BITS, RANK_BITS = 24, 33
#: Hex digits of a slot in a fingerprint; an empty slot is as many dots.
DIGITS = 4


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a string of SLOTS * DIGITS characters; null counts as empty.

    Equal texts have equal fingerprints. A text with fewer than K letters is one k-mer; without
    letters all slots are empty. Letters beyond 2**24 of one text share a position.
    """
    return F.transform(F.array(F.coalesce(text, F.lit(""))), _of_text)[0]


def _of_text(text: Column) -> Column:
    letters = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))
    return F.transform(F.array(letters), _of_letters)[0]


def _of_letters(letters: Column) -> Column:
    # A k-mer as 39 bits of hash over 24 of position: sorted, equal k-mers stand in order of place.
    low = F.lit(1 << PLACE_BITS)
    last = F.lit((1 << PLACE_BITS) - 1).cast("bigint")
    count = F.greatest(F.size(letters) - F.lit(K - 1), F.least(F.size(letters), F.lit(1)))
    numbers = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    kmers = F.transform(numbers, lambda i: F.shiftrightunsigned(
        F.xxhash64(*[F.get(letters, i - 1 + j) for j in range(K)]), 63 - 38) * low
        + F.least(i.cast("bigint"), last))
    return F.transform(F.array(F.sort_array(kmers)), _of_sorted)[0]


def _of_sorted(kmers: Column) -> Column:
    same = 1 << PLACE_BITS
    starts = F.filter(F.sequence(F.lit(0), F.size(kmers) - 1), lambda i: (i == 0) | (
        F.shiftright(F.get(kmers, i), PLACE_BITS) != F.shiftright(F.get(kmers, i - 1), PLACE_BITS)))
    return F.when(F.size(kmers) == 0, F.lit("." * (SLOTS * DIGITS))).otherwise(
        F.transform(F.array(starts), lambda s: _of_starts(kmers, s, same))[0])


def _of_starts(kmers: Column, starts: Column, same: int) -> Column:
    def numbered(start: Column, j: Column) -> Column:
        end = F.coalesce(F.get(starts, j + 1), F.size(kmers))
        return F.transform(F.slice(kmers, start + 1, end - start), lambda kmer, number: _entry(kmer, number, same))

    return F.transform(F.array(F.sort_array(F.flatten(F.transform(starts, numbered)))), _of_entries)[0]


def _entry(kmer: Column, number: Column, same: int) -> Column:
    """Slot, rank and position of a numbered k-mer in one number."""
    drawn = F.shiftrightunsigned(F.xxhash64(F.shiftright(kmer, PLACE_BITS), number), 63 - RANK_BITS - 5)
    return F.coalesce(drawn * F.lit(same) + kmer.bitwiseAND(F.lit(same - 1).cast("bigint")), F.lit(0).cast("bigint"))


def _of_entries(entries: Column) -> Column:
    """The least TAKE of each slot, by position, hashed; `entries` is sorted by slot and rank."""
    bits = PLACE_BITS + RANK_BITS

    def slot(entry: Column) -> Column:
        return F.shiftright(entry, bits)

    chosen = F.filter(entries, lambda entry, i: (i < TAKE) | (slot(F.get(entries, i - TAKE)) != slot(entry)))
    return F.transform(F.array(chosen), lambda c: F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: _tuple(F.filter(c, lambda e: slot(e) == s))), ""))[0]


def _tuple(entries: Column) -> Column:
    mask = F.lit((1 << PLACE_BITS) - 1).cast("bigint")
    placed = F.array_sort(F.transform(entries, lambda e: F.struct(
        e.bitwiseAND(mask).alias("place"), F.shiftright(e, PLACE_BITS).alias("kmer"))))
    hashed = F.xxhash64(F.transform(placed, lambda p: p["kmer"]))
    return F.when(F.size(entries) == 0, F.lit("." * DIGITS)).otherwise(
        F.lpad(F.lower(F.hex(hashed.bitwiseAND(F.lit(16 ** DIGITS - 1).cast("bigint")))), DIGITS, "0"))


def likeness(one: Column, two: Column) -> Column:
    """Share of the slots filled in either fingerprint that agree, 0 to 1; two empty ones are alike."""
    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))

    def part(whole: Column, i: Column) -> Column:
        return F.substring(whole, i * DIGITS + 1, F.lit(DIGITS))

    empty = F.lit("." * DIGITS)
    filled = F.size(F.filter(slots, lambda i: (part(one, i) != empty) | (part(two, i) != empty)))
    agree = F.size(F.filter(slots, lambda i: (part(one, i) == part(two, i)) & (part(one, i) != empty)))
    return F.when(one == two, F.lit(1.0)).otherwise(agree / filled)


def successors(docs: DataFrame) -> DataFrame:
    """doc_id, after_id, after_chars: who each document is next to, in descending doc_id.

    For each doc_id the document before it in that order (after the last comes the first) and
    that document's number of characters. Ids are sorted by range; only one row per range meets in one
    task. Rows of one doc_id are one document here, with its longest text.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = docs.groupBy("doc_id").agg(F.max(F.length(F.coalesce("text", F.lit("")))).cast("bigint").alias("chars"))
    ranged = cut(sizes.repartitionByRange(parts, F.desc("doc_id")).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(F.desc("doc_id"))
    ends = ranged.groupBy("_part").agg(F.min(F.struct("doc_id", "chars")).alias("_last"))
    order = Window.orderBy("_part")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per range.
    ends = ends.select("_part", F.coalesce(F.lag("_last").over(order), F.last("_last").over(everything)).alias("_end"))
    before = ranged.select("_part", "doc_id", F.lag(F.struct("doc_id", "chars")).over(inside).alias("_before"))
    return before.join(F.broadcast(ends), "_part").select(
        "doc_id", F.coalesce("_before", "_end").alias("_at")).select(
        "doc_id", F.col("_at.doc_id").alias("after_id"), F.col("_at.chars").alias("after_chars"))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, next_id, text, edited: every document and its edited text.

    The last third of the characters (rounded down) is replaced by as many first ones of the next
    document, or all of them, in descending doc_id; the last is followed by the first. Null texts
    are empty; rows without doc_id are left out; of rows with one doc_id the next document is
    the one with the longest text, the least of these.
    """
    docs = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = cut(successors(docs))
    heads = docs.join(order, "doc_id").select(
        F.col("after_id").alias("doc_id"), F.struct(
            -F.length("text"), F.expr("substring(text, 1, cast(floor(after_chars / 3) as int))").alias("head"),
            F.col("doc_id").alias("next_id")).alias("_next"))
    heads = heads.groupBy("doc_id").agg(F.min("_next").alias("_next"))
    n = F.length("text")
    return docs.join(heads, "doc_id").select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.col("_next.next_id").alias("next_id"), "text",
        F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"),
                 F.expr("substring(_next.head, 1, cast(floor(length(text) / 3) as int))")).alias("edited"))
