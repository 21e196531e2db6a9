"""A Merkle manifest of a corpus: leaves, roots and proofs, all in SQL functions.

A tree has `FAN` children per node. Sixteen times sixteen consecutive nodes make an aligned
block, and a block is one row that keeps a level as one string of hexadecimal digests, 64
characters each. The parents of a block are hashes of fixed-width substrings of that string,
and a node's siblings are what stands before and after it in its substring. The digests of
all blocks are the next tree's nodes, so the same step is repeated until every key has one
node left: a key with a third of all rows is many blocks like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgrid.llm.text import small_or_shuffled
from plumbgrid.session import cut

#: Children of a node, and characters of a digest.
FAN, WIDE = 16, 64
#: Nodes of a block: two levels.
BLOCK = FAN * FAN
#: Sources up to which their paths, of a few thousand bytes each, may be broadcast.
SMALL_SOURCES = 4_000
#: One row in this many is tampered with, by its checksum.
TAMPERED = 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left: binary, right: binary>>"


def digest(parts: Column) -> Column:
    """The hash of bytes, as the bytes of its lower-case hexadecimal text."""
    return F.sha2(parts, 256).cast("binary")


def leaf(columns: list[Column]) -> Column:
    """The hash of values, each as its length in bytes, a colon and itself; `-` for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def _joined(digests: Column) -> Column:
    """An array of digests as one string, in bytes, which are taken apart without counting characters."""
    return F.array_join(F.transform(digests, lambda d: d.cast("string")), "").cast("binary")


def _parents(level: Column) -> Column:
    """Digests of each FAN consecutive nodes of a level, as one string."""
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / F.lit(FAN * WIDE)).cast("int"))
    return _joined(F.transform(runs, lambda r: digest(F.substring(level, r * (FAN * WIDE) + 1, F.lit(FAN * WIDE)))))


def _flanks(level: Column, at: Column) -> Column:
    """What stands before and after node `at` of a level in its run of FAN."""
    run = F.substring(level, F.floor(at / F.lit(FAN)).cast("int") * (FAN * WIDE) + 1, F.lit(FAN * WIDE))
    left = (at % FAN) * WIDE
    return F.struct(F.substring(run, F.lit(1), left).alias("left"),
                    F.substring(run, left + (WIDE + 1), F.lit(FAN * WIDE)).alias("right"))


def numbered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows with `_at`, their place from 0 among the rows of their `key`, and `_n`, the rows of it.

    Ranges of (key, order) are sorted and written, and a table with one row per range and key
    says what came before; no task holds a key.
    """
    spark = rows.sparkSession
    by = [F.col(key).asc_nulls_first(), *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = cut(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")))
    sizes = stored.groupBy(key, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    every = Window.partitionBy(key)
    earlier = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = cut(sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), (F.coalesce(
        F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(every).alias("_n")))
    met = stored.join(small_or_shuffled(known), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return met.select(*rows.columns, (F.col("_id") + F.col("_shift")).alias("_at"), "_n")


def blocks(nodes: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Numbered nodes (key, digest, _at, _n) as blocks.

    One row per key and block: `_block`, `_nodes` (their `kept` columns by place), `_levels`
    (those inside the block), `_l0` and `_l1` (the level of the nodes and of their parents) and
    `digest`, the node above.
    """
    block = F.floor(F.col("_at") / F.lit(BLOCK)).alias("_block")
    grouped = nodes.groupBy(key, block).agg(
        F.array_sort(F.collect_list(F.struct("_at", "digest", *kept))).alias("_nodes"), F.max("_n").alias("_n"))
    levels = F.when(F.col("_n") > FAN, 2).when(F.col("_n") > 1, 1).otherwise(0)
    out = grouped.select(key, "_block", "_n", "_nodes", levels.alias("_levels"), _joined(F.col("_nodes.digest")).alias("_l0"))
    out = out.select("*", F.when(F.col("_levels") > 0, _parents(F.col("_l0"))).alias("_l1"))
    return out.select("*", F.when(F.col("_levels") == 2, digest(F.col("_l1"))).when(F.col("_levels") == 1, F.col("_l1"))
                      .otherwise(F.col("_l0")).alias("digest"))


def path_in_block(at: Column) -> Column:
    """The siblings of node `at` on the levels inside its block."""
    first = _flanks(F.col("_l0"), at)
    second = _flanks(F.col("_l1"), F.floor(at / F.lit(FAN)).cast("int"))
    return (F.when(F.col("_levels") == 2, F.array(first, second)).when(F.col("_levels") == 1, F.array(first))
            .otherwise(F.array().cast(PATH)))


def within(at: Column) -> Column:
    return (at % BLOCK).cast("int")


def rooted(nodes: DataFrame, key: str, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """The blocks of numbered nodes, and the path from each to the root of its key.

    Returns the written blocks and a table (key, _block, _up, root): `_up` holds the siblings
    above the block. Rounds grow with the logarithm of the largest key to base 256.
    """
    made = cut(blocks(nodes, key, kept))
    most = made.agg(F.max("_n")).first()[0] or 0
    nothing = F.array().cast(PATH)
    if most <= BLOCK:
        return made, made.select(key, "_block", nothing.alias("_up"), F.col("digest").alias("root"))
    # A key with one block is done; the blocks of the others are the nodes of the next round.
    one = made.where(F.col("_n") <= BLOCK).select(key, "_block", nothing.alias("_up"), F.col("digest").alias("root"))
    more = made.where(F.col("_n") > BLOCK).select(
        key, "digest", F.col("_block").alias("_at"), F.ceil(F.col("_n") / F.lit(BLOCK)).alias("_n"))
    upper, above = rooted(more, key, [])
    known = above.withColumnsRenamed({key: "_key", "_block": "_b"})
    met = upper.join(known, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_b")))
    each = F.transform("_nodes", lambda x: F.struct(x["_at"].alias("_block"), F.concat(
        path_in_block(within(x["_at"])), F.col("_up")).alias("_up")))
    found = met.select(key, "root", F.explode(each).alias("x")).select(key, "x._block", "x._up", "root")
    return made, cut(one.unionByName(found))


def folded(start: Column, path: Column) -> Column:
    """The root that a digest and its siblings lead to."""
    return F.aggregate(path, start, lambda d, p: digest(F.concat(p["left"], d, p["right"])))


def _proof(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"]).cast("string")), "")


def tampering(doc_id: Column) -> Column:
    """Whether a row is tampered with; a null id has no checksum, so it is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))


def manifest(docs: DataFrame, tampered: bool = True) -> DataFrame:
    """Leaves, roots and proofs of `docs` (doc_id, source, lang, n_chars, text), one row per row.

    doc_id, leaf, subroot (of its source), root, proof_sha256 (of all siblings up to the root),
    folded_root (what the row, tampered with where `tampering` says so, and the original siblings
    lead to) and verified (whether that is the root). Rows of one source ascend by doc_id, null
    first; of equal ones, by leaf. Null is a source like others and comes first. Without rows
    there is no row. Other columns are not looked at.
    """
    rest = [F.col("source"), F.col("lang"), F.col("n_chars").cast("bigint")]
    whole = leaf([F.col("doc_id").cast("bigint"), *rest, F.col("text")])
    change = tampering(F.col("doc_id").cast("bigint")) if tampered else F.lit(False)
    other = leaf([F.col("doc_id").cast("bigint"), *rest, F.translate(F.col("text"), UPPER, LOWER)])
    leaves = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        whole.cast("binary").alias("digest"), F.when(change, other).cast("binary").alias("found"))
    placed = numbered(leaves, "source", [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()])
    made, up = rooted(placed, "source", ["doc_id", "found"])
    # The sources' own tree: their roots, ordered by source.
    roots = made.where(F.col("_block") == 0).select("source", "_block").join(
        up.withColumnsRenamed({"source": "_s", "_block": "_b"}),
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))).select(
        "source", F.lit(0).alias("all"), F.col("root").alias("digest"))
    top = numbered(roots, "all", [F.col("source").asc_nulls_first()])
    above, over = rooted(top, "all", ["source"])
    highest = above.join(over.withColumnsRenamed({"all": "_a", "_block": "_b"}),
                         (F.col("all") == F.col("_a")) & (F.col("_block") == F.col("_b")))
    each = F.transform("_nodes", lambda x: F.struct(x["source"].alias("_src"), x["digest"].alias("subroot"), F.concat(
        path_in_block(within(x["_at"])), F.col("_up")).alias("_over")))
    sources = cut(highest.select("root", F.explode(each).alias("x")).select("x._src", "x.subroot", "x._over", "root"))
    up = up.drop("root").withColumnsRenamed({"source": "_s", "_block": "_b"})
    met = made.join(up, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))).join(
        small_or_shuffled(sources, SMALL_SOURCES), F.col("source").eqNullSafe(F.col("_src")))
    onward = F.concat("_up", "_over")
    ready = met.select("_nodes", "_levels", "_l0", "_l1", "subroot", "root", onward.alias("_on"), _proof(onward).alias("_beyond"))
    proven = F.transform("_nodes", lambda x: F.struct(
        x["doc_id"].alias("doc_id"), x["digest"].alias("digest"), path_in_block(within(x["_at"])).alias("path"),
        F.coalesce(x["found"], x["digest"]).alias("found")))
    checked = F.transform(proven, lambda x: F.struct(
        x["doc_id"].alias("doc_id"), x["digest"].cast("string").alias("leaf"),
        F.sha2(F.concat(_proof(x["path"]), F.col("_beyond")), 256).alias("proof_sha256"),
        folded(folded(x["found"], x["path"]), F.col("_on")).cast("string").alias("folded_root")))
    return ready.select(F.col("subroot").cast("string").alias("subroot"), F.col("root").cast("string").alias("root"),
                        F.explode(checked).alias("x")).select(
        "x.doc_id", "x.leaf", "subroot", "root", "x.proof_sha256", "x.folded_root",
        (F.col("x.folded_root") == F.col("root")).alias("verified"))


def sql(levels: int = 6) -> str:
    """The query in SQL, for at most 16 ** levels rows of a source, and sources."""
    def tree(name: str, leaves: str) -> list[str]:
        out = [f"{name}0 AS ({leaves})"]
        for d in range(levels):
            out.append(f"{name}r{d} AS (SELECT key, pos // 16 AS p, any_value(n) AS n, string_agg(h, '' ORDER BY pos) AS s "
                       f"FROM {name}{d} WHERE n > {16 ** d} GROUP BY key, pos // 16)")
            out.append(f"{name}{d + 1} AS (SELECT key, p AS pos, n, sha256(s) AS h FROM {name}r{d})")
        tops = " UNION ALL ".join(f"SELECT key, h FROM {name}{d} WHERE n <= {16 ** d}" for d in range(levels + 1))
        return [*out, f"{name}top AS ({tops})"]

    def climb(name: str, source: str, key: str, pos: str, last: str) -> list[str]:
        out = [f"{name}f0 AS (SELECT * FROM {source})"]
        for d in range(levels):
            at = f"64 * ((x.{pos} // {16 ** d}) % 16)"
            left, right = f"substr(r.s, 1, CAST({at} AS BIGINT))", f"substr(r.s, CAST({at} + 65 AS BIGINT))"
            out.append(f"""{name}f{d + 1} AS (SELECT x.* REPLACE (CASE WHEN r.s IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f,
  CASE WHEN r.s IS NULL THEN proof ELSE proof || {left} || {right} END AS proof)
  FROM {name}f{d} x LEFT JOIN {name}r{d} r ON r.key = x.{key} AND r.p = x.{pos} // {16 ** (d + 1)})""")
        return [*out, f"{last} AS (SELECT * FROM {name}f{levels})"]

    def hashed(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in (
            "doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"

    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), "
           "lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), "
           "lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))")
    steps = [
        f"""l AS (SELECT doc_id, source, {hashed('text')} AS leaf, CASE WHEN {crc} % {TAMPERED} = 0
  THEN {hashed(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents)""",
        """p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS key, count(*) OVER (PARTITION BY source) AS n,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l)""",
        *tree("a", "SELECT key, pos, n, leaf AS h FROM p"),
        *tree("b", "SELECT 0 AS key, key AS pos, count(*) OVER () AS n, h FROM atop"),
        "q AS (SELECT p.doc_id, leaf, key, pos, 0 AS one, coalesce(other, leaf) AS f, '' AS proof FROM p)",
        *climb("a", "q", "key", "pos", "q1"), *climb("b", "q1", "one", "key", "q2")]
    return "WITH " + ",\n".join(steps) + """
SELECT q2.doc_id, leaf, atop.h AS subroot, btop.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = btop.h AS verified
FROM q2 JOIN atop ON atop.key = q2.key, btop"""
