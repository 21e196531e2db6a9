"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbgrid.llm import bins, decontaminate, fingerprints, language, manifest, mixing, near, packing, phrases, pii, secrets, substrings, urls
from plumbgrid.session import cut
from plumbgrid.llm.text import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written packed and described from the files."""
    return packing.encoded(read(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: the patterns' spans, and those the field adds."""
    docs = read(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.train(docs)))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = read(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs.where(language.learnable())))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their three-word shingles."""
    return near.near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


SQL["op10_near_duplicates"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 2], ' ')) AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS i, b.doc_id AS j FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
         JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
ways AS (SELECT i, j FROM link UNION ALL SELECT j, i FROM link),
reach(i, j) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.i, b.j FROM reach r JOIN ways b ON r.j = b.i)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.j) AS component_id, min(r.j) = w.doc_id AS kept
FROM w JOIN reach r ON r.i = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word passages that an earlier one holds."""
    found = substrings.without_repeats(read(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op2_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
           FROM documents),
x AS (SELECT doc_id, ws, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS k FROM x WHERE i + 12 <= len(ws)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS lo FROM k) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (SELECT unnest(range(0, 13)) AS j)),
kept AS (SELECT x.doc_id, string_agg(x.ws[x.i], ' ' ORDER BY x.i) AS t, count(*) AS n
         FROM x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    made = cut(fingerprints.with_edits(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "next_id", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.fingerprint(F.col("text")).alias("fingerprint"),
        fingerprints.fingerprint(F.col("edited")).alias("edited_fingerprint")))
    following = made.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fingerprint").alias("_next"))
    return made.join(following, "next_id").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, found through a trigram index."""
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


SQL["op3_secrets"] = secrets.sql()


#: Share of the greatest entropy that mixed sources reach, and how often a source is repeated.
MIX_ENTROPY, MIX_REPEATS = 0.97, 4.0


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mixture of all sources takes of every document, under a budget of all tokens."""
    docs = read(spark, sf_dir, "documents")
    return mixing.mixed(docs, entropy=MIX_ENTROPY, repeats=MIX_REPEATS).select(
        "doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"),
        F.col("_epoch").alias("epoch"), F.col("_order").alias("block_order"))


@query
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL, by the given rules or by mined ones."""
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the evidence."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document lies in sequences of 2048 tokens."""
    return bins.placed(bins.sequences(read(spark, sf_dir, "documents"), tokenizer_file(), end_id=0, with_ids=False))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether it still leads to the root when tampered with."""
    return manifest.manifest(read(spark, sf_dir, "documents"))


SQL["op12_merkle_manifest"] = manifest.sql()


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of each language."""
    return phrases.collocations(read(spark, sf_dir, "documents")).drop("path")


SQL["op11_phrases"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
f1 AS (SELECT lang, a, count(*) AS n FROM g GROUP BY ALL),
f2 AS (SELECT lang, a, b, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, a, b, c, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
tot AS (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY lang),
t AS (SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c AS phrase, f3.n AS f, x.n AS l1, yz.n AS r1, xy.n AS l2, z.n AS r2
      FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f1 z ON z.lang = f3.lang AND z.a = f3.c
      JOIN f2 xy ON xy.lang = f3.lang AND xy.a = f3.a AND xy.b = f3.b JOIN f2 yz ON yz.lang = f3.lang AND yz.a = f3.b AND yz.b = f3.c),
s AS (SELECT *, 1000000::HUGEINT * f * f // (l1::HUGEINT * r1) AS s1, 1000000::HUGEINT * f * f // (l2::HUGEINT * r2) AS s2 FROM t),
longer AS (SELECT lang, a, b, max(n) AS n FROM (SELECT lang, a, b, n FROM f3 UNION ALL SELECT lang, b, c, n FROM f3) GROUP BY ALL),
two AS (SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.n AS a, x.n AS l, y.n AS r FROM f2
        JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b
        LEFT JOIN longer o ON o.lang = f2.lang AND o.a = f2.a AND o.b = f2.b
        WHERE f2.n >= 10 AND NOT coalesce(100 * o.n >= 50 * f2.n, false)),
every AS (SELECT lang, phrase, f AS a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END AS l, CASE WHEN s2 < s1 THEN r2 ELSE r1 END AS r,
            least(s1, s2)::BIGINT AS score FROM s
          UNION ALL SELECT lang, phrase, a, l, r, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT FROM two),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT lang, rank, phrase, a, l, r, tot.n, score FROM ranked JOIN tot USING (lang) WHERE rank <= 2000
"""
