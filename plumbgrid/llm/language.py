"""Language by error-correcting output codes over character n-grams.

Every language has a codeword; bit b of all codewords splits the languages in two, and a binary
n-gram classifier predicts it: the log-odds of an n-gram under the languages with that bit
against those without. A text gets the language whose codeword has the least loss, each bit
weighted by how well it separates. Counts of n-grams come from all rows that may be learned from.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbgrid.llm.text import giving_back, slices

#: n-grams are hashed to this many places; the model has that many weights per bit.
PLACES = 1 << 15
#: n-grams beyond which more of them do not make a text's evidence stronger.
EVIDENCE = 40
#: Difference of loss to the next codeword below which a prediction is ambiguous.
AMBIGUOUS = 0.05
SMOOTH = 0.5
#: Languages that can be told apart; the model on the driver is bounded by it.
MOST_LANGUAGES = 500
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # (language, bit) of -1 and 1
    weights: np.ndarray  # (bit, place)
    trust: np.ndarray  # per bit


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def grams(texts: list[str], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 2- and 3-grams of letters and word borders, and each text's offset among them.

    2-grams of one letter and a border are kept, so a text has n-grams if it has a letter.
    """
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    points = np.where(is_letter[points], points, np.uint64(0))
    after = np.cumsum([len(t) + 1 for t in texts])
    a = np.concatenate([np.zeros(1, dtype=np.uint64), points[:-1]])
    c = np.concatenate([points[1:], np.zeros(1, dtype=np.uint64)])
    two = (a | points) != 0
    three = points != 0
    k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    pair = a * k1 + points * k2
    out = np.empty(2 * len(points), dtype=np.uint64)
    keep = np.empty(2 * len(points), dtype=bool)
    out[0::2], out[1::2] = pair, pair + c * k3 + np.uint64(1)
    keep[0::2], keep[1::2] = two, three
    out = ((out ^ (out >> np.uint64(29))) * k2) >> np.uint64(64 - 15)
    counts = np.concatenate([[0], np.cumsum(keep)])
    return out[keep].astype(np.int32), counts[np.concatenate([[0], after]) * 2]


def learnable() -> Column:
    """Rows to learn from: id, text and language there, and not held out."""
    return F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()


def held_out() -> Column:
    """crc32 of the id's text, modulo 4, is 2; an unknown id is not held out, nor learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: exhaustive up to 5 languages, else far apart of seeded draws."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        bits = [[1 if (b >> i) & 1 else -1 for b in range(1, 1 << (n - 1))] for i in range(n - 1)]
        return np.array([*bits, [-1] * ((1 << (n - 1)) - 1)], dtype=float)
    best, best_distance = None, -1
    length = 10 * int(np.ceil(np.log2(n)))
    for seed in range(100):
        draw = random.Random(seed)
        codes = np.array([[draw.choice((-1, 1)) for _ in range(length)] for _ in range(n)], dtype=float)
        agree = codes @ codes.T
        np.fill_diagonal(agree, -length)
        distance = (length - agree.max()) / 2
        if distance > best_distance and (np.abs(codes.sum(axis=0)) < n).all():
            best, best_distance = codes, distance
    return best


def train(docs: DataFrame) -> Model:
    """Counts n-grams per language over all rows of `docs` (text, lang) with neither null.

    What reaches the driver is languages times PLACES counts. Without rows there is no language
    and every prediction is unknown.
    """
    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = letters()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = pc.utf8_lower(batch.column(0)), batch.column(1).to_pylist()
            for start, end in slices(texts):
                by: dict[str, list[str]] = {}
                for lang, text in zip(langs[start:end], texts[start:end].to_pylist()):
                    by.setdefault(lang, []).append(text)
                for lang, held in by.items():
                    places, _ = grams(held, is_letter)
                    sums.setdefault(lang, np.zeros(PLACES, dtype=np.int64))
                    sums[lang] += np.bincount(places, minlength=PLACES)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(n[at], pa.int64())], ["lang", "place", "n"])

    rows = (docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
            .select(F.col("text").cast("string"), F.col("lang").cast("string"))
            .mapInArrow(count, "lang string, place int, n bigint")
            .groupBy("lang", "place").agg(F.sum("n").alias("n")))
    sums: dict[str, np.ndarray] = {}
    for row in rows.toLocalIterator():
        if row.lang not in sums:
            if len(sums) == MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
            sums[row.lang] = np.zeros(PLACES)
        sums[row.lang][row.place] = row.n
    languages = sorted(sums)
    codes = codewords(len(languages))
    if not languages:
        return Model([], codes, np.zeros((0, PLACES), dtype=np.float32), np.zeros(0))
    share = np.array([(sums[k] + SMOOTH) / (sums[k].sum() + SMOOTH * PLACES) for k in languages])
    weights = np.array([np.log(share[codes[:, b] > 0].mean(axis=0) / share[codes[:, b] < 0].mean(axis=0))
                        for b in range(codes.shape[1])]).reshape(codes.shape[1], PLACES)
    # The mean evidence for the right bit, of the language that a bit serves worst.
    trust = np.maximum((share @ weights.T * codes).min(axis=0), 1e-3) if len(languages) > 1 else np.zeros(0)
    return Model(languages, codes, weights.astype(np.float32), trust / max(trust.sum(), 1e-9))


def losses(places: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Loss (text, language) of each codeword; a text without n-grams has zeros."""
    n = np.diff(offsets)
    some = n > 0
    out = np.zeros((len(n), len(model.languages)))
    if some.any() and len(model.trust):
        starts = offsets[:-1][some]
        sums = np.array([np.add.reduceat(row[places].astype(np.float64), starts) for row in model.weights]).T
        margin = sums / n[some][:, None] * np.minimum(n[some], EVIDENCE)[:, None]
        loss = np.logaddexp(0, -margin[:, None, :] * model.codes[None, :, :])
        out[some] = loss @ model.trust
    return out


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns `keep`), lang_pred, score (0 to 1) and ambiguous, one row per row.

    Reads text only. A null text, one without letters, or a model without languages gives
    `und` with score 0. Ties go to the first language in order and are ambiguous.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.codes, model.weights, model.trust))

    @giving_back
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, known = letters(), Model(*shared.value)
        names = np.array([*known.languages, UNKNOWN], dtype=object)
        for batch in batches:
            texts = pc.utf8_lower(pc.fill_null(batch.column(len(kept)), ""))
            for start, end in slices(texts):
                places, offsets = grams(texts[start:end].to_pylist(), is_letter)
                some = (np.diff(offsets) > 0) & bool(known.languages)
                best = np.full(end - start, len(known.languages))
                score, doubt = np.zeros(end - start), ~some
                if some.any():
                    loss = losses(places, offsets, known)
                    order = np.sort(loss, axis=1)
                    best[some] = loss.argmin(axis=1)[some]
                    score[some] = (1 / np.exp(order[:, :1] - order).sum(axis=1))[some]
                    if len(known.languages) > 1:
                        doubt = ~some | (order[:, 1] - order[:, 0] < AMBIGUOUS)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c)[start:end] for c in range(len(kept))], pa.array(names[best], pa.string()),
                     pa.array(score, pa.float64()), pa.array(doubt, pa.bool_())],
                    [*kept, "lang_pred", "score", "ambiguous"])

    kept = ["doc_id"] if keep is None else keep
    rows = docs.select(*kept, F.col("text").cast("string").alias("_text"))
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return rows.mapInArrow(work, schema)
