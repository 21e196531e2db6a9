"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments (some words in a row) by features of the segment, and
a dynamic programme over segments of at most MAX_WORDS words picks boundaries and types at once.
It learns from what the patterns find in a bounded sample, and from copies of the same regions in
which each of these entities is written as the patterns do not see it (`rewritten`): other marks
between the digits, a dot spelled out, no plus. So it adds such entities. A plain word (without a digit or an at
sign, and not a filler) may not stand in a segment at all, neither at its ends nor inside, and a segment
of more than MAX_WORDS words or 320 characters is not scored. So the field adds no span such as
'+1 555 ext 204'. Under these limits the programme loses nothing by running over the regions between
plain words. What the patterns find is not limited by them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Words of a segment at most.
MAX_WORDS = 6
#: Regions the field is fitted on at most, and their words at most.
SAMPLE_REGIONS, SAMPLE_WORDS = 800, 40
#: Score above "no entity" that a segment needs to be added.
MIN_SCORE = 1.0
EPOCHS, RATE, DECAY = 40, 0.5, 1e-3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")
FOUR = re.compile(r"[0-9]{1,3}(?:[^0-9A-Za-z@]{1,2}[0-9]{1,3}){3}")
QUADS = re.compile(r"(?:[0-9]{4}[^0-9A-Za-z@]{1,2}){2,4}[0-9]{1,4}")
DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CORE = re.compile(r"[0-9@]")
FILLER = re.compile(r"[()./-]+")
TRIM = "\"'`.,;:!?()[]{}<>*#$%&|"

Span = tuple[int, int, int]  # kind, start, end
Example = tuple[int, list, np.ndarray, list[tuple[int, int]]]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octets(s: str) -> bool:
    """Whether every dotted part is at most 255, leading zeros allowed."""
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches from at sign to at sign, in time that follows the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, by start and then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(0, s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        if text.count(".") >= 3:
            for run in DOTTED.finditer(text):
                if run[0].count(".") >= 3:
                    out += [(1, run.start() + m.start(), run.start() + m.end())
                            for m in IP.finditer(run[0]) if octets(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = digits_of(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], x[0]))


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words that may hold entities: (start, end) of each word, trimmed of punctuation."""
    if not CORE.search(text):
        return []
    out: list[list[tuple[int, int]]] = []
    run: list[tuple[int, int]] = []
    core = 0  # words of the run up to its last core word
    for m in WORD.finditer(text):
        s, e = m.span()
        if CORE.search(text, s, e):
            run.append((s, e))
            core = len(run)
        elif run and FILLER.fullmatch(text, s, e):
            run.append((s, e))
        elif run:
            out.append(run[:core])
            run, core = [], 0
    if run:
        out.append(run[:core])
    return out


FEATURES = (["bias"] + [f"words{n}" for n in range(1, MAX_WORDS + 1)]
            + [f"digits{n}" for n in ("0", "1-3", "4-6", "7-8", "9-11", "12-15", "16", "17-19", "20+")]
            + ["at", "at_local", "at_domain", "plus", "only_digits", "digits_space", "digits_dots", "phone_marks",
               "letters", "luhn", "dotted4", "octets", "hex", "brackets", "ends_digit", "starts_digit",
               "four_octets", "quads", "date", "lead00", "lead0", "one_mark", "at_letters", "two_words_of_kind"]
            + [f"groups{n}" for n in ("1", "2", "3", "4", "5-6", "7+")])
INDEX = {name: i for i, name in enumerate(FEATURES)}


def features(s: str, n_words: int) -> list[int]:
    """The features that hold for a candidate segment with this text."""
    digits = digits_of(s)
    n = len(digits)
    size = ("0" if n == 0 else "1-3" if n < 4 else "4-6" if n < 7 else "7-8" if n < 9 else "9-11" if n < 12
            else "12-15" if n < 16 else "16" if n == 16 else "17-19" if n < 20 else "20+")
    local, at, domain = s.partition("@")
    dotted = bool(IP.fullmatch(s))
    runs = DIGITS.findall(s)
    marks = set(s) - set("0123456789")
    groups = str(len(runs)) if len(runs) < 5 else "5-6" if len(runs) < 7 else "7+"
    tests = {
        "bias": True, f"words{n_words}": True, f"digits{size}": True, "at": bool(at),
        "at_local": bool(at and local and set(local) <= LOCAL), "at_domain": bool(at and DOMAIN.fullmatch(domain)),
        "plus": s.startswith("+"), "only_digits": n == len(s), "digits_space": bool(CARD.fullmatch(s)),
        "digits_dots": bool(re.fullmatch(r"[0-9.]+", s)), "phone_marks": bool(re.fullmatch(r"[+0-9() .-]+", s)),
        "letters": any(c.isalpha() for c in s), "luhn": 12 <= n <= 19 and luhn(digits), "dotted4": dotted,
        "octets": dotted and octets(s), "hex": n < len(s) and bool(re.fullmatch(r"[0-9a-f]{16,}", s)),
        "brackets": "(" in s, "ends_digit": s[-1:].isdigit(), "starts_digit": s[:1].isdigit(),
        "four_octets": bool(FOUR.fullmatch(s)) and all(int(r) <= 255 for r in runs), "quads": bool(QUADS.fullmatch(s)),
        "date": bool(DATE.fullmatch(s)), "lead00": s.startswith("00"), "lead0": s.startswith("0"), "one_mark": len(marks) == 1,
        "at_letters": bool(at and domain[:1].isalnum() and any(c.isalpha() for c in domain)),
        "two_words_of_kind": s.count("@") > 1, f"groups{groups}": len(runs) > 0,
    }
    return [INDEX[k] for k, holds in tests.items() if holds]


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in TRIM:
        start += 1
    while end > start and text[end - 1] in TRIM:
        end -= 1
    return start, end


def candidates(text: str, run: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """(first word, past last word, start, end) of each segment, and its features as a row."""
    segments, rows = [], []
    for i in range(len(run)):
        for j in range(i + 1, min(len(run), i + MAX_WORDS) + 1):
            s, e = trimmed(text, run[i][0], run[j - 1][1])
            # A segment begins and ends with a word that holds a digit or an at sign.
            if s < e and CORE.search(text, *run[i]) and CORE.search(text, *run[j - 1]) and e - s <= 320:
                segments.append((i, j, s, e))
                row = np.zeros(len(FEATURES))
                row[features(text[s:e], j - i)] = 1
                rows.append(row)
    return segments, np.array(rows).reshape(len(rows), len(FEATURES))


def best_segments(n: int, segments: list, scores: np.ndarray) -> list[tuple[int, int]]:
    """Viterbi over segmentations of n words: (segment, kind) of the best one; ties: no entity."""
    ending: dict[int, list[int]] = {}
    for k, (_, j, _, _) in enumerate(segments):
        ending.setdefault(j, []).append(k)
    best, back = [0.0] * (n + 1), [(-1, -1)] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in ending.get(j, ()):
            kind = int(scores[k].argmax())
            value = best[segments[k][0]] + scores[k, kind]
            if value > best[j]:
                best[j], back[j] = value, (k, kind)
    out, j = [], n
    while j > 0:
        k, kind = back[j]
        if k >= 0:
            out.append((k, kind))
        j = segments[k][0] if k >= 0 else j - 1
    return out[::-1]


def gold(run: list[tuple[int, int]], segments: list, found: list[Span]) -> list[tuple[int, int]]:
    """The segments that the patterns' spans stand for; of spans that share words, the first."""
    index = {(i, j): k for k, (i, j, _, _) in enumerate(segments)}
    out, taken = [], 0
    for kind, s, e in found:
        inside = [w for w, (a, b) in enumerate(run) if a < e and b > s]
        if inside and inside[0] >= taken and (k := index.get((inside[0], inside[-1] + 1))) is not None:
            out.append((k, kind))
            taken = inside[-1] + 1
    return out


def rewritten(text: str, found: list[Span], draw: int) -> tuple[str, list[Span]]:
    """A text with its spans written so that the patterns do not find them, and where they are now.

    `draw` picks among the ways; spans that overlap one before them stay as they are and go.
    """
    out, spans, at, length = [], [], 0, 0
    for kind, s, e in found:
        if s < at:
            continue
        way, old = (draw + s) % 4, text[s:e]
        if kind == 0:
            local, _, domain = old.partition("@")
            new = f"{local}@{domain.replace('.', ('_', ',', '-dot-', '(dot)')[way])}"
        elif kind == 1:
            new = old.replace(".", ("-", ",", ":", "..")[way])
        elif kind == 2:
            digits = digits_of(old)
            new = (".", "_", "/", "  ")[way].join(digits[i:i + 4] for i in range(0, len(digits), 4))
        else:
            digits = old[1:]
            new = (digits, "00" + digits, digits.replace(" ", ".").replace("-", "."), digits.replace(" ", "/"))[way]
        out += [text[at:s], new]
        length += s - at
        spans.append((kind, length, length + len(new)))
        length += len(new)
        at = e
    return "".join([*out, text[at:]]), spans


def examples_of(region: str) -> list[Example]:
    """What the field learns from a region: itself, and its rewritten copies if it holds entities."""
    found = base_spans(region)
    texts = [(region, found)] + [rewritten(region, found, draw) for draw in (range(2) if found else ())]
    out = []
    for text, spans in texts:
        for run in regions(text):
            segments, matrix = candidates(text, run)
            out.append((len(run), segments, matrix, gold(run, segments, spans)))
    return out


def likelihood(example: Example, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The logarithm of the probability of an example's gold segmentation, and its gradient.

    An example is its number of words, its segments, their features and the gold segments.
    Sums over all segmentations come from a forward and a backward pass.
    """
    n, segments, rows, right = example
    scores = rows @ weights.T
    each = np.logaddexp.reduce(scores, axis=1) if len(segments) else scores[:, :0].sum(axis=1)
    forward, backward = [0.0] + [-np.inf] * n, [-np.inf] * n + [0.0]
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for k, (i, j, _, _) in enumerate(segments):
        by_end.setdefault(j, []).append(k)
        by_start.setdefault(i, []).append(k)
    for j in range(1, n + 1):
        terms = [forward[j - 1]] + [forward[segments[k][0]] + each[k] for k in by_end.get(j, ())]
        forward[j] = np.logaddexp.reduce(terms)
    for i in range(n - 1, -1, -1):
        terms = [backward[i + 1]] + [backward[segments[k][1]] + each[k] for k in by_start.get(i, ())]
        backward[i] = np.logaddexp.reduce(terms)
    if not len(segments):
        return 0.0, np.zeros_like(weights)
    outside = np.array([forward[i] + backward[j] for i, j, _, _ in segments]) - forward[n]
    gradient = np.exp(scores + outside[:, None])
    for k, kind in right:
        gradient[k, kind] -= 1
    return sum(scores[k, kind] for k, kind in right) - forward[n], -gradient.T @ rows


def fit(examples: list[Example]) -> np.ndarray:
    """Weights (kind, feature) by gradient ascent on the likelihood of the gold segmentations.

    Without examples all weights are 0 and nothing is added.
    """
    weights = np.zeros((len(KINDS), len(FEATURES)))
    squares = np.full_like(weights, 1e-6)
    for _ in range(EPOCHS if examples else 0):
        gradient = -DECAY * len(examples) * weights
        for example in examples:
            gradient += likelihood(example, weights)[1]
        squares += gradient ** 2
        weights += RATE * gradient / np.sqrt(squares)
    return weights


def added_spans(text: str, found: list[Span], weights: np.ndarray) -> list[Span]:
    """Spans of the best segmentation that score enough and meet none of the patterns' spans (`found`, by start)."""
    out = []
    starts = np.array([a for _, a, _ in found], dtype=np.int64)
    reach = np.maximum.accumulate(np.array([b for _, _, b in found], dtype=np.int64))
    for run in regions(text):
        segments, rows = candidates(text, run)
        scores = rows @ weights.T
        for k, kind in best_segments(len(run), segments, scores):
            _, _, s, e = segments[k]
            before = int(np.searchsorted(starts, e))
            if scores[k, kind] >= MIN_SCORE and not (before and reach[before - 1] > s):
                out.append((kind, s, e))
    return out


def rendered(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def train(docs: DataFrame, regions_limit: int = SAMPLE_REGIONS) -> np.ndarray:
    """Fit on at most `regions_limit` regions, drawn by a hash of text and place.

    Half of them hold spans of the patterns, half do not, as far as there are so many; what is
    collected is bounded by that number of regions of at most SAMPLE_WORDS words each.
    """
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                found = base_spans(text)
                for run in regions(text):
                    s, e = run[0][0], run[-1][1]
                    if len(run) <= SAMPLE_WORDS and e - s <= 4000:
                        held = any(a < e and b > s for _, a, b in found)
                        order = hashlib.blake2b(f"{s}:{text[s:e]}".encode(), digest_size=7).hexdigest()
                        rows.append((held, order, text[s:e]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.string())], ["held", "place", "region"])

    drawn = docs.where(F.col("text").rlike("[0-9@]")).select("text").mapInArrow(
        sample, "held boolean, place string, region string")
    half = regions_limit // 2
    rows = [r for held in (True, False) for r in
            drawn.where(F.col("held") == held).orderBy("place", "region").limit(half).collect()]
    return fit([x for row in rows for x in examples_of(row.region)])


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, base array<struct<kind, start, end>>, added the same, one row per row of `docs`.

    Offsets count code points, end exclusive. A null text is empty, a null doc_id stays null, and
    rows of one doc_id stay rows each; other columns are left out. Of segmentations with equal
    scores the one with fewer entities counts. Time and memory grow with a text's length.
    """
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text or "")
                base.append([dict(kind=k, start=s, end=e) for k, s, e in found])
                more.append([dict(kind=k, start=s, end=e) for k, s, e in added_spans(text or "", found, weights)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(more, kind)],
                                             ["doc_id", "base", "added"])

    spans = "array<struct<kind:int,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        work, f"doc_id bigint, base {spans}, added {spans}")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, a hash of the patterns' spans, and all spans as text."""
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
            ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k: int):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    return found.select("doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.concat("base", "added")).alias("spans"))
