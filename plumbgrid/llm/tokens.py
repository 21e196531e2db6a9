"""Texts to token ids, whole and by the batch.

A tokenizer whose rules cut a text at white space, and then between letters, single digits and
punctuation, before it merges anything gives a text the ids of its units one after the other.
Such a tokenizer is asked once per different unit; a batch of texts is cut into units, the units
are numbered, and ids are gathered by number, all as array operations.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from plumbgrid.llm.text import IS_SPACE, LOWER, flat_bytes

#: Units whose ids are remembered before remembering starts afresh; idle workers keep some 65 MB of them.
CACHE_UNITS = 400_000

#: Fixed value: the rule by which a tokenizer with word ends cuts a text.
PIECE_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SPACE, LETTER, DIGIT, MARK, ODD = range(5)


def _classes() -> np.ndarray:
    """The class of each byte; what is neither plain ASCII nor an apostrophe is odd."""
    out = np.full(256, ODD, dtype=np.uint8)
    for byte in range(33, 127):
        if byte != ord("'"):
            out[byte] = LETTER if chr(byte).isalpha() else DIGIT if chr(byte).isdigit() else MARK
    out[IS_SPACE] = SPACE
    return out


CLASSES = _classes()
#: The byte that leads the two-byte letters of Latin-1, and the two signs among what follows it.
LATIN, SIGNS = 0xC3, (0x97, 0xB7)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, starts of the units that tile them, and whether each is a run of letters.

    ASCII letters of such runs come out in lower case, as the tokenizer will have them. White
    space is a unit too. A piece between white space that holds an apostrophe, "<|" or a
    character other than ASCII and the letters of Latin-1 is one unit.
    """
    n = len(data)
    kind = CLASSES[data]
    lead = np.flatnonzero(data[:-1] == LATIN)
    follow = data[lead + 1]
    lead = lead[(follow >= 0x80) & (follow < 0xC0) & (follow != SIGNS[0]) & (follow != SIGNS[1])]
    kind[lead] = kind[lead + 1] = LETTER
    kind[:-1][(data[:-1] == ord("<")) & (data[1:] == ord("|"))] = ODD
    first = np.zeros(n, dtype=bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        space = kind == SPACE
        edge = first.copy()
        edge[1:] |= space[1:] != space[:-1]
        piece = np.cumsum(edge) - 1
        whole = np.zeros(piece[-1] + 1, dtype=bool)
        whole[piece[odd]] = True
        kind[whole[piece]] = ODD
    first[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    starts = np.flatnonzero(first)
    return np.where(kind == LETTER, LOWER[data], data), starts, kind[starts] == LETTER


class Encoder:
    """Whole texts to ids, as the tokenizer in `file` encodes them without special tokens.

    Tokenizers with other rules than PIECE_RULE after NFC and lower-casing encode each text as
    it is.
    """

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x.get("type") for x in ((made.get("normalizer") or {}).get("normalizers") or [])]
        cuts = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_pieces = steps == ["NFC", "Replace", "Lowercase"] and cuts.get("invert") is True and (
            cuts.get("behavior"), (cuts.get("pattern") or {}).get("Regex")) == ("Removed", PIECE_RULE)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.vocabulary, dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.bounds = np.zeros(1, dtype=np.int64)

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, sizes.sum()), sizes

    def letters(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """As `each` of runs of letters, in few calls: the last id of a run carries the mark of an end."""
        out = []
        for at in range(0, len(words), 4096):
            part = words[at:at + 4096]
            ids, _ = self.each([b" ".join(part).decode()])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                out.append((ids, np.diff(ends, prepend=0)))
            else:
                out.append(self.each([w.decode() for w in part]))
        return out

    def learn(self, names: list[bytes], plain: np.ndarray) -> None:
        words = [x for x, p in zip(names, plain) if p]
        rest = [x for x, p in zip(names, plain) if not p]
        made = [*self.letters(words), self.each([x.decode() for x in rest])]
        self.known.update(zip(words + rest, range(len(self.known), len(self.known) + len(names))))
        self.flat = np.concatenate([self.flat, *[ids for ids, _ in made]])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate([n for _, n in made]))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row as unsigned 32-bit integers, and each text's offset among them; null is empty."""
        if not self.by_pieces:
            ids, sizes = self.each([t or "" for t in texts.to_pylist()])
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        data, offsets = flat_bytes(texts)
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        data, starts, plain = units(data, offsets)
        tiles = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = tiles.dictionary_encode()
        which = coded.indices.to_numpy()
        names = coded.dictionary.to_pylist()
        if len(self.known) + len(names) > CACHE_UNITS:
            self.forget()
        number = np.fromiter((self.known.get(x, -1) for x in names), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        if len(new):
            letters = np.zeros(len(names), dtype=bool)
            letters[which] = plain
            self.learn([names[i] for i in new], letters[new])
            number[new] = [self.known[names[i]] for i in new]
        low, size = self.bounds[number][which], np.diff(self.bounds)[number][which]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(low - before[:-1], size) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, offsets)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, offsets = self.encode(pa.array(texts, pa.large_string()))
        ids = ids.astype("<u4")
        return [ids[s:e].tobytes() for s, e in zip(offsets, offsets[1:])]


def worker_encoder(file: str) -> Encoder:
    """An encoder of `file` that lives as long as the Python worker, so that later tasks know its units.

    This package's functions travel by value and keep no state; the tokenizer's module does.
    """
    import tokenizers

    held = vars(tokenizers).setdefault("_encoders_by_file", {})
    if file not in held:
        held[file] = Encoder(file)
    return held[file]
