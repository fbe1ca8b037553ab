"""Token ids of whole texts by a public tokenizer, word by word.

The tokenizer drops white space and never merges across it, so a text's ids are the ids of its space-separated chunks, one after
the other; nor does it merge a Latin letter with the punctuation behind it, so such tails are chunks of their own. Chunks of a batch are
dictionary-encoded and each distinct one is looked up once; a bounded cache lives as long as the worker. Plain words (Latin letters)
go to the tokenizer's model directly, lower-cased and in the byte alphabet that its pre-tokenizer would use; all others go
through its whole pipeline. That the short way agrees is checked on samples when the tokenizer is loaded, and left out if it doesn't.
"""

from __future__ import annotations

from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that a worker remembers, or those of one batch if they are more.
CACHE = 250_000
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_TAIL = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,!?;:%&$#*\"()+=_~-]+)( |$)"  # no apostrophe, and nothing that special tokens have
_SAMPLES = ["Thtionnd,", "éèêaux", "Ñandú.", "straße", "a", "ÀÉ!?", "ÿ", "über;:", "x1, don't. É.. a.b, (c): ß", "a%%% b-, c_) d'&", "x<|endoftext|> <|endoftext|>, y"]
_loaded: dict[str, Words] = {}


def _byte_letters() -> dict[int, str]:
    """Printable bytes stand for themselves; the others, in order, for the characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Words:
    """A tokenizer with a bounded cache: each known chunk's place in one run of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.forget()
        self.direct = True
        self.direct = all(self.encode(pa.array([s], pa.large_string()))[0].tolist() == self.full(s) for s in _SAMPLES)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}  # the empty chunk has place 0 and no ids
        self.ids, self.ends = array("I"), array("q", [0, 0])  # the k-th chunk's ids end at ends[k + 1]

    def full(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def _plain(self, word: str) -> list[int]:
        spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return [t.id for t in self.tokenizer.model.tokenize(spelled)]

    def _keep(self, names: list[str]) -> None:
        """Start anew with the chunks of ``names`` that are known: what a batch repeats is likely to come again."""
        known, ids, ends = self.known, self.ids, self.ends
        self.forget()
        for name in names:
            place = known.get(name)
            if place:
                self.ids.extend(ids[ends[place] : ends[place + 1]])
                self.known[name] = len(self.ends) - 1
                self.ends.append(len(self.ids))

    def places(self, chunks: pa.Array) -> np.ndarray:
        """The places of distinct chunks without blanks; those not known are tokenized and remembered."""
        if not len(chunks):
            return np.zeros(0, dtype=np.int64)
        if self.direct:
            plain = pc.match_substring_regex(chunks, _PLAIN)
            chunks = pc.if_else(plain, pc.utf8_lower(chunks), chunks)
            plain = plain.to_numpy(zero_copy_only=False)
        else:
            plain = np.zeros(len(chunks), dtype=bool)
        # joined and split, as to_pylist() takes ten times as long
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), pa.scalar(" ", chunks.type))[0].as_py().split(" ")
        if len(self.known) + len(names) > CACHE:
            self._keep(names)
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        known, ids, ends = self.known, self.ids, self.ends
        for k in np.flatnonzero(at < 0).tolist():
            name = names[k]
            place = known.get(name)  # the same word in other case may have come a moment ago
            if place is None:
                ids.extend(self._plain(name) if plain[k] else self.full(name))
                place = known[name] = len(ends) - 1
                ends.append(len(ids))
            at[k] = place
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and where each text's ids end."""
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        if self.direct:
            texts = pc.replace_substring_regex(texts, _TAIL, r"\1 \2\3")
        lists = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        offsets = lists.offsets.to_numpy()[: len(texts) + 1]
        offsets = offsets - offsets[0]
        del lists, texts
        at = self.places(coded.dictionary)
        pool, all_ends = np.array(self.ids, dtype=np.uint32), np.array(self.ends, dtype=np.int64)
        starts, lengths = all_ends[at], all_ends[at + 1] - all_ends[at]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        many = lengths[codes]
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total)
        where += np.repeat(starts[codes] - (ends - many), many)
        return pool[where], np.concatenate([[0], ends])[offsets[1:]]


def words(path: str) -> Words:
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def encode(texts: pa.Array, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row (uint32) and where each text's ids end; null texts are empty; ``end_id`` closes each."""
    out, closes = words(path).encode(pc.fill_null(texts.cast(pa.large_string()), ""))
    if end_id is not None:
        out = np.insert(out, closes, np.uint32(end_id))
        closes = closes + np.arange(1, len(closes) + 1)
    return out, closes
