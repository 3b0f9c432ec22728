"""Substring dedup by relative Lempel-Ziv parsing against blocks of reference passages.

A reference block is the text of all passages that meet in one bucket (passages.py), by ascending id of their documents,
with an index of its phrases: `words` consecutive words -> where the block first has them. A document's passages are parsed
greedily, from left to right, against the part of the block that documents with a smaller id gave: the next phrase is looked
up as text, a phrase that is there is extended word by word for as long as both texts agree, and that is a factor; where no
phrase starts, the parse goes on one word later. A phrase across a factor's end lies in none, yet the block may hold it
elsewhere: so the parse goes on at the first phrase that crosses the border, and every phrase across it is looked up. Phrases
within factors, all at least `words` words long, are the duplicate spans. Every document meets every block that could hold a
phrase of it; other blocks cannot give a factor that long.

A factor follows the block's first place of its phrase, not the one that matches longest; as borders are checked, the
spans are the same. Spans of a document are the union of what all blocks found.

Defined cases: a null text has no words; texts under `words` words lose nothing; phrases that repeat within one document
only do not count; null ids, repeated ids, very long texts and empty tables as passages.py says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import passages

#: Words of an anchor: a shared phrase of 13 words then has an anchor among each 9 grams.
GRAM = 5


def cuts_of(text: bytes) -> list[int]:
    """Where the words of a text with single blanks start, and where one after the last would."""
    return [0, *accumulate([len(w) + 1 for w in text.split(b" ")])]


class Reference:
    """A block's texts and an index of their phrases: phrase -> (id, text, place in it), the first one added."""

    def __init__(self, words: int):
        self.words = words
        self.texts: list[bytes] = []
        self.index: dict[bytes, tuple[int, int, int]] = {}

    def add(self, i: int, text: bytes, cuts: list[int]) -> None:
        number, words, index = len(self.texts), self.words, self.index
        self.texts.append(text)
        for k in range(len(cuts) - words):
            a = cuts[k]
            index.setdefault(text[a : cuts[k + words] - 1], (i, number, a))

    def find(self, phrase: bytes, before: int) -> tuple[int, int] | None:
        """Text and place of the phrase in a document whose id is less than before."""
        found = self.index.get(phrase)
        return None if found is None or found[0] >= before else found[1:]

    def agreement(self, number: int, place: int, text: bytes, cuts: list[int], k: int) -> int:
        """The word before which the text, from its word k on, and the block's text from this place on stop being the same."""
        other = self.texts[number]
        rest = text[cuts[k] :]
        if other.startswith(rest, place) and other[place + len(rest) : place + len(rest) + 1] in (b"", b" "):
            return len(cuts) - 1
        shift = place - cuts[k]
        while k + 1 < len(cuts):
            a, b = cuts[k], cuts[k + 1] - 1
            if not other.startswith(text[a:b], a + shift) or other[b + shift : b + shift + 1] not in (b"", b" "):
                break
            k += 1
        return k


def parse(text: bytes, cuts: list[int], reference: Reference, before: int) -> list[tuple[int, int]]:
    """Factors (first word, word after the last) of a text against what documents with ids below `before` gave the block."""
    out, k, words, last = [], 0, reference.words, len(cuts) - 1
    while k + words <= last:
        found = reference.find(text[cuts[k] : cuts[k + words] - 1], before)
        if found is None:
            k += 1
            continue
        end = reference.agreement(*found, text, cuts, k)
        out.append((k, end))
        k = end - words + 1  # the first phrase across the border
    return out


def against_block(words: int) -> Callable[[np.ndarray, list[bytes]], list[np.ndarray]]:
    """The method for passages.judge: passages by ascending id are parsed against the block, then added to it."""

    def look(ids: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
        reference, late = Reference(words), [np.zeros(0, bool)] * len(texts)
        for k in np.argsort(ids, kind="stable").tolist():
            text, i = texts[k], int(ids[k])
            cuts = cuts_of(text)
            flags = np.zeros(len(cuts) - words, bool)
            for a, b in parse(text, cuts, reference, i):
                flags[a : b - words + 1] = True
            late[k] = flags
            reference.add(i, text, cuts)
        return late

    return look


def spans_of(removed: np.ndarray) -> np.ndarray:
    """Starts and ends of the maximal runs, flat."""
    return np.flatnonzero(np.diff(np.r_[0, removed.astype(np.int8), 0])).astype(np.int32)


def _kept(data: bytes, removed: np.ndarray | None) -> tuple[int, int, bytes, np.ndarray | tuple]:
    words = data.split()
    if removed is None:
        return len(words), 0, b" ".join(words), ()
    return len(words), int(removed.sum()), b" ".join([w for w, gone in zip(words, removed.tolist(), strict=True) if not gone]), spans_of(removed)


def _finish(data: bytes, removed: np.ndarray | None) -> tuple:
    n, gone, kept, spans = _kept(data, removed)
    return n, gone, hashlib.sha256(kept).hexdigest(), spans


def _finish_text(data: bytes, removed: np.ndarray | None) -> tuple:
    n, gone, kept, spans = _kept(data, removed)
    return n, gone, kept.decode(), spans


def _run(docs: DataFrame, finish, name: str, words: int, id_col: str, text: str) -> DataFrame:
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), (name, pa.string()), ("spans", pa.list_(pa.int32()))]
    schema = f"doc_id long, n_words long, n_removed long, {name} string, spans array<int>"
    return passages.judge(docs, passages.Words, words, min(GRAM, words), against_block(words), finish, schema, pa.schema(fields), id_col, text)


def digests(docs: DataFrame, words: int = 13, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans): spans holds start and end of each removed run of words."""
    return _run(docs, _finish, "kept_sha256", words, id_col, text)


def dedup(docs: DataFrame, words: int = 13, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text, spans) with the words that stay, joined by blanks."""
    return _run(docs, _finish_text, "text", words, id_col, text)
