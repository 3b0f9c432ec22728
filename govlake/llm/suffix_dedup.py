"""Suffix-array dedup with a logarithmic family of indexes.

A batch is a range of documents by ascending id. Its suffix array holds the suffixes of the batch's passages
(passages.py) that have at least `size` bytes, in byte order of their first `size` bytes: no more is compared for a match of
that length. A new batch's array is merge-scanned against the array of each level of the family: both are sorted, one pass
merges them, and equal neighbours are matches. Then the suffixes that no level has become a level of their own, and
levels of like size are merged, so a family holds about log2 of the number of batches. Each string is held once, with the
least id that has it.

Levels lie in buckets, where all equal strings of the corpus meet; a family over a whole corpus is as many families as
there are buckets, each of bounded size, and lives as long as the task of its bucket.

Defined cases: a null text is empty; texts under `size` bytes lose nothing; strings that repeat within one document
only do not count; null ids, repeated ids, very long texts and empty tables as passages.py says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import passages
from .substring_rlz import spans_of

#: Bytes of an anchor: a shared string of 50 bytes then has an anchor among each 27 grams. Suffixes of a batch in a bucket.
GRAM, BATCH = 24, 1 << 18


class SuffixArray:
    """Places of suffixes in a text, in byte order of their first `size` bytes, and the ids of their documents."""

    def __init__(self, text: bytes, size: int, starts: np.ndarray, ids: np.ndarray):
        self.text, self.size, self.starts, self.ids = text, size, starts, ids

    def __len__(self) -> int:
        return len(self.starts)

    def strings(self) -> np.ndarray:
        """The first `size` bytes of each suffix."""
        if not len(self.starts):
            return np.zeros(0, f"S{self.size}")
        return np.ndarray((len(self.text) - self.size + 1,), f"S{self.size}", self.text, strides=(1,))[self.starts]

    def taken(self, at: np.ndarray) -> SuffixArray:
        return SuffixArray(self.text, self.size, self.starts[at], self.ids[at])

    @classmethod
    def of(cls, text: bytes, size: int, starts: np.ndarray, ids: np.ndarray) -> SuffixArray:
        """Suffixes at these places, sorted; equal ones in the order given."""
        array = cls(text, size, starts, ids)
        return array.taken(np.argsort(array.strings(), kind="stable"))


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted arrays as one, and the order that makes it of both one behind the other. The stable sort finds the two runs and merges them."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    return both[order], order


class Family:
    """Levels, each a suffix array of distinct strings, larger ones first. All lie in one text, to which batches are appended."""

    def __init__(self, size: int):
        self.size = size
        self.levels: list[SuffixArray] = []

    def scan(self, strings: np.ndarray) -> np.ndarray:
        """For sorted distinct strings the id that a level has with each, or -1."""
        found = np.full(len(strings), -1, np.int64)
        for level in self.levels:
            in_order, order = merged(level.strings(), strings)
            same = np.flatnonzero(in_order[1:] == in_order[:-1])  # the level's comes first
            found[order[same + 1] - len(level)] = level.ids[order[same]]
        return found

    def add(self, batch: SuffixArray) -> np.ndarray:
        """The least id that has each suffix of a batch, in its order; its ids are not below those added before."""
        strings = batch.strings()
        head = np.r_[True, strings[1:] != strings[:-1]] if len(strings) else np.zeros(0, bool)
        first = np.flatnonzero(head)
        found = self.scan(strings[first])
        # equal suffixes are in order of id, so the head has the least
        least = np.where(found >= 0, np.minimum(found, batch.ids[first]), batch.ids[first])
        new = batch.taken(first[found < 0])
        while self.levels and len(self.levels[-1]) < 2 * len(new):
            old = self.levels.pop()
            _, order = merged(old.strings(), new.strings())
            new = SuffixArray(batch.text, self.size, np.concatenate([old.starts, new.starts])[order], np.concatenate([old.ids, new.ids])[order])
        if len(new):
            self.levels.append(new)
        return least[np.cumsum(head) - 1]


def suffixes(texts: list[bytes], ids: np.ndarray, size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as one, the places of the suffixes of `size` bytes or more within their text, and their ids."""
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(lengths - size + 1, 0)
    begins = np.repeat(np.cumsum(lengths) - lengths, counts)
    within = np.arange(len(begins)) - np.repeat(np.cumsum(counts) - counts, counts)
    return b"".join(texts), begins + within, np.repeat(ids, counts)


def through_levels(size: int) -> Callable[[np.ndarray, list[bytes]], list[np.ndarray]]:
    """The method for passages.judge: batches by ascending id go through the family of the bucket."""

    def look(ids: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
        order = np.argsort(ids, kind="stable")
        text, starts, owners = suffixes([texts[k] for k in order.tolist()], ids[order], size)
        family, late = Family(size), np.zeros(len(starts), bool)
        for a in range(0, len(starts), BATCH):
            place = np.argsort(np.ndarray((len(text) - size + 1,), f"S{size}", text, strides=(1,))[starts[a : a + BATCH]], kind="stable")
            batch = SuffixArray(text, size, starts[a : a + BATCH][place], owners[a : a + BATCH][place])
            late[a + place] = batch.ids > family.add(batch)
        counts = np.array([len(texts[k]) - size + 1 for k in order.tolist()], np.int64)
        out = [np.zeros(0, bool)] * len(texts)
        for k, flags in zip(order.tolist(), np.split(late, np.cumsum(counts)[:-1]), strict=True):
            out[k] = flags
        return out

    return look


def _finish(data: bytes, removed: np.ndarray | None) -> tuple:
    if removed is None:
        return len(data), 0, 0, hashlib.sha256(data).hexdigest(), ()
    spans = spans_of(removed)
    return len(data), int(removed.sum()), len(spans) // 2, hashlib.sha256(np.frombuffer(data, np.uint8)[~removed].tobytes()).hexdigest(), spans


FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int32()))]
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>"


def digests(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): spans holds start and end of each removed run of bytes."""
    return passages.judge(docs, passages.Bytes, size, min(GRAM, size), through_levels(size), _finish, SCHEMA, pa.schema(FIELDS), id_col, text)
