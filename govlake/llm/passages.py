"""Which passages of a document another document might hold too: the candidate search of the two substring operators.

A document is a sequence of symbols (words or bytes); a window is `length` consecutive symbols. Most windows occur once
in a corpus, and none of the two methods has to look at them. So texts are dealt into blocks of about BLOCK_BYTES by a
hash of id and text, and three rounds follow, each a shuffle of packed arrays:

1. Every window has an anchor, the least hash of its `gram`-symbol grams; equal windows have equal anchors. Each block
   sends its distinct anchors to buckets chosen by hash, 4 bytes each. An anchor that several blocks sent goes back to these.
2. Consecutive windows with one shared anchor are a passage. Each block sends the text of its distinct passages to the
   anchor's bucket, with the least id that holds each. So all equal windows of the corpus meet in one bucket, as text. What
   happens there is the operator's own: it says for each window whether a document with a smaller id holds it.
3. Each block marks its windows from these answers.

Passages are compared as text; hashes only choose where they meet. A message is a row for each block and bucket, but
never more than one for each anchor or passage, so messages grow with the input and not with the square of the blocks.
An anchor that many documents hold (MANY in one block, HOT in all) would bring one bucket a passage from each; its windows
are sent one by one to the bucket of their own text instead, where equal ones of a block are one. Texts that copy a whole
earlier text are found first, in Spark's own aggregates: blocks send each digest once, with its least id.

Ids are integers. Rows whose id is null are no reference and keep all they have. Rows that share an id are judged each by
its own text, and are not earlier than each other. Null and empty texts have no windows. Long texts are worked on in
slices of SLICE symbols. An empty table gives no rows. Columns besides id and text are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integer_id, parts

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
U64 = np.uint64
#: Bytes of text in a block; symbols of a slice; documents that hold an anchor in one block, and in all, until it is hot.
BLOCK_BYTES, SLICE, MANY, HOT = 8 << 20, 1 << 16, 32, 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random 64-bit value for each byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * U64(BASES[0]))


def grams(values: np.ndarray, n: int, base: int) -> np.ndarray:
    """A polynomial hash of each n consecutive values, joined from powers of two."""
    total = len(values) - n + 1
    if total <= 0:
        return values[:0]
    out, have, block, size = None, 0, values, 1
    while True:
        if n & size:
            if out is None:
                out, have = block, size
            else:
                keep = len(values) - have - size + 1
                out, have = out[:keep] + block[have : have + keep] * U64(pow(base, have, 1 << 64)), have + size
        if have == n:
            return mixed(out[:total])
        block = block[:-size] + block[size:] * U64(pow(base, size, 1 << 64))
        size *= 2


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    total, size = len(values) - width + 1, 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:total], values[width - size : width - size + total])


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(k: int, n: int) -> np.ndarray:
    """Powers of a base (k = 0) or of its inverse (k = 1), at least n of them."""
    if len(_powers[k]) < n:
        base = BASES[1] if k == 0 else pow(BASES[1], -1, 1 << 64)
        _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 16), base, np.uint64))])
    return _powers[k][:n]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = int(starts[0])
    values = BYTE_VALUES[np.frombuffer(data, np.uint8, int(ends[-1]) - first, first)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _power(0, len(values)), dtype=np.uint64)])
    a, b = starts - first, ends - first
    return mixed((sums[b] - sums[a]) * _power(1, len(values) + 1)[a] + (b - a).astype(np.uint64))


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space."""
    b = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_symbols(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    return word_hashes(text, *word_bounds(text))


class Bytes:
    """Texts as they are, one after the other; symbols are bytes."""

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts)
        self.sizes = np.array([len(t) for t in texts], np.int64)

    def symbols(self, a: int, b: int) -> np.ndarray:
        return BYTE_VALUES[np.frombuffer(self.data, np.uint8, b - a, a)]

    def bounds(self, start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
        """Where in data the symbols from start to end lie."""
        return start.tolist(), end.tolist()


class Words:
    """Texts with one blank between words, one after the other; symbols are words."""

    def __init__(self, texts: list[bytes]):
        texts = [b" ".join(t.split()) for t in texts]
        self.data = b" ".join([t for t in texts if t])
        self.sizes = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        blanks = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 32)
        self.starts, self.ends = np.r_[0, blanks + 1][: self.sizes.sum()], np.r_[blanks, len(self.data)][: self.sizes.sum()]

    def symbols(self, a: int, b: int) -> np.ndarray:
        return word_hashes(self.data, self.starts[a:b], self.ends[a:b])

    def bounds(self, start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
        return self.starts[start].tolist(), self.ends[end - 1].tolist()


@dataclass(frozen=True)
class Plan:
    """symbols: Bytes or Words; length: of a window; gram: of an anchor; buckets: where passages meet."""

    symbols: type
    length: int
    gram: int
    buckets: int


def among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array found."""
    if not len(found):
        return np.zeros(len(values), bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


def anchor_key(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits within it: as buckets grow with the data, the chance that two anchors look alike stays."""
    return ((anchors % U64(buckets)) << U64(32)) | (anchors >> U64(32))


class Block:
    """The documents of one block by id. `copies` are whole copies of an earlier text, `fresh` the others."""

    def __init__(self, table: pa.Table, notes: pa.Table, plan: Plan):
        self.plan = plan
        ids = np.array(table.column("doc_id").to_numpy(), np.int64)
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        texts = table.column("text").to_pylist()
        self.texts = [(texts[i] or "").encode() for i in order.tolist()]
        least = {d: i for d, i in zip(notes.column("digest").to_pylist(), notes.column("least").to_pylist(), strict=True) if d is not None}
        gone = [bool(least) and least.get(hashlib.sha256(t).digest(), i) < i for i, t in zip(self.ids.tolist(), self.texts, strict=True)]
        self.copies, self.fresh = [k for k, g in enumerate(gone) if g], [k for k, g in enumerate(gone) if not g]
        self.body = plan.symbols([self.texts[k] for k in self.fresh])
        self.ends = np.cumsum(self.body.sizes)
        self.start, self.count, self.anchor = self._runs()
        self.doc = np.searchsorted(self.ends, self.start, "right")  # its place in fresh

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Consecutive windows of a document with one anchor: first window, how many, anchor."""
        plan, total = self.plan, int(self.ends[-1]) if len(self.ends) else 0
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for a in range(0, total, SLICE):
            symbols = self.body.symbols(a, min(total, a + SLICE + plan.length - 1))
            n = len(symbols) - plan.length + 1
            if n <= 0:
                break
            anchors = least_in(grams(symbols, plan.gram, BASES[0]), plan.length - plan.gram + 1)
            whole, new = np.ones(n, bool), np.r_[True, anchors[1:] != anchors[:-1]]
            for e in (self.ends[np.searchsorted(self.ends, a, "right") : np.searchsorted(self.ends, a + n + plan.length, "left")] - a).tolist():
                whole[max(0, e - plan.length + 1) : e] = False
                if e < n:
                    new[e] = True
            new[1:] |= whole[1:] != whole[:-1]
            at = np.flatnonzero(new)
            keep = whole[at]
            out.append((at[keep] + a, np.diff(np.r_[at, n])[keep], anchors[at][keep]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and in how many documents each is."""
        order = np.lexsort((self.doc, self.anchor))
        a, d = self.anchor[order], self.doc[order]
        pair = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])] if len(a) else np.zeros(0, bool)
        return np.unique(a[pair], return_counts=True)


class Passages:
    """What a block sends in round 2: the distinct passages that round 1 could not clear, in order of bucket and first holder."""

    def __init__(self, table: pa.Table, notes: pa.Table, plan: Plan):
        self.block = block = Block(table, notes, plan)
        shared, hot = (np.unique(_values(notes.column(c), np.int64)[0].view(np.uint64)) for c in ("anchors", "hot"))
        found, holders = block.anchors()
        keys = anchor_key(found, plan.buckets)
        take = np.searchsorted(found, block.anchor)
        chosen = np.flatnonzero(((holders > 1) | among(keys, shared))[take])
        one_by_one = among(keys, hot)[take[chosen]]
        # windows of hot anchors are passages of their own
        times = np.where(one_by_one, block.count[chosen], 1)
        run = np.repeat(chosen, times)
        single = np.repeat(one_by_one, times)
        step = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
        self.start, self.count, self.doc = block.start[run] + step, np.where(single, 1, block.count[run]), block.doc[run]
        seen: dict[bytes, int] = {}
        data, group, texts, first, buckets = block.body.data, [], [], [], []
        home = (block.anchor[run] % U64(plan.buckets)).astype(np.int64).tolist()
        for i, (a, b) in enumerate(zip(*block.body.bounds(self.start, self.start + self.count + plan.length - 1), strict=True)):
            text = data[a:b]
            g = seen.get(text)
            if g is None:
                g = seen[text] = len(texts)
                texts.append(text)
                first.append(i)
                buckets.append(zlib.crc32(text) % plan.buckets if single[i] else home[i])
            group.append(g)
        self.texts, self.group, self.first, self.buckets = texts, np.array(group, np.int64), np.array(first, np.int64), np.array(buckets, np.int64)

    def holders(self) -> np.ndarray:
        """The least id that holds each distinct passage."""
        return self.block.ids[np.array(self.block.fresh, np.int64)[self.doc[self.first]]] if len(self.first) else np.zeros(0, np.int64)

    def late(self, bits: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Windows that an earlier document holds, and the fresh document of each."""
        counts = self.count[self.first]
        flags: list[np.ndarray] = [np.zeros(0, bool)] * len(self.first)
        for b, at in split(self.buckets):
            if b in bits:
                many = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=int(counts[at].sum())).astype(bool)
                for k, f in zip(at.tolist(), np.split(many, np.cumsum(counts[at])[:-1]), strict=True):
                    flags[k] = f
        later = self.block.ids[np.array(self.block.fresh, np.int64)[self.doc]] > self.holders()[self.group] if len(self.group) else np.zeros(0, bool)
        windows, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, count, g, all_of_it, doc in zip(self.start.tolist(), self.count.tolist(), self.group.tolist(), later.tolist(), self.doc.tolist(), strict=True):
            if all_of_it:
                windows.append(np.arange(start, start + count))
            elif len(flags[g]) and flags[g].any():
                windows.append(start + np.flatnonzero(flags[g]))
            else:
                continue
            docs.append(np.full(len(windows[-1]), doc))
        return np.concatenate(windows), np.concatenate(docs)


def split(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places that name it, in their order."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(buckets[order]) != 0])
    for i, j in zip(at, np.r_[at[1:], len(order)], strict=True):
        yield int(buckets[order[i]]), order[i:j]


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _values(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and for each the row that it is from."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(arr.value_lengths().fill_null(0))
    return arr.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False), np.repeat(np.arange(len(arr)), lengths)


ANCHORS = "bucket int, block int, anchors array<int>, many array<int>"
ANCHORS_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("anchors", pa.list_(pa.int32())), ("many", pa.list_(pa.int32()))])
TEXTS = "bucket int, block int, ids array<long>, sizes array<int>, texts binary"
TEXTS_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("texts", pa.binary())])
NOTES = "block int, bucket int, anchors array<long>, hot array<long>, bits binary, digest binary, least long"
NOTES_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("anchors", pa.list_(pa.int64())), ("hot", pa.list_(pa.int64())), ("bits", pa.binary()), ("digest", pa.binary()), ("least", pa.int64())])


def _send_anchors(plan: Plan):
    """many: 0, or the number of documents if a block has MANY with the anchor."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, notes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table_of([], ANCHORS_ARROW)
        found, holders = Block(table, notes, plan).anchors()
        keys = anchor_key(found, plan.buckets)
        order = np.argsort(keys, kind="stable")
        keys, many = keys[order], np.where(holders >= MANY, holders, 0)[order].astype(np.int32)
        rows = []
        for b, at in split((keys >> U64(32)).astype(np.int64)):
            rows.append((b, key[0].as_py(), keys[at].astype(np.uint32).view(np.int32), many[at] if many[at].any() else None))
        return table_of(rows, ANCHORS_ARROW)

    return run


def _answer_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Anchors that more than one block sent go back to these; hot ones are named to all that sent them."""
    blocks = np.asarray(table.column("block"))
    anchors, row = _values(table.column("anchors"), np.int32)
    many, from_row = _values(table.column("many"), np.int32)
    holders = np.ones(len(anchors), np.int64)
    sizes = np.bincount(row, minlength=len(blocks))
    begins = np.cumsum(sizes) - sizes
    if len(many):
        there = np.bincount(from_row, minlength=len(blocks)) > 0
        holders[np.concatenate([np.arange(begins[r], begins[r] + sizes[r]) for r in np.flatnonzero(there)])] = np.maximum(many, 1)
    _, at, n = np.unique(anchors.view(np.uint32), return_inverse=True, return_counts=True)
    hot = np.bincount(at, weights=holders)[at] >= HOT if len(at) else np.zeros(0, bool)
    names = (anchors.view(np.uint32).astype(np.uint64) | (U64(key[0].as_py()) << U64(32))).view(np.int64)
    keep = np.flatnonzero((n[at] > 1) | hot)
    rows = []
    for _, places in split(row[keep]):
        mine = keep[places]
        rows.append((blocks[row[mine[0]]], key[0].as_py(), names[mine], names[mine[hot[mine]]] if hot[mine].any() else None, None, None, None))
    return table_of(rows, NOTES_ARROW)


def _send_texts(plan: Plan):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, notes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table_of([], TEXTS_ARROW)
        p = Passages(table, notes, plan)
        ids = p.holders()
        rows = []
        for b, at in split(p.buckets):
            texts = [p.texts[k] for k in at.tolist()]
            rows.append((b, key[0].as_py(), ids[at], [len(t) for t in texts], b"".join(texts)))
        return table_of(rows, TEXTS_ARROW)

    return run


def _answer_texts(look: Callable[[np.ndarray, list[bytes]], list[np.ndarray]]):
    """One bit a window of a passage, in the order in which its block sent them; blocks without any late window get no answer."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        ids, row = _values(table.column("ids"), np.int64)
        texts: list[bytes] = []
        for sizes, data in zip(table.column("sizes").to_pylist(), table.column("texts").to_pylist(), strict=True):
            at = 0
            for n in sizes:
                texts.append(data[at : at + n])
                at += n
        late = look(ids, texts)
        rows = []
        for r, at in split(row):
            flags = np.concatenate([late[k] for k in at.tolist()])
            if flags.any():
                rows.append((blocks[r], key[0].as_py(), None, None, np.packbits(flags).tobytes(), None, None))
        return table_of(rows, NOTES_ARROW)

    return run


def whole_copies(present: DataFrame) -> DataFrame:
    """Notes (block, digest, least) for texts of a block that an earlier id has; a block sends each text's digest once."""
    local = present.groupBy("block", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    least = local.groupBy("digest").agg(F.min("lo").alias("least"), F.max("hi").alias("last")).where("least < last").drop("last")
    late = local.join(least, "digest").where("least < hi")
    null = F.lit(None)
    return late.select(F.col("block").alias("block"), null.cast("int").alias("bucket"), null.cast("array<bigint>").alias("anchors"), null.cast("array<bigint>").alias("hot"), null.cast("binary").alias("bits"), "digest", "least")


def judge(docs: DataFrame, symbols: type, length: int, gram: int, look, finish: Callable, schema: str, arrow: pa.Schema, id_col: str, text: str) -> DataFrame:
    """One row (id, *finish(text, removed)) for each row of docs, where removed marks the symbols that go (None: none).

    look(ids, texts) is the method: for passages and the ids of their holders, which windows of each a smaller id holds.
    Blocks are as many as partitions of a shuffle, more if they would exceed BLOCK_BYTES; buckets are as many.
    """
    spark = docs.sparkSession
    rows = docs.select(integer_id(docs, id_col).alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(parts(spark), -(-size // BLOCK_BYTES))
    plan = Plan(symbols, length, gram, n)
    present = rows.where("doc_id IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    known = present.repartition(parts(spark), "block").groupBy("block")
    copies = whole_copies(present)
    first = known.cogroup(copies.groupBy("block")).applyInArrow(_send_anchors(plan), ANCHORS).groupBy("bucket").applyInArrow(_answer_anchors, NOTES)
    second = known.cogroup(first.unionByName(copies).groupBy("block")).applyInArrow(_send_texts(plan), TEXTS).groupBy("bucket").applyInArrow(_answer_texts(look), NOTES)

    def last(key: tuple[pa.Scalar, ...], table: pa.Table, notes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        p = Passages(table, notes, plan)
        block = p.block
        windows, docs_ = p.late({b: v for b, v in zip(notes.column("bucket").to_pylist(), notes.column("bits").to_pylist(), strict=True) if v is not None})
        marks: dict[int, np.ndarray] = {}
        begins = block.ends - block.body.sizes
        for d, at in split(docs_):
            size = int(block.body.sizes[d])
            starts = windows[at] - begins[d]
            edges = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(starts + length, minlength=size + 1)
            marks[block.fresh[d]] = np.cumsum(edges[:-1]) > 0
        for k in block.copies:
            size = int(plan.symbols([block.texts[k]]).sizes[0])
            if size >= length:
                marks[k] = np.ones(size, bool)
        return table_of([(i, *finish(data, marks.get(k))) for k, (i, data) in enumerate(zip(block.ids.tolist(), block.texts, strict=True))], arrow)

    judged = known.cogroup(first.unionByName(second).unionByName(copies).groupBy("block")).applyInArrow(last, schema)

    def unjudged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield from table_of([(None, *finish(d, None)) for d in data], arrow).to_batches()

    return judged.unionByName(rows.where("doc_id IS NULL").mapInArrow(unjudged, schema))
