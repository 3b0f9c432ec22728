"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles' 64-bit hashes. Similarity s of sets of sizes a and b bounds their
symmetric difference: at most d = (a + b) (1 - s) / (1 + s). The sketch of a set, for a size band, has m > d words; each
shingle is XORed into the word that its hash names. Each differing shingle changes one word, so two similar sets agree in
at least m - d words (pigeonhole): they meet in the join on (band, word number, word). Words without a shingle are left
out when more than a document's own empty words must agree, so they make no hot keys. Bands grow by 1 / s, and a set is
put into its own and the next, so partners of any size meet.

1. Each batch of documents sends its distinct keys to buckets of the key's hash, once for all its documents that have a key,
   with their number. A bucket adds these up: how many documents hold each key. Keys that one document holds end there.
2. Of a document's keys in a band at least `need` agree with those of a similar one: m - d, less its own empty words. So each document may leave out its need - 1 most frequent keys of a band
   (ties by key, so all documents order keys alike): of the keys that two similar documents share, the rarest has need - 1
   others above it in both, so both keep it. Documents that share a common passage and little else lose all they share.
3. Of what is left, each key pairs its least id with each other: first within chunks of documents, then between the chunks'
   least ids, so a hot key is one entry of each chunk. Distinct pairs are verified: first by the Hamming distance of
   one-bit parity sketches, a lower bound of the symmetric difference, then by the intersection of the sets. Verified pairs
   and equal sets give components.
4. Where a key's documents still lie in several components, any two of them might link. Of keys with the same documents one
   is taken, and keys that share documents become one group where that makes no more pairs than the keys have together. A
   group's documents are compared in tiles of TILE, each pair of tiles in its own task, by Hamming bound. Where the
   possible pairs across components are few, distinct ones are verified by their sets; where they are more than PAIRS_EACH a
   document, its documents fetch their sets into the tiles, and only verified pairs that join components come out.

Nothing is capped, and components are exact; PAIRS_EACH, TILE and BROADCAST_IDS change the plan only. Step 4 is quadratic in
the number of documents that share a key which step 2 leaves and yet lie in several components.

Defined cases: an empty table gives no rows. Very long texts are whole: their sets, and the memory of the task that holds
them, grow with their words. Null and empty texts, and texts without words, have an empty set and link with nothing. Texts of fewer
words than a shingle have one shingle, the whole sequence. Rows with a null id are in no component (null). Rows
that share an id are one node that links with whatever any of them links. Other columns are never read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Unions, connected_components, integer_id, parts, write_shared
from .passages import BASES, U64, _values, grams, mixed, split, table_of, word_symbols

#: Pairs for each document of two tiles that are named one by one; documents of a tile; least and most 64-bit words of a one-bit parity sketch.
PAIRS_EACH, TILE, LEAST_SKETCH, MOST_SKETCH = 4, 1024, 8, 1024
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, A to Z lower-cased."""
    symbols = word_symbols((text or "").encode().translate(LOWER))
    if not len(symbols):
        return symbols
    n = min(words, len(symbols))
    return np.unique(mixed(grams(symbols, n, BASES[0]) + U64(n)))


class Bands:
    """Size bands and, for each, how many sketch words the pigeonhole needs. similarity is in hundredths."""

    def __init__(self, similarity: int):
        self.similarity = similarity
        self.starts = [1]

    def most_different(self, together: int) -> int:
        """The largest symmetric difference of similar sets whose sizes sum to `together`."""
        return together * (100 - self.similarity) // (100 + self.similarity)

    def _grow(self) -> None:
        self.starts.append(max(self.starts[-1] + 1, -(-self.starts[-1] * 100 // self.similarity)))

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self._grow()
        return bisect.bisect_right(self.starts, size) - 1

    def words(self, band: int) -> tuple[int, int]:
        """Words of a sketch in this band, and how many of them agree at least; (0, 0) if only equal sets are similar."""
        while len(self.starts) <= band + 1:
            self._grow()
        d = self.most_different(2 * (self.starts[band + 1] - 1))
        return (d + 3 + d // 8, 3 + d // 8) if d else (0, 0)

    def keys(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a set in its two bands, and for each a tag: 4 x the keys of its band that it shares with similar sets at least, + 1 in bands of odd number."""
        band, out, tags = self.of(len(tokens)), [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for b in (band, band + 1):
            m, agree = self.words(b)
            if not m:
                continue
            word = (mixed(tokens + U64(b + 1)) % U64(m)).astype(np.uint16 if m <= 1 << 16 else np.int64)  # short ones sort by radix
            order = np.argsort(word, kind="stable")
            word = word[order]
            at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            used, parity = word[at].astype(np.int64), np.bitwise_xor.reduceat(tokens[order], at)
            need = min(MOST_NEED, max(1, agree - (m - len(used))))  # the others that agree may be empty words
            if m - len(used) >= agree:  # even all of them
                empty = np.setdiff1d(np.arange(m), used)
                used, parity = np.r_[used, empty], np.r_[parity, np.zeros(len(empty), np.uint64)]
            out.append(mixed(parity + mixed(used.astype(np.uint64) + U64(b << 32))))
            tags.append(np.full(len(used), 4 * need + b % 2, np.int32))
        return np.concatenate(out), np.concatenate(tags)


SENT = "bucket int, keys array<int>, ids array<long>, tags array<short>, held array<short>, kind array<int>, a array<long>, b array<long>, c array<int>"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("keys", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int16())), ("held", pa.list_(pa.int16())), ("kind", pa.list_(pa.int32())), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("c", pa.list_(pa.int32()))])
FACT = "kind int, a long, b long, c int, d int"
FACT_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int32()), ("d", pa.int32())])
#: Kinds of facts: key, id, tag, holders; key, id, tag of a batch's other documents; key and holders for these; an equal pair; id (or null) and size of a set.
MEMBER, OTHER, KEY, EQUAL, SIZE = range(5)
#: The tag of the key that stands for a whole set: it is never left out.
WHOLE = 2
#: Asking for less is always right; tags stay within 16 bits. Ids up to so many (16 MB) are broadcast, more are joined by a shuffle.
MOST_NEED, BROADCAST_IDS = 8_000, 1_000_000


def _fact(kind: int, a, b, c=None) -> tuple[np.ndarray, ...]:
    return np.full(len(a), kind, np.int32), np.asarray(a, np.int64), np.asarray(b, np.int64), np.zeros(len(a), np.int32) if c is None else np.asarray(c, np.int32)


def _groups(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and id, the places in it where a key begins, and the number of its rows."""
    order = np.lexsort((ids, keys))
    k = keys[order]
    begins = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return order, begins, np.diff(np.r_[begins, len(k)])


def _star(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the row with each key's least id, and distinct pairs of it with each other id of the key."""
    order, begins, sizes = _groups(keys, ids)
    least = np.repeat(ids[order][begins], sizes)
    other = least != ids[order]
    pairs = np.stack([least[other], ids[order][other]], 1)
    return order[begins], np.unique(pairs, axis=0) if len(pairs) else pairs


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, as the keys and sets of a text take several times its memory."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _send(bands: Bands, words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            equal, sizes, unknown, seen = [], [], [], {}
            keys, tags, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            rows = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0))
            for i, text in rows:
                tokens = shingles(text, words)
                if i is None:
                    unknown.append(len(tokens))
                    continue
                sizes.append((i, len(tokens)))
                if not len(tokens):
                    continue
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                if digest in seen:
                    equal.append((seen[digest], i))
                    continue
                seen[digest] = i
                k, t = bands.keys(tokens)
                # a key of its own for the whole set brings together equal sets of several batches
                keys.append(np.append(k, U64(int.from_bytes(digest[:8], "little"))))
                tags.append(np.append(t, np.int32(WHOLE)))
                ids.append(np.full(len(k) + 1, i, np.int64))
            k, t, i = np.concatenate(keys), np.concatenate(tags), np.concatenate(ids)
            names = ((k % U64(buckets)) << U64(32)) | (k >> U64(33) << U64(1)) | (t.astype(np.uint64) & U64(1))
            order, begins, held = _groups(names, i)
            first = order[begins]
            other = np.setdiff1d(order[np.repeat(held > 1, held)], first)
            out = [(b, names[first[at]].astype(np.uint32).view(np.int32), i[first[at]], t[first[at]], held[at], None, None, None, None) for b, at in split((names[first] >> U64(32)).astype(np.int64))]
            own = [_fact(OTHER, names[other].view(np.int64), i[other], t[other]), _fact(EQUAL, [e[0] for e in equal], [e[1] for e in equal]), _fact(SIZE, [s[0] for s in sizes], [s[1] for s in sizes])]
            kind, a, b, c = (np.concatenate(x) for x in zip(*own, strict=True))
            out.append((int(batch.num_rows + (sizes[0][0] if sizes else 0)) % buckets, None, None, None, None, kind, a, b, c))
            if unknown:
                out.append((0, None, None, None, None, np.full(len(unknown), SIZE, np.int32), [None] * len(unknown), unknown, [0] * len(unknown)))
            yield from table_of(out, SENT_ARROW).to_batches()

    return run


def _meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Members of the bucket's keys that several documents hold, with the number of holders; facts that batches found pass through."""
    keys, ids, tags, held = (_values(table.column(c), d)[0] for c, d in (("keys", np.int32), ("ids", np.int64), ("tags", np.int16), ("held", np.int16)))
    order, begins, sizes = _groups(keys.view(np.uint32), ids)
    holders = np.add.reduceat(held[order].astype(np.int64), begins) if len(begins) else begins
    most = np.maximum.reduceat(held[order], begins) if len(begins) else begins
    names = (keys.view(np.uint32)[order].astype(np.uint64) | (U64(key[0].as_py()) << U64(32))).view(np.int64)
    shared = np.repeat(holders > 1, sizes)
    inside = begins[most > 1]
    member, others = _fact(MEMBER, names[shared], ids[order][shared], tags[order][shared].astype(np.int32)), _fact(KEY, names[inside], np.zeros(len(inside)))
    own = pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(member, others, strict=True)] + [pa.array(np.r_[np.repeat(holders, sizes)[shared], holders[most > 1]].astype(np.int32))], schema=FACT_ARROW)
    known = [table.column(n).combine_chunks().flatten() for n in ("kind", "a", "b", "c")]
    return pa.concat_tables([own, pa.Table.from_arrays([*known, pa.nulls(len(known[0]), pa.int32())], schema=FACT_ARROW)])


STAR = "key long, src long, dst long"


def _chunk_stars(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Of (id, keys) in chunks of about `most` keys: (key, least id, null) for each key, (null, least id, id) for each pair."""

    def stars(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        keys, row = _values(table.column("keys"), np.int64)
        ids = table.column("id").to_numpy()[row]
        first, pairs = _star(keys, ids)
        arrays = [np.r_[keys[first], np.zeros(len(pairs), np.int64)], np.r_[ids[first], pairs[:, 0]], np.r_[np.zeros(len(first), np.int64), pairs[:, 1]]]
        is_pair = np.arange(len(first) + len(pairs)) >= len(first)
        yield from pa.table({"key": pa.array(arrays[0], mask=is_pair), "src": arrays[1], "dst": pa.array(arrays[2], mask=~is_pair)}).to_batches()

    rows, have = [], 0
    for batch in batches:
        rows.append(batch)
        have += len(batch.column(1).flatten())
        if have >= most:
            yield from stars(rows)
            rows, have = [], 0
    if rows:
        yield from stars(rows)


def _bucket_stars(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    _, pairs = _star(table.column("key").to_numpy(), table.column("src").to_numpy())
    return pa.table({"src": pa.array(pairs[:, 0], pa.int64()), "dst": pa.array(pairs[:, 1], pa.int64())})


def similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Whether two sorted sets' intersection is at least the share of their union."""
    if min(len(a), len(b)) * 100 < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def parity(tokens: np.ndarray, words: int) -> np.ndarray:
    """The one-bit parity sketch: each shingle flips one of 64 * words bits."""
    bits = np.bincount((tokens % U64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The same sketch on fewer words; both numbers are powers of two."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _width(size: int) -> int:
    """Sketch words for a set: two bits a shingle or more, a power of two, so that like sizes have like widths.

    Where differing shingles meet in a bit they cancel: fewer bits only let more pairs through to be verified.
    """
    return int(min(MOST_SKETCH, max(LEAST_SKETCH, 1 << max(0, size * 2 // 64).bit_length())))


def _near(similarity: int):
    """Pairs whose sketches' Hamming distance doesn't exceed what similar sets can differ in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(similarity)
        for batch in batches:
            ok = []
            for m, n, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                a, b = (np.asarray(v.values).view(np.uint64) for v in (x, y))
                width = min(len(a), len(b))
                close = min(m, n) * 100 >= similarity * max(m, n)
                ok.append(close and int(np.bitwise_count(folded(a, width) ^ folded(b, width)).sum()) <= bands.most_different(m + n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verify(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(*(np.asarray(v.values).view(np.uint64) for v in pair), similarity) for pair in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    return run


def _having(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is one of the written ids. Up to BROADCAST_IDS of them the rows aren't shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _ends(pairs: DataFrame, *sides: str) -> DataFrame:
    """The distinct ids at these sides of the pairs, written."""
    ids = pairs.select(F.explode(F.array(*sides)).alias("id"))
    return write_shared(ids.distinct(), "ends")


def _beside(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Written pairs(src, dst) with these columns of both documents, as src_... and dst_...

    Pairs are stars around their least ids, so few documents are a src and many a dst. Each dst goes to its src, and a src sends its own
    once, not once for each of its pairs. The pairs go to the sets, up to BROADCAST_IDS of them by broadcast, so that a dst moves but once.
    A src has at most the pairs of a chunk or one for each chunk; AQE splits larger ones.
    """
    def end(side: str) -> list[Column]:
        return [F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)]

    src = _having(sets.select("id", *columns), _ends(pairs, "src")).select(*end("src"))
    to = pairs.withColumnRenamed("dst", "id")
    dst = sets.select("id", *columns).join(F.broadcast(to) if pairs.count() <= BROADCAST_IDS else to, "id").select("src", *end("dst"))
    return dst.join(src, "src").select("src", "dst", *(f"{side}_{c}" for c in columns for side in ("src", "dst")))


def near_pairs(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs that pass the Hamming bound; no set is fetched for it."""
    return write_shared(_beside(pairs, sets, ["n", "sketch"]).mapInArrow(_near(similarity), "src long, dst long"), "near_pairs")


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The similar ones of distinct, written pairs(src, dst). Only the sets of their documents are shuffled."""
    return _beside(pairs, sets, ["tokens"]).mapInArrow(_verify(similarity), "src long, dst long")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of sorted rows by (key, p, q), which may lie across batches."""
    carry = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if carry is None else [*carry.to_batches(), batch])
        columns = [table.column(c).to_numpy() for c in ("key", "p", "q")]
        new = np.zeros(max(0, table.num_rows - 1), bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        begins = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(begins, begins[1:], strict=False):
            yield table.slice(a, b - a)
        carry = table.slice(begins[-1])
    if carry is not None and carry.num_rows:
        yield carry


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")


def _across(table: pa.Table, similarity: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each document of two tiles its possible partners in other components that are not smaller: size and Hamming distance allow them."""
    side, sizes, component = (table.column(c).to_numpy() for c in ("side", "n", "component"))
    whole = table.column("p")[0] == table.column("q")[0]
    if component.min() == component.max():
        return
    sketches = [np.asarray(x.values).view(np.uint64) for x in table.column("sketch").combine_chunks()]
    order = np.argsort(sizes, kind="stable")  # partners of a set are a run in it
    in_order = sizes[order]
    stacks: dict[int, np.ndarray] = {}  # all sketches folded to a width
    for place, i in enumerate(order.tolist()):
        others = order[place + 1 : np.searchsorted(in_order, sizes[i] * 100 // similarity, "right")]
        others = others[component[others] != component[i]]
        if not whole:
            others = others[side[others] != side[i]]
        if not len(others):
            continue
        width = len(sketches[i])  # the smaller set has no longer sketch
        if width not in stacks:
            stacks[width] = np.stack([folded(s, width) if len(s) >= width else np.zeros(width, np.uint64) for s in sketches])
        most = (sizes[others] + sizes[i]) * (100 - similarity) // (100 + similarity)
        others = others[np.bitwise_count(stacks[width][others] ^ stacks[width][i]).sum(1) <= most]
        if len(others):
            yield i, others


NEAR = "key long, p int, q int, side int, id long, component long, other long, other_component long"


def _near_tiles(similarity: int):
    """Of two tiles of a key the possible pairs (id, other) with their components, if they are at most PAIRS_EACH for each document;
    else the documents that have a possible partner. So rows grow with the documents, whatever the number of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            near, found, many = np.zeros(table.num_rows, bool), [], 0
            for i, others in _across(table, similarity):
                near[i] = True
                near[others] = True
                many += len(others)
                if many <= PAIRS_EACH * table.num_rows:
                    found += [(i, j) for j in others.tolist()]
            if not near.any():
                continue
            ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
            if many <= PAIRS_EACH * table.num_rows:
                a, b = np.array(found).T
                a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
                none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32())]
                rows = [*none, *(pa.array(x) for x in (ids[a], component[a], ids[b], component[b]))]
            else:
                these = table.select(["key", "p", "q", "side", "id", "component"]).filter(pa.array(near)).combine_chunks()
                rows = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in these.columns] + [pa.nulls(these.num_rows, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(rows, names=["key", "p", "q", "side", "id", "component", "other", "other_component"])

    return run


def _verified_tiles(similarity: int):
    """Documents of two tiles of a key -> (component, component) of similar pairs that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            names, at = np.unique(table.column("component").to_numpy(), return_inverse=True)
            tokens = [np.asarray(x.values).view(np.uint64) for x in table.column("tokens").combine_chunks()]
            unions, edges = Unions(len(names)), []
            for i, others in _across(table, similarity):
                for j in others.tolist():
                    if unions.root(at[i]) != unions.root(at[j]) and similar(tokens[i], tokens[j], similarity):
                        unions.join(at[i], at[j])
                        edges.append((int(names[at[i]]), int(names[at[j]])))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    return run


def rarest(facts: DataFrame) -> DataFrame:
    """(id, keys): the keys of each document without, in each band, its need - 1 most frequent ones."""
    members = facts.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("id"), F.col("c").alias("tag"), F.col("d").alias("holders"))
    others = facts.where(F.col("kind") == OTHER).select(F.col("a").alias("key"), F.col("b").alias("id"), F.col("c").alias("tag"))
    holders = facts.where(F.col("kind") == KEY).select(F.col("a").alias("key"), F.col("d").alias("holders"))
    every = members.unionByName(others.join(holders, "key").select("key", "id", "tag", "holders")).repartition("id")
    banded = every.groupBy("id", F.col("tag").bitwiseAND(3).alias("band")).agg(F.min(F.shiftright("tag", 2)).alias("need"), F.sort_array(F.collect_list(F.struct("holders", "key")), asc=False).alias("keys"))
    left = banded.select("id", F.slice("keys", F.greatest("need", F.lit(1)), F.greatest(F.size("keys") - F.greatest("need", F.lit(1)) + 1, F.lit(0)))["key"].alias("keys"))
    return left.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys")).where(F.size("keys") > 0)


def _small(rows: DataFrame) -> DataFrame:
    """Written rows of a few numbers each: up to BROADCAST_IDS of them are broadcast, more are joined by a shuffle. The result is the same."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def open_groups(kept: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, component, size): the documents of each group in which pairs of different components must still be compared.

    A group is a key whose documents are not yet in one component; of keys with the same documents one. Documents of one
    template meet under many keys, each time with almost the same others: keys that share documents are a cluster, and where the pairs of all its
    documents are no more than those of its keys together, the cluster is one group in their place.
    """
    placed = kept.join(_small(found.withColumnRenamed("node", "id")), "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.explode("keys").alias("key"))
    still = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    members = write_shared(placed.join(_small(write_shared(still.select("key"), "open_keys")), "key"), "members")
    sums = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("who"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("too"))
    keys = sums.where("size > 2").groupBy("size", "who", "too").agg(F.min(F.struct("key", "least")).alias("k")).select("k.key", "k.least", "size")  # a pair alone was verified
    keys = write_shared(keys, "keys")
    members = members.join(_small(keys), "key")
    clusters = write_shared(connected_components(members.select(F.col("least").alias("src"), F.col("id").alias("dst"))).select(F.col("node").alias("id"), F.col("component").alias("cluster")), "clusters")
    cost = keys.join(clusters.withColumnRenamed("id", "least"), "least").groupBy("cluster").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("apart"))
    cost = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("all")).join(cost, "cluster").withColumn("whole", F.col("all").cast("double") * F.col("all") <= F.col("apart"))
    # a cluster may hold a third of all members: they aren't dealt by it, but where there are more clusters than a broadcast takes, and then AQE splits it
    placed = write_shared(members.join(_small(clusters), "id").join(_small(write_shared(cost, "cost")), "cluster"), "placed")
    whole = placed.where("whole").groupBy(F.col("cluster").alias("key"), "id", "component").agg(F.max("all").alias("size"))
    return placed.where("NOT whole").select("key", "id", "component", "size").unionByName(whole)


def _having_sets(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """The groups' documents with size and sketch; only sketches of these documents are shuffled."""
    groups = write_shared(groups, "groups")
    ids = write_shared(groups.select("id").distinct(), "ends")
    return groups.join(_having(sets.select("id", "n", "sketch"), ids), "id")


def components(docs: DataFrame, words: int = 5, similarity: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for each row: size of its set, least id reachable by links, its own included."""
    n = parts(docs.sparkSession)
    rows = docs.select(integer_id(docs, id_col).alias("id"), F.col(text).alias("text"))
    sent = rows.mapInArrow(_send(Bands(similarity), words, n), SENT)
    facts = write_shared(sent.groupBy("bucket").applyInArrow(_meet, FACT), "facts")
    kept = write_shared(rarest(facts), "kept")
    stars = write_shared(kept.mapInArrow(_chunk_stars, STAR), "stars")
    meets = stars.where("key IS NOT NULL").groupBy(F.pmod("key", F.lit(n)).alias("bucket")).applyInArrow(_bucket_stars, "src long, dst long")
    pairs = write_shared(stars.where("key IS NULL").select("src", "dst").unionByName(meets).distinct(), "pairs")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 500):
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            sketches = [parity(s, _width(len(s))).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "n", "sketch", "tokens"])

    sets = write_shared(_having(rows, _ends(pairs, "src", "dst")).mapInArrow(tokens, "id long, n long, sketch array<long>, tokens array<long>"), "sets")
    equal = facts.where(F.col("kind") == EQUAL).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = write_shared(connected_components(verified(near_pairs(pairs, sets, similarity), sets, similarity).unionByName(equal)), "found")
    inside = _having_sets(open_groups(kept, found), sets)
    inside = inside.withColumn("tiles", F.ceil(F.col("size") / F.lit(TILE)).cast("int")).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiles = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "key", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "id", "component", "n", "sketch"
    )
    near = write_shared(_dealt(tiles).mapInArrow(_near_tiles(similarity), NEAR), "near")
    near, few = near.where("other IS NULL").drop("other", "other_component"), near.where("other IS NOT NULL").select(F.col("id").alias("src"), F.col("other").alias("dst"), "component", "other_component").distinct()
    few = write_shared(few, "few")
    # one pair of each two components first; the others only of components that these left apart
    tried = few.groupBy("component", "other_component").agg(F.min(F.struct("src", "dst")).alias("x")).select("component", "other_component", "x.src", "x.dst")

    def joined(pairs: DataFrame) -> DataFrame:
        pairs = write_shared(pairs, "tried")
        good = verified(write_shared(pairs.select("src", "dst").distinct(), "tried_pairs"), sets, similarity)  # these have passed the Hamming bound
        return write_shared(good.join(pairs, ["src", "dst"]).select(F.col("component").alias("src"), F.col("other_component").alias("dst")), "joined")

    good = joined(tried)
    whole = connected_components(good)
    for c in ("component", "other_component"):
        few = few.join(whole.select(F.col("node").alias(c), F.col("component").alias(f"{c}_now")), c, "left").withColumn(f"{c}_now", F.coalesce(f"{c}_now", c))
    apart = few.where("component_now <> other_component_now").drop("component_now", "other_component_now").join(tried.select("src", "dst"), ["src", "dst"], "left_anti")
    good = good.unionByName(joined(apart))
    # of groups with the same documents left one
    last = near.groupBy("key", "p", "q").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id")).alias("who"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("too"))
    last = last.groupBy("size", "who", "too", (F.col("p") == F.col("q")).alias("whole")).agg(F.min(F.struct("key", "p", "q")).alias("g")).select("g.*")
    near = near.join(last, ["key", "p", "q"], "left_semi")
    more = connected_components(_dealt(near.join(sets, "id")).mapInArrow(_verified_tiles(similarity), "src long, dst long").unionByName(good))
    sizes = facts.where(F.col("kind") == SIZE).select(F.col("a").alias("id"), F.col("b").alias("n_shingles"))
    out = sizes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    out = out.join(more.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("whole", "component").alias("component_id"))


def dedup(docs: DataFrame, words: int = 5, similarity: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs of which one of each component stays (the least id), with all their columns; rows with a null id stay."""
    gone = components(docs, words, similarity, id_col, text).where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("_gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone_id"], "left_anti")
