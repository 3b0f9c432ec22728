"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton over Latin-1 mapped bytes.

Each piece that the pattern cuts from a text is encoded on its own: the longest token that matches at a
position is tried first; a token may follow another only if the pair is one that the merges would leave
side by side (memoised); where no token fits, the walk steps back to the last token's next shorter prefix.
Positions that failed are not tried again, so a piece takes linear time. The ids equal those of the merges.

Defined cases: a null text is the empty text, which has no ids; bytes that are no UTF-8 can't occur in a
string column; rows with equal ids are encoded each on its own; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Pieces up to so many characters are remembered, at most so many of them, in each worker.
CACHED_LENGTH, CACHED_PIECES, KNOWN_PAIRS = 40, 120_000, 500_000

# The letters, numbers and blanks of Latin-1, for use inside [...] or alone.
LATIN_1 = {
    r"[^\s\p{L}\p{N}]": "[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]",
    r"\p{L}": "[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]",
    r"\p{N}": "[0-9\xb2\xb3\xb9\xbc-\xbe]",
    r"\s": "[\t-\r \x85\xa0]",
    r"\S": "[^\t-\r \x85\xa0]",
}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token, blank, rank, in each line. Its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    """Encodes pieces of text. Needs every single byte among the tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.split = regex.compile(pattern).findall
        # for texts within Latin-1 the same pattern in re, which has no \p: about twice as fast
        latin = pattern
        for name, members in LATIN_1.items():
            latin = latin.replace(name, members)
        self.split_latin = re.compile(latin).findall
        self.ranks, self.tokens = ranks, {r: t for t, r in ranks.items()}
        self.prefixes = ahocorasick.Automaton()
        for token in ranks:
            self.prefixes.add_word(token.decode("latin-1"), token)
        self.prefixes.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known, self.before = {}, {}  # piece -> (ids as text, bytes that they decode to), and what was known before the last turn

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: replay the merges of its bytes until two parts are left."""
        if rank not in self.halves:
            parts = [bytes([b]) for b in self.tokens[rank]]
            while len(parts) > 2:
                _, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[rank]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these tokens side by side: undo their merges, latest first, and see that no merge across the border was due."""
        key = (left, right)
        if key in self.pairs:
            return self.pairs[key]
        due, found = 1 << 60, True
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < due:
                found = False
                break
            of_left, of_right = self._halves(left), self._halves(right)
            if of_left and (left > right or not of_right):
                due, left = left, of_left[1]
            elif of_right:
                due, right = right + 1, of_right[0]
            else:
                break
        if len(self.pairs) >= KNOWN_PAIRS:
            self.pairs.clear()
        self.pairs[key] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        starting: list[list[int]] = [[] for _ in piece]  # tokens by the place where they start, shorter ones first
        for end, token in self.prefixes.iter(piece.decode("latin-1")):
            starting[end + 1 - len(token)].append(self.ranks[token])
        alive = bytearray(b"\1") * (len(piece) + 1)
        out: list[int] = []
        tried: list[int] = []  # for each token of out, its place in starting[its start]
        at, k = 0, len(starting[0]) - 1
        while at < len(piece):
            if k < 0:
                alive[at] = 0
                k = tried.pop() - 1
                at -= len(self.tokens[out.pop()])
                continue
            rank = starting[at][k]
            end = at + len(self.tokens[rank])
            if alive[end] and (not out or self.fits(out[-1], rank)):
                out.append(rank)
                tried.append(k)
                at = end
                k = len(starting[at]) - 1 if at < len(piece) else 0
            else:
                k -= 1
        return out

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split(text)
        return self.split_latin(text)

    def encode(self, text: str) -> list[int]:
        return [rank for piece in self.pieces(text) for rank in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _piece(self, piece: str) -> tuple[str, bytes]:
        found = self.before.get(piece)
        if found is None:
            ids = self.encode_piece(piece.encode())
            found = (" ".join(map(str, ids)), self.decode(ids))
        if len(piece) <= CACHED_LENGTH:
            if len(self.known) >= CACHED_PIECES:
                self.known, self.before = {}, self.known
            self.known[piece] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids as text, sha256 of the decoded bytes."""
        got = []
        for piece in self.pieces(text):
            found = self.known.get(piece)
            got.append(self._piece(piece) if found is None else found)
        ids, back = " ".join([x[0] for x in got]), b"".join([x[1] for x in got])
        return ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()


_encoders: dict[str, Encoder] = {}


def _encoder(ranks, pattern: str) -> Encoder:
    """One encoder for each worker and vocabulary; ranks is a broadcast of the file's ranks."""
    key = f"{ranks.value['id']} {pattern}"
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks.value["ranks"], pattern)
    return _encoders[key]


def _vocabulary(docs: DataFrame, path: str):
    """The vocabulary file is read on the driver and broadcast: a fixed size, under 1 MB for 50,000 tokens."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast({"id": hashlib.sha256(f.read()).hexdigest(), "ranks": read_ranks(path)})


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for each row."""
    ranks = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    rows = docs.select(id_col, text)
    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text) for each row of (id_col, ids); null ids decode to the empty text."""
    ranks = _vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            texts = [encoder.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    rows = encoded.select(id_col, "ids")
    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode the ids: (id_col, n_tokens, ids_sha256 of the ids in decimal with blanks between, decoded_sha256)."""
    ranks = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            n, ids, back = zip(*[encoder.digest(t or "") for t in batch.column(1).to_pylist()], strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(id_col, text)
    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
