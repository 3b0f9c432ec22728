"""Exact dedup and byte-level BPE: contracts on small and odd inputs."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken

from govlake.llm import bpe, exact_dedup

ODD = [(1, "a  b"), (2, "a\tb"), (3, "a b"), (3, "a b"), (4, None), (5, ""), (None, "a b"), (None, "only"), (6, "é b"), (7, "é b"), (8, "x" * 200_000), (9, "x" * 200_000), (10, " ")]


def plain_decisions(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out, used = [], set()
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        kept = i == keep and (t, i) not in used
        if kept:
            used.add((t, i))
        out.append((i, keep, len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("salts", [1, 16])
def test_decisions(spark, salts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, digest string").repartition(5)
    got = sorted([tuple(r) for r in exact_dedup.decisions(docs, salts=salts).collect()], key=repr)
    assert got == plain_decisions(ODD)


def test_dedup_keeps_one_row_of_each_group_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, "n", 7) for i, t in ODD], "doc_id long, text string, norm string, keep_id int")
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    want = sorted([(1, "a  b"), (4, None), (None, "only"), (6, "é b"), (7, "é b"), (8, "x" * 200_000), (10, " ")], key=repr)
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == want
    assert exact_dedup.dedup(docs.limit(0)).count() == 0


PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


def test_ids_equal_those_of_the_merges(encoder, library):
    rng = random.Random(5)
    alphabets = ["ab", "abc ", "etaoin shrdlu", "€äö日本 \n", "0123456789 .,", "ก́😀a", "a1 \t\n\x85\xa0\x1c\x1f²½ªé'st", "ab'll don't <|endoftext|>", "x　 ​ é1 "]
    for _ in range(3000):
        s = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60)))
        assert encoder.encode(s) == library.encode_ordinary(s), s


def test_long_pieces_take_linear_time(encoder, library):
    for s in ("a" * 30_000, "ab" * 20_000, "abcabd" * 5_000, " " * 5_000 + "x"):
        assert encoder.encode(s) == library.encode_ordinary(s)


def test_cache_turns_over(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 10)
    e = bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    text = " ".join(f"word{i % 40} zebra" for i in range(400))
    ids = library.encode_ordinary(text)
    assert e.digest(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_rows(spark, library):
    rows = [(1, "Hello there"), (2, None), (2, ""), (None, "naïve 😀"), (3, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, [9]) for i, t in rows], "doc_id long, text string, ids array<int>").repartition(3)
    got = sorted([tuple(r) for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()], key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=repr)
    encoded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, PATH, public_tokenizers.PATTERN)
    assert sorted([(r.doc_id, r.text) for r in back.collect()], key=repr) == sorted([(i, t or "") for i, t in rows], key=repr)
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
