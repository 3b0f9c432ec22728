"""The two substring operators against plain versions, on the small table and on odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from govlake.llm import passages, substring_rlz, suffix_dedup

from . import brute

ODD = [
    (1, "a " * 30), (2, "a " * 40), (3, None), (4, ""), (None, "a " * 40), (5, "x" * 200), (6, "y" + "x" * 120), (6, "x" * 60), (6, "a " * 40), (7, "z q " * 20), (8, "z q " * 20), (8, "z q " * 20),
    (9, "ü" * 80), (10, "ö" + "ü" * 60), (11, "short text"), (12, " ".join(f"w{i}" for i in range(4_000))), (13, " ".join(f"w{i}" for i in range(50, 3_000))),
]


def made(seed, n=60):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 40))) for _ in range(12)]
    return [(rng.choice([i, i, i % 9]), rng.choice(["", " ", "\n"]).join(rng.choice(pool) for _ in range(rng.randint(1, 5)))) for i in range(n)]


@pytest.mark.parametrize("rows", [ODD, made(1), made(2)], ids=["odd", "made1", "made2"])
def test_against_plain_version(spark, rows):
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, block int").repartition(3)
    words = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_rlz.digests(docs).collect()], key=repr)
    assert words == sorted(brute.word_windows(rows), key=repr)
    size = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs).collect()], key=repr)
    assert size == sorted(brute.byte_windows(rows), key=repr)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_rlz.digests(docs).collect()], key=repr) == sorted(brute.word_windows(rows), key=repr)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs).collect()], key=repr) == sorted(brute.byte_windows(rows), key=repr)


def test_empty_table_and_texts(spark):
    docs = spark.createDataFrame([(1, " ".join("abcdefghijklmnop")), (2, " ".join("abcdefghijklmnopq"))], "doc_id long, text string")
    assert substring_rlz.digests(docs.limit(0)).count() == 0 and suffix_dedup.digests(docs.limit(0)).count() == 0
    assert {r.doc_id: r.text for r in substring_rlz.dedup(docs).collect()}[2] == "q"


@pytest.mark.parametrize("size", [1, 3])
def test_levels_find_what_earlier_batches_hold(size):
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 100, rng.integers(0, 25)).astype(np.uint8)) for _ in range(60)]
    ids = np.sort(rng.integers(0, 30, 60))
    text, starts, owners = suffix_dedup.suffixes(texts, ids, size)
    family, first = suffix_dedup.Family(size), {}
    for x, i in zip(starts.tolist(), owners.tolist(), strict=True):
        first.setdefault(text[x : x + size], i)
    for a in range(0, len(starts), 40):
        batch = suffix_dedup.SuffixArray.of(text, size, starts[a : a + 40], owners[a : a + 40])
        strings = [text[x : x + size] for x in batch.starts.tolist()]
        assert strings == sorted(strings)
        assert family.add(batch).tolist() == [first[s] for s in strings]
        lengths = [len(level) for level in family.levels]
        assert all(x >= 2 * y for x, y in zip(lengths, lengths[1:], strict=False))
        for level in family.levels:
            held = level.strings().tolist()
            assert held == sorted(set(held))
    assert sum(len(level) for level in family.levels) == len(first)


def test_parse_is_greedy_and_checks_borders():
    reference = substring_rlz.Reference(3)
    for i, text in enumerate([b"a b c d e", b"d e f g", b"x b c"]):
        reference.add(i, text, substring_rlz.cuts_of(text))
    parse = lambda t, before=9: substring_rlz.parse(t, substring_rlz.cuts_of(t), reference, before)
    assert parse(b"a b c d e") == [(0, 5)]
    assert parse(b"q a b c d e f g q") == [(1, 6), (4, 8)]  # d e f lies across the border of the first factor
    assert parse(b"q a b c d e f g q", before=1) == [(1, 6)]
    assert parse(b"a b c d", before=0) == [] and parse(b"a b") == []
    assert parse(b"a b cc d") == [] and parse(b"a b c dd") == [(0, 3)] and parse(b"x b c d") == [(0, 3), (1, 4)]


def plain_runs(block, texts, symbols, length):
    """Windows of each text that the runs name."""
    out = []
    for s, n, d in zip(block.start.tolist(), block.count.tolist(), block.doc.tolist(), strict=True):
        begin = int(block.ends[d] - block.body.sizes[d])
        out += [(d, s - begin + k) for k in range(n)]
    return sorted(out) == [(d, k) for d, t in enumerate(texts) for k in range(len(symbols(t)) - length + 1)]


@pytest.mark.parametrize("kind,symbols,length,gram", [(passages.Words, brute.words, 4, 2), (passages.Bytes, list, 7, 3), (passages.Bytes, list, 1, 1)])
def test_every_window_is_in_one_run(monkeypatch, kind, symbols, length, gram):
    monkeypatch.setattr(passages, "SLICE", 16)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.choice([0, 3, 20, 70]))) for _ in range(40)]
    table = pa.table({"doc_id": pa.array(range(40), pa.int64()), "text": texts})
    block = passages.Block(table, passages.NOTES_ARROW.empty_table(), passages.Plan(kind, length, gram, 3))
    assert plain_runs(block, [t.encode() if kind is passages.Bytes else t for t in texts], symbols, length)


@pytest.mark.parametrize("hot,many,block_bytes", [(6, 2, 1 << 23), (3, 1, 400), (1 << 40, 32, 300)])
def test_hot_anchors_and_many_blocks(spark, monkeypatch, hot, many, block_bytes):
    """Common passages amid other text, with anchors that count as hot, over many blocks."""
    for name, value in (("HOT", hot), ("MANY", many), ("BLOCK_BYTES", block_bytes)):
        monkeypatch.setattr(passages, name, value)
    rng = random.Random(8)
    common = " ".join(f"c{k}" for k in range(30))
    rows = [(i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 20))) + " " + common[rng.randint(0, 20) :] + " " + " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(9))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_rlz.digests(docs).collect()]) == sorted(brute.word_windows(rows))
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs).collect()]) == sorted(brute.byte_windows(rows))


def test_ids_must_be_integers(spark):
    docs = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    with pytest.raises(TypeError):
        substring_rlz.digests(docs)


def test_grams_and_words():
    v = np.arange(1, 40, dtype=np.uint64)
    for n in (1, 2, 3, 5, 13, 24):
        g = passages.grams(v, n, passages.BASES[0])
        assert len(g) == len(v) - n + 1 and len(np.unique(g)) == len(g)
        assert (passages.grams(v[4:], n, passages.BASES[0]) == g[4:]).all()
    assert len(passages.grams(v[:2], 3, passages.BASES[0])) == 0
    a, b = passages.word_symbols(b"one two\tone"), passages.word_symbols(b"  one")
    assert a[0] == a[2] == b[0] and a[0] != a[1] and len(passages.word_symbols(b" \n")) == 0
    assert passages.least_in(np.array([5, 3, 4, 1, 2], np.uint64), 3).tolist() == [3, 1, 1]
