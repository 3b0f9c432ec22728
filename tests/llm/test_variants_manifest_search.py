"""Spelling variants, the Merkle manifest and top-k search against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from govlake.llm import merkle, queries, spelling, topk_search

# ------------------------------------------------------------------ spelling


def near(a, b):
    """Exactly one code point inserted, deleted or replaced, by trying each."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=5):
    out = []
    form = {}
    near_of = {w: [v for v in counts if v != w and len(w) > 1 and len(v) > 1 and near(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(near_of[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near_of[w]), counts.get(form[w])))
    return sorted(out)


def vocabulary(seed, letters="abé", longest=8, count=300):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(count)}
    words |= {"interc" + "".join(p) for p in itertools.product("xyzñ", repeat=4)}  # one chunk that hundreds share
    return {w: rng.choice([5, 6, 25, 30, 125, 700, 5000]) for w in words}


@pytest.mark.parametrize("seed,meet", [(1, spelling.MEET), (2, 0), (3, 8)])
def test_variants_against_plain_version(spark, seed, meet):
    """Whatever share of the grams counts as hot, the pairs are the same."""
    counts = vocabulary(seed)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("gram", F.lit(1)).repartition(5)
    assert sorted(tuple(r) for r in spelling.variants(words, meet=meet).collect()) == plain_variants(counts)


def test_chains_follow_to_the_end(spark):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb"]
    counts = {w: 5 ** (k + 1) for k, w in enumerate(chain)}
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"bbbbbb"}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


def test_spelling_query_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeats, other letters and columns that clash; every occurrence counts."""
    rng = random.Random(5)
    base = ["Garden", "garden", "GARDÉN", "gardens", "gaÞden", "forêts", "çédilles", "ÀÉÎÕÜß", "a", "×÷times", "wordlong" * 30]
    rows = [(None, " ".join(base * 9)), (1, None), (2, ""), (2, "..."), (3, "Garden1garden_garden-garden")]
    rows += [(i, " ".join(rng.choices(base, k=rng.randint(1, 60)))) for i in range(10, 400)]
    rows += [(500, " ".join(rng.choices(base, k=120_000)))] + [(7, "gardin garden")] * 40
    counts = Counter()
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert len(counts) > 8
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, run int").repartition(6)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op11_spelling_variants(spark, str(tmp_path)).collect())
    assert got == plain_variants(counts)


def test_spelling_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_spelling_variants(spark, str(tmp_path)).collect() == []


# ------------------------------------------------------------------ manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    """Root and, for each leaf, its (left, right) segments from the leaf up."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def plain_manifest(rows):
    """(doc_id, source, lang, n_chars, text) -> rows of the query."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = {}, []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]])
    root, over = plain_tree([trees[g][0] for g in order])
    for g, above in zip(order, over, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            path = path + above
            altered = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            at = plain_leaf([*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])] if altered else r)
            for left, right in path:
                at = sha(left + at + right)
            out.append((r[0], plain_leaf(r), trees[g][0], root, sha("".join(a + b for a, b in path)), at, at == root))
    return sorted(out, key=repr)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows(seed, sizes):
    rng = random.Random(seed)
    return [(rng.randrange(10**6), rng.choice(["s", None, ""]), lang, rng.choice([None, k]), rng.choice([None, "", "Text é", "low", "x" * 50_000 + "Y"])) for lang, n in sizes.items() for k in range(n)]


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 1}, {"en": 9, "": 64, None: 65}, {"en": 1100, "de": 512, "Ä": 513, None: 3} | {f"l{k}": 1 for k in range(9)}])
def test_manifest_against_plain_version(spark, tmp_path, sizes):
    rows = manifest_rows(len(sizes), sizes)
    rows += [rows[0]] * 3 + [(None, None, "en", None, None)] * 2 + [(rows[0][0], "other", rows[0][2], 5, "Same id")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], f"{COLUMNS}, place int, key string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=repr) == plain_manifest(rows)
    assert any(not r[-1] for r in got) or len(rows) < 10


def test_manifest_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_merkle_manifest(spark, str(tmp_path)).collect() == []


def test_any_changed_leaf_changes_the_root(spark):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(600)]
    root = lambda r: merkle.build(spark.createDataFrame(r, COLUMNS)).roots.first().root
    first = root(rows)
    assert root(rows[::-1]) == first
    for k in (0, 511, 599):
        assert root([(*r[:4], r[4] + " ") if i == k else r for i, r in enumerate(rows)]) != first
    assert root(rows[:-1]) != first and root([(*r[:1], None, *r[2:]) if r[0] == 9 else r for r in rows]) != first


# ------------------------------------------------------------------ top k


def plain_top_k(rows, asked, k):
    """Of (id, vector): each of asked (places in rows) with its k best others."""
    good = [(n, i, [int(np.floor(1024 * np.float64(x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, q, v in good:
        if n in asked and q is not None:
            scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i is None, i or 0) for m, i, w in good if m != n and len(w) == len(v))
            out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile,chunk,block,fan", [(topk_search.TILE, topk_search.CHUNK, 256, 16), (2_000, 3_000, 7, 2)])
def test_top_k_against_plain_version(spark, monkeypatch, tile, chunk, block, fan):
    """Small tiles, groups and merges give what large ones do: copies, ties, repeated and null ids, other lengths, bad components."""
    for name, value in (("TILE", tile), ("CHUNK", chunk), ("BLOCK", block), ("FAN", fan)):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(40, 12)).astype(np.float32)
    rows = [(i, vectors[rng.integers(0, 40)].tolist()) for i in range(500)] + [(100, vectors[0].tolist())] * 3 + [(None, vectors[1].tolist()), (200, vectors[2].tolist())]
    rows += [(600, None), (700, []), (701, []), (800, [1.0, None]), (900, [float("nan"), 1.0]), (1000, [float("inf"), 1.0]), (1100, [1.5, -2.5]), (1101, [0.5, 1e-9])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, v string").repartition(3)
    got = topk_search.top_k(table, table.where("vec_id % 100 = 0"), k=10)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_top_k(rows, {n for n, (i, _) in enumerate(rows) if i is not None and i % 100 == 0}, 10)


def test_top_k_beyond_doubles(spark):
    """Where sums pass 2**53 the integers are still exact; beyond a long it is an error."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-(1 << 29), 1 << 29, 5) / 1024).tolist()) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in topk_search.top_k(table, table.where("vec_id % 20 = 0"), k=7).collect()), key=repr)
    assert got == plain_top_k(rows, {0, 20, 40}, 7)
    huge = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        topk_search.top_k(huge, huge).collect()
    with pytest.raises(Exception, match="beyond a long"):
        topk_search.top_k(huge.withColumn("embedding", F.expr("array(1e300D)")), huge).collect()


def test_top_k_of_other_queries_and_empty_tables(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "vec_id int, embedding array<double>")
    assert [tuple(r) for r in topk_search.top_k(table, asked, k=2, scale=1, own=False).orderBy("rank").collect()] == [(9, 1, 4, 4), (9, 2, 3, 3)]
    assert topk_search.top_k(table.limit(0), asked, own=False).collect() == [] and topk_search.top_k(table, asked.limit(0)).collect() == []
    alone = table.where("vec_id = 0")
    assert topk_search.top_k(alone, alone).collect() == []
