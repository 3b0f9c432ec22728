"""The parity-sketch join and embedding near-dedup against plain versions."""

import random

import numpy as np
import pytest

from govlake.llm import common, embedding_dedup, parity_join

from . import brute


def made(seed):
    rng = random.Random(seed)
    base = [str(rng.randint(0, 99)) for _ in range(60)]
    rows = [(None, "a b c d e"), (1, None), (2, ""), (3, "A b C d e f"), (4, "a B c d e f"), (5, "a b"), (6, "a  b"), (6, "x y z"), (7, "x\ty z"), (8, " \n"), (8, " \n"), (9, "Ä b c d e"), (10, "ä b c d e")]
    for k in range(80):
        w = list(base)
        for _ in range(k // 12):
            w[rng.randrange(60)] = f"q{rng.randint(0, 9)}"
        rows.append((100 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize("words,similarity,each", [(4, 85, 4), (5, 80, 0)])
def test_components_against_plain_version(spark, monkeypatch, words, similarity, each):
    monkeypatch.setattr(parity_join, "PAIRS_EACH", each)
    monkeypatch.setattr(parity_join, "TILE", 30 if each else 1024)
    rows = made(words)
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component string").repartition(5)
    assert sorted([tuple(r) for r in parity_join.components(docs, words, similarity).collect()], key=repr) == brute.jaccard_components(rows, words, similarity)
    kept = parity_join.dedup(docs, words, similarity)
    assert kept.columns == docs.columns and kept.where("doc_id = 4").count() == 0 and kept.where("doc_id IS NULL").count() == 1
    assert parity_join.components(docs.limit(0), words, similarity).count() == 0


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in parity_join.components(docs, 4, 85).collect()], key=repr) == brute.jaccard_components(rows, 4, 85)


def test_pigeonhole_never_misses():
    """Any two sets at the threshold share a key, whatever their sizes."""
    rng = np.random.default_rng(1)
    for similarity in (80, 85):
        bands = parity_join.Bands(similarity)
        for size in [*range(6, 60), 97, 200, 701, 1500]:
            a = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
            for _ in range(6):
                most = bands.most_different(2 * len(a))
                gone, new = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
                b = np.unique(np.r_[rng.permutation(a)[: len(a) - gone], rng.integers(1, 1 << 62, new).astype(np.uint64)])
                if parity_join.similar(a, b, similarity) and len(np.setxor1d(a, b)):
                    (x, s), (y, t) = bands.keys(a), bands.keys(b)
                    both = np.intersect1d(x, y)
                    # in some band, both share as many keys as either asks for
                    assert any(len(np.intersect1d(x[s % 4 == odd], y[t % 4 == odd])) >= max(s[s % 4 == odd].max(), t[t % 4 == odd].max()) >> 2 for odd in set((s % 4).tolist()) & set((t % 4).tolist()) if len(both))
                    width = parity_join._width(max(len(a), len(b)))
                    near = np.bitwise_count(parity_join.parity(a, width) ^ parity_join.parity(b, width)).sum()
                    assert near <= len(np.setxor1d(a, b)) <= bands.most_different(len(a) + len(b))


def test_chain_of_near_copies_is_one_component(spark):
    rows = []
    for k in range(40):
        w = [f"w{i}" for i in range(120)]
        w[: 3 * k] = [f"v{i}" for i in range(3 * k)]
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in parity_join.components(docs, 4, 85).collect()], key=repr) == brute.jaccard_components(rows, 4, 85)


def test_long_path_contracts(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (950, 950)], "src long, dst long")
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}


def vectors(seed=3, n=600):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 32))
    x[100:220] = x[0] + 0.09 * rng.standard_normal((120, 32))
    for k in range(220, 300):
        x[k] = x[k - 200] + 0.15 * rng.standard_normal(32)
    return x.astype(np.float32)


def test_embeddings_against_plain_version(spark):
    x = vectors()
    rows = [(i, x[i].tolist(), i % 2 if i >= 300 else 0) for i in range(len(x))]
    rows += [(1000, None, 0), (1001, [0.0] * 32, 0), (1002, [float("nan")] * 32, 0), (1003, x[0].tolist(), None), (1004, [float("inf")] + [1.0] * 31, 0), (1005, [1.0, None], 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0), (1008, [], 0)]
    df = spark.createDataFrame([(*r, "h") for r in rows], "vec_id long, embedding array<float>, label int, hash string").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[: len(x)]])
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    while True:
        new = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    assert near.sum() > 1000
    found = sum(min(got[i][0], near[i].sum()) for i in range(len(x)))
    assert found >= 0.99 * near.sum() and all(got[i][0] <= near[i].sum() for i in range(len(x)))
    assert sum(got[i][1] == comp[i] for i in range(len(x))) >= 0.99 * len(x)
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1008):
        assert got[i] == (0, i, True)
    assert got[1006] == (1, 1006, True) and got[1007] == (1, 1006, False)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_double_precision_at_the_threshold_and_at_the_ends(spark):
    below = [0.9799999996, float(np.sqrt(1 - 0.9799999996**2))]
    above = [0.9800000004, float(np.sqrt(1 - 0.9800000004**2))]
    rows = [(1, [1.0, 0.0], 0), (2, below, 0), (3, [1.0, 0.0], 1), (4, above, 1), (5, [1e-60, 0.0], 2), (6, [1e-60, 0.0], 2), (7, [1e200, 1.0], 3), (8, [1e200, 1.0], 3), (9, [1e-320, 1e-320], 4), (10, [1.0, 1.0], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 7), 9: (1, 9), 10: (1, 9)}


def test_tiles_of_a_component_larger_than_one(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 50)
    x = vectors()
    df = spark.createDataFrame([(i, x[i].tolist(), 0) for i in range(300)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    u = x[:300].astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    assert sum(got.values()) >= 0.99 * near.sum() and all(got[i] <= near[i].sum() for i in got)


def test_groups_keep_every_open_pair(spark):
    """Any two documents of different components under a key meet in a group, whether its cluster is taken whole or by keys."""
    rng = random.Random(7)
    same = [(i, [rng.randint(1, 5) for _ in range(4)]) for i in range(12)]  # few keys, many documents: a cluster
    chain = [(100 + i, [1000 + i, 1001 + i, 1002 + i]) for i in range(30)]  # keys of three documents in a row: by keys
    rows = [(i, sorted(set(k))) for i, k in same + chain] + [(200, [9]), (201, [9]), (300, [8]), (301, [8]), (302, [8])]
    component = {i: i - i % 2 for i, _ in rows[:-3]} | {300: 300, 301: 300, 302: 300}
    kept = spark.createDataFrame(rows, "id long, keys array<long>")
    found = spark.createDataFrame([(i, c) for i, c in component.items() if i != 100], "node long, component long")
    got = [tuple(r) for r in parity_join.open_groups(kept, found).select("key", "id", "component", "size").collect()]
    members = {}
    for key, i, c, size in got:
        assert c == component[i]
        members.setdefault(key, []).append(i)
    assert all(size == len(members[key]) == len(set(members[key])) for key, _, _, size in got)
    met = {(a, b) for ids in members.values() for a in ids for b in ids}
    sizes = {k: sum(k in keys for _, keys in rows) for _, keys in rows for k in keys}
    for a, keys in rows:
        for b, others in rows:
            if component[a] != component[b] and any(sizes[k] > 2 for k in set(keys) & set(others)):
                assert (a, b) in met
    assert not {200, 201, 300, 301, 302} & {i for ids in members.values() for i in ids}
    assert sorted(len(v) for v in members.values())[-1] == 12 and sum(len(v) == 3 for v in members.values()) >= 20
