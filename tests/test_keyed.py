"""Keyed tables: upserts by bucket, late and repeated batches, the first writer's names."""

import os

import pytest

from govlake.operators import catalog, graph
from govlake.sources import keyed

SCHEMA = "k string, seq long, v string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(spark, *r):
    return spark.createDataFrame(list(r), "k string, seq long, v string")


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    t = keyed.create(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=16)
    assert t.read().count() == 0 and t.upsert(rows(spark)) == []
    t.upsert(rows(spark, *[(f"k{i}", 1, "a") for i in range(200)]))
    before = files(t.path)
    touched = t.upsert(rows(spark, ("k3", 2, "b"), ("k3", 3, "c"), ("k3", 0, "late"), ("new", 1, "n")))
    after = files(t.path)
    assert 1 <= len(touched) <= 2
    for f, at in before.items():
        kept = f"_bucket={os.path.dirname(f).rpartition('=')[2]}"
        assert (after.get(f) == at) == (int(kept.removeprefix("_bucket=")) not in touched)
    assert t.read().count() == 201 and t.get("k3").collect()[0].v == "c" and t.get("gone").collect() == []
    plan = t.get("k3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan


def test_late_repeated_and_null_rows(spark, tmp_path):
    t = keyed.create(spark, str(tmp_path / "t"), SCHEMA, ["k"], buckets=4)
    batches = [rows(spark, ("a", 5, "five"), (None, 1, "null key")), rows(spark, ("a", 4, "four"), ("a", None, "no seq")), rows(spark, ("a", 5, "five again"), (None, 2, None))]
    for b in [*batches, batches[1], batches[2]]:
        t.upsert(b)
    assert {tuple(r) for r in t.read().collect()} == {("a", 5, "five again"), (None, 2, None)}
    first = keyed.create(spark, str(tmp_path / "f"), SCHEMA, ["k"], buckets=4, keep="first")
    for b in batches[::-1]:
        first.upsert(b)
    assert {tuple(r) for r in first.read().collect()} == {("a", 4, "four"), (None, 1, "null key")}
    narrow = rows(spark, ("b", 1, "x")).drop("v")
    first.upsert(narrow)
    assert first.get("b").first().v is None


def test_layout_is_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(spark, path, SCHEMA, ["k"], buckets=4).upsert(rows(spark, ("a", 1, "x")))
    assert keyed.open_table(spark, path).read().count() == 1 and keyed.create(spark, path, SCHEMA, ["k"], buckets=4).buckets == 4
    for other in ({"buckets": 8}, {"keep": "first", "buckets": 4}):
        with pytest.raises(ValueError):
            keyed.create(spark, path, SCHEMA, ["k"], **other)
    with pytest.raises(ValueError):
        keyed.create(spark, path, SCHEMA, ["k"], keep="any")


def test_names_are_the_first_writers_for_good(spark, tmp_path):
    g = graph.store(spark, str(tmp_path / "g"), 4)
    e = lambda *r: spark.createDataFrame(list(r), "id string, label string, aliases array<string>, seq long")
    graph.upsert_entities(g, e(("b", "Shared", ["old"], 2)))
    graph.upsert_entities(g, e(("c", " shared ", None, 3), ("b", "Renamed", [], 4)))
    graph.upsert_entities(g, e(("a", "OLD", ["Late"], 9), ("z", None, ["late"], 9)))
    assert {r.token: r.id for r in g.aliases.read().collect()} == {"b": "b", "shared": "b", "old": "b", "c": "c", "renamed": "b", "a": "a", "late": "a", "z": "z"}
    assert {r.id: r.label for r in g.entities.read().collect()} == {"a": "OLD", "b": "Renamed", "c": " shared ", "z": None}
    known = graph.resolve(spark.createDataFrame([("Shared",), ("none",)], "mention string"), g.aliases.read()).collect()
    assert {r.mention: r.resolved for r in known} == {"Shared": "b", "none": "none"}


def test_registering_a_dataset_again_replaces_it(spark, tmp_path):
    t = catalog.registry(spark, str(tmp_path / "c"), 4)
    for seq, title in ((1, "first"), (3, "third"), (2, "second")):
        t.upsert(spark.createDataFrame([("d/x", "x", title, ["t"], seq)], "id string, name string, title string, tags array<string>, seq long"))
    assert [(r.title, r.seq, r.tags) for r in t.get("d/x").collect()] == [("third", 3, ["t"])] and t.read().count() == 1
