"""Sinks of cleaned data. Landing twice gives two snapshots with a parent, one edge and one catalog row."""

import json

import pytest
from pyspark.sql import functions as F

from govlake.operators import clean, profile
from govlake.sources import tables
from govlake.sources.landing import Landings


def test_landing_twice(spark, tmp_path):
    store = Landings(spark, str(tmp_path / "l"))
    assert store.catalog().count() == 0 and store.edges().count() == 0
    people = spark.createDataFrame([(1, "a@b.co", None), (2, "c@d.org", "x")], "id int, email string, note string")
    at = lambda s: F.lit(s).cast("timestamp")
    first = store.land(people, "hr", "people", "ann", "csv:people", at=at("2024-01-01 00:00:00"))
    second = store.land(people.unionByName(people.withColumn("id", F.col("id") + 2)), "hr", "people", "ann", "csv:people", at=at("2024-01-02 00:00:00"))
    third = store.land(people.unionByName(people.withColumn("id", F.col("id") + 2)).repartition(3), "hr", "people", "bob", "csv:people", at=at("2024-01-03 00:00:00"))
    assert [(r.snapshot_id, r.parent_id, r.rows, r.changed) for r in store.snapshots().orderBy("at").collect()] == [(first, None, 2, True), (second, first, 4, True), (third, second, 4, False)]
    assert [(r.src, r.dst, r.operation, r.runs) for r in store.edges().collect()] == [("csv:people", "hr/people", "clean", 3)]
    c = store.catalog().collect()
    assert len(c) == 1 and (c[0].id, c[0].version, c[0].row_count, c[0].pii_fields, c[0].sensitivity) == ("hr/people", 3, 4, 1, "pii") and c[0].quality == pytest.approx(1 - 2 / 12, abs=1e-4)
    assert store.read("hr/people").count() == 4 and store.read("hr/people", first).count() == 2
    store.land(store.read("hr/people").select("id"), "hr", "ids", "ann", "hr/people", "derive")
    nodes, edges = store.lineage()
    assert {r.node: r.kind for r in nodes.collect()} == {"csv:people": "source", "hr/people": "dataset", "hr/ids": "dataset"} and edges.count() == 2
    with pytest.raises(LookupError):
        store.read("hr/none")


def test_a_landing_that_fails_leaves_no_event(spark, tmp_path):
    store = Landings(spark, str(tmp_path / "l"))
    bad = spark.range(3).select(F.expr("1 / (id - 1)").alias("x"))
    with pytest.raises(Exception):  # noqa: B017
        store.land(bad, "d", "n", "me", "src")
    assert store.events().count() == 0 and store.catalog().count() == 0
    store.land(spark.range(0), "d", "none", "me", "src")
    assert store.catalog().first().row_count == 0 and store.read("d/none").count() == 0


def test_cleaned_data_goes_to_parquet_csv_and_a_report(spark, tmp_path):
    df = spark.createDataFrame([(1, " a,b ", ["x"]), (2, "", None), (3, None, ["y", 'q"']), (4, 'say "hi"\nthere', [])], "id int, `t.x` string, l array<string>")
    done = clean.apply_plan(df, [clean.Step("trim"), clean.Step("odd")])
    done.data.count()
    paths = tables.write_cleaned(done.data, str(tmp_path), "c", profile.assess(df.select("id")), done.audit())
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths["csv"])
    assert {r.id: (r["t.x"], r.l) for r in back.collect()} == {"1": ("a,b", '["x"]'), "2": (None, None), "3": (None, '["y","q\\""]'), "4": ('say "hi"\nthere', "[]")}
    lines = {r.value for r in spark.read.text(paths["csv"]).collect()}
    assert '2,"",' in lines and any(x.startswith("3,,") for x in lines)  # an empty text and a null
    assert spark.read.parquet(paths["parquet"]).count() == 4
    report = [(r.kind, json.loads(r.facts)) for r in spark.read.json(paths["report"]).collect()]
    assert {f["op"] for k, f in report if k == "step"} == {"trim", "odd"} and [f["column"] for k, f in report if k == "column"] == ["id"]
