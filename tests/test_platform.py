"""Topics with offsets, columns of mixed kinds, the overview from daily partials, roll-ups at several levels."""

import datetime

import pytest
from pyspark.sql import functions as F

from govlake.operators import carbon, models, overview, privacy
from govlake.sources import mixed
from govlake.streaming.topics import Topic


def test_polls_are_exact_and_groups_have_their_own_cursor(spark, tmp_path):
    topic = Topic(spark, str(tmp_path / "t"))
    send = lambda lo, hi: topic.produce(spark.range(lo, hi).select("id", F.lit("k").alias("key"), F.col("id").cast("string").alias("value"), F.create_map(F.lit("n"), F.col("id").cast("string")).alias("headers")).repartition(3), ["id"])
    assert len(topic.poll("early", 5)) == 0
    assert send(0, 10) == (0, 10) and send(10, 25) == (10, 25)
    got = [topic.poll("a", 7) for _ in range(5)]
    assert [len(p) for p in got] == [7, 7, 7, 4, 0]
    assert [r.value for p in got for r in p.rows.orderBy("offset").collect()] == [str(i) for i in range(25)]
    assert got[1].rows.orderBy("offset").first().headers == {"n": "7"}
    kept = topic.poll("b", 3, advance=False)
    assert (kept.start, kept.end) == (0, 3) and topic.poll("b", 4).end == 4 and topic.poll("b", 100).start == 4
    topic.seek("b", 20)
    assert topic.poll("b", 100).rows.count() == 5
    seen = []
    assert topic.drain("c", lambda df: seen.append(df.count()), 10) == 25 and seen == [10, 10, 5]
    assert topic.produce(spark.createDataFrame([("x", None)], "key string, value string"), ["key"]) == (25, 26)
    assert topic.poll("a", 9).rows.first().headers is None
    plan = topic.read(12, 15)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_start" in plan and "GreaterThanOrEqual(offset,12)" in plan
    for bad in (("", 1), ("a", 0)):
        with pytest.raises(ValueError):
            topic.poll(*bad)


def test_a_failed_batch_is_overwritten(spark, tmp_path):
    topic = Topic(spark, str(tmp_path / "t"))
    spark.range(5).select(F.col("id").alias("offset")).write.parquet(f"{tmp_path}/t/log/_start=0")  # what a producer left that died before it moved the end
    assert topic.poll("a", 9).rows.count() == 0
    topic.produce(spark.createDataFrame([("k", "v")], "key string, value string"), ["key"])
    assert [(r.offset, r.value) for r in topic.poll("a", 9).rows.collect()] == [(0, "v")]


def test_mixed_fields_become_text_without_loss(spark):
    rows = ['{"k": 1, "x": true, "d": 1, "n": {"a": 1}, "a.b": "p", "q\'s": 1}', '{"k": "two", "d": 2.5, "n": null, "a.b": "r"}', "not json", "[1, 2]", "7", None, '{"k": {"deep": [1, "é"]}}', "{}"]
    got = mixed.settle(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string").repartition(3), "v", ("i",))
    kinds = dict(got.dtypes)
    assert kinds["k"] == "string" and kinds["x"] == "boolean" and kinds["d"].startswith("decimal") and kinds["n"] == "string" and kinds["q's"] == "bigint"
    by = {r.i: r for r in got.collect()}
    assert [by[i].k for i in (0, 1, 2, 3, 4, 5, 6, 7)] == ["1", "two", None, None, None, None, '{"deep":[1,"é"]}', None]
    odd = mixed.settle(spark.createDataFrame([('{"a\'\\"b": 1, "c d": 2}',)], "v string"), "v").first()
    assert odd["a'\"b"] == 1 and odd["c d"] == 2
    assert by[0]["a.b"] == "p" and by[0].n == '{"a":1}' and float(by[1].d) == 2.5
    none = mixed.settle(spark.createDataFrame([("x",)], "v string"), "v")
    assert none.columns == [] and none.count() == 1


def test_text_columns_take_the_type_that_holds_all(spark):
    df = spark.createDataFrame([("1", "1", "true", "x", None, "1"), ("2", "2.5", "false", "1", None, ""), (None, "3", None, None, None, "2")], "a string, b string, c string, d string, e string, f string")
    kinds = dict(mixed.widen(df, df.columns).dtypes)
    assert kinds["a"] == "bigint" and kinds["b"].startswith("decimal") and kinds["c"] == "boolean" and kinds["d"] == kinds["e"] == kinds["f"] == "string"


def test_days_loaded_again_are_replaced(spark, tmp_path):
    log = lambda rows: spark.createDataFrame([(datetime.datetime(2024, 1, d, 5), 1 << 30, "eu-north", ms, s) for d, ms, s in rows], "at timestamp, bytes long, region string, ms long, status string")
    p = overview.store(spark, str(tmp_path / "p"))
    overview.load(p, log([(1, m, "ok") for m in range(100)]), 1)
    overview.load(p, log([(2, 500, "denied")]), 2)
    assert overview.p95(p).first().p95_ms == 95
    overview.load(p, log([(1, 7, "ok"), (1, 8, "denied")]), 3)
    one = overview.p95(p).first()
    assert (one.p95_ms, one.queries) == (500, 3) and {str(r.day): r.p95_ms for r in overview.p95(p, ["day"]).collect()} == {"2024-01-01": 8, "2024-01-02": 500}
    catalog = spark.createDataFrame([("a", "d1", 5, 0.5, 2), ("b", "d2", 7, 1.0, 0)], "id string, domain string, row_count long, quality double, pii_fields int")
    edges = spark.createDataFrame([("raw", "a")], "src string, dst string")
    r = overview.overview(catalog, edges, p, F.lit("2024-01-01").cast("date")).first()
    assert (r.datasets, r.domains, r.rows_indexed, r.quality_avg, r.pii_protected, r.coverage, r.queries, r.queries_today, r.denied, r.p95_ms) == (2, 2, 12, 0.75, 2, 0.5, 3, 2, 2, 500)
    empty = overview.store(spark, str(tmp_path / "e"))
    r = overview.overview(catalog.limit(0), edges, empty, F.current_date()).first()
    assert (r.datasets, r.queries, r.p95_ms, r.quality_avg) == (0, 0, None, 0.0)


def test_levels_are_one_scan(spark):
    feeds = spark.createDataFrame([("streaming", "a", 5, True), ("batch", "a", 7, False), ("batch", "b", 1, True)], "modality string, domain string, per_minute long, within boolean")
    got = {(r.level, r.modality, r.domain): (r.feeds, r.per_minute, r.slo_share, r.attention) for r in carbon.feed_board(feeds).collect()}
    assert got["total", None, None] == (3, 13, 0.6667, 1) and got["modality", "batch", None] == (2, 8, 0.5, 1) and got["domain", None, "a"] == (2, 12, 0.5, 1) and len(got) == 5
    plan = carbon.feed_board(feeds)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and "Union" not in plan and "Join" not in plan


def test_two_classifications_fail_closed(spark):
    make = lambda *r: spark.createDataFrame(list(r), "column string, pii boolean, sensitivity string")
    got = {r.column: (r.pii, r.sensitivity) for r in privacy.merge_classes(make(("a", False, "internal"), ("b", True, "pii"), ("c", None, "odd")), make(("a", True, "phi"), ("b", False, "public"), ("d", False, None))).collect()}
    assert got == {"a": (True, "phi"), "b": (True, "pii"), "c": (True, "restricted"), "d": (False, "restricted")}


def test_identifiers_are_refused_and_the_list_is_a_parameter():
    for name in ("email", "National_ID", "applicant_name"):
        with pytest.raises(ValueError):
            models.refuse_protected(["income", name])
    models.refuse_protected(["email"], protected=["salary"])
    with pytest.raises(ValueError):
        models.refuse_protected(["Salary"], protected=["salary"])
