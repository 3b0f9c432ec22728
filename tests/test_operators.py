"""Edge cases of the governance operators on small inputs."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlake.functions import text as X
from govlake.operators import access, carbon, clean, export, graph, lineage, models, privacy, profile, provenance, quality, quantiles
from govlake.plans import governed, onboard
from govlake.sources import readers, tables
from govlake.streaming import ingest

DIRTY = """id,customer,email,amount,weight,country,joined
1, Ann ,ann@example.com,10.5,90 KG,France,2021-01-05
2,Bob,bob@example.com,,80 KG,france,2021-02-05
3,Cy,cy@example.com,30.25,70 KG,FRANCE,2021-03-05
4,Di,di@example.com,NA,60 KG,Spain,2021-04-05
5,Ed,ed@example.com,12,50 KG,Spain,2021-05-05
6,Flo,flo@example.com,14.5,40 KG,Spain,2021-06-05
6,Flo,flo@example.com,14.5,40 KG,Spain,2021-06-05
"""


@pytest.fixture
def dirty(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text(DIRTY)
    return str(path)


def test_csv_is_text_and_blank_is_empty(spark, dirty):
    df = readers.read(spark, dirty)
    assert {t for _, t in df.dtypes} == {"string"} and df.count() == 7
    assert df.where("id = '2'").first().amount == ""
    rows, facts = readers.limited(df, 3)
    assert rows.count() == 3 and facts.first().row_estimate == 7 and facts.first().truncated


def test_assessment_and_plan(spark, dirty):
    df = readers.read(spark, dirty)
    p = {r.column: r for r in profile.assess(df).collect()}
    assert p["id"].inferred_type == "int" and p["amount"].inferred_type == "double" and p["joined"].inferred_type == "date"
    assert p["weight"].embedded_unit == "KG" and p["country"].mixed_case and p["email"].pii and p["email"].top_values is None
    assert profile.duplicate_rows(df).first().duplicates == 1
    plan = clean.derive_plan(profile.assess(df))
    assert [s.op for s in plan] == ["trim", "empty_to_null", "standardize_case", "normalize_category", "split_unit", "coerce_type", "dedupe_rows"]
    done = clean.apply_plan(df, plan)
    assert done.data.count() == 6
    kinds = dict(done.data.dtypes)
    assert kinds["id"] == "bigint" and kinds["amount"] == "double" and kinds["weight_value"] == "double" and kinds["joined"] == "date"
    audit = {a["op"]: a for a in done.audit()}
    assert audit["trim"]["cells_changed"] == 1 and audit["empty_to_null"]["cells_changed"] == 2
    assert audit["split_unit"]["removed"] == ["weight"]


def test_unknown_step_is_noted(spark):
    done = clean.apply_plan(spark.createDataFrame([(" a",)], "x string"), [clean.Step("no_such"), clean.Step("trim", ("x",))])
    assert done.data.first().x == "a" and "skipped" in done.notes[0]["note"]


def test_null_is_not_empty(spark):
    df = spark.createDataFrame([("",), (None,), ("x",)], "c string")
    assert clean.dedupe_rows(df).count() == 3 and profile.duplicate_rows(df).first().duplicates == 0


def test_all_null_columns_go_and_rows_stay(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "a string, b int")
    left = clean.drop_empty_columns(df)
    assert left.columns == [] and left.count() == 2 and clean.score(left).first().score == 0.0
    assert clean.score(df.limit(0)).first().score == 1.0


@pytest.mark.parametrize("value,want", [("o'neil mc-fly", "O'Neil Mc-Fly"), ("a1b", "A1B"), ("ÉCOLE été", "École Été"), ("", ""), (None, None)])
def test_title(spark, value, want):
    assert spark.createDataFrame([(value,)], "x string").select(X.title(F.col("x")).alias("y")).first().y == want


def test_impute_rounds_half_even_and_skips_misfits(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, None)], "n int, s string")
    assert clean.impute(df, ["n"], "mean").where("n = 2").count() == 2  # 1.5 rounds to 2
    assert clean.impute(df, ["n"], "constant", "no number").where("n IS NULL").count() == 1
    assert clean.impute(df, ["s"], "mode").where("s = 'a'").count() == 3


def test_outliers_need_four_values_and_a_spread(spark):
    few = spark.createDataFrame([(1.0,), (2.0,), (99.0,)], "x double")
    flat = spark.createDataFrame([(1.0,)] * 5 + [(9.0,)], "x double")
    for df in (few, flat):
        assert clean.flag_outliers(df).where("x__outlier").count() == 0
    many = spark.createDataFrame([(float(i),) for i in range(20)] + [(500.0,), (None,)], "x double")
    assert clean.flag_outliers(many).where("x__outlier").count() == 1 and clean.clip_outliers(many).agg(F.max("x")).first()[0] < 500


def test_unique_counts_nulls_and_missing_field_fails(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    rules = [quality.Rule("u", "unique", "k"), quality.Rule("m", "not_null", "gone"), quality.Rule("x", "odd", "k")]
    got = {r.rule_id: r for r in quality.evaluate(df, rules).collect()}
    assert got["u"].violations == 2 and not got["m"].passed and got["x"].passed
    assert quality.gate({"a": quality.evaluate(df, rules)}).first().ok is False


def test_masks_guard_and_noise(spark):
    df = spark.createDataFrame([(1, "a@b.co"), (2, None)], "id int, email string")
    masked = privacy.mask(df, ["email"]).orderBy("id").collect()
    assert len(masked[0].email) == 16 and masked[1].email is None
    grant = governed.Grant(masked={"t": ["email"]})
    with pytest.raises(PermissionError):
        governed.run(spark, "SELECT email FROM {t}", {"t": df}, grant)
    assert governed.run(spark, "SELECT email AS e FROM {t} WHERE id = 1", {"t": df}, grant).first().e == masked[0].email
    with pytest.raises(PermissionError):
        privacy.aggregate_only(df)
    counts = spark.createDataFrame([(i, 4000) for i in range(400)], "g int, n long")
    a, b = (privacy.differential_privacy(counts, ["n"], 1.0, seed=s).orderBy("g").collect() for s in (1, 1))
    assert a == b and all(abs(r.n - 4000) < 200 for r in a) and len({r.n for r in a}) > 3
    assert abs(sum(r.n for r in a) / 400 - 4000) < 1


def test_guards_and_globs(spark):
    rows = spark.createDataFrame([(("EU",), 5), (("US",), None)], "principal struct<region string>, rows int")
    assert [r[0] for r in rows.select(access.guard("principal.region == 'EU' and rows > 3")).collect()] == [True, False]
    ask = lambda g: [r[0] for r in rows.select(access.guard(g)).collect()]
    assert ask('principal.region in ["EU", "CH"]') == [True, False] and ask("not (principal.region in ['EU'])") == [False, True]
    assert ask('principal.region != "a==b"') == [True, True] and ask("rows >= 5 or rows == 7") == [True, False] and ask('principal.region == "it\'s"') == [False, False]
    for bad in ("reflect('java.lang.System', 'exit', 1)", "rows; drop", "`rows` > 1", "rows > (select 1)"):
        with pytest.raises(Exception):  # noqa: B017
            ask(bad)
    globs = spark.createDataFrame([("loan*", "loans"), ("l?n", "loan"), ("a.b", "axb")], "g string, n string")
    assert [r[0] for r in globs.select(F.rlike("n", access.glob(F.col("g")))).collect()] == [True, False, False]


def test_strict_scan_takes_dates_for_phones(spark):
    df = spark.createDataFrame([("2021-01-05 10:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert not privacy.classify(df).first().pii and privacy.classify(df, strict=True).first().pii


def test_walks_stop_at_depth_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "start string")
    assert {(r.node, r.distance) for r in graph.walk(edges, start, 1).collect()} == {("b", 1), ("c", 1)}
    assert {r.node for r in graph.walk(edges, start, 5, "down").collect()} == {"b", "c", "d"}
    tree = spark.createDataFrame([("s", "m"), ("m", "t"), ("s", "t")], "src string, dst string")
    assert {r.node: r.depth for r in lineage.depths(tree).collect()} == {"s": 0, "m": 1, "t": 2}
    assert {r.node: r.kind for r in lineage.nodes(tree).collect()} == {"s": "source", "m": "step", "t": "sink"}


def test_verdicts_and_tampering(spark):
    key = b"k"
    assets = spark.createDataFrame([("payload one",), ("payload two",)], "payload string").withColumn("checksum", F.sha2("payload", 256)).withColumn("signature", provenance.sign(F.col("payload"), key))
    assert provenance.verify(assets, key).where("valid").count() == 2
    broken = assets.withColumn("payload", F.concat("payload", F.lit("!")))
    assert provenance.verify(broken, key).where("valid").count() == 0
    twice = spark.createDataFrame([(1,), (1,)], "x int")
    once = spark.createDataFrame([(1,)], "x int")
    assert provenance.digest(twice).first().digest != provenance.digest(once).first().digest
    left, right = (spark.createDataFrame([r], "a string, b string") for r in ((None, "v"), ("v", None)))
    assert provenance.digest(left).first().digest != provenance.digest(right).first().digest


@pytest.mark.parametrize("key", [b"", b"k", b"x" * 64, b"y" * 200])
def test_signatures_are_hmac(spark, key):
    import hashlib
    import hmac

    texts = ["", "payload", "é" * 100, None]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(provenance.sign(F.col("t"), key).alias("s")).collect()]
    assert got == [None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_numbers_are_read_as_written(spark):
    rows = spark.createDataFrame([("12f",), ("7d",), (" 1.5 ",), ("-2e3",), ("nan",)], "t string")
    assert [r[0] for r in rows.select(X.coerce(F.col("t"), "double")).collect()] == [None, None, 1.5, -2000.0, None]
    got = profile.counts(rows).first()
    assert got.numbers == 2 and got.distinct_count == 4


def test_index_is_dense_over_few_partitions(spark):
    rows = spark.range(50_000).select((F.col("id") * 7919 % 50_021).alias("k"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for _ in range(3):
            got = export.numbered(rows, ["k"], "i").agg(F.count_distinct("i"), F.min("i"), F.max("i")).first()
            assert tuple(got) == (50_000, 0, 49_999)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rules_that_raise_fail_alone(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    rules = [quality.Rule("r", "range", "x", {"min": 0}), quality.Rule("e", "enum", "y", {}), quality.Rule("c", "custom", "x", {"violations": F.sum("nowhere")})]
    assert {r.rule_id: r.passed for r in quality.evaluate(df, rules).collect()} == {"r": True, "e": False, "c": False}


def test_noise_is_on_all_numbers_and_fresh(spark):
    df = spark.createDataFrame([("a", 10, 2.0)], "g string, n int, x double")
    sql = "SELECT g, n, x FROM {t}"
    draws = {tuple(governed.run(spark, sql, {"t": df}, governed.Grant(epsilon=0.1)).first()) for _ in range(3)}
    assert len(draws) == 3 and all(d[2] != 2.0 for d in draws)
    with pytest.raises(PermissionError):
        governed.run(spark, "SELECT g FROM {t}", {"t": df}, governed.Grant(epsilon=0.1))


def test_governed_query_spends_logs_and_refuses(spark, tmp_path):
    people = spark.createDataFrame([(i, f"p{i}", i % 2) for i in range(10)], "id int, name string, g int")
    datasets = spark.createDataFrame([("people", "hr", "people", "boss", "EU", "EU", False, ["name"], True)], "dataset string, domain string, name string, owner string, code string, place string, residency_required boolean, pii_fields array<string>, sensitive boolean")
    policies = spark.createDataFrame([], "id string, position int, domain string, datasets array<string>, actions array<string>, roles array<string>, effect string, obligations array<string>")
    ask = lambda sql, who="ann", action="query": governed.query(spark, who, ["reader"], "EU", sql, {"people": people}, datasets, policies, str(tmp_path), action=action, budget=0.25)
    count = "SELECT g, count(*) AS n FROM {people} GROUP BY g"
    assert ask(count).count() == 2 and ask(count).count() == 2
    for sql, action in ((count, "query"), ("SELECT name FROM {people}", "query"), (count, "read")):
        with pytest.raises(PermissionError):
            ask(sql, action=action)
    assert ask(count, who="bob").count() == 2
    log = spark.read.parquet(f"{tmp_path}/log")
    assert {(r.subject, r.status): r.n for r in log.groupBy("subject", "status").agg(F.count(F.lit(1)).alias("n")).collect()} == {("ann", "ok"): 2, ("ann", "denied"): 3, ("bob", "ok"): 1}
    spent = {r.subject: r.spent for r in privacy.budgets(spark.read.parquet(f"{tmp_path}/ledger"), 0.25).collect()}
    assert spent == {"ann": pytest.approx(0.2), "bob": pytest.approx(0.1)}


def test_forecasts_of_one_value(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 10.0), ("b", 2, 400.0)], "k string, t int, v double")
    got = {(r.k, r.step): r.forecast for r in models.forecast_trend(df, "v", ["k"], ["t"], 2).collect()}
    assert got == {("a", 1): 5.0, ("a", 2): 5.0, ("b", 1): 180.0, ("b", 2): 180.0}
    with pytest.raises(ValueError):
        models.refuse_protected(["Gender"])


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": "two"}]))
    (tmp_path / "b.ndjson").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    (tmp_path / "d.tsv").write_text("a\tb\n1\t\n")
    assert dict(readers.read(spark, str(tmp_path / "a.json")).dtypes)["x"] == "string"
    assert readers.read(spark, str(tmp_path / "b.ndjson")).count() == 2
    assert json.loads(readers.read(spark, str(tmp_path / "c.geojson")).first().geometry)["type"] == "Point"
    assert readers.read(spark, str(tmp_path / "d.tsv")).first().b == ""
    with pytest.raises(ValueError):
        readers.read(spark, "x.odd")
    typed = readers.conform(readers.read(spark, str(tmp_path / "d.tsv")), T.StructType([T.StructField("a", T.IntegerType()), T.StructField("z", T.DoubleType())]))
    assert typed.first().a == 1 and typed.first().z is None
    urls = spark.createDataFrame([("postgresql://u:p@h/db?password=x&a=1",)], "u string")
    assert urls.select(X.redact_url(F.col("u"))).first()[0] == "postgresql://***@h/db?password=***&a=1"


def test_tables(spark, tmp_path):
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    assert tables.write(df, str(tmp_path / "t"), "overwrite", ["p"]) == 10
    assert tables.byte_size(spark, str(tmp_path / "t")).first().bytes > 0
    assert tables.scan(spark.read.parquet(str(tmp_path / "t")), ["id"], "p = 1").count() == 5
    name = tables.create(spark, "d1", "t1", T.StructType([T.StructField("id", T.LongType()), T.StructField("w", T.StringType())]))
    tables.append(df, "d1.t1")
    assert spark.sql(f"SELECT count(*) FROM {name} WHERE w IS NULL").first()[0] == 10
    assert tables.audit_row(spark, "d1.t1", "append", 10).first().rows == 10
    assert tables.empty_view(spark, "none_yet", df.schema).count() == 0


def test_onboarding(spark, dirty, tmp_path):
    got = onboard.onboard(spark, dirty, "customers", str(tmp_path / "out"), "me", ["id"], key=b"k", rows=2)
    assert got.data.count() == 6
    docs = spark.read.json(str(tmp_path / "out/bundle/documents")).orderBy("first").collect()
    assert [d.id for d in docs] == ["customers:0-1", "customers:2-3", "customers:4-5"]
    assert "example.com" not in "".join(d.text for d in docs) and "Weight Value: 90.0" in docs[0].text
    assert got.manifest.first().rows == 6 and "email" in got.manifest.first().masked


def test_stream_groups_are_independent(spark, tmp_path):
    ingest.produce(spark.createDataFrame([(1, '{"v": 1}'), (2, "broken"), (3, '{"v": 3}')], "k int, v string"), str(tmp_path / "topic"), "k", "v")
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
    seen = {"a": 0, "b": 0}
    for group in seen:
        rows = ingest.decode(ingest.topic(spark, str(tmp_path / "topic"), schema), T.StructType([T.StructField("v", T.LongType())]))
        for _ in range(2):  # the second run finds nothing new
            ingest.drain(rows, str(tmp_path / f"cursor-{group}"), lambda df, _, g=group: seen.__setitem__(g, seen[g] + df.count()))
    assert seen == {"a": 2, "b": 2}


def test_carbon_of_unknown_region_is_worst(spark):
    df = spark.createDataFrame([("moon", 1 << 30), ("eu-north", 0)], "region string, bytes long")
    got = {r.region: r for r in carbon.accounted(df).collect()}
    assert got["moon"].grams == pytest.approx(128.0) and got["eu-north"].kwh > 0


def test_renamed_personal_columns():
    assert export.personal_after_renames(["weight"], ["weight_value", "weight_unit", "x"]) == ["weight_value", "weight_unit"]


def test_quantiles_equal_percentile_and_need_no_buffer_of_all_values(spark):
    rows = [("hot", float(i % 37) * 1.5) for i in range(2000)] + [("few", x) for x in (3.0, None, -1.0, float("nan"))] + [("one", 7.25), (None, 2.0), (None, 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = sorted(repr(tuple(r)) for r in quantiles.by_key(df, ["k"], F.col("v"), shares).collect())
    want = df.groupBy("k").agg(*[F.percentile("v", s).alias(n) for n, s in shares.items()]).where("a IS NOT NULL")
    assert got == sorted(repr(tuple(r)) for r in want.collect())
    log = df.withColumnRenamed("v", "ms")
    for lazy in (models.robust_z(df, "v", ["k"]), profile.counts(df), carbon.latency(log, ["k"])):
        plan = lazy._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "row_number" not in plan
    assert {r.k: r.p95_ms for r in carbon.latency(log, ["k"]).where("k IN ('hot', 'one')").collect()} == {"hot": sorted(r[1] for r in rows if r[0] == "hot")[1899], "one": 7.25}


def test_quantiles_need_no_reused_exchange(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.hash("id") % 100_000).cast("double").alias("v"))
    want = {r.k: r.m for r in rows.groupBy("k").agg(F.percentile("v", 0.5).alias("m")).collect()}
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert {r.k: r.m for r in quantiles.by_key(rows, ["k"], F.col("v"), {"m": 0.5}).collect()} == want
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


@pytest.mark.parametrize("kind", ["string", "double", "date", "decimal(9,2)"])
def test_mode_is_the_least_of_the_most_frequent(spark, kind):
    k = F.col("id") % 40
    value = F.date_add(F.lit("2024-01-01").cast("date"), k.cast("int")) if kind == "date" else k.cast(kind)
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, value).alias("a.b"), F.lit(None).cast(kind).alias("none"))
    want = df.agg(F.mode(F.col("`a.b`"), True)).first()[0]
    got = clean.impute(df, ["a.b", "none"], "mode")
    assert got.dtypes == df.dtypes and got.where("none IS NOT NULL").count() == 0
    assert [r["a.b"] for r in got.where("id % 3 = 0").select(F.col("`a.b`")).distinct().collect()] == [want]


def test_modes_of_nothing_and_unknown_strategies(spark):
    empty = spark.createDataFrame([], "v int")
    assert clean.impute(empty, ["v"], "mode").count() == 0
    with pytest.raises(ValueError, match="no strategy"):
        clean.impute(empty, ["v"], "middle")
