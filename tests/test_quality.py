"""Rules that fail while they run, and the gate over a pack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from govlake.operators import clean, quality
from govlake.operators.quality import Rule
from govlake.plans import registry

from . import oracle


def test_guilty_rules_fail_alone(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "c", "z")], "n int, t string, `a.b` string")
    rules = [
        Rule("set", "not_null", "n"), Rule("pattern", "regex", "t", {"pattern": "("}), Rule("text", "range", "t", {"min": 3}), Rule("parent", "referential", "n", {"table": "gone", "column": "k"}),
        Rule("column", "referential", "n", {"table": "p", "column": "gone"}), Rule("small", "range", "n", {"max": 1}), Rule("divides", "custom", "n", {"violations": F.sum(F.expr("1 / (n - 1)"))}), Rule("dotted", "enum", "a.b", {"values": ["x", "y"]}),
        Rule("child", "referential", "n", {"table": "p", "column": "k"}),
    ]
    got = {r.rule_id: r for r in quality.evaluate(df, rules, parents={"p": spark.createDataFrame([(1,)], "k int")}).collect()}
    assert {k: r.violations for k, r in got.items()} == {"set": 1, "pattern": 1, "text": 1, "parent": 1, "column": 1, "small": 1, "divides": 1, "dotted": 1, "child": 1}
    assert {k for k, r in got.items() if r.message} == {"pattern", "text", "parent", "column", "divides"} and not any(r.passed for r in got.values())
    assert got["divides"].message.endswith("DIVIDE_BY_ZERO") and got["set"].sampled == 3


def test_one_failing_rule_among_many_costs_few_scans(spark, monkeypatch):
    df = spark.range(10)
    rules = [Rule(f"r{i}", "range", "id", {"min": 0}) for i in range(32)]
    rules[13] = Rule("bad", "regex", "id", {"pattern": "("})
    scans, real = [], quality._measured
    monkeypatch.setattr(quality, "_measured", lambda df, asked: scans.append(len(asked)) or real(df, asked))
    got = quality.evaluate(df, rules).collect()
    assert [r.rule_id for r in got if not r.passed] == ["bad"] and len(scans) == 11


def test_gate_over_a_pack(spark, tmp_path):
    good = [Rule("set", "not_null", "id")]

    def broken():
        raise OSError("no route")

    spark.range(5).write.parquet(str(tmp_path / "t"))
    lost = spark.read.parquet(str(tmp_path / "t"))
    for f in (tmp_path / "t").glob("part-*"):
        f.write_bytes(b"no parquet")
    pack = {"a": (lambda: spark.range(3), good), "b": (lambda: spark.range(3), [*good, Rule("r", "range", "id", {"min": 1})]), "c": (lambda: None, good), "d": (broken, good), "e": (lambda: lost, good)}
    report = quality.gate_pack(spark, pack, at_once=3)
    assert set(report.results) == {"a", "b"} and report.skipped == {"c": "no data"} and set(report.errored) == {"d", "e"}
    v = report.verdict(spark).first()
    assert (v.datasets, v.skipped, v.errored, v.mean_score, v.passed) == (5, 1, 2, 0.75, False)
    assert quality.gate_pack(spark, {"a": pack["a"], "c": pack["c"]}).verdict(spark).first().passed
    assert not quality.gate_pack(spark, {"c": pack["c"]}, require_data=True).verdict(spark).first().passed
    with pytest.raises(Exception):  # noqa: B017 - a table that can't be read is not the rules' fault
        quality.evaluate(lost, good)


def test_bags_of_rows_are_compared_without_a_key(spark):
    make = lambda rows: spark.createDataFrame(rows, "a string, b string")
    before = make([("x", None)] * 1000 + [("y", ""), (None, "x"), ("z", "z")])
    after = make([("x", None)] * 998 + [("y", None), ("x", None), (None, "x"), ("new", "row"), ("new", "row")])
    assert [tuple(r) for r in clean.differences([before, after]).collect()] == [(1, 3, 3)]
    assert [tuple(r) for r in clean.differences([before, before.repartition(3)]).collect()] == [(1, 0, 0)]
    assert [tuple(r) for r in clean.differences([make([("v", None)]), make([(None, "v")])]).collect()] == [(1, 1, 1)]
    assert clean.differences([before.limit(0), after.limit(0)]).collect() == []
    plan = clean.differences([before, after])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_differences_know_one_zero(spark, tmp_path):
    zeros = "SELECT id AS k, {0} AS d, CAST({0} AS FLOAT) AS f, array({0}, NULL, 1D) AS a, named_struct('x.y', {0}, 'z', array(named_struct('q', {0}))) AS s FROM range(5) UNION ALL SELECT 9, NULL, NULL, NULL, NULL"
    negative, positive = spark.sql(zeros.format("-0.0D")), spark.sql(zeros.format("0.0D"))
    assert [tuple(r) for r in clean.differences([negative, positive]).collect()] == [(1, 0, 0)]
    assert [tuple(r) for r in clean.differences([negative, spark.sql(zeros.format("1E-300D"))]).collect()] == [(1, 5, 5)]
    assert [tuple(r)[1:] for r in clean.step_differences(negative.unionByName(positive), [clean.Step("dedupe_rows")]).collect()] == [("dedupe_rows", 6, 0)]
    assert [tuple(r)[1:] for r in clean.step_differences(spark.createDataFrame([("-0.0",), ("0.0",), ("0",)], "t string"), [clean.Step("coerce_type", ("t",), {"types": {"t": "double"}})]).collect()] == [("coerce_type", 1, 1)]
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN c_custkey IN (3, 20) THEN -0.0::DOUBLE WHEN c_custkey = 4 THEN 0 ELSE c_acctbal END AS c_acctbal) FROM '/root/testdata/sf0.001/customer.parquet') TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    oracle.same(registry.QUERIES["clean_differences"](spark, str(tmp_path)), oracle.connect(str(tmp_path)), registry.ORACLES["clean_differences"])


def test_fingerprints_have_two_hashes(spark):
    one, other = (spark.createDataFrame([(t,)], "t string") for t in ("customer number", "PUyRZQV241Nmnx9"))  # equal in 64 bits
    assert [tuple(r) for r in clean.differences([one, other]).collect()] == [(1, 1, 1)]


def test_cleaning_of_dotted_names(spark):
    df = spark.createDataFrame([(" a ", None, 1.0, "3 kg"), ("b", "NA", None, "4 kg"), ("B", "q", 3.0, "x")], "`x.y` string, `m` string, `n.1` double, `u.v` string")
    plan = [clean.Step("trim"), clean.Step("empty_to_null"), clean.Step("normalize_category", ("x.y",)), clean.Step("impute", ("n.1",)), clean.Step("split_unit", ("u.v",)), clean.Step("clip_outliers"), clean.Step("flag_outliers", ("n.1",)), clean.Step("dedupe_rows")]
    done = clean.apply_plan(df, plan)
    rows = sorted((tuple(r) for r in done.data.collect()), key=lambda r: r[0])
    assert [r[0] for r in rows] == ["B", "B", "a"] and {r[2] for r in rows} == {1.0, 2.0, 3.0} and done.data.columns == ["x.y", "m", "n.1", "n.1__outlier", "u.v_value", "u.v_unit"]
    assert [a["cells_changed"] for a in done.audit()] == [1, 1, 1, 1, 2, 0, 0, 0]
