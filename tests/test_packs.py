"""Models as transformers: built from specs, saved, loaded, found by reference."""

import pytest
from pyspark.sql import functions as F

from govlake.operators import models, packs, quality


def test_saved_models_give_equal_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", i, float(i * i % 7)) for i in range(20)] + [("b", 1, 3.0)], "k string, t int, v double")
    specs = spark.createDataFrame(
        [("trend", "trend", {"field": "v", "group_by": "k", "order_by": "t", "horizon": "2"}), ("last", "forecast", {"field": "v", "group_by": "k", "order_by": "t"}), ("odd", "anomaly", {"field": "v", "group_by": "k"})],
        "id string, task string, params map<string,string>",
    )
    packs.Pack.from_specs("p", specs).save(str(tmp_path))
    again = packs.Pack("p", symbols={"twice": lambda d: d.union(d)})
    again.load(str(tmp_path), {"trend": packs.TrendForecast, "last": packs.LastForecast, "odd": packs.RobustZ})
    rows = lambda d: sorted(map(repr, d.collect()))
    run = lambda name: rows(packs.resolve(f"pack://p/pack.py#{name}", {"p": again}).transform(df))
    assert run("trend") == rows(models.forecast_trend(df, "v", ["k"], ["t"], 2)) and run("last") == rows(models.forecast_last(df, "v", ["k"], ["t"], 7)) and run("odd") == rows(models.robust_z(df, "v", ["k"]))
    assert packs.resolve("pack://p/x#twice", {"p": again})(df).count() == 42


def test_unknown_tasks_params_and_references(spark):
    for bad in (lambda: packs.build("cluster"), lambda: packs.build("anomaly", {"horizon": 3})):
        with pytest.raises(ValueError):
            bad()
    for ref in ("pack://q/a#b", "pack://p/a#b", "os#system", "pack://p/a"):
        with pytest.raises(LookupError):
            packs.resolve(ref, {"p": packs.Pack("p")})
    assert packs.build("anomaly", {"group_by": "k"}).of("group_by") == ["k"]


def test_hooks_of_a_pack(spark, tmp_path):
    pack = packs.Pack("p", connectors={"numbers": lambda s, uri: s.range(int(uri))}, custom_quality={"even": lambda df: F.count_if(F.col("id") % 2 == 1)})
    df = pack.connectors["numbers"](spark, "5")
    rule = quality.Rule("even", "custom", "id", {"violations": pack.custom_quality["even"](df)})
    assert quality.evaluate(df, [rule]).first().violations == 2
