"""Anomalies, forecasts, scores and federated averages as aggregates and expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quantiles
from .profile import NUMBERS

# Direct identifiers that a score must never be given.
IDENTIFIERS = ("applicant_name", "national_id", "email")
PROTECTED = (*IDENTIFIERS, "gender", "sex", "race", "ethnicity", "religion", "age", "nationality", "marital_status")


def anomalies(df: DataFrame, columns: Sequence[str] | None = None, z: float = 3.0) -> DataFrame:
    """Adds anomaly_score, the highest |z| over the numeric columns (null counts 0), and is_anomaly: |z| above z or outside the quartile fences."""
    columns = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NUMBERS)])
    v = {c: F.col(c).cast("double") for c in columns}
    one = df.agg(*[F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.count(x).alias("n")).alias(c) for c, x in v.items()]).first()
    quartiles = quantiles.quartiles(df, v)
    scores, flags = [F.lit(0.0)], F.lit(False)
    for c, x in v.items():
        r, (q1, q3) = one[c], quartiles[c]
        if not r.n:
            continue
        score = F.coalesce(F.abs(x - r.m) / r.s, F.lit(0.0)) if r.s else F.lit(0.0)
        scores.append(score)
        flags = flags | (score > z)
        if r.n >= 4 and q3 != q1:
            flags = flags | F.coalesce((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)), F.lit(False))
    return df.withColumns({"anomaly_score": F.greatest(F.lit(0.0), *scores), "is_anomaly": flags})


def robust_z(df: DataFrame, value: str, keys: Sequence[str], threshold: float = 3.5) -> DataFrame:
    """Adds robust_z, 0.6745 (x - median) / MAD within keys, and is_anomaly; plain z if MAD is 0, 0 if the deviation is 0 too."""
    x = F.col(value).cast("double")
    mid = df.groupBy(*keys).agg(F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_std"))
    with_mid = df.join(mid, list(keys)).join(quantiles.by_key(df, keys, x, {"_median": 0.5}), list(keys), "left")
    mad = quantiles.by_key(with_mid, keys, F.abs(x - F.col("_median")), {"_mad": 0.5})
    score = F.when(F.col("_mad") > 0, 0.6745 * (x - F.col("_median")) / F.col("_mad")).when(F.col("_std") > 0, (x - F.col("_mean")) / F.col("_std")).otherwise(0.0)
    return with_mid.join(mad, list(keys), "left").withColumn("robust_z", score).withColumn("is_anomaly", F.abs("robust_z") > threshold).drop("_median", "_mean", "_std", "_mad")


def forecast_last(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], horizon: int) -> DataFrame:
    """The last value of each key, `horizon` times: (keys, step, forecast)."""
    last = df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("forecast"))
    return last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "forecast")


def forecast_trend(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], horizon: int, low: float = 0.0, high: float = 180.0) -> DataFrame:
    """Least squares over positions 0 to n - 1 of each key, `horizon` ahead, clipped; one value repeats."""
    numbered = df.withColumn("_x", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("double"))
    y = F.col(value).cast("double")
    line = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, F.col("_x")).alias("slope"), F.regr_intercept(y, F.col("_x")).alias("intercept"), F.max(y).alias("only"))
    ahead = line.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    raw = F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step")))
    return ahead.select(*keys, "step", F.least(F.greatest(raw, F.lit(low)), F.lit(high)).alias("forecast"))


def risk_score(income: Column, amount: Column, intercept: float = -1.6, weight: float = 1.15) -> Column:
    """Logistic score of the ratio of income to amount, on a log scale."""
    ratio = F.greatest(income, F.lit(0.0)) / F.greatest(amount, F.lit(1.0))
    return 1.0 / (1.0 + F.exp(-(F.lit(intercept) + F.lit(weight) * F.log1p(ratio))))


def refuse_protected(features: Sequence[str], protected: Sequence[str] = PROTECTED) -> None:
    """Raise if one of the protected columns is among the features, in any case of letters."""
    hit = sorted({f.lower() for f in features} & {p.lower() for p in protected})
    if hit:
        raise ValueError(f"protected features: {', '.join(hit)}")


def predict_mean(df: DataFrame, model: str) -> DataFrame:
    """The mean of the first numeric column as `{model}_prediction`; df itself without one."""
    first = next((f.name for f in df.schema.fields if isinstance(f.dataType, NUMBERS) and not isinstance(f.dataType, T.BooleanType)), None)
    return df if first is None else df.withColumn(f"{model}_prediction", F.lit(df.agg(F.avg(first)).first()[0]))


def federated_average(updates: DataFrame) -> DataFrame:
    """(name, value) from updates(weights map, samples): weighted by samples; every update counts in the divisor."""
    total = updates.agg(F.sum("samples").alias("total"))
    each = updates.select("samples", F.explode("weights").alias("name", "w"))
    return each.groupBy("name").agg(F.sum(F.col("w") * F.col("samples")).alias("s")).crossJoin(F.broadcast(total)).select("name", (F.col("s") / F.col("total")).alias("value"))  # one row on the right
