"""Exact quantiles without a buffer of all values: counts of values, dealt by range, with running totals of the parts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import write_shared


def at_ranks(df: DataFrame, keys: Sequence[str], value: Column, ranks: Sequence[Callable[[Column], Column]], weight: Column | None = None) -> DataFrame:
    """(keys, _n, _r0, _r1, …): rows of each key and its values at the ranks, from 0, that the functions give for _n. Nulls come first.
    A row counts once, or as often as its weight, a whole number, says.

    Equal values of a key are one row after the map-side combine. Tasks sort a range of (keys, value), so a hot key is
    spread over many; what is joined back is one total for each key and range that it lies in. The dealt counts are written once: two plans of
    the same ranges would sample other borders, and totals would not fit places.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    counted = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], value.alias("_v"), (F.lit(1) if weight is None else weight).cast("long").alias("_w")).groupBy(*names, "_v").agg(F.sum("_w").alias("_c"))
    dealt = counted.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names, "_v").withColumn("_part", F.spark_partition_id())
    parts = write_shared(dealt, "quantiles")
    end = F.sum("_c").over(Window.partitionBy("_part", *names).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    of_key = Window.partitionBy(*names)
    totals = parts.groupBy("_part", *names).agg(F.sum("_c").alias("_s")).select(
        F.col("_part").alias("_p"), *[F.col(n).alias(f"_t{n}") for n in names],
        F.coalesce(F.sum("_s").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_s").over(of_key).alias("_n"),
    )
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_t{n}")) for n in names], F.col("_part") == F.col("_p"))
    placed = parts.withColumn("_end", end).join(totals, same).withColumn("_end", F.col("_end") + F.col("_before")).withColumn("_start", F.col("_end") - F.col("_c"))
    hits = [(F.col("_start") <= r(F.col("_n"))) & (r(F.col("_n")) < F.col("_end")) for r in ranks]
    found = placed.where(reduce(Column.__or__, hits)).groupBy(*names).agg(F.max("_n").alias("_n"), *[F.max(F.when(h, F.col("_v"))).alias(f"_r{i}") for i, h in enumerate(hits)])
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "_n", *[f"_r{i}" for i in range(len(ranks))])


def by_key(df: DataFrame, keys: Sequence[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each share): quantiles of the values that aren't null, between two of them by distance, as F.percentile gives."""
    named = df.withColumn("_value", value.cast("double")).where("_value IS NOT NULL")
    ranks = [f for s in shares.values() for f in (lambda n, s=s: F.floor(s * (n - 1)), lambda n, s=s: F.ceil(s * (n - 1)))]
    rows = at_ranks(named, keys, F.col("_value"), ranks)
    out = []
    for i, (name, s) in enumerate(shares.items()):
        at, low, high = s * (F.col("_n") - 1), F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        between = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
        out.append(F.when(low == high, low).otherwise(between).alias(name))
    return rows.select(*keys, *out)


def of_columns(df: DataFrame, values: dict[str, Column], shares: dict[str, float]) -> DataFrame:
    """(column, a column for each share): quantiles of each of the values by name, a row for each that isn't all null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), v.cast("double").alias("value")) for c, v in values.items()])
    return by_key(df.select(F.inline(pairs)), ["column"], F.col("value"), shares)


def quartiles(df: DataFrame, values: dict[str, Column]) -> dict[str, tuple[float | None, float | None]]:
    """name -> (q1, q3); what reaches the driver is a row a name."""
    found = {r.column: (r.q1, r.q3) for r in of_columns(df, values, {"q1": 0.25, "q3": 0.75}).collect()} if values else {}
    return {c: found.get(c, (None, None)) for c in values}
