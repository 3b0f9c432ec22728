"""The platform overview from daily partial aggregates, so that it never scans the query log again.

Each load of a day's log is summed once: a row a day of counts, energy and carbon, and a row for each day and latency with how often it occurred. Both are keyed tables, so a day that is
loaded again is replaced, not added. At read time the partials are merged; the p95 is the exact nearest rank over the merged counts, not a mean of daily percentiles.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import keyed
from ..sources.shared import write_shared
from . import carbon, lineage, quantiles

DAY = "day date, queries long, denied long, kwh double, grams double, seq long"
LATENCY = "day date, ms array<struct<ms:long,n:long>>, slot int, seq long"
#: Latencies of a day are kept in as many rows, so that no row grows with the number of distinct values alone.
SLOTS = 16


class Partials(NamedTuple):
    days: keyed.KeyedTable
    latencies: keyed.KeyedTable


def store(spark: SparkSession, path: str, buckets: int = 8) -> Partials:
    return Partials(keyed.create(spark, f"{path}/days", DAY, ["day"], buckets=buckets), keyed.create(spark, f"{path}/latencies", LATENCY, ["day", "slot"], buckets=buckets))


def load(partials: Partials, log: DataFrame, seq: int) -> None:
    """Sum whole days of a query log (at, bytes, region, ms, status); a later seq replaces the day."""
    at = carbon.accounted(log).withColumn("day", F.to_date("at"))
    days = at.groupBy("day").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("status") == "denied").alias("denied"), F.sum("kwh").alias("kwh"), F.sum("grams").alias("grams"))
    partials.days.upsert(days.withColumn("seq", F.lit(seq).cast("long")))
    counts = at.groupBy("day", "ms").agg(F.count(F.lit(1)).alias("n")).withColumn("slot", F.pmod(F.xxhash64("ms"), F.lit(SLOTS)).cast("int"))
    slots = F.broadcast(partials.days.spark.range(SLOTS).select(F.col("id").cast("int").alias("slot")))  # all slots of a day, so that an earlier load's are replaced too
    packed = counts.groupBy("day", "slot").agg(F.collect_list(F.struct("ms", "n")).alias("ms"))
    every = counts.select("day").distinct().crossJoin(slots).join(packed, ["day", "slot"], "left")
    partials.latencies.upsert(every.withColumn("ms", F.coalesce("ms", F.array().cast("array<struct<ms:long,n:long>>"))).withColumn("seq", F.lit(seq).cast("long")))


def p95(partials: Partials, keys: list[str] | None = None, share: float = 0.95) -> DataFrame:
    """(keys, p95_ms, queries) over all loaded days, or by day: the value at round(share (n - 1)) of the sorted latencies."""
    counts = partials.latencies.read().select("day", F.inline("ms"))
    found = quantiles.at_ranks(counts, keys or [], F.col("ms"), [lambda n: F.bround(share * (n - 1))], weight=F.col("n"))
    return found.select(*(keys or []), F.col("_r0").alias("p95_ms"), F.col("_n").alias("queries"))


def overview(catalog: DataFrame, edges: DataFrame, partials: Partials, today: Column) -> DataFrame:
    """One row for the board: catalog, lineage, carbon and latency figures. catalog(id, domain, row_count, quality, pii_fields, ...) has the latest records."""
    board = catalog.agg(
        F.count(F.lit(1)).alias("datasets"), F.count_distinct("domain").alias("domains"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_indexed"),
        F.coalesce(F.round(F.avg("quality"), 4), F.lit(0.0)).alias("quality_avg"), F.coalesce(F.sum("pii_fields"), F.lit(0)).alias("pii_protected"),
    )
    covered = lineage.coverage(catalog.select(F.col("id").alias("dataset")), edges).select("coverage")
    worst = max(carbon.INTENSITY.values())
    days = partials.days.read().agg(
        F.coalesce(F.sum("queries"), F.lit(0)).alias("queries"), F.coalesce(F.sum(F.when(F.col("day") == today, F.col("queries"))), F.lit(0)).alias("queries_today"), F.coalesce(F.sum("denied"), F.lit(0)).alias("denied"),
        F.round(F.sum("grams") / F.sum("queries"), 9).alias("carbon_per_query"), F.round(1 - F.sum("grams") / (F.sum("kwh") * worst), 4).alias("carbon_saved"),
    )
    latency = write_shared(p95(partials).select("p95_ms"), "p95")
    # each side is one row; the latency may be none
    return board.crossJoin(F.broadcast(covered)).crossJoin(F.broadcast(days)).join(F.broadcast(latency), F.lit(True), "left")
