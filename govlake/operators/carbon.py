"""Energy and carbon of a query log, and the figures of an operations board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles

# Grams of CO2 a kWh, and kWh a GiB scanned.
INTENSITY = {"local": 380.0, "eu-north": 28.0, "us-west": 210.0, "ap-south": 640.0}
KWH_PER_GIB = 0.2


def intensity(region: Column) -> Column:
    """Grams a kWh; an unknown region counts as the dirtiest."""
    table = F.create_map(*[F.lit(x) for pair in INTENSITY.items() for x in pair])
    return F.coalesce(F.element_at(table, region), F.lit(max(INTENSITY.values())))


def greenest(candidates: Column) -> Column:
    """Of an array of regions the one of least intensity, first by name among equals."""
    ranked = F.array_sort(F.transform(candidates, lambda r: F.struct(intensity(r).alias("g"), r.alias("r"))))
    return F.element_at(ranked, 1)["r"]


def renewable_share(region: Column) -> Column:
    return F.round(F.least(F.greatest(1 - intensity(region) / 800.0, F.lit(0.0)), F.lit(1.0)), 3)


def accounted(log: DataFrame) -> DataFrame:
    """Adds kwh and grams to a query log with bytes and region."""
    kwh = F.greatest(F.col("bytes"), F.lit(1)) * KWH_PER_GIB / float(1 << 30)
    return log.withColumn("kwh", kwh).withColumn("grams", F.col("kwh") * intensity(F.col("region")))


def savings(log: DataFrame, against: float = max(INTENSITY.values())) -> DataFrame:
    """(day, queries, kwh, grams, grams_saved, share_saved) against a grid of that intensity."""
    day = accounted(log).groupBy(F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("queries"), F.sum("kwh").alias("kwh"), F.sum("grams").alias("grams"))
    return day.withColumn("grams_saved", F.col("kwh") * against - F.col("grams")).withColumn("share_saved", F.col("grams_saved") / (F.col("kwh") * against))


def savings_at_levels(log: DataFrame, against: float = max(INTENSITY.values()), price: float = 0.25) -> DataFrame:
    """(level, day, region, queries, kwh, grams, cost, grams_saved): by day and region, by day, by region and in total, from one scan.

    cost is energy at `price` a kWh; against is the grid that savings are told from, as the local one or the worst.
    """
    at = accounted(log).withColumn("day", F.to_date("at"))
    sets = at.groupingSets([["day", "region"], ["day"], ["region"], []], "day", "region")
    level = F.element_at(F.array(*[F.lit(n) for n in ("day and region", "day", "region", "total")]), (F.grouping_id("day", "region") + 1).cast("int"))
    out = sets.agg(level.alias("level"), F.count(F.lit(1)).alias("queries"), F.sum("kwh").alias("kwh"), F.sum("grams").alias("grams"))
    return out.withColumn("cost", F.col("kwh") * price).withColumn("grams_saved", F.col("kwh") * against - F.col("grams"))


def latency(log: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """The nearest-rank percentile of ms within keys, at round(share (n - 1)) of the sorted values."""
    found = quantiles.at_ranks(log, keys, F.col("ms"), [lambda n: F.bround(share * (n - 1))])
    return found.select(*keys, F.col("_r0").alias("p95_ms"), F.col("_n").alias("queries"))


def freshness(feeds: DataFrame, now: Column) -> DataFrame:
    """Adds lag_seconds and within: 30 s for streaming feeds, 4 h for the others."""
    lag = F.unix_timestamp(now) - F.unix_timestamp("last_at")
    return feeds.withColumn("lag_seconds", lag).withColumn("within", F.when(F.col("modality") == "streaming", lag <= 30).otherwise(lag <= 4 * 3600))


def feed_roll_up(feeds: DataFrame) -> DataFrame:
    return feeds.groupBy("modality").agg(F.count(F.lit(1)).alias("feeds"), F.sum("per_minute").alias("per_minute"), F.round(F.avg(F.col("within").cast("double")), 4).alias("slo_share"), F.count_if(~F.col("within")).alias("attention"))


def feed_board(feeds: DataFrame) -> DataFrame:
    """(level, modality, domain, feeds, per_minute, slo_share, attention) of feeds with modality, domain, per_minute and within: in total, by modality and by domain, from one scan."""
    sets = feeds.groupingSets([["modality"], ["domain"], []], "modality", "domain")
    level = F.when(F.grouping_id("modality", "domain") == 3, "total").when(F.grouping("domain") == 1, "modality").otherwise("domain")
    return sets.agg(
        level.alias("level"), F.count(F.lit(1)).alias("feeds"), F.sum("per_minute").alias("per_minute"), F.round(F.avg(F.col("within").cast("double")), 4).alias("slo_share"), F.count_if(~F.col("within")).alias("attention")
    )
