"""The dataset catalog as an append-only table of records; the latest record of an id counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import keyed
from .privacy import rank

#: What a catalog record holds.
RECORD = (
    "id string, name string, domain string, title string, description string, tags array<string>, modality string, sensitivity string, signed boolean, location string, semantic_types int, "
    "license string, provenance int, pii_fields int, row_count long, quality double, version int, version_at timestamp, seq long"
)


def registry(spark: SparkSession, path: str, buckets: int = 64) -> keyed.KeyedTable:
    """The catalog as a keyed table by id: register by `upsert`, one dataset by `get`, all by `read`. The record of greatest seq counts."""
    return keyed.create(spark, path, RECORD, ["id"], "seq", buckets)


def latest(records: DataFrame) -> DataFrame:
    """The latest record of each id by version_at."""
    place = Window.partitionBy("id").orderBy(F.desc("version_at"), F.desc("seq"))
    return records.withColumn("_rank", F.row_number().over(place)).where("_rank = 1").drop("_rank")


def get(records: DataFrame, id_: str) -> DataFrame:
    return latest(records.where(F.col("id") == id_))


def all_sorted(records: DataFrame) -> DataFrame:
    return latest(records).orderBy("id")


def search(catalog: DataFrame, query: str = "", domain: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Records whose text holds the query, of a domain, with all the tags."""
    text = F.lower(F.concat_ws(" ", "title", "description", "domain", "name", F.array_join("tags", " ")))
    out = catalog.where(F.contains(text, F.lit(query.lower())))
    if domain is not None:
        out = out.where(F.col("domain") == domain)
    return out.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), "tags")) == 0) if tags else out


def facets(catalog: DataFrame) -> DataFrame:
    """(facet, value, n) for domain, modality, sensitivity and signed."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in ("domain", "modality", "sensitivity", "signed")])
    return catalog.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def top_sensitivity(levels: Column) -> Column:
    """The highest of an array of sensitivities."""
    return F.element_at(F.array_sort(F.transform(levels, lambda s: F.struct(rank(s).alias("r"), s.alias("s")))), -1)["s"]


def fair(catalog: DataFrame) -> DataFrame:
    """Adds findable, accessible, interoperable, reusable and their mean, fair_score."""
    flags = {
        "findable": F.coalesce((F.length("title") > 0) & (F.length("description") > 0), F.lit(False)), "accessible": F.col("location").isNotNull(),
        "interoperable": F.coalesce(F.col("semantic_types") > 0, F.lit(False)), "reusable": F.coalesce((F.length("license") > 0) & (F.col("provenance") > 0), F.lit(False)),
    }
    mean = sum((F.col(f).cast("double") for f in flags), F.lit(0.0)) / 4
    return catalog.withColumns(flags).withColumn("fair_score", mean)


def summary(catalog: DataFrame) -> DataFrame:
    return fair(catalog).agg(
        F.count(F.lit(1)).alias("datasets"), F.count_distinct("domain").alias("domains"), F.sum("row_count").alias("rows"), F.count_if("signed").alias("signed"),
        F.sum("pii_fields").alias("pii_fields"), F.round(F.avg("fair_score"), 4).alias("mean_fair"), F.round(F.avg("quality"), 4).alias("mean_quality"),
    )


def populated_version(catalog: DataFrame) -> DataFrame:
    """For each name the record of most rows, then of the highest version."""
    return catalog.groupBy("name").agg(F.max_by("id", F.struct("row_count", "version")).alias("id"))


def declared_version(catalog: DataFrame, domain: str, name: str) -> DataFrame:
    return catalog.where((F.col("domain") == domain) & (F.col("name") == name)).orderBy(F.desc("version")).limit(1).select("version")


def to_load(planned: DataFrame, catalog: DataFrame) -> DataFrame:
    """Planned loads of datasets that have no rows yet."""
    return planned.join(catalog.where("row_count > 0").select("id"), "id", "left_anti")


def history(log: DataFrame) -> DataFrame:
    """The query log, newest first, without internal columns (those that start with _)."""
    return log.select(*[c for c in log.columns if not c.startswith("_")]).orderBy(F.desc("at"))


def ontology(fields: DataFrame, mappings: DataFrame, terms: DataFrame) -> DataFrame:
    """fields(dataset, column) with term and parent term."""
    return fields.join(mappings, ["dataset", "column"], "left").join(terms, "term", "left").select("dataset", "column", "term", "parent")


def pack_counts(entries: DataFrame) -> DataFrame:
    """entries(pack, kind) -> (pack, datasets, rules, models, policies, terms)."""
    kinds = ("datasets", "rules", "models", "policies", "terms")
    return entries.groupBy("pack").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
