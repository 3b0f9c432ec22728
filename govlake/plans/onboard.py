"""Connect, assess, clean, write, land and export a table, each step over the whole of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean, export, profile
from ..sources import readers, tables


@dataclass
class Onboarded:
    profile: DataFrame
    plan: list[clean.Step]
    data: DataFrame
    audit: list[dict]
    facts: dict[str, DataFrame]
    manifest: DataFrame | None


def onboard(spark: SparkSession, path: str, dataset: str, out: str, principal: str, order: list[str], format: str | None = None, key: bytes | None = None, rows: int = 1) -> Onboarded:
    """The receipt of an onboarding; with a key the documents are exported too."""
    raw = readers.read(spark, path, format)
    assessment = profile.assess(raw)
    plan = clean.derive_plan(assessment)
    cleaned = clean.apply_plan(raw, plan)
    facts = tables.land(cleaned.data, f"{out}/table", dataset, principal)
    stored = spark.read.parquet(f"{out}/table")
    manifest = None
    if key is not None:
        pii = [r.column for r in facts["fields"].where("pii").select("column").collect()]
        manifest = export.bundle(stored, dataset, [c for c in order if c in stored.columns], pii, f"{out}/bundle", key, rows)
    return Onboarded(assessment, plan, stored, cleaned.audit(), facts, manifest)
