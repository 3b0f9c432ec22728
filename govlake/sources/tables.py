"""Tables: create, append, overwrite, scan, audit of writes, byte sizes, landing of cleaned data."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import privacy, provenance
from .readers import conform


def create(spark: SparkSession, domain: str, name: str, schema: T.StructType, partition_by: Sequence[str] = ()) -> str:
    """The table of a dataset, in its domain's database, if it isn't there yet."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{domain}`")
    full = f"`{domain}`.`{name}`"
    if not spark.catalog.tableExists(f"{domain}.{name}"):
        writer = spark.createDataFrame([], schema).write.format("parquet")
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(full)
    return full


def write(df: DataFrame, path: str, mode: str = "append", partition_by: Sequence[str] = ()) -> int:
    """Write Parquet; the rows written are counted on the way."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return seen.get["rows"]


def write_cleaned(df: DataFrame, base: str, name: str, assessment: DataFrame | None = None, audit: Sequence[dict] = ()) -> dict[str, str]:
    """Cleaned data below base as Parquet and as CSV with a header, and a report as JSON: a line for each assessed column and one for each audited step. The paths by kind.

    The CSV is written from the Parquet, so the cleaning runs once. Nested columns are JSON text in the CSV; an empty text is quoted there, so it stays apart from null.
    """
    spark = df.sparkSession
    paths = {kind: f"{base.rstrip('/')}/{name}.{kind}" for kind in ("parquet", "csv", "report")}
    df.write.mode("overwrite").parquet(paths["parquet"])
    stored = spark.read.schema(df.schema).parquet(paths["parquet"])
    cell = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = stored.select(*[(F.to_json(cell(f)) if isinstance(f.dataType, nested) else cell(f)).alias(f.name) for f in stored.schema.fields])
    flat.write.mode("overwrite").option("header", True).option("emptyValue", '""').option("nullValue", "").option("escape", '"').csv(paths["csv"])
    lines = spark.createDataFrame([("step", json.dumps(a, default=str, sort_keys=True)) for a in audit], "kind string, facts string")
    if assessment is not None:
        lines = assessment.select(F.lit("column").alias("kind"), F.to_json(F.struct("*")).alias("facts")).unionByName(lines)
    lines.write.mode("overwrite").json(paths["report"])
    return paths


def append(df: DataFrame, table: str) -> None:
    """Append by name to the stored schema: absent columns are null, unknown ones are dropped."""
    conform(df, df.sparkSession.table(table).schema).write.insertInto(table)


def scan(df: DataFrame, columns: Sequence[str] | None = None, predicate: Column | str | None = None) -> DataFrame:
    """Pruned and filtered: both reach the Parquet scan."""
    out = df if predicate is None else df.where(predicate)
    return out if columns is None else out.select(*columns)


def audit_row(spark: SparkSession, table: str, operation: str, rows: int, at: Column | None = None, parent: str | None = None) -> DataFrame:
    """A record of a write, for the append-only audit table that stands for snapshots."""
    one = spark.range(1).select(F.lit(table).alias("table"), F.lit(operation).alias("operation"), F.lit(rows).cast("long").alias("rows"), (F.current_timestamp() if at is None else at).alias("at"), F.lit(parent).cast("string").alias("parent_id"))
    return one.withColumn("snapshot_id", F.sha2(F.concat_ws("|", "table", "operation", F.col("rows").cast("string"), F.col("at").cast("string")), 256))


def byte_size(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row (files, bytes) of the files below a path, or below several; only their lengths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def empty_view(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    df = spark.createDataFrame([], schema)
    df.createOrReplaceTempView(name)
    return df


def land(df: DataFrame, path: str, dataset: str, principal: str) -> dict[str, DataFrame]:
    """Overwrite the table, then its facts: field classes, provenance and a lineage edge, each a DataFrame to append."""
    write(df, path, "overwrite")
    stored = df.sparkSession.read.parquet(path)
    return {
        "fields": privacy.classify(stored).withColumn("dataset", F.lit(dataset)),
        "provenance": provenance.capture(stored, path, principal, "clean").withColumn("dataset", F.lit(dataset)),
        "lineage": df.sparkSession.range(1).select(F.lit(f"raw/{dataset}").alias("src"), F.lit(f"prepared/{dataset}").alias("dst"), F.lit("clean").alias("operation"), F.current_timestamp().alias("at")),
    }
