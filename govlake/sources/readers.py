"""Readers. None caps rows by itself; `limited` does on request and says so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"csv": "csv", "tsv": "tsv", "parquet": "parquet", "json": "json", "ndjson": "json", "jsonl": "json", "geojson": "geojson", "orc": "orc"}


def read_text_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with a header, every column as text; an empty cell is the empty text."""
    return spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array, a single object, or one object a line: the first character of the first line says which."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.trim("value").alias("v")).collect()
    lines = bool(head) and head[0].v.startswith("{") and head[0].v.endswith("}")
    return spark.read.option("multiLine", not lines).json(path)


def read_geojson(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """A FeatureCollection as a row for each feature: its properties as columns, its geometry as JSON text."""
    features = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return features.select("f.properties.*", F.to_json("f.geometry").alias(geometry))


def read(spark: SparkSession, path: str, format: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """By format, else by suffix. A schema makes the read typed (conformed for text formats)."""
    kind = FORMATS.get((format or path.rstrip("/").rpartition(".")[2]).lower())
    if kind is None:
        raise ValueError(f"no reader for {format or path}")
    if kind in ("csv", "tsv"):
        out = read_text_table(spark, path, "\t" if kind == "tsv" else ",")
    elif kind == "json":
        out = read_json(spark, path)
    elif kind == "geojson":
        out = read_geojson(spark, path)
    else:
        out = spark.read.format(kind).load(path)
    return conform(out, schema) if schema else out


def read_database(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A JDBC table or query; partition = (column, lower, upper, parts) reads in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    reader = reader.option("query", query) if query else reader.option("dbtable", table)
    if partition and not query:
        for k, v in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition, strict=True):
            reader = reader.option(k, str(v))
    return reader.load()


def richest(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the table of most rows (first by name among equals) and its rows."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name)) for name, df in tables.items()]
    best = F.min(F.struct((-F.col("rows")).alias("r"), F.col("table").alias("t")))
    return reduce(DataFrame.unionByName, counts).agg(best.alias("b")).select(F.col("b.t").alias("table"), (-F.col("b.r")).alias("rows"))


def limited(df: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """At most `rows` rows, and one row that tells the true total and whether it was truncated."""
    total = df.agg(F.count(F.lit(1)).alias("row_estimate"))
    return df.limit(rows), total.select("row_estimate", F.least("row_estimate", F.lit(rows)).alias("rows_read"), (F.col("row_estimate") > rows).alias("truncated"))


def describe(df: DataFrame, source: str) -> DataFrame:
    """(source, column, type, rows) for each column."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return rows.select(F.lit(source).alias("source"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type")) for c, t in df.dtypes])).alias("f"), "rows").select("source", "f.*", "rows")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared fields in order: cast where a value allows it (else null), null where a field is absent, others dropped."""
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name, metadata=f.metadata) for f in schema.fields])


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
