"""De-identified text documents from rows, and the bundle that carries them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.shared import write_shared
from . import privacy, provenance


def personal_after_renames(pii: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Personal columns, with the value and unit columns that were split from one."""
    return [c for c in columns if c in pii or any(c == f"{p}{s}" for p in pii for s in ("_value", "_unit"))]


def row_text(df: DataFrame, dataset: str, pii: Sequence[str], index: str) -> DataFrame:
    """Adds `text`: `Dataset record i — Key: value; …` without personal, null and empty values."""
    shown = []
    for f in df.schema.fields:
        if f.name in pii or f.name == index:
            continue
        v = F.col(f"`{f.name}`")
        v = F.when(v != "", v) if isinstance(f.dataType, T.StringType) else v.cast("string")
        shown.append(F.concat(F.lit(f"{X.humanised(f.name)}: "), v))
    body = F.concat_ws("; ", *shown)
    head = F.concat(F.lit(f"{X.humanised(dataset)} record "), F.col(index).cast("string"))
    return df.withColumn("text", F.when(body != "", F.concat(head, F.lit(" — "), body)).otherwise(head))


def numbered(df: DataFrame, order: Sequence[str], name: str = "_i") -> DataFrame:
    """Adds a dense index from 0 in the given order: counts of range partitions first, then places within each.

    The dealt rows are written once: two plans of the same ranges would sample other borders, and sizes would not fit places.
    """
    dealt = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id())
    parts = write_shared(dealt, "numbered")
    local = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # as many rows as partitions
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return local.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_k") - 1).cast("long")).drop("_part", "_k", "_before")


def chunks(df: DataFrame, dataset: str, index: str, pii: Sequence[str] = (), rows: int = 1) -> DataFrame:
    """(id, text, metadata, first, last): `rows` records a document, in the order of a dense index column."""
    each = row_text(df, dataset, pii, index).select(F.col(index).alias("i"), "text")
    group = each.groupBy(F.floor(F.col("i") / rows).alias("g")).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.sort_array(F.collect_list(F.struct("i", "text"))).alias("t"))
    name = F.when(F.col("first") == F.col("last"), F.format_string("%s:%d", F.lit(dataset), "first")).otherwise(F.format_string("%s:%d-%d", F.lit(dataset), "first", "last"))
    meta = F.create_map(F.lit("dataset"), F.lit(dataset), F.lit("rows"), (F.col("last") - F.col("first") + 1).cast("string"))
    return group.select(name.alias("id"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"), meta.alias("metadata"), "first", "last")


def bundle(df: DataFrame, dataset: str, order: Sequence[str], pii: Sequence[str], path: str, key: bytes, rows: int = 1) -> DataFrame:
    """Mask, number, chunk and write documents (JSON lines) and the masked table (Parquet) under path; returns the manifest, which is written too."""
    hidden = personal_after_renames(pii, df.columns)
    masked = privacy.mask(df, hidden)
    documents = chunks(numbered(masked, order), dataset, "_i", hidden, rows)
    documents.write.mode("overwrite").json(f"{path}/documents")
    masked.write.mode("overwrite").parquet(f"{path}/table")
    spark = df.sparkSession
    facts = provenance.digest(spark.read.parquet(f"{path}/table"))
    manifest = facts.select(F.lit(dataset).alias("dataset"), "rows", F.col("digest").cast("string").alias("checksum"), F.array(*[F.lit(c) for c in hidden]).alias("masked"), F.lit(rows).alias("rows_per_document"))
    manifest = manifest.withColumn("signature", provenance.sign(F.concat_ws("|", "dataset", F.col("rows").cast("string"), "checksum"), key))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest
