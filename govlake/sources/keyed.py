"""Keyed tables on Parquet: upserts that rewrite only the hash buckets a batch touches.

A table is a folder with a partition for each bucket of its keys' hash. An upsert reads the touched buckets only, merges the batch by key and
replaces these buckets by dynamic partition overwrite; the files of all others stay as they are. The merged rows are written to the shared folder first, so
that a lost executor can't take rows with it that are no longer in the table, and one writer at a time is assumed, as for any Parquet folder.

Of the rows of a key the one with the greatest seq counts (`keep="latest"`) or the one with the least (`keep="first"`, the first writer's). Among equal
seq a latest-table takes the batch's row, a first-table keeps the stored one, and equal rows of one batch are ordered by their content. So a batch that
comes twice, or late, leaves the table as if it had come once and in order.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import conform
from .shared import write_shared

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    seq: str = "seq"
    buckets: int = 64
    keep: str = "latest"

    def bucket(self, keys: Sequence[Column] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(keys or [F.col(f"`{k}`") for k in self.keys])), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def get(self, *key) -> DataFrame:
        """The row of a key, from its bucket alone: the bucket is a constant, so the scan's partitions are pruned."""
        typed = [F.lit(v).cast(self.schema[k].dataType) for k, v in zip(self.keys, key, strict=True)]
        out = self._stored().where(F.col(BUCKET) == self.bucket(typed))
        for k, v in zip(self.keys, typed, strict=True):
            out = out.where(F.col(f"`{k}`").eqNullSafe(v))
        return out.drop(BUCKET)

    def _winners(self, rows: DataFrame) -> DataFrame:
        """One row for each key of rows, which have `_new`: whether they come with the batch."""
        names = [f"`{f.name}`" for f in self.schema.fields]
        rank = F.struct(F.col(f"`{self.seq}`"), "_new", F.xxhash64(F.to_json(F.struct(*names))))
        best = (F.max_by if self.keep == "latest" else F.min_by)(F.struct(*names), rank)
        return rows.groupBy(BUCKET, *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(self.keys)]).agg(best.alias("row")).select(BUCKET, "row.*")

    def upsert(self, batch: DataFrame) -> list[int]:
        """Merge rows of the table's columns (absent ones are null); the buckets that were rewritten."""
        new = conform(batch, self.schema).where(F.col(f"`{self.seq}`").isNotNull()).withColumn(BUCKET, self.bucket()).withColumn("_new", F.lit(True))
        new = write_shared(self._winners(new), "batch")
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # as many as there are buckets at most
        if touched:
            old = self._stored().where(F.col(BUCKET).isin(*touched)).withColumn("_new", F.lit(False))
            merged = write_shared(self._winners(old.unionByName(new.withColumn("_new", F.lit(True)))), "merged")
            merged.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return touched


def open_table(spark: SparkSession, path: str) -> KeyedTable:
    """The table of a folder, as its layout says."""
    r = spark.read.json(f"{path}/_layout").first()
    return KeyedTable(spark, path, T.StructType.fromJson(json.loads(r.fields)), tuple(r.keys), r.seq, r.buckets, r.keep)


def create(spark: SparkSession, path: str, schema: T.StructType | str, keys: Sequence[str], seq: str = "seq", buckets: int = 64, keep: str = "latest") -> KeyedTable:
    """The table of a folder, made if it isn't there. Its layout is kept beside it, as rows only meet in the buckets that they were dealt to: another one is an error."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if keep not in ("latest", "first"):
        raise ValueError(f"keep is latest or first, not {keep}")
    table = KeyedTable(spark, path, schema, tuple(keys), seq, buckets, keep)
    try:
        found = open_table(spark, path)
    except AnalysisException:
        facts = spark.range(1).select(F.lit(schema.json()).alias("fields"), F.array(*[F.lit(k) for k in keys]).alias("keys"), F.lit(seq).alias("seq"), F.lit(buckets).alias("buckets"), F.lit(keep).alias("keep"))
        facts.coalesce(1).write.json(f"{path}/_layout")
        return table
    if (found.keys, found.seq, found.buckets, found.keep, found.schema.simpleString()) != (table.keys, seq, buckets, keep, schema.simpleString()):
        raise ValueError(f"{path} has another layout: keys {found.keys}, seq {found.seq}, {found.buckets} buckets, {found.keep}")
    return found
