"""Streams: JSON messages decoded, conformed and appended. A consumer group is a checkpoint of its own over the same source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def topic(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A watched folder as a stream. For a broker use spark.readStream.format("kafka") and the same functions."""
    reader = spark.readStream.schema(schema).format(format)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def produce(df: DataFrame, path: str, key: str, value: str) -> None:
    """Append (key, value) messages to the folder of a topic."""
    df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value")).write.mode("append").parquet(path)


def decode(messages: DataFrame, schema: T.StructType, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Messages as rows of the schema; those that aren't JSON objects are dropped. Works on batches and streams."""
    bad = "_malformed"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    parsed = F.from_json(F.col(value), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = messages.select(*keep, parsed.alias("p")).where(F.col("p").isNotNull() & F.col(f"p.{bad}").isNull())
    return rows.select(*keep, *[F.col(f"p.`{f.name}`").alias(f.name) for f in schema.fields])


def drain(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Everything available now, batch by batch, then stop. The checkpoint is the group's cursor."""
    query = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed(events: DataFrame, at: str, keys: list[str], value: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extra: tumbling sums with a watermark for late rows."""
    return events.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")
