"""Topics with dense offsets: messages with keys and headers, polled by groups up to an exact number of records.

A topic is a Parquet table of messages, numbered from 0 in the order they were produced, a folder for each batch, and a keyed table of cursors. The end of the topic moves only once a
batch has been written, and a batch that failed half-way is overwritten by the next, as that starts at the same offset. A poll reads an interval of offsets, so its size is
exact; folders and row groups outside the interval are not read. Each group has its own cursor, and so sees the whole topic.

One producer at a time is assumed, and one poller for a group. `advance=False` leaves the cursor until `commit`, for at-least-once reading.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.export import numbered
from ..sources import keyed

MESSAGE = "offset long, key string, value string, headers map<string,string>, produced_at timestamp"
#: The cursor that stands for the topic's end; no group can have this name.
END = ""


@dataclass(frozen=True)
class Poll:
    """Messages with offsets from start up to end."""

    rows: DataFrame
    start: int
    end: int

    def __len__(self) -> int:
        return self.end - self.start


class Topic:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.cursors = keyed.create(spark, f"{self.path}/cursors", "name string, position long, seq long", ["name"], buckets=8)

    def _cursor(self, name: str) -> tuple[int, int]:
        found = self.cursors.get(name).first()
        return (found.position, found.seq) if found else (0, 0)

    def _move(self, name: str, position: int) -> None:
        _, seq = self._cursor(name)
        self.cursors.upsert(self.spark.range(1).select(F.lit(name).alias("name"), F.lit(position).cast("long").alias("position"), F.lit(seq + 1).cast("long").alias("seq")))

    def end(self) -> int:
        return self._cursor(END)[0]

    def produce(self, messages: DataFrame, order: Sequence[str]) -> tuple[int, int]:
        """Append messages(key, value, and headers, a map, where they have them), numbered by the order of the given columns; the interval of their offsets."""
        start = self.end()
        headers = F.col("headers") if "headers" in messages.columns else F.lit(None)
        rows = numbered(messages.select("key", "value", headers.cast("map<string,string>").alias("headers"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]), [f"_o{i}" for i in range(len(order))])
        at = f"{self.path}/log/_start={start}"
        out = rows.select((F.col("_i") + start).alias("offset"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "headers", F.current_timestamp().alias("produced_at"))
        out.sortWithinPartitions("offset").write.mode("overwrite").parquet(at)
        end = start + self.spark.read.parquet(at).count()
        self._move(END, end)
        return start, end

    def read(self, start: int, end: int) -> DataFrame:
        """The messages of an interval of offsets."""
        if end <= start:
            return self.spark.createDataFrame([], MESSAGE)
        log = self.spark.read.schema(f"{MESSAGE}, _start long").parquet(f"{self.path}/log")
        return log.where((F.col("_start") < end) & (F.col("offset") >= start) & (F.col("offset") < end)).drop("_start")

    def poll(self, group: str, max_records: int, advance: bool = True) -> Poll:
        """The next messages of a group, max_records of them or as many as there are."""
        if group == END or max_records < 1:
            raise ValueError("a group has a name, and a poll one record at least")
        start = self._cursor(group)[0]
        end = max(start, min(start + max_records, self.end()))
        if advance and end > start:
            self._move(group, end)
        return Poll(self.read(start, end), start, end)

    def commit(self, group: str, poll: Poll) -> None:
        self._move(group, poll.end)

    def seek(self, group: str, offset: int) -> None:
        self._move(group, offset)

    def drain(self, group: str, on_batch: Callable[[DataFrame], None], max_records: int = 1_000_000) -> int:
        """All that the group hasn't seen, poll by poll; a poll is committed once on_batch is through with it. How many messages there were."""
        seen = 0
        while len(poll := self.poll(group, max_records, advance=False)):
            on_batch(poll.rows)
            self.commit(group, poll)
            seen += len(poll)
        return seen
