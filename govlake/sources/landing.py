"""Landing: one append-only table of events from which catalog, snapshots, provenance and lineage are folded.

A landing writes the cleaned table, measures it on the way by an observation, and then appends one event, which is the only place where the landing is recorded: if the event is
not there, the table was not landed. Current state is a fold of the events: the latest of a dataset is its catalog record, all of them are its snapshots, each with the one before it as
parent, and their sources and targets are the edges of the lineage, each once. Nothing is stored twice, so nothing can disagree.

Each landing writes a version folder of its own, which the event names, so readers of the version before aren't disturbed and a landing that failed half-way leaves no trace but files that no
event names. One writer at a time for a dataset is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import privacy, provenance

EVENT = (
    "event string, at timestamp, dataset string, domain string, name string, operation string, principal string, source string, location string, rows long, nulls long, quality double, checksum string, "
    "fields array<struct<column:string,type:string,pii:boolean,sensitivity:string>>"
)


class Landings:
    """The events below a folder, and what they say."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        spark.createDataFrame([], EVENT).write.mode("append").parquet(f"{self.base}/events")

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT).parquet(f"{self.base}/events")

    def land(self, df: DataFrame, domain: str, name: str, principal: str, source: str, operation: str = "clean", at: Column | None = None, partition_by: Sequence[str] = ()) -> str:
        """Write a version of the dataset and its event; the id of the event."""
        event, dataset = uuid.uuid4().hex, f"{domain}/{name}"
        location = f"{self.base}/data/{dataset}/{event}"
        seen = Observation()
        nulls = sum((F.count_if(F.col("`" + c.replace("`", "``") + "`").isNull()) for c in df.columns), F.lit(0))
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), nulls.cast("long").alias("nulls")).write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(location)
        rows, empty = seen.get["rows"], seen.get["nulls"]
        stored = self.spark.read.parquet(location)
        kinds = dict(stored.dtypes)
        classes = privacy.classify(stored).collect() if stored.columns else []  # a row a column
        columns = F.array(*[F.struct(F.lit(r.column).alias("column"), F.lit(kinds[r.column]).alias("type"), F.lit(r.pii).alias("pii"), F.lit(r.sensitivity).alias("sensitivity")) for r in classes])
        cells = rows * len(df.columns)
        fact = provenance.digest(stored).select(
            F.lit(event).alias("event"), (F.current_timestamp() if at is None else at).alias("at"), F.lit(dataset).alias("dataset"), F.lit(domain).alias("domain"), F.lit(name).alias("name"), F.lit(operation).alias("operation"),
            F.lit(principal).alias("principal"), F.lit(source).alias("source"), F.lit(location).alias("location"), F.lit(rows).cast("long").alias("rows"), F.lit(empty).cast("long").alias("nulls"),
            F.lit(round(1 - empty / cells, 4) if cells else 1.0).alias("quality"), F.col("digest").cast("string").alias("checksum"), columns.cast("array<struct<column:string,type:string,pii:boolean,sensitivity:string>>").alias("fields"),
        )
        fact.write.mode("append").parquet(f"{self.base}/events")
        return event

    def snapshots(self) -> DataFrame:
        """(dataset, snapshot_id, parent_id, at, operation, rows, checksum, changed): every version, and whether its content differs from its parent's."""
        before = Window.partitionBy("dataset").orderBy("at", "event")
        e = self.events().withColumns({"parent_id": F.lag("event").over(before), "was": F.lag("checksum").over(before)})
        return e.select("dataset", F.col("event").alias("snapshot_id"), "parent_id", "at", "operation", "rows", "checksum", F.coalesce(F.col("was") != F.col("checksum"), F.lit(True)).alias("changed"))

    def catalog(self) -> DataFrame:
        """(id, name, domain, version, row_count, quality, pii_fields, sensitivity, location, checksum, updated_at): the latest of each dataset; version counts its landings."""
        last = F.max_by(F.struct("name", "domain", "rows", "quality", "location", "checksum", "fields", "at"), F.struct("at", "event"))
        e = self.events().groupBy("dataset").agg(last.alias("e"), F.count(F.lit(1)).cast("int").alias("version"))
        ranks = F.transform("e.fields", lambda f: privacy.rank(f["sensitivity"]))
        top = F.element_at(F.array(*[F.lit(r) for r in privacy.RANKS]), F.coalesce(F.array_max(ranks), F.lit(1)).cast("int"))
        return e.select(
            F.col("dataset").alias("id"), "e.name", "e.domain", "version", F.col("e.rows").alias("row_count"), "e.quality", F.size(F.filter("e.fields", lambda f: f["pii"])).alias("pii_fields"), top.alias("sensitivity"),
            "e.location", "e.checksum", F.col("e.at").alias("updated_at"),
        )

    def edges(self) -> DataFrame:
        """(src, dst, operation, first_at, last_at, runs): each edge once, however often it ran."""
        return self.events().groupBy(F.col("source").alias("src"), F.col("dataset").alias("dst"), "operation").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("runs"))

    def lineage(self) -> tuple[DataFrame, DataFrame]:
        """The whole graph: nodes(node, kind), a node being a dataset if it was landed and a source else, and edges(src, dst, operation)."""
        edges = self.edges().select("src", "dst", "operation")
        ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("landed")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("landed")))))
        return ends.groupBy("node").agg(F.when(F.max("landed") == 1, "dataset").otherwise("source").alias("kind")), edges

    def read(self, dataset: str, snapshot: str | None = None) -> DataFrame:
        """The rows of a dataset as of its latest landing, or of a snapshot."""
        mine = self.events().where(F.col("dataset") == dataset)
        found = mine.where(F.col("event") == snapshot) if snapshot else mine
        at = found.orderBy(F.desc("at"), F.desc("event")).select("location").first()
        if at is None:
            raise LookupError(f"{dataset} was never landed" + (f" as {snapshot}" if snapshot else ""))
        return self.spark.read.parquet(at.location)
