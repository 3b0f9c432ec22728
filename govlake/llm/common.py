"""What several operators share: the shared folder, connected components, fixed patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the operators define words.
BLANKS = r"[\x20\x09-\x0D]+"
LETTERS_UP, LETTERS_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder serves a local master, whose executors are the driver's process; on a cluster that is an error.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="govlake-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it as Parquet to the shared folder and read it again. Lost executors cost nothing that is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def integer_id(docs: DataFrame, id_col: str) -> Column:
    """The id column as long; an error at once if it holds no integers."""
    kind = dict(docs.select(id_col).dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must hold integers, not {kind}")
    return F.col(id_col).cast("long")


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Rows kept from training: crc32 of the id's text is a multiple of folds. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


#: Edges up to this many are contracted in one task, a few MB; more than that go through rounds.
SMALL_EDGES = 200_000


class Unions:
    """Sets of rows 0 to n-1, each with its least row as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (src, dst), all of them -> each node with the least node reachable."""
    table = pa.Table.from_batches(list(batches), schema=pa.schema([("src", pa.int64()), ("dst", pa.int64())]))
    nodes, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("src", "dst")]), return_inverse=True)
    unions = Unions(len(nodes))
    for i, j in at.reshape(2, -1).T.tolist():
        unions.join(i, j)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[[unions.root(i) for i in range(len(nodes))]] if len(nodes) else nodes, pa.int64())], names=["node", "to"])


def _relabelled(labels: DataFrame | None, step: DataFrame) -> DataFrame:
    new = step.select("node", F.col("to").alias("label")) if labels is None else labels.join(step.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return write_shared(new, "labels")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(src, dst) -> (node, component): the smallest node reachable, for every node of an edge that isn't a loop.

    Randomised contraction: each round maps every node to the neighbour (or itself) of least hash, drops
    edges within a new node and keeps distinct ones, so the edges shrink by a constant share however long
    the paths are. The first round takes the least node itself, as most edges come as stars around their least node.
    What is left of at most SMALL_EDGES is contracted by one task. A hub is a key of map-side combined aggregates and of joins that AQE splits.
    Each round is written to the shared folder.
    """
    left = write_shared(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    labels = None
    for k in range(rounds):
        count = left.count()
        if not count:
            break
        if count <= SMALL_EDGES:
            step = left.coalesce(1).mapInArrow(_contract, "node long, to long")
            labels, left = _relabelled(labels, step), left.limit(0)
            continue
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rank = lambda c, k=k: (F.xxhash64(c, F.lit(k)) if k else F.col(c)).alias("h")
        least = F.min(F.struct(rank("dst"), F.col("dst").alias("v")))
        step = write_shared(
            both.groupBy("src").agg(least.alias("m")).select(
                F.col("src").alias("node"),
                F.when(F.struct(rank("src"), F.col("src").alias("v")) < F.col("m"), F.col("src")).otherwise(F.col("m.v")).alias("to"),
            ),
            "step",
        )
        labels = _relabelled(labels, step)
        left = (
            left.join(step.select(F.col("node").alias("src"), F.col("to").alias("a")), "src")
            .join(step.select(F.col("node").alias("dst"), F.col("to").alias("b")), "dst")
            .where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        )
        left = write_shared(left, "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if labels is None:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
