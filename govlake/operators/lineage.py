"""Lineage edges(src, dst, operation, run_id, at): walks, coverage, depth of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut, walk


def upstream_downstream(edges: DataFrame, node: str) -> DataFrame:
    """(node, side): direct neighbours of a node."""
    up = edges.where(F.col("dst") == node).select(F.col("src").alias("node"), F.lit("upstream").alias("side"))
    return up.union(edges.where(F.col("src") == node).select(F.col("dst").alias("node"), F.lit("downstream").alias("side"))).distinct()


def lineage(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    return walk(edges, starts, depth)


def nodes(edges: DataFrame) -> DataFrame:
    """(node, kind): source if nothing flows into it, sink if nothing flows out, else step."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.max("out").alias("out"), F.max("into").alias("into")).select("node", F.when(F.col("into") == 0, "source").when(F.col("out") == 0, "sink").otherwise("step").alias("kind"))


def coverage(datasets: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: share of datasets(dataset) that an edge touches."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias("dataset")).distinct().withColumn("hit", F.lit(1))
    return datasets.select("dataset").distinct().join(touched, "dataset", "left").agg(F.count(F.lit(1)).alias("datasets"), F.count("hit").alias("covered"), F.coalesce(F.round(F.try_divide(F.count("hit"), F.count(F.lit(1))), 4), F.lit(0.0)).alias("coverage"))


def depths(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, depth): the longest path from a source; a cycle stops adding to it after `rounds`."""
    pairs = edges.select("src", "dst").where("src <> dst").distinct()
    level = nodes(edges).select("node", F.lit(0).alias("depth"))
    for _ in range(rounds):
        longer = level.join(pairs, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg((F.max("depth") + 1).alias("next"))
        new = cut(level.join(longer, "node", "left").select("node", F.greatest("depth", F.coalesce("next", F.lit(0))).alias("depth"), (F.coalesce("next", F.lit(0)) > F.col("depth")).alias("moved")))
        level = new.select("node", "depth")
        if new.where("moved").isEmpty():
            break
    return level
