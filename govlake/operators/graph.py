"""Entities, relations and graph walks. Walks go one join a round, from a frontier that is written to the checkpoint folder."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import keyed
from ..sources.shared import shared_dir, write_shared


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint, in the folder of spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def token(c: Column) -> Column:
    return F.lower(X.strip(c))


def tokens(entities: DataFrame) -> DataFrame:
    """(token, id, seq): what each of entities(id, seq, label, aliases) is called."""
    names = F.concat(F.array("id", "label"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = entities.select("id", "seq", F.explode(F.array_distinct(F.transform(names, token))).alias("token"))
    return each.where("token <> ''").select("token", "id", "seq")


def alias_index(entities: DataFrame) -> DataFrame:
    """(token, id) from entities(id, seq, label, aliases): the entity of least seq has a token."""
    return tokens(entities).groupBy("token").agg(F.min_by("id", F.struct("seq", "id")).alias("id"))


class Graph(NamedTuple):
    """Stored entities and relations (the latest of a key counts) and the index of their names (a name is its first writer's for good)."""

    entities: keyed.KeyedTable
    aliases: keyed.KeyedTable
    relations: keyed.KeyedTable


ENTITY = "id string, type string, domain string, label string, aliases array<string>, properties map<string,string>, seq long"
ALIAS = "token string, id string, seq long"
RELATION = "src string, dst string, type string, properties string, seq long"


def store(spark: SparkSession, path: str, buckets: int = 64) -> Graph:
    """The graph below a folder, made if it isn't there."""
    return Graph(
        keyed.create(spark, f"{path}/entities", ENTITY, ["id"], buckets=buckets), keyed.create(spark, f"{path}/aliases", ALIAS, ["token"], buckets=buckets, keep="first"),
        keyed.create(spark, f"{path}/relations", RELATION, ["src", "dst", "type"], buckets=buckets),
    )


def upsert_entities(graph: Graph, batch: DataFrame) -> None:
    """Entities by id, and their names into the index: all names of the batch, also of rows that another of the same id replaces, as each was written once.

    Of two entities that claim a name at the same seq the one of the lesser id has it.
    """
    batch = write_shared(batch, "entities")
    names = tokens(batch).groupBy("token").agg(F.min(F.struct("seq", "id")).alias("m")).select("token", "m.id", "m.seq")
    graph.aliases.upsert(names)
    graph.entities.upsert(batch)


def upsert_relations(graph: Graph, batch: DataFrame) -> None:
    """Relations by their ends and type."""
    graph.relations.upsert(batch)


def resolve(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """mentions(mention) with the id that each resolves to, else itself."""
    return mentions.join(index, token(F.col("mention")) == F.col("token"), "left").select("mention", F.coalesce("id", "mention").alias("resolved"), F.col("id").isNotNull().alias("known"))


def walk(edges: DataFrame, starts: DataFrame, depth: int = 3, directed: str = "both") -> DataFrame:
    """(start, node, distance) within depth steps over edges(src, dst); the start itself is left out.

    Starts with the starts(start) and joins the frontier with the edges once a round: the work follows the
    nodes reached. directed: both, down (src to dst) or up.
    """
    pairs = edges.select("src", "dst").distinct()
    turned = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = {"down": pairs, "up": turned, "both": pairs.union(turned).distinct()}[directed]
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance")).distinct()
    frontier = seen
    for k in range(1, depth + 1):
        step = frontier.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(k)))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen.where("distance > 0")


def walked_edges(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, src, dst, type): distinct edges that a walk of both directions crosses."""
    inside = walk(edges, starts, depth - 1).select("start", "node").unionByName(starts.select("start", F.col("start").alias("node"))) if depth > 1 else starts.select("start", F.col("start").alias("node"))
    from_src = inside.join(edges, F.col("node") == F.col("src")).select("start", "src", "dst", "type")
    return from_src.unionByName(inside.join(edges, F.col("node") == F.col("dst")).select("start", "src", "dst", "type")).distinct()


def cross_domain(relations: DataFrame, entities: DataFrame, shared: str = "shared") -> DataFrame:
    """Relations whose ends are of different domains, neither of them shared."""
    ends = entities.select("id", "domain")
    both = relations.join(ends.toDF("src", "src_domain"), "src").join(ends.toDF("dst", "dst_domain"), "dst")
    return both.where((F.col("src_domain") != F.col("dst_domain")) & (F.col("src_domain") != shared) & (F.col("dst_domain") != shared))


def match(entities: DataFrame, kind: str | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """Entities of a type with the given properties (a map column)."""
    out = entities if kind is None else entities.where(F.col("type") == kind)
    for k, v in (properties or {}).items():
        out = out.where(F.element_at("properties", k) == v)
    return out


def roll_up(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(type, entities, degree): entities of each type and the number of edge ends at them."""
    degree = relations.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    return entities.join(degree, "id", "left").groupBy("type").agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("d"), F.lit(0)).alias("degree"))


def board(entities: DataFrame, relations: DataFrame, shared: str = "shared") -> DataFrame:
    """(level, type, domain, entities, degree, cross_links): by type, by domain and in total.

    degree counts the ends of relations at the entities, cross_links those of relations to another domain, neither of them shared. Each end is looked up once; the levels are
    one aggregate over the entities with their counts.
    """
    ends = entities.select("id", "domain")
    linked = relations.select("src", "dst").join(ends.toDF("src", "src_domain"), "src", "left").join(ends.toDF("dst", "dst_domain"), "dst", "left")
    crosses = F.coalesce((F.col("src_domain") != F.col("dst_domain")) & (F.col("src_domain") != shared) & (F.col("dst_domain") != shared), F.lit(False))
    each = linked.select(F.explode(F.array("src", "dst")).alias("id"), crosses.cast("int").alias("x")).groupBy("id").agg(F.count(F.lit(1)).alias("d"), F.sum("x").alias("x"))
    sets = entities.join(each, "id", "left").groupingSets([["type"], ["domain"], []], "type", "domain")
    level = F.when(F.grouping_id("type", "domain") == 3, "total").when(F.grouping("domain") == 1, "type").otherwise("domain")
    return sets.agg(level.alias("level"), F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("d"), F.lit(0)).alias("degree"), F.coalesce(F.sum("x"), F.lit(0)).alias("cross_links"))
