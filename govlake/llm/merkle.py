"""Merkle dataset manifest by concatenated-level strings, in SQL functions.

Rows are leaves of one tree for each group, in order of an id; the groups' roots are leaves of the tree of the whole table. A run of ARITY consecutive nodes of
a level is hashed to their parent. Aligned blocks of BLOCK = ARITY ** LEVELS consecutive nodes keep each of their levels as one string of hex digests:
fixed-width substrings of one level, hashed and joined, are the next, so that a block of 512 leaves is four strings and one node for the blocks
above, where the same recurs until one node is left. A leaf's proof is read off going down: in each level of its block, what flanks its
node in its run is a segment (left, right), and a block hands the segments above it to its children.

A leaf moves through shuffles as two digests and an id; texts stay where they are read. The tasks of a block hold BLOCK leaves, and a
group of any size is split by range of id. Levels are written to the shared folder, as they are read going up and down.

Defined cases: nulls in a field are `-`; null ids and a null group come first; rows with the same id are ordered by their leaf, and equal rows are interchangeable.
Empty texts and texts of any length are hashed whole. A group of one leaf has that leaf as its root, a table of one group that group's root; an
empty table gives no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.export import numbered
from .common import write_shared

HEX, ARITY, LEVELS = 64, 8, 3
RUN, BLOCK = HEX * ARITY, ARITY**LEVELS
#: Fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Manifest(NamedTuple):
    """blocks: of each super-level from the leaves up, (key, block, size, deep, level0, level1, level2, top); those of the first also have entries. roots: (key, subroot, root, path)."""

    blocks: list[DataFrame]
    roots: DataFrame


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value, integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _piece(level: Column, run: Column) -> Column:
    return F.substring(level, run * RUN + 1, F.lit(RUN))


def _parents(level: Column) -> Column:
    """The digests of a level's runs, joined: the level above."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(_piece(level, i).cast("binary"), 256)), "")


def _deep(size: Column) -> Column:
    """Levels above the leaves of a tree of that size."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda d: F.pow(F.lit(float(ARITY)), d) < size))


def _levels(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Blocks of (key, size, deep, place, node, carried): the strings of their levels and the node that they are above."""
    held = F.sort_array(F.collect_list(F.struct("place", "node", *carried)))
    blocks = nodes.groupBy("key", "size", "deep", F.floor(F.col("place") / BLOCK).alias("block")).agg(held.alias("entries"))
    blocks = blocks.withColumn("level0", F.array_join(F.transform("entries", lambda e: e["node"]), ""))
    for k in range(1, LEVELS + 1):
        blocks = blocks.withColumn(f"level{k}", F.when(F.col("deep") >= k, _parents(F.col(f"level{k - 1}"))))
    top = F.coalesce(*[F.col(f"level{k}") for k in range(LEVELS, -1, -1)])
    if carried:
        blocks = blocks.withColumn("entries", F.transform("entries", lambda e: F.struct(*[e[c].alias(c) for c in carried])))
    return blocks.withColumn("top", top).drop(f"level{LEVELS}", *([] if carried else ["entries"]))


def _tree(nodes: DataFrame, deepest: int, carried: Sequence[str] = ()) -> list[DataFrame]:
    """Super-levels of blocks above (key, size, place, node, carried), the last with one block a key, whose top is its root."""
    nodes = nodes.withColumn("deep", _deep(F.col("size")))
    out = [write_shared(_levels(nodes, carried), "merkle")]
    for _ in range(LEVELS, deepest, LEVELS):
        above = out[-1].select("key", "size", F.greatest(F.col("deep") - LEVELS, F.lit(0)).alias("deep"), F.col("block").alias("place"), F.col("top").alias("node"))
        out.append(write_shared(_levels(above), "merkle"))
    return out


def _segment(run: Column, place: Column) -> Column:
    """What flanks a node of a run."""
    at = F.pmod(place, F.lit(ARITY)).cast("int") * HEX
    return F.struct(F.substring(run, F.lit(1), at).alias("left"), F.substring(run, at + HEX + 1, F.lit(RUN)).alias("right"))


def _down(blocks: DataFrame, above: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """(key, place, path, node, carried) of each node of the blocks: its segments up to the root, above giving those of (key, block)."""
    one = F.array().cast("array<struct<left:string,right:string>>")
    # a run of leaves at a time, so that the long strings are cut once for eight leaves
    runs = blocks.join(above, ["key", "block"]).withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.length("level0") - 1) / RUN).cast("int"))))
    pieces = runs.select(
        "key", "block", "deep", "run", "path", _piece(F.col("level0"), F.col("run")).alias("piece0"),
        _piece(F.col("level1"), F.floor(F.col("run") / ARITY).cast("int")).alias("piece1"), _piece(F.col("level2"), F.lit(0)).alias("piece2"),
        *([F.slice("entries", F.col("run") * ARITY + 1, ARITY).alias("entries")] if carried else []),
    )
    each = pieces.withColumn("slot", F.explode(F.sequence(F.lit(0), (F.length("piece0") / HEX).cast("int") - 1)))
    segments = F.array(_segment(F.col("piece0"), F.col("slot")), _segment(F.col("piece1"), F.col("run")), _segment(F.col("piece2"), F.floor(F.col("run") / ARITY)))
    path = F.concat(F.slice(segments, 1, F.least("deep", F.lit(LEVELS))), F.coalesce("path", one))
    node = F.substring(F.col("piece0"), F.col("slot") * HEX + 1, F.lit(HEX))
    more = [F.element_at("entries", F.col("slot") + 1)[c].alias(c) for c in carried]
    return each.select("key", (F.col("block") * BLOCK + F.col("run") * ARITY + F.col("slot")).alias("place"), path.alias("path"), node.alias("node"), *more)


def _paths(blocks: list[DataFrame], roots: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """(key, place, path, node, carried) of each leaf below the roots (key, path)."""
    above = roots.select("key", F.lit(0).cast("long").alias("block"), "path")
    for level in blocks[:0:-1]:
        above = _down(level, above).select("key", F.col("place").alias("block"), "path")
    return _down(blocks[0], above, carried)


def build(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS, carried: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs: a tree for each value of group, its leaves by order, and the tree above them. carried: more columns to keep beside each leaf, by name."""
    extra = carried or {}
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(key.alias("key"), F.col(order).alias("id"), F.unhex(leaf([F.col(c) for c in fields])).alias("digest"), *[v.alias(c) for c, v in extra.items()], F.monotonically_increasing_id().alias("tie"))
    rows = write_shared(rows, "digests")  # texts are read once, not again for the borders of the ranges
    dense = numbered(rows, ["key", "id", "digest", "tie"])
    dense = write_shared(dense.drop("tie"), "leaves")
    groups = write_shared(dense.groupBy("key").agg(F.min("_i").alias("first"), F.count(F.lit(1)).alias("size")), "groups")
    largest, count = groups.agg(F.max("size"), F.count(F.lit(1))).first()
    nodes = dense.join(groups, "key").select("key", "size", (F.col("_i") - F.col("first")).alias("place"), F.lower(F.hex("digest")).alias("node"), "id", *extra)
    depth = lambda n: next(d for d in range(64) if ARITY**d >= (n or 0))
    blocks = _tree(nodes, depth(largest), ["id", *extra])
    tops = numbered(blocks[-1].select("key", F.col("top").alias("node")), ["key"])
    tops = write_shared(tops.select(F.lit("").alias("key"), F.lit(count).alias("size"), F.col("_i").alias("place"), "node", F.col("key").alias("group")), "subroots")
    over = _tree(tops, depth(count), ["group"])
    root = over[-1].select("key", F.col("top").alias("root"))
    whole = root.select("key", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    paths = _paths(over, whole, ["group"]).join(root, "key").select(F.col("group").alias("key"), F.col("node").alias("subroot"), "root", "path")
    return Manifest(blocks, write_shared(paths, "roots"))


def proofs(manifest: Manifest, carried: Sequence[str] = ()) -> DataFrame:
    """(id, leaf, path, subroot, root, carried): each leaf with its segments (left, right) from its run to the root."""
    below = _paths(manifest.blocks, manifest.roots, ["id", *carried])
    return below.join(manifest.roots.drop("path"), "key").select("id", F.col("node").alias("leaf"), "path", "subroot", "root", *carried)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its segments give."""
    return F.aggregate(path, node, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, from the leaf's run up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
