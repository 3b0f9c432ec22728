"""Digests, keyed signatures, verdicts and chains of custody."""

from __future__ import annotations

import hashlib

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import write_shared


#: Nulls are written, and times to the microsecond.
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest): the count, and a sha256 in hex over sums of the rows' sha256, whatever their order.

    A row is hashed as JSON with its nulls and column names, so a value can't move to another column. Equal rows add up, they don't cancel.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), JSON), 256)
    lanes = [F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).alias(f"_{k}") for k in range(5)]
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *lanes)
    return sums.select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.coalesce(F.col(f"_{k}").cast("string"), F.lit("0")) for k in range(5)]), 256).alias("digest"))


def row_digest(df: DataFrame) -> Column:
    """sha256 of a row: for each column its name, and `-` for null, else the UTF-8 byte count, a colon and the value as text; so no value can pass for another, or for its neighbour's."""

    def text(f: T.StructField) -> Column:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, T.TimestampType):
            return F.unix_micros(c).cast("string")  # the instant, whatever the session's zone
        if isinstance(f.dataType, T.BinaryType):
            return F.hex(c)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return F.to_json(F.struct(c.alias("v")), JSON)
        return c.cast("string")

    parts = []
    for f in df.schema.fields:
        parts += [F.lit(f"{f.name}="), F.coalesce(F.concat(F.octet_length(text(f)).cast("string"), F.lit(":"), text(f)), F.lit("-")), F.lit(";")]
    return F.sha2(F.concat(*parts, F.lit("")).cast("binary"), 256)


def hash_tree(df: DataFrame, order: Sequence[str], chunk: int = 1024, fan: int = 64) -> DataFrame:
    """(level, node, rows, digest) over the rows in their order: level 0 has a digest for each `chunk` rows, each level above one for `fan` nodes below, the last one the root.

    Unlike `digest` it tells a changed order. Two tables of one order have the same root iff they have the same rows in the same places. A task holds the
    digests of one chunk or of one node's children, so a table of any size is digested in log(rows) small steps after one sort by range. Rows that the order
    doesn't part are ordered by their digest. An empty table has no nodes.
    """
    from .export import numbered

    rows = df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"_o{i}") for i, c in enumerate(order)], F.unhex(row_digest(df)).alias("h"))
    dense = numbered(write_shared(rows, "rows"), [f"_o{i}" for i in range(len(order))] + ["h"])
    joined = lambda c: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", c))), lambda x: x["h"]), "").cast("binary"), 256)
    leaves = dense.select(F.col("_i").alias("i"), F.lower(F.hex("h")).alias("h"))
    levels = [write_shared(leaves.groupBy(F.floor(F.col("i") / chunk).alias("node")).agg(F.count(F.lit(1)).alias("rows"), joined("h").alias("digest")), "tree")]
    nodes = levels[0].count()
    while nodes > 1:
        below = levels[-1].select(F.col("node").alias("i"), "rows", F.col("digest").alias("h"))
        levels.append(write_shared(below.groupBy(F.floor(F.col("i") / fan).alias("node")).agg(F.sum("rows").alias("rows"), joined("h").alias("digest")), "tree"))
        nodes = -(-nodes // fan)
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("level"), "node", "rows", "digest") for k, d in enumerate(levels)])


def root(tree: DataFrame) -> DataFrame:
    """One row (rows, digest) of a hash tree: those of its top."""
    return tree.agg(F.max_by("rows", "level").alias("rows"), F.max_by("digest", "level").alias("digest"))


def changed_chunks(old: DataFrame, new: DataFrame, fan: int = 64) -> DataFrame:
    """(node, rows_before, rows_after) of the chunks in which two hash trees of the same chunk and fan differ, found going down from the roots: only children of differing nodes are compared.

    A row that is added or lost moves all rows after it, so from its chunk on all differ; give a chunk by key its own tree where that matters.
    """
    one = lambda t, side: t.select("level", "node", F.col("digest").alias(side), F.col("rows").alias(f"rows_{side}"))
    tops = [t.agg(F.max("level")).first()[0] for t in (old, new)]
    both = one(old, "before").join(one(new, "after"), ["level", "node"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
    shared_top = min((t for t in tops if t is not None), default=0)
    at = both.where(F.col("level") == shared_top)
    for level in range(shared_top - 1, -1, -1):
        parents = at.select(F.col("node").alias("parent"))
        at = both.where(F.col("level") == level).join(parents, F.floor(F.col("node") / fan) == F.col("parent"), "left_semi")
    return at.select("node", F.coalesce("rows_before", F.lit(0)).alias("rows_before"), F.coalesce("rows_after", F.lit(0)).alias("rows_after"))


def sign(payload: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex of a text column, as two nested sha2. Plans hold the padded key: keep event logs as safe as it."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, payload.cast("binary")), 256))), 256)


def verify(assets: DataFrame, key: bytes) -> DataFrame:
    """assets(payload, checksum, signature) with checksum_match, signature_present, signature_match and valid."""
    facts = assets.withColumn("checksum_match", F.coalesce(F.sha2("payload", 256) == F.col("checksum"), F.lit(False))).withColumn("signature_present", F.col("signature").isNotNull())
    facts = facts.withColumn("signature_match", F.coalesce(sign(F.col("payload"), key) == F.col("signature"), F.lit(False)))
    return facts.withColumn("valid", F.col("checksum_match") & F.col("signature_match"))


def verdict(claimed: Column, match: Column, payload: Column, least_bytes: int = 16) -> Column:
    """struct(verdict, confidence): tampered .95, authentic .9, unverified .6, suspect .7 for payloads that are too short."""
    said = lambda v, c: F.struct(F.lit(v).alias("verdict"), F.lit(c).alias("confidence"))
    enough = F.octet_length(payload) >= least_bytes
    return F.when(claimed & ~match, said("tampered", 0.95)).when(claimed & match, said("authentic", 0.9)).when(F.coalesce(enough, F.lit(False)), said("unverified", 0.6)).otherwise(said("suspect", 0.7))


def chain(stored: DataFrame, attached: DataFrame) -> DataFrame:
    """Stored and attached records, each once, by time of capture."""
    return stored.unionByName(attached).dropDuplicates().orderBy("captured_at")


def capture(df: DataFrame, source: str, principal: str, method: str, at: Column | None = None) -> DataFrame:
    """A provenance record of an ingest, with the table's digest."""
    return digest(df).select(F.lit(source).alias("source"), F.lit(principal).alias("principal"), F.lit(method).alias("method"), (F.current_timestamp() if at is None else at).alias("captured_at"), "rows", F.col("digest").cast("string").alias("checksum"))
