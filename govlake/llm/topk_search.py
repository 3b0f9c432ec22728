"""Exact top-k search by inner product: tiled matrix products of queries and shards, selection in each tile, merged as a tree.

Rows are packed into tiles of about TILE bytes; tiles are dealt in turn to shard groups, and queries by hash to query groups, of about CHUNK bytes each. A task
holds one query group and one shard group, multiplies them tile by tile and keeps each query's best k + 1, so what moves is every row once for each query group and
every query once for each shard group, whatever ids or copies are frequent. The lists of a query then meet FAN at a time until one is left. The own row of a
query is taken out at the end, one of as many as repeat it.

Scores are exact: components are scaled and floored to integers, and products run in doubles only where no sum can reach 2**53, else in longs, else in
Python's integers.

Defined cases: vectors that are null or hold null or non-finite components take no part; those of other lengths than the query's are no candidates (empty ones
score 0 among themselves). A null id is no query, and as a candidate comes last among equal scores. Rows that repeat an id are each a query and a candidate. A component or score beyond
a long is an error. Empty tables give no rows. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, write_shared

#: Bytes of a tile and of a group of tiles, its components counted as eight bytes each.
TILE, CHUNK = 4 << 20, 32 << 20
#: Queries multiplied with a tile at a time; lists of a query that meet at a time.
BLOCK, FAN = 256, 16
TILE_COLUMNS = "width int, ids binary, missing int, bits int, components binary, tags binary, copies binary"


def usable(vector: str) -> Column:
    """Whether a vector is neither null nor holds null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component as long."""

    def one(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < float(1 << 63), F.floor(y)).otherwise(F.raise_error(F.lit("a component is beyond a long")).cast("long"))

    return F.transform(vector, one)


def _tile(table: pa.Table) -> Iterator[dict]:
    """A tile for each length of vector of the rows (id, v), and of tag and copies where they have them. Null ids come last."""
    vectors = table.column("v").combine_chunks()
    lengths, flat = np.asarray(vectors.value_lengths()), vectors.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    ids = table.column("id").to_pylist()
    for width in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == width)
        at = np.array(sorted(at.tolist(), key=lambda i: (ids[i] is None, ids[i] or 0)))
        values = flat[(starts[at][:, None] + np.arange(width)).ravel()]
        bits = next(b for b in (8, 16, 32, 64) if not len(values) or (-(1 << b - 1) <= values.min() and values.max() < 1 << b - 1))
        named = {"tags": b"", "copies": b""}
        if "tag" in table.column_names:
            tags, copies = table.column("tag").to_pylist(), table.column("copies").to_numpy()
            named = {"tags": b"".join(tags[i] for i in at), "copies": copies[at].astype(np.int64).tobytes()}
        yield {
            "width": width, "ids": np.array([ids[i] or 0 for i in at], np.int64).tobytes(), "missing": sum(ids[i] is None for i in at),
            "bits": bits, "components": values.astype(f"i{bits // 8}").tobytes(), **named,
        }


def _packed(groups: int):
    """Rows (id, v) of a partition -> tiles, dealt in turn to the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("missing", pa.int32()), ("bits", pa.int32()), ("components", pa.binary()), ("tags", pa.binary()), ("copies", pa.binary())])
        held, size, turn = [], 0, TaskContext.get().partitionId()

        def tiles() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([t | {"g": turn % groups} for t in _tile(pa.Table.from_batches(held))], schema=schema)

        for batch in batches:
            while batch.num_rows:
                each = 8 * (1 + len(batch.column(1).flatten()) // batch.num_rows)
                take = batch.slice(0, max(1, (TILE - size) // each))
                held, size, batch = [*held, take], size + take.num_rows * each, batch.slice(take.num_rows)
                if size >= TILE:
                    yield tiles()
                    held, size, turn = [], 0, turn + 1
        if held:
            yield tiles()

    return run


def _group_tiles(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    found = list(_tile(table))
    schema = pa.schema([("h", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("missing", pa.int32()), ("bits", pa.int32()), ("components", pa.binary()), ("tags", pa.binary()), ("copies", pa.binary())])
    return pa.Table.from_pylist([t | {"h": key[0].as_py()} for t in found], schema=schema)


def products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = (max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (queries, tile))
    bound = math.prod(most) * queries.shape[1]
    if bound < 1 << 53:
        return (queries.astype(np.float64) @ tile.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return queries.astype(np.int64) @ tile.astype(np.int64).T
    exact = queries.astype(object) @ tile.astype(object).T
    if max(exact.max(), -exact.min()) >= 1 << 63:
        raise OverflowError("a score is beyond a long")
    return exact.astype(np.int64)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, rows in order and best first, ties to the earlier column."""
    n = scores.shape[1]
    enough = np.partition(scores, n - k, axis=1)[:, n - k, None] if n > k else np.iinfo(np.int64).min
    row, column = np.nonzero(scores >= enough)
    order = np.lexsort((column, ~scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], column[kept]


def _read(tile: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, whether missing, components) of a tile."""
    ids = np.frombuffer(tile["ids"], np.int64)
    return ids, np.arange(len(ids)) >= len(ids) - tile["missing"], np.frombuffer(tile["components"], f"i{tile['bits'] // 8}").reshape(len(ids), tile["width"])


LIST = pa.struct([("s", pa.int64()), ("missing", pa.bool_()), ("id", pa.int64())])


def _cell(k: int):
    """The best k of each query of a query group in a shard group. A score is kept as its complement, so that the best comes first in ascending order."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "tag": [], "own": [], "copies": [], "node": [], "top": []}
        kinds = {"query_id": pa.int64(), "tag": pa.binary(), "own": pa.int64(), "copies": pa.int64(), "node": pa.int32(), "top": pa.list_(LIST)}
        shards = {}
        for tile in right.to_pylist():
            shards.setdefault(tile["width"], []).append(_read(tile))
        chunks = [pa.table({n: pa.array([], t) for n, t in kinds.items()})]
        for tile in left.to_pylist():
            ids, _, vectors = _read(tile)
            copies = np.frombuffer(tile["copies"], np.int64)
            for start in range(0, len(ids) if tile["width"] in shards else 0, BLOCK):
                block = vectors[start : start + BLOCK]
                found = []
                for names, missing, components in shards[tile["width"]]:
                    scores = products(block, components)
                    row, column = best(scores, k)
                    found.append((row, ~scores[row, column], missing[column], names[column]))
                row, s, missing, name = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((name, missing, s, row))
                row, s, missing, name = row[order], s[order], missing[order], name[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, s, missing, name = row[kept], s[kept], missing[kept], name[kept]
                n = len(block)
                offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
                entries = pa.StructArray.from_arrays([pa.array(s), pa.array(missing), pa.array(name, mask=missing)], fields=list(LIST))
                own = [int(products(block[i : i + 1], block[i : i + 1])[0, 0]) for i in range(n)]
                at = range(start, start + n)
                chunks.append(pa.table({
                    "query_id": pa.array(ids[start : start + n]), "tag": pa.array([tile["tags"][32 * i : 32 * i + 32] for i in at], pa.binary()), "own": pa.array(own, pa.int64()),
                    "copies": pa.array(copies[start : start + n]), "node": pa.array([key[1].as_py()] * n, pa.int32()), "top": pa.ListArray.from_arrays(offsets, entries),
                }))
        return pa.concat_tables([c.cast(chunks[0].schema) for c in chunks])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024, own: bool = True) -> DataFrame:
    """(query_id, rank from 1, id_col, score): the k rows with the highest integer inner product for each row of queries, ties to the smaller id.

    own: each query is itself a row of rows, which doesn't count. Both tables have id_col, an integer, and vector.
    """
    spark = rows.sparkSession
    cut = lambda df: df.where(usable(vector)).select(F.col(id_col).cast("long").alias("id"), integers(vector, scale).alias("v"))
    asked = cut(queries.where(F.col(id_col).isNotNull())).groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies")).withColumn("tag", F.unhex(F.sha2(F.array_join("v", ",").cast("binary"), 256)))
    asked = write_shared(asked, "queries")
    weight = F.coalesce(F.sum(8 * F.greatest(F.size("v"), F.lit(1))), F.lit(0))
    h = max(1, math.ceil(asked.agg(weight).first()[0] / CHUNK))
    g = max(parts(spark), math.ceil(cut(rows).agg(weight).first()[0] / CHUNK))
    left = asked.withColumn("h", F.pmod(F.xxhash64("tag", "id"), F.lit(h)).cast("int")).groupBy("h").applyInArrow(_group_tiles, f"h int, {TILE_COLUMNS}")
    left = left.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    right = cut(rows).mapInArrow(_packed(g), f"g int, {TILE_COLUMNS}").withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
    more = k + 1 if own else k
    lists = left.groupBy("h", "g").cogroup(right.groupBy("h", "g")).applyInArrow(_cell(more), "query_id long, tag binary, own long, copies long, node int, top array<struct<s:long,missing:boolean,id:long>>")
    while True:
        merged = F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, more)
        lists = lists.groupBy("query_id", "tag", F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(merged.alias("top"), F.min("own").alias("own"), F.min("copies").alias("copies"))
        g = math.ceil(g / FAN)
        if g == 1:
            break
    top = F.col("top")
    if own:
        at = F.array_position("top", F.struct(F.bitwise_not("own").alias("s"), F.lit(False).alias("missing"), F.col("query_id").alias("id")))
        top = F.filter("top", lambda _, i: i + 1 != at)
    each = lists.withColumn("top", F.slice(top, 1, k)).select("query_id", F.explode(F.array_repeat("top", F.col("copies").cast("int"))).alias("top"))
    return each.select("query_id", F.posexplode("top").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias(id_col), F.bitwise_not("x.s").alias("score"))
