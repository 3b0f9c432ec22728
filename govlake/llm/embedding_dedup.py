"""Embedding near-dedup by sorted projection passes.

Each pass has its own random hyperplanes; the signs of a vector's projections, concatenated, are its hash. A pass
orders the vectors of each label lexicographically by that hash (a range partitioning and a sort, so no label
has to fit a task), compares each vector with its neighbours in a bounded window by cosine in double precision, and
unions the pairs that reach the threshold. The unions of all passes give the components. A pass misses a pair if it puts
more than a window, or a border of the range partitioning, between the two; a pair is lost if all passes miss it and nothing
else connects the two. `tests/llm` measures the share found against brute force.

A window holds few of the links of a vector amid thousands of near copies, so links are counted afterwards, exactly,
for the members of each component of three vectors or more: they are cut into tiles of `TILE`, and each pair of tiles
gives one number a vector. No pair is emitted. Work, and the vectors shuffled (size / TILE times each), grow with the
square of a component's size, as the count of links asks; the memory of a task doesn't.

Defined cases: vectors that are null, zero, or hold null or non-finite values, and rows with a null label, link with
nothing and are their own component. Vectors of other lengths than their neighbours' link with nothing of another
length. Rows that share an id are one vector if equal; else the first in array order is taken. Null ids are left out
of links and keep a null component. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Unions, connected_components, integer_id, parts, write_shared

#: Sign bits of a hash; rows of a block that is compared with itself and the next; rows of a tile of the exact count.
BITS, WINDOW, TILE = 48, 64, 1024


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = len(values[0]) if len(values) else 0
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square is too small or too large
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vector: str = "embedding"):
    """Whether a vector can link: not null or empty, all finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN counts as larger than any
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def hashes(vectors: DataFrame, passes: int, seed: int) -> DataFrame:
    """Adds `turns`, the hash of each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.asarray(batch.column(2).value_lengths())
            turns = np.zeros((batch.num_rows, passes), np.int64)
            for width in np.unique(lengths):
                at = np.flatnonzero(lengths == width)
                planes = np.random.default_rng([seed, int(width)]).standard_normal((passes * BITS, int(width)))
                signs = (_matrix(batch.column(2).take(pa.array(at))) @ planes.T > 0).reshape(len(at), passes, BITS)
                turns[at] = (signs * (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).sum(2)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, turns.size + 1, passes), pa.int32()), pa.array(turns.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=["id", "label", "vector", "turns"])

    return vectors.mapInArrow(run, f"id long, label {dict(vectors.dtypes)['label']}, vector {dict(vectors.dtypes)['vector']}, turns array<long>")


def _neighbours(threshold: float):
    """Rows of one pass in order -> edges (src, dst) of a forest over the pairs that reach the threshold within the windows."""

    def compare(ids: np.ndarray, groups: np.ndarray, units: np.ndarray) -> list[tuple[int, int]]:
        sets = Unions(len(ids))
        for i in range(0, len(ids), WINDOW):
            near = units[i : i + WINDOW] @ units[i : i + 2 * WINDOW].T
            same = groups[i : i + WINDOW, None] == groups[None, i : i + 2 * WINDOW]
            for a, b in zip(*np.nonzero(np.triu(near >= threshold, 1) & same), strict=True):
                sets.join(i + a, i + b)
        return [(int(ids[i]), int(ids[r])) for i in range(len(ids)) if (r := sets.root(i)) != i and ids[i] != ids[r]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # the last window of a batch meets the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([carry, batch] if carry is not None else [batch]).combine_chunks()
            lengths = np.asarray(table.column("vector").combine_chunks().value_lengths())
            _, labels = np.unique(np.array(table.column("label").to_pylist(), object).astype(str), return_inverse=True)
            groups = (labels * (table.column("turn").to_numpy().max() + 1) + table.column("turn").to_numpy()) * (lengths.max() + 1) + lengths
            edges = []
            for width in np.unique(lengths):
                at = np.flatnonzero(lengths == width)
                edges += compare(table.column("id").to_numpy()[at], groups[at], _unit(_matrix(table.column("vector").take(pa.array(at)))))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["src", "dst"])
            carry = table.slice(max(0, table.num_rows - WINDOW)).combine_chunks().to_batches()[0]

    return run


def _count(threshold: float):
    """For a pair of tiles of a component: how many of the one each vector of the other links with."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        lengths = np.asarray(table.column("vector").combine_chunks().value_lengths())
        n = np.zeros(len(ids), np.int64)
        for width in np.unique(lengths):
            left, right = np.flatnonzero((lengths == width) & (side == 0)), np.flatnonzero((lengths == width) & (side == 1))
            units = {k: _unit(_matrix(table.column("vector").take(pa.array(at)))) for k, at in ((0, left), (1, right)) if len(at)}
            if not len(left):
                continue
            if key[1].as_py() == key[2].as_py():
                n[left] += (units[0] @ units[0].T >= threshold).sum(1) - ((units[0] * units[0]).sum(1) >= threshold)
            elif len(right):
                near = units[0] @ units[1].T >= threshold
                n[left] += near.sum(1)
                n[right] += near.sum(0)
        return pa.table({"id": ids, "n": n})

    return run


def near_duplicates(
    table: DataFrame, threshold: float = 0.98, passes: int = 16, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 1
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row: links within its label, least id reachable, whether that is its own."""
    n = parts(table.sparkSession)
    kept_as = "array<float>" if dict(table.dtypes)[vector] == "array<float>" else "array<double>"
    rows = table.select(integer_id(table, id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast(kept_as).alias("vector"))
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector")).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.label", "x.vector")
    good = write_shared(hashes(good, passes, seed), "hashed")
    turns = good.select("label", "id", "vector", F.posexplode("turns").alias("turn", "hash"))
    ordered = turns.repartitionByRange(n, "turn", "label", "hash", "id").sortWithinPartitions("turn", "label", "hash", "id").select("id", "label", "vector", "turn")
    edges = ordered.mapInArrow(_neighbours(threshold), "src long, dst long")
    found = connected_components(edges)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    # tiles: a member's tile is chosen by hash; each tile meets itself and every other tile of its component once
    members = found.join(sizes, "component").join(good.select(F.col("id").alias("node"), "vector"), "node").select(
        F.col("node").alias("id"), "component", "vector", F.ceil(F.col("size") / F.lit(TILE)).cast("int").alias("tiles")
    ).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    meets = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    counted = meets.select("id", "vector", "component", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), (F.col("tile") > F.col("other")).cast("int").alias("side"))
    links = counted.groupBy("component", "a", "b").applyInArrow(_count(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    facts = links.join(found.withColumnRenamed("node", "id"), "id")
    out = rows.select("id").join(facts, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))
