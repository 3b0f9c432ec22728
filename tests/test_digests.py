"""Digests that see order, microseconds and places of nulls, and the walk to what differs."""

import datetime

from pyspark.sql import functions as F

from govlake.operators import provenance


def tree_root(df, order=("k",)):
    return provenance.root(provenance.hash_tree(df, list(order), 4, 2)).first().digest


def test_roots_differ_iff_the_tables_do(spark):
    at = datetime.datetime(2024, 1, 1, 0, 0, 0, 123456)
    make = lambda rows: spark.createDataFrame(rows, "k int, a string, b string, t timestamp, n timestamp_ntz, `x.y` array<string>")
    rows = [(i, "v", None, at, at, ["p", None]) for i in range(37)]
    first = tree_root(make(rows))
    assert tree_root(make(rows[::-1]).repartition(5)) == first
    later = at.replace(microsecond=123999)
    for changed in [(5, None, "v", at, at, ["p", None]), (5, "v", None, later, at, ["p", None]), (5, "v", None, at, later, ["p", None]), (5, "v", "", at, at, ["p", None]), (5, "v", None, at, at, ["p"]), (99, "v", None, at, at, ["p", None])]:
        assert tree_root(make([changed if r[0] == 5 else r for r in rows])) != first
        if changed[0] == 5:
            assert provenance.digest(make([changed if r[0] == 5 else r for r in rows])).first().digest != provenance.digest(make(rows)).first().digest
    assert tree_root(make(rows[:-1])) != first
    # rows in another order: a column that gives the place is the order
    placed = spark.createDataFrame([(0, "x"), (1, "y")], "place int, v string")
    swapped = spark.createDataFrame([(0, "y"), (1, "x")], "place int, v string")
    assert tree_root(placed, ["place"]) != tree_root(swapped, ["place"]) and tree_root(placed.withColumnRenamed("v", "w"), ["place"]) != tree_root(placed, ["place"])


def test_walk_finds_the_chunk(spark):
    df = spark.range(1000).withColumn("v", F.lit("x"))
    tree = lambda d: provenance.hash_tree(d, ["id"], 10, 4)
    old = tree(df)
    new = tree(df.withColumn("v", F.when(F.col("id").isin(123, 128, 777), "y").otherwise(F.col("v"))))
    assert sorted(r.node for r in provenance.changed_chunks(old, new, 4).collect()) == [12, 77]
    assert provenance.changed_chunks(old, tree(df.repartition(7)), 4).count() == 0
    longer = provenance.changed_chunks(old, tree(spark.range(1500).withColumn("v", F.lit("x"))), 4).collect()
    assert sorted(r.node for r in longer) == list(range(100, 150)) and {(r.rows_before, r.rows_after) for r in longer} == {(0, 10)}
    empty = tree(df.limit(0))
    assert empty.count() == 0 and provenance.changed_chunks(old, empty, 4).count() == 100 and provenance.changed_chunks(empty, empty, 4).count() == 0
