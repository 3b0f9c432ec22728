"""Compares a query with its SQL in DuckDB: names, row count and values, in any order."""

import datetime
import decimal
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if x != x else x + 0.0
    if isinstance(x, (datetime.date, decimal.Decimal)):
        return str(x)
    return x


def same(df, connection, sql):
    got = connection.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(([plain(r[n]) for n in order] for r in df.collect()), key=repr)
    theirs = sorted(([plain(r[names.index(n)]) for n in order] for r in got.fetchall()), key=repr)
    assert ours == theirs
