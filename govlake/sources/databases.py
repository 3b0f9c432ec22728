"""Databases by JDBC: the list of tables, and reads in balanced parts with the true count and whether a cap cut them.

Bounds of the parts are quantiles of the key's values as they are, from one read of the key column alone, so a key with gaps or with most rows in one corner still gives parts of equal size; fixed bounds
between least and greatest wouldn't. The same read counts the rows. A single value that is many rows stays in one part, as no range of the key can split it.
"""

from __future__ import annotations

import datetime
import decimal
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redact_url
from ..operators import quantiles

#: What lists the tables, by the database in the url.
TABLES = {
    "postgresql": "SELECT table_name AS name FROM information_schema.tables WHERE table_schema NOT IN ('pg_catalog', 'information_schema')",
    "mysql": "SELECT table_name AS name FROM information_schema.tables WHERE table_schema = database()",
    "sqlite": "SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%'",
    "derby": "SELECT TABLENAME AS name FROM SYS.SYSTABLES WHERE TABLETYPE IN ('T', 'V')",
}


@dataclass(frozen=True)
class Read:
    """rows, and one row of facts(source, table, row_estimate, rows_read, truncated), the url without credentials."""

    rows: DataFrame
    facts: DataFrame


def tables(spark: SparkSession, url: str, **options: str) -> list[str]:
    """Names of tables and views, sorted."""
    kind = url.split(":")[1]
    if kind not in TABLES:
        raise ValueError(f"no list of tables for {kind}")
    return sorted(r[0] for r in spark.read.format("jdbc").option("url", url).option("query", TABLES[kind]).options(**options).load().collect())


def _literal(v: object) -> str:
    if isinstance(v, bool) or not isinstance(v, (int, float, decimal.Decimal, str, datetime.date)):
        raise TypeError(f"a key can't hold {type(v).__name__}")
    return str(v) if isinstance(v, (int, float, decimal.Decimal)) else "'" + str(v).replace("'", "''") + "'"


def predicates(keys: DataFrame, key: str, parts: int, quote: str = '"') -> tuple[list[str], int]:
    """Conditions that deal a table into parts of about equal size by a key, each row in exactly one, and the number of rows."""
    ranks = [lambda n, i=i: F.floor(n * i / parts) for i in range(parts)]
    found = quantiles.at_ranks(keys.select(F.lit(1).alias("one"), F.col("`" + key.replace("`", "``") + "`").alias("key")), ["one"], F.col("key"), ranks).first()
    if found is None:
        return ["1 = 1"], 0
    name = quote + key.replace(quote, 2 * quote) + quote
    cuts = list(dict.fromkeys(v for v in (found[f"_r{i}"] for i in range(1, parts)) if v is not None))
    edges = [f"{name} >= {_literal(c)}" for c in cuts]
    whole = [" AND ".join(x for x in (lo, f"{name} < {_literal(hi)}" if hi is not None else "") if x) for lo, hi in zip(["", *edges], [*cuts, None], strict=True)]
    return [*(w or f"{name} IS NOT NULL" for w in whole), f"{name} IS NULL"], found["_n"]


def read(spark: SparkSession, url: str, table: str | None = None, key: str | None = None, parts: int = 8, limit: int | None = None, quote: str = '"', **options: str) -> Read:
    """A table, the first by name unless given, in `parts` parts by a key, or in one without; `limit` caps the rows, and the facts say so."""
    table = table or next(iter(tables(spark, url, **options)), None)
    if table is None:
        raise ValueError("no readable tables")
    source = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
    if key is None:
        rows, total = source, source.count()
    else:
        conditions, total = predicates(source.select("`" + key.replace("`", "``") + "`"), key, parts, quote)
        rows = spark.read.jdbc(url, table, predicates=conditions, properties=dict(options))
    kept = total if limit is None else min(limit, total)
    facts = spark.range(1).select(
        redact_url(F.lit(url)).alias("source"), F.lit(table).alias("table"), F.lit(total).cast("long").alias("row_estimate"), F.lit(kept).cast("long").alias("rows_read"), F.lit(kept < total).alias("truncated")
    )
    return Read(rows if limit is None else rows.limit(limit), facts)
