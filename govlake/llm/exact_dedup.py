"""Exact dedup by skew-safe combining: local, then salted digest groups, then salt winners; DataFrame functions only.

Every stage groups by the digest and the whole normalised text, so texts are compared in full and the digest
only chooses the partition. A group of copies that holds a third of all rows leaves one row per task and salt
after the map-side combine of the first stage, and at most `salts` rows before the last.

Defined cases: an empty table gives no rows; texts of any length are compared whole; a null text counts as empty. A null id loses to any other id; a group with null ids only has
the null keep_id. Of rows that repeat the kept id and its text, one is kept. `decisions` reads no other columns; `dedup` carries
them along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS


def normalised(text: str = "text") -> Column:
    """The text with each run of ASCII white space as one blank; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")


def _hashed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), normalised(text).alias("norm")).select("id", "norm", F.unhex(F.sha2("norm", 256)).alias("digest"))


def winners(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """One row (digest, check, keep_id, group_size) for each distinct normalised text. check is a second hash of the text, for joins."""
    salted = (
        _hashed(docs, id_col, text)
        .groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "norm")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    last = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return last.select("digest", F.xxhash64("norm").alias("check"), "keep_id", "group_size")


def decisions(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) for each row of docs, dropped ones too."""
    rows = _hashed(docs, id_col, text).select("id", "digest", F.xxhash64("norm").alias("check"))
    out = rows.join(winners(docs, id_col, text, salts), ["digest", "check"])
    repeats = F.row_number().over(Window.partitionBy("digest", "id").orderBy("check"))
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (repeats == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    The row with the least id rides along in each stage, so there is no join back; a row's text is beside its normalised
    text there, and they compress together.
    """
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")).alias("rank"), normalised(text).alias("norm"))
    best = (F.min_by("row", "rank").alias("row"), F.min("rank").alias("rank"))
    salted = rows.groupBy(F.unhex(F.sha2("norm", 256)).alias("digest"), F.pmod(F.xxhash64("rank"), F.lit(salts)).alias("salt"), "norm").agg(*best)
    return salted.groupBy("digest", "norm").agg(best[0]).select("row.*")
