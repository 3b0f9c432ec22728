"""The corpus pipeline: five stages from raw documents to token digests, each over all that the one before kept.

Language ID drops what it rejects; exact dedup and the n-gram Jaccard join keep one document of each group; mixing
samples to tempered source, language and topic marginals; the last stage encodes what is left. All stages but the
last return the columns of documents. Each result is written as Parquet and read again as the next stage's docs.

Defined cases: a null text, or one without letters, is rejected by the first stage, so the others meet none here; each would
take it (exact dedup as empty, the join as linked with nothing, mixing as without tokens, encoding as empty). A row whose id is
null stays in the join and is drawn by mixing as the empty id. Rows that repeat are one after exact dedup. Texts of any
length pass whole. Extra columns are carried along whatever their names; an empty table passes as empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.llm import bpe, exact_dedup, language_id, mixing, parity_join
from govlake.llm.common import shared_dir

#: Share of the tokens that mixing keeps.
FRACTION = 0.6


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled languages of docs; rejects texts without letters and those between two languages."""
    judged = language_id.judgement(spark, language_id.train(docs))
    return docs.select(F.struct("*").alias("row"), judged(F.col("text")).alias("judged")).where("NOT judged.rejected").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity_join.dedup(docs)


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, fraction=FRACTION)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_copies),
    ("parity_join", drop_near_copies),
    ("mixing", sample_mixture),
    ("byte_bpe", encode),
]

#: Compression, parity sketches and byte-pair merges have no SQL form; tests/llm holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
