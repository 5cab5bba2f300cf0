"""A training corpus from raw documents: quality rules, exact and near duplicates, source mixing, token ids.

Defined cases: null and empty texts fail the quality rules, so later stages don't see them in run(); each stage alone takes
them as its operator says. Rows without a doc_id are documents like others: of equal texts one stays, they are near copies
of others but never stand for them, and they share one point of the mixture. Columns of any name pass through all stages but the last.
An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import block_naming, byte_bpe, near_copies, quality_rules, source_mixing
from spanloom.scratch import clear, materialize
from spanloom.session import ship


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality_rules.keep_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship(spark)
    return block_naming.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return near_copies.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target rate draws them, in random order."""
    return source_mixing.mix(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the text decoded from them."""
    ship(spark)
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select("doc_id", "ids", decoded["decoded"].cast("string").alias("text"))


STAGES = [("quality rules", rules), ("exact dedup", exact), ("simhash near-dedup", near), ("source mixing", mixing), ("byte-level BPE", tokens)]

#: Compression ratios and fingerprints are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write run()'s rows to ``path`` as Parquet, then delete what the stages left in the shared folder."""
    run(spark, sf_dir).write.parquet(path)
    clear(spark)
