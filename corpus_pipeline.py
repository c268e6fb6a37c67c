"""Corpus pipeline: five stages over ``documents``, each one operator of ``treeloom.llm``.

Every stage takes the documents that the one before it kept, written as Parquet
below ``spark.checkpoint.dir`` and read again, so a lost executor repeats at most
one stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm import byte_bpe, exact_dedup, minhash, mixing, quality
from treeloom.llm.common import prepare, table, written
from treeloom.llm.queries import domain_of_source, mixture_weights, pre_token_pattern, vocabulary

#: Share of the tokens that reach the mixing stage which it hands on.
MIXED_SHARE = 0.9
SEED = 17


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive quality model accepts."""
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, by the digest index."""
    prepare(spark)
    return exact_dedup.kept_documents(docs, exact_dedup.DigestIndex(spark))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, likeness 0.8)."""
    prepare(spark)
    return minhash.keep_one(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of a one-epoch mixture: repeats would undo the stages before."""
    prepare(spark)
    return mixing.take_mixture(docs, mixture_weights(), domain_of_source(), seed=SEED, share=MIXED_SHARE)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, with the digest of their decoded bytes."""
    prepare(spark)
    return byte_bpe.encode_digests(docs, vocabulary("byte_bpe_50k.tiktoken"), pre_token_pattern())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash", near_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encode_stage),
]

#: SQL cannot express the trained model and the encoder; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
