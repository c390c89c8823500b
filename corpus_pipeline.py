"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Toxic documents go, then exact and near copies, then the sources are mixed, and the documents drawn are encoded. Every
stage works on all rows that the one before it kept. All stages but the last return the columns of ``documents``.

Results that SQL can't express (a trained field, numpy merge rounds) are tested against brute force in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardframe.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from shardframe.llm.shared import table, written

#: The mix takes every document at least once; no source is repeated more often than this.
MAX_REPEATS = 2.0

ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_of(docs, model) < toxicity.THRESHOLD)


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.keep_first(docs, exact_dedup.exact_dedup(docs))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return jaccard_join.keep_first(docs, jaccard_join.jaccard_join(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources again up to the limit on repeats."""
    drawn = mixing.mix(docs, target_entropy=None, max_repeats=MAX_REPEATS, keep_all=True)
    return drawn.select(*[f"`{c}`" for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text, for each row drawn."""
    return bpe.encode(docs, bpe.default_path())


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", exact_copies_out),
    ("jaccard_join", near_copies_out),
    ("mixing", mixed),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
