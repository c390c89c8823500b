"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardframe.llm import (
    bpe,
    collocations,
    divergence,
    exact_dedup,
    html_text,
    jaccard_join,
    license_scan,
    mixing,
    oracles,
    quality_rules,
    suffix_dedup,
    topk_search,
    toxicity,
)
from shardframe.llm.registry import QUERIES, query
from shardframe.llm.shared import table
from shardframe.llm.url_queries import op7_url_filter

__all__ = ["QUERIES", "op7_url_filter"]


@query("op9_exact_dedup", oracles.OP9_SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winner and group of every document."""
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.default_path())


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and offending spans of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_quality_rules", oracles.OP5_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base signals and verdict of every document."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("text_chars")


@query("op2_license_scan", oracles.op2_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("places")


@query("op6_jaccard_join", oracles.OP6_SQL)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard similarity."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn for a mix of 98 % of the largest entropy, of as many words as the table has."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


@query("op1_suffix_dedup", oracles.OP1_SQL)
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat a string of an earlier one."""
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op11_topk_search", oracles.OP11_SQL)
def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best neighbours, by integer inner product, of every fiftieth vector."""
    found = topk_search.top_k(table(spark, sf_dir, "embeddings"))
    return found.select("query_id", "rank", "vec_id", "score")


@query("op12_divergence", oracles.OP12_SQL)
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every pair of sources of a language, and the terms that set each source apart."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query("op13_collocations", oracles.OP13_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("cut")
