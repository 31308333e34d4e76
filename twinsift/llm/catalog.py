"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinsift.llm import bpe, catalog_sql, html_extract, jaccard_join, mixing, periodic_runs, pitman_yor, quality, ranked_search, secrets, sharding, super_minhash, toxicity, winnowing
from twinsift.llm.common import table


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of all documents and of their edited texts."""
    return winnowing.edited_likeness(table(spark, sf_dir, "documents"))


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret candidates of all documents, rated by a random forest."""
    return secrets.findings(table(spark, sf_dir, "documents"))


def op3_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources to target weights takes of every document."""
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight contiguous shards of near equal bytes."""
    return sharding.sharded_documents(table(spark, sf_dir, "documents"))


def op5_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts of all documents and the verdict by limits of their language and source."""
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op6_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents linked by near equal sets of three-word shingles."""
    return jaccard_join.linked_documents(table(spark, sf_dir, "documents"))


def op7_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents, encoded and decoded by byte-level BPE."""
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a hierarchical Pitman-Yor model of word pairs."""
    return pitman_yor.scored_documents(table(spark, sf_dir, "documents"))


def op9_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages, without what the pages of a host repeat."""
    return html_extract.page_texts(table(spark, sf_dir, "pages"))


def op10_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by their maximum-scoring segments."""
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near equal documents (four words, 0.8) and the one of each that stays."""
    return super_minhash.kept_documents(table(spark, sf_dir, "documents"))


def op12_geometric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, by exact block bounds."""
    return ranked_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_synchronised_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of all documents, some with a periodic end put in."""
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_winnowing": op1_winnowing,
    "op2_secret_forest": op2_secret_forest,
    "op3_golden_mix": op3_golden_mix,
    "op4_byte_shards": op4_byte_shards,
    "op5_adaptive_quality": op5_adaptive_quality,
    "op6_jaccard_groups": op6_jaccard_groups,
    "op7_speculative_bpe": op7_speculative_bpe,
    "op8_pitman_yor": op8_pitman_yor,
    "op9_host_suffixes": op9_host_suffixes,
    "op10_toxic_segments": op10_toxic_segments,
    "op11_super_minhash": op11_super_minhash,
    "op12_geometric_search": op12_geometric_search,
    "op13_synchronised_runs": op13_synchronised_runs,
}


def oracle_sql() -> dict[str, str]:
    return catalog_sql.oracle_sql()
