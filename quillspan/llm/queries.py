"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import compression_rules, embedding_join, html_template, language_id, license_scan, line_dedup, mixing, ngram_join, packing, periodic_runs, secret_scan, source_divergence, suffix_dedup
from .common import table
from .oracle import oracle_sql as oracle_sql


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def default_tokenizer() -> str:
    """The tokenizer file that op3 and the pipeline name; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in the sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), default_tokenizer())


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_template.extract(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document's lines."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence family of every document."""
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of four words and near-copy component (ratio 0.85) of every document."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), percent=85, width=4)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 100-byte strings."""
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return compression_rules.quality_table(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and by which terms."""
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document."""
    return periodic_runs.run_report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_mixing": op2_mixing,
        "op3_packing": op3_packing,
        "op4_html_extraction": op4_html_extraction,
        "op5_line_dedup": op5_line_dedup,
        "op6_license_scan": op6_license_scan,
        "op7_embedding_near_dedup": op7_embedding_near_dedup,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_quality_rules": op10_quality_rules,
        "op11_secret_scan": op11_secret_scan,
        "op12_source_divergence": op12_source_divergence,
        "op13_periodic_runs": op13_periodic_runs,
    }
