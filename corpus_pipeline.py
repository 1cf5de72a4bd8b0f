"""A training-corpus pipeline over `documents`: five stages, each one operator of quillspan.llm.

Stage outputs are written as Parquet and read again as the next stage's documents. All
stages but the last return the columns of documents; texts that a stage changes get a new
n_chars. Mixing repeats a document's row once for each copy that the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import compression_rules, line_dedup, mixing, ngram_join, packing
from quillspan.llm.common import WORD_RE, materialize, table
from quillspan.llm.queries import default_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands and base rules keep."""
    return compression_rules.keep_compressible(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that stand earlier; documents that lose all their words go."""
    out = line_dedup.remove_repeated_lines(docs)
    n_removed = F.col(f"{out.columns[-1]}.n_removed")
    left = (n_removed == 0) | F.col("text").rlike(WORD_RE)
    n_chars = F.when(n_removed > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.filter(left).select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's row as often as the mix takes it."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences."""
    return packing.pack(docs, default_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the compression, the tokenizer or the linear program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
