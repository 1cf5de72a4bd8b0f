"""Content-addressed corpus tables: witnesses, segments and q-gram postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T


def add_witnesses(docs: DataFrame, text: str = "text", metadata: str = "metadata_json", order: str | None = None) -> DataFrame:
    """witness_id, doc_hash, merkle_root, metadata_json, normalized_text, segments of each distinct document.

    metadata holds canonical JSON. Documents with equal text and metadata are one witness;
    the first by `order` (or any) stays, summed with map-side combine.
    """
    d = docs.select(F.col(metadata).alias("metadata_json"), F.coalesce(F.col(text), F.lit("")).alias("raw"), (F.col(order) if order else F.lit(0)).alias("order_"))
    d = d.select("metadata_json", T.normalize_text("raw").alias("normalized_text"), T.segments_of("raw").alias("segments"), "order_")
    d = d.withColumn("doc_hash", F.sha2("normalized_text", 256))
    d = d.withColumn("witness_id", F.sha2(F.concat("doc_hash", F.lit("|"), "metadata_json"), 256))
    first = F.min_by(F.struct("doc_hash", "metadata_json", "normalized_text", "segments"), "order_").alias("w")
    d = d.groupBy("witness_id").agg(first, F.min("order_").alias("order_"))
    root = T.merkle_root(F.transform("w.segments", lambda s: F.sha2(s, 256)))
    out = d.select("witness_id", "w.doc_hash", root.alias("merkle_root"), "w.metadata_json", "w.normalized_text", "w.segments", "order_")
    return out.withColumnRenamed("order_", order) if order else out.drop("order_")


def segments(witnesses: DataFrame, *keep: str) -> DataFrame:
    """segment_id, witness_id, ordinal, segment_hash, text, canonical (and columns to keep) of each segment."""
    s = witnesses.select("witness_id", *keep, F.posexplode("segments").alias("ordinal", "text"))
    s = s.withColumn("segment_hash", F.sha2("text", 256))
    segment_id = F.sha2(F.concat("witness_id", F.lit("|"), F.col("ordinal").cast("string"), F.lit("|"), "segment_hash"), 256)
    return s.select(segment_id.alias("segment_id"), "witness_id", *keep, "ordinal", "segment_hash", "text", T.canonical_of_normalized("text").alias("canonical"))


def document_segments(docs: DataFrame, key: str, text: str = "text", columns: tuple = ("text", "canonical"), first: bool = False) -> DataFrame:
    """key, ordinal, text, canonical (or the columns named, see exploded_segments) of plain rows, without witness ids; first: only what stands first."""
    return T.exploded_segments(docs, key, text, columns, first)


def postings(segs: DataFrame, *key: str, q: int = 3) -> DataFrame:
    """The inverted q-gram index: one row for each segment and distinct gram."""
    return segs.select(*key, F.explode(T.qgrams("canonical", q)).alias("gram"))


def gram_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("gram").agg(F.count("*").alias("segments"))


def witness(witnesses: DataFrame, witness_id: str) -> DataFrame:
    """Point lookup, without the text; metadata is parsed."""
    return witnesses.filter(F.col("witness_id") == witness_id).select("witness_id", "doc_hash", "merkle_root", F.parse_json("metadata_json").alias("metadata"))


def exact_segment_hash(segs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Segments whose hash is in hashes(segment_hash), with score 1."""
    return segs.join(hashes.select("segment_hash").distinct(), "segment_hash").withColumn("score", F.lit(1.0))


def repeated_segments(segs: DataFrame) -> DataFrame:
    """segment_hash and number of segments of every text that stands twice or more."""
    return segs.groupBy("segment_hash").agg(F.count("*").alias("copies")).filter("copies > 1")


def story_families(witnesses: DataFrame, family: str, key: str = "witness_id") -> DataFrame:
    """family, members, first_member of each story family; rows without a family are in none."""
    named = witnesses.filter(F.col(family).isNotNull()).select(F.col(family).alias("family"), F.col(key).alias("key_"))
    return named.groupBy("family").agg(F.count_distinct("key_").alias("members"), F.min("key_").alias("first_member"))


def byte_totals(files: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """key..., files, bytes: how many files, and how many bytes of UTF-8 they hold."""
    return files.groupBy(*key).agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"))


def append_new(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """First wins: rows of new whose key is not there yet are added."""
    fresh = new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, *key: str, seq: str) -> DataFrame:
    """Last wins: of the rows of a key in new the one with the largest seq replaces the existing one."""
    cols = existing.columns
    last = new.groupBy(*key).agg(F.max_by(F.struct(*cols), seq).alias("r")).select("r.*")
    return existing.join(last.select(*key), list(key), "left_anti").unionByName(last)


def uniqueness_violations(table: DataFrame, *key: str) -> DataFrame:
    return table.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")
