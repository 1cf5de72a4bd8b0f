"""Batch jobs put together from the operators: fixtures, archive bridge, scan of old outputs, review."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.operators import acquisition, bundle, compare, corpus, events, legacy
from quillspan.sources import readers, writers

_EVENT = "struct<ordinal:int,segment_ordinal:int,predicate:string,actor:string,patient:string,tags:array<string>,payload:string,state_before:string,state_after:string>"


def ingest_fixtures(fixtures: DataFrame) -> dict[str, DataFrame]:
    """witness, segment, semantic_version, event and edge tables of fixture rows (see readers.fixtures).

    Events keep their place in the fixture's list, which orders the NEXT_EVENT edges; their
    segment is looked up by its ordinal in the witness.
    """
    docs = bundle.load_fixture_documents(fixtures)
    witness = corpus.add_witnesses(docs).withColumn("fixture_id", F.get_json_object("metadata_json", "$.fixture_id"))
    segment = corpus.segments(witness, "fixture_id")
    versions = events.semantic_versions(fixtures.select("semantic_version", F.lit(None).cast("string").alias("parent_version"), "config", F.lit("manual benchmark").alias("description"), "fixture_id"), "fixture_id")
    listed = fixtures.select("fixture_id", "semantic_version", F.posexplode("events").alias("place", "e")).select("fixture_id", "semantic_version", "place", F.from_json("e", _EVENT).alias("e"))
    listed = listed.select("fixture_id", "semantic_version", "place", "e.*").join(witness.select("fixture_id", "witness_id"), "fixture_id")
    ids = segment.select(F.col("witness_id").alias("w_"), F.col("ordinal").alias("o_"), "segment_id")
    listed = listed.join(ids, (F.col("witness_id") == F.col("w_")) & (F.col("segment_ordinal") == F.col("o_")), "left").drop("w_", "o_", "segment_ordinal")
    event = events.add_checked(listed, witness, versions, segment)
    following = F.lead("event_id").over(Window.partitionBy("fixture_id").orderBy("place"))
    edge = event.select("fixture_id", "semantic_version", F.col("event_id").alias("src"), following.alias("dst")).filter("dst is not null")
    provenance = F.to_json(F.struct("fixture_id", "semantic_version"))
    edge = edge.select("src", "dst", F.lit("NEXT_EVENT").alias("edge_type"), F.lit(1.0).alias("confidence"), provenance.alias("provenance_json"))
    return {"witness": witness, "segment": segment, "semantic_version": versions, "event": event, "edge": edge}


def compare_fixture_pairs(tables: dict[str, DataFrame], pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text comparison and semantic diff of pairs (left, right) of witness ids."""
    return compare.compare_witnesses(compare.profiles(tables["segment"], "witness_id"), pairs, "witness_id"), events.semantic_diff(tables["event"], pairs)


def archive_bridge(spark: SparkSession, manifest: str, results: str | None, stubs_dir: str, records: str | None = None) -> dict[str, int]:
    """Manifest and results to source stubs (and records as JSON lines); returns the counts."""
    found = acquisition.join_records(readers.archive_manifest(spark, manifest), readers.archive_results(spark, results) if results else None)
    stubs = acquisition.source_stubs(found)
    writers.source_stubs(stubs, stubs_dir)
    if records:
        writers.jsonl(stubs, records, order="source_id", single=True)
    return acquisition.summary(found).first().asDict()


def scan_exports(spark: SparkSession, input_dir: str, output_dir: str, terms: list[str] = (), include_text: bool = True) -> DataFrame:
    """All .md and .txt files below input_dir as bundles of labelled blocks below output_dir; returns files and blocks."""
    root = _local(_qualified(spark, input_dir))
    files = readers.text_files(spark, input_dir)
    relative = F.substring(F.regexp_replace("path", r"^file:/+", "/"), len(root) + 2, 1 << 20)
    source = F.to_json(F.struct(relative.alias("source_path"), F.lit("LEGACY_EXPORT").alias("source_type")))
    outputs = legacy.identified(files.withColumn("source_json", source)).persist()  # files are read once for the blocks and the index
    blocks = legacy.records_of(outputs, list(terms)).persist()
    index = legacy.index(outputs, blocks).persist()
    writers.legacy_bundles(index, blocks, output_dir, include_text)
    counts = spark.createDataFrame([legacy.block_counts(index).first()])
    for df in (index, blocks, outputs):
        df.unpersist()
    return counts


def _qualified(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def _local(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def review(segments: DataFrame, blocks: DataFrame, min_score: float = 0.12, limit_per_block: int = 5) -> DataFrame:
    """Review queue of blocks over the fingerprints of the segments."""
    return legacy.review_queue(blocks, segments, "block_id", min_score, limit_per_block, place=("witness_id", "ordinal", "segment_id"), last="segment_id")
