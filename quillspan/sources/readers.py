"""File sources as tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.acquisition import MANIFEST_COLUMNS, RESULT_COLUMNS, check_manifest, check_results, clean_rows


#: Tables whose rows cost far more to work on than to move.
HEAVY = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in HEAVY else found


def spread(df: DataFrame) -> DataFrame:
    """A scan that leaves cores idle is dealt out to all of them.

    Files of one row group are one task however they are split, so a scan of fewer
    splits than cores is taken for such a one; larger scans stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The corpus tables without rows, by name."""
    ddl = {
        "witness": "witness_id string, doc_hash string, merkle_root string, metadata_json string, normalized_text string",
        "segment": "segment_id string, witness_id string, ordinal int, segment_hash string, text string, canonical string",
        "gram": "gram string, segment_id string",
        "semantic_version": "semantic_version string, parent_version string, config_hash string, description string",
        "event": "event_id string, witness_id string, segment_id string, ordinal int, semantic_version string, predicate string, actor string, patient string, state_before string, state_after string, tags array<string>, payload string, event_hash string",
        "edge": "src string, dst string, edge_type string, confidence double, provenance_json string",
        "fingerprint_meta": "key string, value string",
        "fingerprint": "fingerprint string, segment_id string",
    }
    return {name: spark.createDataFrame([], columns) for name, columns in ddl.items()}


def text_files(spark: SparkSession, path: str, suffixes: tuple = (".md", ".txt")) -> DataFrame:
    """path, text of all files below path with a suffix in any case; bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.lower("path")
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | name.endswith(s)
    return files.filter(wanted).select("path", _decoded("content").alias("text")).orderBy("path")


def _decoded(content):
    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return decode(content)


def text_with_metadata(spark: SparkSession, text_path: str, metadata_path: str) -> DataFrame:
    """text and metadata_json of one document given as two files."""
    text = spark.read.text(text_path, wholetext=True).select(F.col("value").alias("text"))
    meta = spark.read.text(metadata_path, wholetext=True).select(F.col("value").alias("metadata_json"))
    return text.join(F.broadcast(meta))  # one row each


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """Bundles below path, one row for each folder that holds a manifest.json, in the shape of build_bundles."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), _decoded("content").alias("text"))
    wide = files.groupBy("folder").agg(*[F.max(F.when(F.col("name") == n, F.col("text"))).alias(a) for n, a in (("manifest.json", "m"), ("source.json", "source_json"), ("normalized.txt", "n"), ("segments.jsonl", "s"))])
    manifest = "struct<bundle_version:string,witness_key:string,doc_hash:string,merkle_root:string,segment_count:int,normalized_size_chars:int,raw_included:boolean,semantic_events_included:boolean>"
    lines = F.filter(F.split("s", "\n"), lambda x: F.trim(x) != "")
    rows = F.transform(lines, lambda x: F.from_json(x, "struct<ordinal:int,segment_hash:string,text:string>"))
    out = wide.filter("m is not null").select("folder", "source_json", F.regexp_replace("n", r"\n+$", "").alias("normalized"), rows.alias("segments"), F.from_json("m", manifest).alias("m"))
    return out.select("folder", "source_json", "normalized", "segments", "m.*").orderBy("folder")


def segments_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ordinal int, segment_hash string, text string").json(path)


def tsv(spark: SparkSession, path: str, required: tuple) -> DataFrame:
    """Trimmed rows of a tab-separated file with a header; short rows are filled with '', extra cells dropped."""
    return clean_rows(spark.read.csv(path, sep="\t", header=True, mode="PERMISSIVE"), required)


def archive_manifest(spark: SparkSession, path: str) -> DataFrame:
    return check_manifest(tsv(spark, path, MANIFEST_COLUMNS))


def archive_results(spark: SparkSession, path: str) -> DataFrame:
    return check_results(tsv(spark, path, RESULT_COLUMNS))


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """One row a fixture of a JSON file with a `fixtures` array; free-form parts stay JSON texts."""
    raw = spark.read.text(path, wholetext=True).first()["value"]  # one small file
    rows = []
    for f in json.loads(raw)["fixtures"]:
        rows.append((f["fixture_id"], f["semantic_version"], json.dumps(f.get("semantic_config", {"fixture": "manual-gold"}), ensure_ascii=False), json.dumps(f["source"], ensure_ascii=False), f["derived_test_segments"], [json.dumps(e, ensure_ascii=False) for e in f["events"]]))
    return spark.createDataFrame(rows, "fixture_id string, semantic_version string, config string, source_json string, derived_test_segments array<string>, events array<string>")
