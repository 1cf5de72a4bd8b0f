"""File sinks."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import pieces, stable_json
from quillspan.operators.legacy import BUNDLE_GUARD
from quillspan.sources.snapshots import file_system


def jsonl(df: DataFrame, path: str, order: str | None = None, single: bool = False) -> None:
    """Rows as lines of canonical JSON; ordered and in one file if asked (small results only)."""
    lines = df.select(stable_json(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("value"), *([F.col(order).alias("o_")] if order else []))
    if order:
        lines = lines.orderBy("o_").select("value")
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def source_stubs(stubs: DataFrame, path: str) -> None:
    """One folder a source_id with its record as JSON."""
    if not stubs.filter(F.trim(F.coalesce("source_id", F.lit(""))) == "").isEmpty():
        raise ValueError("source record missing source_id")
    body = stable_json(F.to_json(F.struct(*stubs.columns), {"ignoreNullFields": "false"}))
    stubs.select(F.col("source_id").alias("id"), body.alias("value")).write.mode("overwrite").partitionBy("id").text(path)


# The files of a bundle and the keys of its manifest.
BUNDLE_FILES = {"source": "source.json", "normalized": "normalized.txt", "segments": "segments.jsonl", "raw": "raw.txt", "semantic_events": "semantic-events.jsonl"}
MANIFEST = ("bundle_version", "witness_key", "doc_hash", "merkle_root", "segment_count", "normalized_size_chars", "raw_included", "semantic_events_included")


def bundle_files(built: DataFrame, key: str = "witness_key") -> DataFrame:
    """folder, name, content: every file of every bundle as a row; the bundles of some million signs are Python objects at once."""

    def files(batches):
        for batch in batches:
            for low, high in pieces(pc.binary_length(batch.column("segments")).to_pylist()):
                rows = [(r["folder"], name, content) for r in batch.slice(low, high - low).to_pylist() for name, content in _files_of(r).items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["folder", "name", "content"])

    optional = [F.col(c) if c in built.columns else F.lit(None).cast(t).alias(c) for c, t in (("raw", "string"), ("semantic_events", "array<string>"))]
    parts = built.select(F.col(key).alias("folder"), *MANIFEST, "source_json", "normalized", F.to_json("segments").alias("segments"), *optional)
    return parts.mapInArrow(files, "folder string, name string, content string")


def _files_of(r: dict) -> dict[str, str]:
    def pretty(value) -> str:
        return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n"

    def lines(values) -> str:
        return "".join(json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n" for v in values)

    content = {"source": pretty(json.loads(r["source_json"])), "normalized": r["normalized"] + "\n", "segments": lines(json.loads(r["segments"]))}
    if r["raw_included"]:
        content["raw"] = r["raw"]
    if r["semantic_events_included"]:
        content["semantic_events"] = lines(map(json.loads, r["semantic_events"]))
    manifest = {c: r[c] for c in MANIFEST} | {"artifacts": {k: n if k in content else None for k, n in BUNDLE_FILES.items()}}
    return {BUNDLE_FILES[k]: v for k, v in content.items()} | {"manifest.json": pretty(manifest)}


def write_files(files: DataFrame, path: str) -> None:
    """Rows (folder, name, content) as files path/folder/name, written by the executors, on any file system that Arrow knows.

    A file is written under another name and then moved, so a task that is run again leaves the same files.
    On a cluster a local path must be one that all executors share: below spark.checkpoint.dir.
    """
    import posixpath
    import uuid

    from pyarrow.fs import FileSystem

    spark = files.sparkSession
    fs, target = file_system(spark, path)
    uri = fs.makeQualified(target).toString().replace("file:/", "file:///").replace("file:////", "file:///")
    shared = spark.conf.get("spark.checkpoint.dir", None) or ""
    if uri.startswith("file:") and not spark.sparkContext.master.startswith("local") and not (shared and path.startswith(shared)):
        raise ValueError("bundles are written as single files: name a path below spark.checkpoint.dir")

    def write(rows) -> None:
        store, base = FileSystem.from_uri(uri)
        for r in rows:
            folder = posixpath.join(base, r["folder"])
            store.create_dir(folder, recursive=True)
            draft = posixpath.join(folder, f".{uuid.uuid4().hex}")
            with store.open_output_stream(draft) as out:
                out.write(r["content"].encode("utf-8"))
            store.move(draft, posixpath.join(folder, r["name"]))

    files.foreachPartition(write)


def bundles(built: DataFrame, path: str, key: str = "witness_key") -> None:
    """Bundles below path, a folder each, as readers.bundles reads them."""
    write_files(bundle_files(built, key), path)


def legacy_bundles(index: DataFrame, blocks: DataFrame, path: str, include_text: bool = True) -> None:
    """Blocks as JSON lines, a folder for each output, with a manifest each, and LEGACY_INDEX beside them; hash-only without texts."""
    b = blocks if include_text else blocks.drop("text")
    b.withColumn("bundle", F.substring("output_id", 1, 16)).write.mode("overwrite").partitionBy("bundle").json(f"{path}/blocks")
    guarded = index.withColumn("text_included", F.lit(include_text)).withColumn("guard", F.lit(BUNDLE_GUARD))
    guarded.withColumn("bundle", F.col("bundle_path")).write.mode("overwrite").partitionBy("bundle").json(f"{path}/manifests")
    index.coalesce(1).write.mode("overwrite").json(f"{path}/LEGACY_INDEX")
