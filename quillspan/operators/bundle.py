"""Witness bundles: building, checking and ingesting document artifacts as tables."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators.corpus import add_witnesses

# Fixed value: the bundle format.
VERSION = "witness-bundle/v1"


def build_bundles(docs: DataFrame, text: str = "text", source_json: str = "source_json", include_raw: bool = False, keep: tuple = (), events: str | None = None) -> DataFrame:
    """keep..., source_json, normalized, segments(ordinal, segment_hash, text), manifest columns (raw too if asked).

    events: a column with an array of JSON texts, the bundle's semantic events.
    """
    @F.arrow_udf("string")
    def complete(sources: pa.Array) -> pa.Array:
        def one(s):
            record = {**json.loads(s or "{}"), "bundle_version": VERSION, "raw_source_committed": include_raw}
            return json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

        return T.mapped(sources, one, pa.string())

    raw = F.coalesce(F.col(text), F.lit(""))
    listed = [F.col(events).alias("semantic_events")] if events else []
    d = docs.select(*keep, complete(F.col(source_json)).alias("source_json"), raw.alias("raw"), T.normalize_text(raw).alias("normalized"), T.segments_of(raw).alias("parts"), *listed, (F.col(events).isNotNull() if events else F.lit(False)).alias("semantic_events_included"))
    d = T.fenced(d)
    hashes = F.transform("parts", lambda s: F.sha2(s, 256))
    d = d.withColumn("segments", F.transform("parts", lambda s, i: F.struct(i.alias("ordinal"), F.sha2(s, 256).alias("segment_hash"), s.alias("text"))))
    d = d.withColumn("doc_hash", F.sha2("normalized", 256)).withColumn("merkle_root", T.merkle_root(hashes))
    d = d.withColumn("witness_key", F.sha2(F.concat("doc_hash", F.lit("|"), "source_json"), 256))
    d = d.withColumn("bundle_version", F.lit(VERSION)).withColumn("segment_count", F.size("parts")).withColumn("normalized_size_chars", F.char_length("normalized")).withColumn("raw_included", F.lit(include_raw))
    return d.drop("parts") if include_raw else d.drop("parts", "raw")


def verify_bundles(bundles: DataFrame) -> DataFrame:
    """bundles with errors (codes, in checking order) and ok. Source JSON is brought to canonical form first."""
    b = bundles.withColumn("source_", T.stable_json("source_json"))
    texts = F.transform("segments", lambda s: F.coalesce(s["text"], F.lit("")))
    b = b.withColumn("texts_", _normalize_all(texts))
    b = T.fenced(b.withColumn("hashes_", F.transform("texts_", lambda s: F.sha2(s, 256))))
    count = F.size("segments")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    per_segment = F.flatten(
        F.transform(
            places,
            lambda i: F.array_compact(
                F.array(
                    F.when(~F.get("segments", i)["ordinal"].eqNullSafe(i), F.concat(F.lit("segment_ordinal_mismatch:"), i.cast("string"))),
                    F.when(~F.get("hashes_", i).eqNullSafe(F.get("segments", i)["segment_hash"]), F.concat(F.lit("segment_hash_mismatch:"), i.cast("string"))),
                )
            ),
        )
    )
    head = F.array_compact(
        F.array(
            F.when(~F.col("bundle_version").eqNullSafe(F.lit(VERSION)), "bundle_version_mismatch"),
            F.when(~F.get_json_object("source_", "$.bundle_version").eqNullSafe(F.lit(VERSION)), "source_bundle_version_mismatch"),
            F.when(~F.sha2("normalized", 256).eqNullSafe(F.col("doc_hash")), "doc_hash_mismatch"),
            F.when(~count.eqNullSafe(F.col("segment_count")), "segment_count_mismatch"),
        )
    )
    tail = F.array_compact(
        F.array(
            F.when(~T.merkle_root("hashes_").eqNullSafe(F.col("merkle_root")), "merkle_root_mismatch"),
            F.when(F.trim(F.array_join(F.filter("texts_", lambda t: t != ""), " ")) != F.col("normalized"), "normalized_reconstruction_mismatch"),
            F.when(~F.sha2(F.concat(F.coalesce("doc_hash", F.lit("")), F.lit("|"), "source_"), 256).eqNullSafe(F.col("witness_key")), "witness_key_mismatch"),
        )
    )
    b = b.withColumn("errors", F.concat(head, per_segment, tail)).withColumn("ok", F.size("errors") == 0)
    return b.drop("source_", "texts_", "hashes_")


def _normalize_all(texts):
    """Normalised texts of an array."""

    @F.pandas_udf("array<string>")
    def each(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else [T.normalize_plain(t) for t in a])

    return each(texts)


def ingest_bundles(bundles: DataFrame, segments: str = "normalized") -> DataFrame:
    """Witnesses of bundles that all verify (else ValueError). By default the normalised text is split anew,
    which gives one segment each; segments='artifact' keeps the bundles' own."""
    checked = verify_bundles(bundles)
    bad = checked.filter("not ok").orderBy("witness_key").first()
    if bad is not None:
        raise ValueError("invalid witness bundle: " + ", ".join(bad["errors"]))

    @F.pandas_udf("string")
    def extend(sources: pd.Series, keys: pd.Series, roots: pd.Series) -> pd.Series:
        def one(s, k, r):
            return json.dumps({**json.loads(s), "artifact_witness_key": k, "artifact_merkle_root": r}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

        return pd.Series([one(*x) for x in zip(sources, keys, roots, strict=True)])

    text = F.array_join(F.transform("segments", lambda s: s["text"]), "\n\n") if segments == "artifact" else F.col("normalized")
    d = T.fenced(bundles.select(text.alias("text"), "source_json", "witness_key", "merkle_root"))
    return add_witnesses(d.select("text", extend("source_json", "witness_key", "merkle_root").alias("metadata_json")))


def load_fixture_documents(fixtures: DataFrame) -> DataFrame:
    """text and metadata_json of fixture rows (fixture_id, source_json, derived_test_segments)."""
    @F.pandas_udf("string")
    def metadata(sources: pd.Series, ids: pd.Series) -> pd.Series:
        def one(s, i):
            return json.dumps({**json.loads(s), "fixture_id": i, "fixture_kind": "DERIVED_PUBLIC_SAFE_BENCHMARK", "raw_source_committed": False}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

        return pd.Series([one(*x) for x in zip(sources, ids, strict=True)])

    return fixtures.select("fixture_id", F.array_join("derived_test_segments", "\n\n").alias("text"), metadata("source_json", "fixture_id").alias("metadata_json"))
