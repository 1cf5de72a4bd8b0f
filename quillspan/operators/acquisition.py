"""Acquisition bookkeeping: checked manifests and results, their join, source stubs, work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Required columns, source kinds and their success statuses, schema name.
MANIFEST_COLUMNS = ("source_id", "url", "filename")
RESULT_COLUMNS = ("source_id", "status", "filename", "size_bytes", "sha256", "source_url")
SUCCESS = {"PDF": "OK_PDF", "TEXT": "OK_TEXT"}
SCHEMA = "archive-fetch-bridge/v1.1"


def clean_rows(table: DataFrame, required: tuple) -> DataFrame:
    """Trimmed strings, '' for missing cells, no rows without any value; raises on missing columns."""
    missing = [c for c in required if c not in table.columns]
    if not table.columns:
        raise ValueError("missing TSV header")
    if missing:
        raise ValueError("missing TSV columns: " + ", ".join(missing))
    t = table.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in table.columns])
    return t.filter(F.exists(F.array(*t.columns), lambda v: v != ""))


def _check_ids(table: DataFrame, what: str) -> None:
    bad = table.groupBy("source_id").agg(F.count("*").alias("n")).filter("source_id = '' or n > 1").orderBy("source_id").first()
    if bad is not None:
        raise ValueError(f"empty source_id in archive {what}" if bad["source_id"] == "" else f"duplicate source_id in archive {what}: {bad['source_id']}")


def check_manifest(table: DataFrame) -> DataFrame:
    t = clean_rows(table, MANIFEST_COLUMNS)
    _check_ids(t, "manifest")
    kind = F.upper("expected_kind") if "expected_kind" in t.columns else F.lit("")
    t = t.withColumn("expected_kind", F.when(kind == "", F.lit("PDF")).otherwise(kind))
    bad = t.filter(~F.col("expected_kind").isin(*SUCCESS)).first()
    if bad is not None:
        raise ValueError(f"unsupported expected_kind {bad['expected_kind']!r}; supported: {sorted(SUCCESS)}")
    return t


def check_results(table: DataFrame) -> DataFrame:
    t = clean_rows(table, RESULT_COLUMNS)
    _check_ids(t, "results")
    return t


def join_records(manifest: DataFrame, results: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """One record a manifest row. Without a result it stays FETCH_NOT_RUN_OR_RESULT_MISSING;
    only the success status of its own kind, with a hash, verifies it (strict: a success without one raises)."""
    m = manifest.select("source_id", F.col("url").alias("source_url"), "filename", F.col("expected_kind").alias("source_kind"))
    if results is None:
        results = manifest.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in RESULT_COLUMNS))
    r = results.select("source_id", F.col("status").alias("bridge_status"), F.col("filename").alias("r_file"), F.col("source_url").alias("r_url"), F.col("sha256").alias("r_sha"), F.col("size_bytes").alias("r_size"), F.lit(True).alias("found"))
    j = m.join(r, "source_id", "left")
    expected = F.coalesce(*[F.when(F.col("source_kind") == k, F.lit(s)) for k, s in SUCCESS.items()])
    verified = F.coalesce((F.col("bridge_status") == expected) & (F.col("r_sha") != ""), F.lit(False))
    if strict:
        j = j.withColumn("bridge_status", F.when((F.col("bridge_status") == expected) & (F.col("r_sha") == ""), F.raise_error(F.concat(expected, F.lit(" without sha256: "), F.col("source_id"))).cast("string")).otherwise(F.col("bridge_status")))
    status = (
        F.when(F.col("found").isNull(), "FETCH_NOT_RUN_OR_RESULT_MISSING")
        .when(verified, "ACQUIRED_VERIFIED_BY_BRIDGE")
        .when(F.col("bridge_status").isin(*SUCCESS.values()), "SOURCE_KIND_MISMATCH")
        .when(F.col("bridge_status") == "", "UNKNOWN_BRIDGE_STATUS")
        .otherwise(F.col("bridge_status"))
    )
    other = lambda a, b: F.when((F.col(b) != "") & (F.col(b) != F.col(a)), F.struct(F.col(a).alias("manifest"), F.col(b).alias("result")))
    mismatch = F.when(status == "SOURCE_KIND_MISMATCH", F.struct(F.col("source_kind").alias("expected_kind"), expected.alias("expected_status"), F.col("bridge_status").alias("bridge_status")))
    return j.select(
        F.lit(SCHEMA).alias("archive_bridge_schema"),
        "source_id",
        "source_url",
        "filename",
        "source_kind",
        status.alias("acquisition_status"),
        F.when(verified, F.col("r_sha")).alias("source_sha256"),
        F.when(verified & (F.col("r_size") != ""), F.col("r_size").cast("long")).alias("source_size_bytes"),
        "bridge_status",
        other("filename", "r_file").alias("result_filename_conflict"),
        other("source_url", "r_url").alias("result_url_conflict"),
        mismatch.alias("kind_mismatch"),
    )


def source_stubs(records: DataFrame, **extra) -> DataFrame:
    """Records with extra columns and the defaults of a stub."""
    out = records.withColumns({k: F.lit(v) for k, v in extra.items()})
    for name, value in (("raw_source_committed", False), ("source_layer", "ARCHIVE_SOURCE")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value))
    return out


def summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("records"), F.count_if(F.col("acquisition_status") == "ACQUIRED_VERIFIED_BY_BRIDGE").alias("verified"), F.count_if(F.col("source_id") != "").alias("source_stubs"))


def listed_files(listing: DataFrame, extensions: list[str]) -> DataFrame:
    """Files (path, size) with a positive size and an allowed ending, by path."""
    ends = F.lit(False)
    for x in extensions:
        ends = ends | F.lower("path").endswith(x.lower())
    return listing.filter((F.col("size") > 0) & ends).orderBy("path")


def enabled_targets(targets: DataFrame) -> DataFrame:
    return targets.filter(F.coalesce("enabled", F.lit(True))).orderBy(F.coalesce("priority", F.lit(100)))


def pending_files(listing: DataFrame, done: DataFrame) -> DataFrame:
    return listing.join(done.select("path"), "path", "left_anti").orderBy("path")
