"""Provenance metadata: aliases, conflicts inside a record, alerts between two records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import metadata_form

# The compared metadata fields.
FIELDS = (
    "emic_locality",
    "informant_location",
    "collection_location",
    "performance_location",
    "publication_section_label",
    "analyst_geography",
    "collector",
    "narrator",
)
GEOGRAPHY = ("publication_section_label", "analyst_geography")


def resolve_aliases(aliases: dict[str, str]) -> dict[str, str]:
    """Every alias's last name along its chain; cycles stop where they began. Keys and values are compared in metadata form."""
    import re
    import unicodedata

    form = lambda v: re.sub("[^0-9a-z㐀-鿿]+", "", unicodedata.normalize("NFKC", str(v or "")).strip().lower())
    step = {form(k): form(v) for k, v in aliases.items()}
    out = {}
    for k in step:
        seen, name = set(), k
        while name in step and name not in seen:
            seen.add(name)
            name = step[name]
        out[k] = name
    return out


def canonical_alias(value: Column, aliases: dict[str, str] | None = None) -> Column:
    """Metadata form with aliases resolved; a small map becomes a literal."""
    form = metadata_form(value)
    closed = resolve_aliases(aliases or {})
    if not closed:
        return form
    table = F.create_map(*[F.lit(x) for kv in closed.items() for x in kv])
    return F.coalesce(F.element_at(table, form), form)


def internal_conflicts(record: str) -> Column:
    """array of (left_field, left_value, right_field, right_value, type, severity): locations that differ inside one record (a struct column)."""
    found = []
    place = F.col(f"{record}.collection_location")
    for field in GEOGRAPHY:
        other = F.col(f"{record}.{field}")
        a, b = metadata_form(place), metadata_form(other)
        row = F.struct(F.lit("GEOGRAPHY_SLOT_CONFLICT").alias("type"), F.lit("WARN").alias("severity"), F.lit("collection_location").alias("left_field"), place.alias("left_value"), F.lit(field).alias("right_field"), other.alias("right_value"))
        found.append(F.when((a != "") & (b != "") & (a != b), row))
    return F.array_compact(F.array(*found))


def compare_provenance(pairs: DataFrame, left: str = "left", right: str = "right", similarity: str = "text_similarity", overlap: str = "rare_sequence_overlap", aliases: dict[str, str] | None = None) -> DataFrame:
    """pairs with same_collector, same_narrator, geography_conflict, publication_relabel, field_deltas, alert, severity.

    left and right are structs with the eight FIELDS as strings.
    """
    p = pairs
    for side in (left, right):
        for field in FIELDS:  # each form once, as a column of its own
            p = p.withColumn(f"{side}__{field}", metadata_form(F.col(f"{side}.{field}")))
    form = lambda side, field: F.col(f"{side}__{field}")

    def same(field: str) -> Column:
        a, b = canonical_alias(F.col(f"{left}.{field}"), aliases), canonical_alias(F.col(f"{right}.{field}"), aliases)
        return (a != "") & (a == b)

    def differ(a: Column, b: Column) -> Column:
        return (a != "") & (b != "") & (a != b)

    deltas = F.array_compact(F.array(*[F.when(form(left, f) != form(right, f), F.struct(F.lit(f).alias("field"), F.col(f"{left}.{f}").alias("left"), F.col(f"{right}.{f}").alias("right"))) for f in FIELDS]))
    place, label = "collection_location", "publication_section_label"
    p = p.withColumn("same_collector", same("collector")).withColumn("same_narrator", same("narrator"))
    p = p.withColumn("geography_conflict", differ(form(left, place), form(right, place)))
    p = p.withColumn("publication_relabel", differ(form(left, place), form(right, label)) | differ(form(right, place), form(left, label)))
    p = p.withColumn("field_deltas", deltas)
    strong, bundle = F.col(similarity) >= 0.85, F.coalesce(F.col(overlap), F.lit(0.0)) >= 0.80
    reuse, moved = F.col("same_collector") | F.col("same_narrator"), F.col("geography_conflict") | F.col("publication_relabel")
    alert = F.when(strong & reuse & moved, "PSEUDOREPLICATION_ALERT").when(strong & bundle & moved, "SAME_OCCURRENCE_CANDIDATE").when(strong & reuse, "TEXTUAL_DEPENDENCE_CANDIDATE")
    p = p.withColumn("alert", alert).withColumn("severity", F.when(F.col("alert") == "PSEUDOREPLICATION_ALERT", "HIGH").when(F.col("alert").isNotNull(), "MEDIUM"))
    return p.drop(*[f"{s}__{f}" for s in (left, right) for f in FIELDS])
