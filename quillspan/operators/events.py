"""Symbolic events: content ids, filters, successor edges, aligned diffs, slot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators.graph import pointers
from quillspan.operators.corpus import orphans

FIELDS = ("actor", "patient", "tags", "payload", "state_before", "state_after")


def add_events(events: DataFrame, natural_json: bool = True) -> DataFrame:
    """Events with canonical JSON parts and event_id = event_hash.

    Input: witness_id, semantic_version, ordinal, predicate, actor, patient, segment_id,
    tags array<string>, and payload, state_before, state_after as JSON texts (null: {}).
    With natural_json the JSON texts are brought to canonical form first.
    """
    e = events
    for c in ("payload", "state_before", "state_after"):
        text = F.coalesce(F.col(c), F.lit("{}"))
        e = e.withColumn(c, T.stable_json(text) if natural_json else text)
    e = e.withColumn("tags", F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))))
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit("null"))
    text_of = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(quoted(c))
    body = [
        ("actor", text_of("actor")),
        ("ordinal", F.col("ordinal").cast("string")),
        ("patient", text_of("patient")),
        ("payload", F.col("payload")),
        ("predicate", text_of("predicate")),
        ("segment_id", text_of("segment_id")),
        ("semantic_version", text_of("semantic_version")),
        ("state_after", F.col("state_after")),
        ("state_before", F.col("state_before")),
        ("tags", F.to_json("tags")),
        ("witness_id", text_of("witness_id")),
    ]
    pieces = []
    for k, (name, value) in enumerate(body):
        pieces += [F.lit(("{" if k == 0 else ",") + f'"{name}":'), value]
    e = e.withColumn("event_hash", F.sha2(F.concat(*pieces, F.lit("}")), 256))
    return e.withColumn("event_id", F.col("event_hash"))


def semantic_versions(versions: DataFrame, seq: str) -> DataFrame:
    """semantic_version, parent_version, config_hash, description; the last row of a version wins."""
    v = versions.withColumn("config_hash", F.sha2(T.stable_json("config"), 256)).withColumn("description", F.coalesce("description", F.lit("")))
    return v.groupBy("semantic_version").agg(F.max_by(F.struct("parent_version", "config_hash", "description"), seq).alias("r")).select("semantic_version", "r.*")


def version_tree(versions: DataFrame, paths: bool = True) -> DataFrame:
    """semantic_version, root, depth (and path) along the parents, at any depth, by parent doubling.

    A path names all versions above one, so in deep trees paths=False keeps the rows short. Versions that hang
    below a cycle or an unknown parent are left out; version_faults lists them.
    """
    known = versions.select(F.col("semantic_version").alias("node"), F.col("parent_version").alias("parent"))
    found = pointers(known.filter("parent is not null"), ways=paths)
    top = known.filter("parent is null").select(F.col("node").alias("top"))
    under = found.filter("steps > 0").join(top, F.col("root") == F.col("top"), "left_semi")
    cols = [F.col("node").alias("semantic_version"), "root", F.col("steps").cast("int").alias("depth")]
    own = top.select(F.col("top").alias("semantic_version"), F.col("top").alias("root"), F.lit(0).alias("depth"), *([F.col("top").alias("path")] if paths else []))
    return own.union(under.select(*cols, *([F.array_join(F.reverse(F.array_append("way", F.col("root"))), " > ").alias("path")] if paths else [])))


def version_faults(versions: DataFrame) -> DataFrame:
    """semantic_version, fault of every version without a root: CYCLE on or below a cycle, MISSING_PARENT below an unknown version."""
    known = versions.select(F.col("semantic_version").alias("node"), F.col("parent_version").alias("parent"))
    found = pointers(known.filter("parent is not null")).join(known.select("node"), "node", "left_semi")
    top = known.filter("parent is null").select(F.col("node").alias("root"))
    lost = found.filter("root is null").select("node", F.lit("CYCLE").alias("fault"))
    missing = found.filter("steps > 0").join(top, "root", "left_anti").select("node", F.lit("MISSING_PARENT").alias("fault"))
    return lost.union(missing).withColumnRenamed("node", "semantic_version")


def search_events(events: DataFrame, predicate: str | None = None, semantic_version: str | None = None) -> DataFrame:
    e = events
    if predicate is not None:
        e = e.filter(F.col("predicate") == predicate)
    if semantic_version is not None:
        e = e.filter(F.col("semantic_version") == semantic_version)
    return e.orderBy("witness_id", "ordinal")


def event_rows(events: DataFrame, witness_id, semantic_version: str) -> DataFrame:
    """One witness's events of a version, in diff order."""
    return events.filter((F.col("semantic_version") == semantic_version) & (F.col("witness_id") == witness_id)).orderBy("ordinal", "predicate", "event_id")


def next_event_edges(events: DataFrame, witness: str = "witness_id", position: str = "ordinal", event: str = "event_id") -> DataFrame:
    """(src, dst, edge_type, confidence): consecutive events of each witness in listing order."""
    following = F.lead(event).over(Window.partitionBy(witness).orderBy(position))
    return events.select(F.col(event).alias("src"), following.alias("dst")).filter("dst is not null").select("src", "dst", F.lit("NEXT_EVENT").alias("edge_type"), F.lit(1.0).alias("confidence"))


def occurrences(events: DataFrame) -> DataFrame:
    """Events with their occurrence number within witness and predicate."""
    order = Window.partitionBy("witness_id", "predicate").orderBy("ordinal", "event_id")
    return events.withColumn("occurrence", F.row_number().over(order) - 1)


def semantic_diff(events: DataFrame, pairs: DataFrame, fields: tuple = FIELDS) -> DataFrame:
    """left, right, predicate, occurrence, status (retained, added, removed), changed fields (comma-joined)."""
    e = occurrences(events).select("witness_id", "predicate", "occurrence", *fields)
    a = pairs.join(e.withColumnRenamed("witness_id", "left"), "left").select("left", "right", "predicate", "occurrence", *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("in_a"))
    b = pairs.join(e.withColumnRenamed("witness_id", "right"), "right").select("left", "right", "predicate", "occurrence", *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("in_b"))
    j = a.join(b, ["left", "right", "predicate", "occurrence"], "full_outer")
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("retained")
    delta = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields])), ",")
    return j.select("left", "right", "predicate", "occurrence", status.alias("status"), F.when(status == "retained", delta).otherwise(F.lit("")).alias("changed"))


def slot_mutations(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """left, right, predicate, status, slot, left_value, right_value.

    Payloads (JSON objects) of each witness's last event of a predicate are compared slot by
    slot, with the types of their values: 1 and "1" differ; a missing slot equals null. Predicates without a change have one row
    with a null slot.
    """
    last = events.groupBy("witness_id", "predicate").agg(F.max_by("payload", F.struct("ordinal", "event_id")).alias("payload"))
    text = F.coalesce("payload", F.lit("{}"))
    typed = F.transform_values(F.from_json(text, "map<string,variant>"), lambda _, v: F.nullif(F.to_json(v), F.lit("null")))
    last = last.select("witness_id", "predicate", F.from_json(text, "map<string,string>").alias("shown"), typed.alias("typed"))
    a = pairs.join(last.withColumnRenamed("witness_id", "left"), "left").select("left", "right", "predicate", F.col("shown").alias("a"), F.col("typed").alias("at"))
    b = pairs.join(last.withColumnRenamed("witness_id", "right"), "right").select("left", "right", "predicate", F.col("shown").alias("b"), F.col("typed").alias("bt"))
    j = a.join(b, ["left", "right", "predicate"], "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("retained")
    slots = F.filter(F.array_union(F.map_keys("a"), F.map_keys("b")), lambda k: ~F.try_element_at("at", k).eqNullSafe(F.try_element_at("bt", k)))
    slots = F.when(status == "retained", slots)
    j = j.withColumn("status", status).withColumn("slots", slots)
    out = j.select("left", "right", "predicate", "status", "a", "b", F.explode_outer("slots").alias("slot"))
    return out.select("left", "right", "predicate", "status", "slot", F.when(F.col("slot").isNotNull(), F.element_at("a", F.col("slot"))).alias("left_value"), F.when(F.col("slot").isNotNull(), F.element_at("b", F.col("slot"))).alias("right_value"))


def with_all_predicates(events: DataFrame, predicates: list[str], key: str = "witness_id") -> DataFrame:
    """Witnesses that have every one of the predicates."""
    wanted = list(dict.fromkeys(predicates))
    return events.filter(F.col("predicate").isin(wanted)).groupBy(key).agg(F.count_distinct("predicate").alias("n")).filter(F.col("n") == len(wanted)).select(key)


def add_checked(events: DataFrame, witnesses: DataFrame, versions: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """add_events with its references enforced: an unknown witness, version or segment raises."""
    checks = [("witness_id", witnesses), ("semantic_version", versions), *([("segment_id", segments)] if segments is not None else [])]
    for column, parent in checks:
        bad = orphans(events, column, parent, column).first()
        if bad is not None:
            raise ValueError(f"event refers to an unknown {column}: {bad[column]}")
    return add_events(events)


def earliest(table: DataFrame, key: str, when: str, what: str) -> DataFrame:
    """First attestation of each key."""
    return table.groupBy(key).agg(F.min(when).alias("first_seen"), F.min_by(what, F.struct(when, what)).alias(f"first_{what}"))
