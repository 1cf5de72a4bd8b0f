"""Registered queries over the test tables, one or more for each operator family."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.fingerprint import fingerprint_values
from quillspan.functions.fingerprint import winnow_fingerprints as winnow_fingerprints_of
from quillspan.operators import acquisition, bundle, compare, corpus, events, exports, graph, legacy, provenance, search
from quillspan.operators.overlap_index import FORMAT, OverlapIndex
from quillspan.plans import jobs
from quillspan.sources import readers, writers
from quillspan.sources.readers import table
from quillspan.sources.snapshots import children, file_system, shared_folder
from quillspan.streaming.ingest import windowed_counts

KEYWORDS = ["GNU", "Licensed under", "license", "MIT License", "rights reserved", "Apache", "Öl", "zzqx", "mit license"]
PLACE = ("doc_id", "ordinal")


def _segments(spark: SparkSession, sf_dir: str, *columns: str, first: bool = False) -> DataFrame:
    """The documents' segments with the columns named, else text and canonical."""
    return corpus.document_segments(table(spark, sf_dir, "documents"), "doc_id", columns=columns or ("text", "canonical"), first=first)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("turn_id", F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")))


def _neighbours(ids: DataFrame, key: str) -> DataFrame:
    """(left, right): each id with the next whole number, where there is one."""
    return ids.select(F.col(key).alias("left")).join(ids.select(F.col(key).alias("right")), F.col("right") == F.col("left") + 1)


def normalize_canonical(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.coalesce("text", F.lit(""))).alias("n"))
    c = T.canonical_of_normalized("n")
    return d.select("doc_id", F.sha2("n", 256).alias("normalized_sha256"), F.sha2(c, 256).alias("canonical_sha256"), F.char_length(c).cast("long").alias("canonical_chars"))


def segments(spark, sf_dir):
    return _segments(spark, sf_dir)


def _witnesses(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("metadata_json", T.fixed_json("lang", "source"))
    return corpus.add_witnesses(d, order="doc_id")


def witness_ids(spark, sf_dir):
    return _witnesses(spark, sf_dir).select("witness_id", "doc_hash", "doc_id", F.size("segments").cast("long").alias("n_segments"))


def segment_ids(spark, sf_dir):
    return corpus.segments(_witnesses(spark, sf_dir), "doc_id").select("doc_id", "ordinal", "segment_id", "segment_hash")


def merkle_roots(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.segments_of(F.coalesce("text", F.lit(""))).alias("s"))
    return d.select("doc_id", T.merkle_root(F.transform("s", lambda x: F.sha2(x, 256))).alias("merkle_root"))


def qgram_postings(spark, sf_dir):
    return corpus.postings(_segments(spark, sf_dir, "canonical"), *PLACE)


def gram_df(spark, sf_dir):
    return corpus.gram_frequencies(qgram_postings(spark, sf_dir))


def exact_segment_dups(spark, sf_dir):
    return corpus.repeated_segments(_segments(spark, sf_dir, "segment_hash"))


def exact_segment_lookup(spark, sf_dir):
    """All places of the segments that documents begin with."""
    first = _segments(spark, sf_dir, "segment_hash", first=True)
    return corpus.exact_segment_hash(_segments(spark, sf_dir, "segment_hash"), first).select("doc_id", "ordinal", "segment_hash", "score")


def witness_lookup(spark, sf_dir):
    """The witness of document 0, by its id."""
    w = _witnesses(spark, sf_dir)
    wanted = w.filter("doc_id = 0").first()["witness_id"]
    field = lambda name: F.variant_get("metadata", f"$.{name}", "string").alias(name)
    return corpus.witness(w, wanted).select("witness_id", "doc_hash", field("lang"), field("source"))


def phrase_search(spark, sf_dir):
    return search.search_phrase(_segments(spark, sf_dir, "canonical"), table(spark, sf_dir, "benchmark"), "item_id", place=PLACE)


def phrase_short(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", F.substring(T.canonical_text("text"), 1, 2).alias("text"))
    return search.search_phrase(_segments(spark, sf_dir, "canonical"), q, "item_id", place=PLACE)


def fuzzy_search(spark, sf_dir):
    return search.search_fuzzy(_segments(spark, sf_dir, "canonical"), table(spark, sf_dir, "benchmark"), "item_id", place=PLACE)


def _stored_index(spark, sf_dir, kind, **options):
    """The index of the documents' segments in the shared folder; made by the first query that asks for it, and anew where the files have changed."""
    _, files = file_system(spark, f"{sf_dir}/documents.parquet")
    state = [(s[0], s[1], s[2]) for s in children(spark, files.getParent().toString()) if s[0] == "documents.parquet"] + children(spark, files.toString())
    name = hashlib.sha256(json.dumps([sf_dir, FORMAT, kind, options, state]).encode()).hexdigest()[:24]
    path = f"{shared_folder(spark)}/index-{kind}-{name}"
    try:
        found = OverlapIndex(spark, path)
    except ValueError:
        found = OverlapIndex.create(spark, path, {"doc_id": "long", "ordinal": "int"}, kind, texts=kind == "grams", **options)
    return found if found.meta["parts"] else found.append(_segments(spark, sf_dir, "canonical"))


def _gram_index(spark, sf_dir):
    return _stored_index(spark, sf_dir, "grams", q=3)


def gram_index(spark, sf_dir):
    """In how many segments each gram stands, from the stored index."""
    return _gram_index(spark, sf_dir).frequencies().groupBy("token").agg(F.sum("n").alias("segments")).select(F.col("token").alias("gram"), "segments")


def phrase_by_index(spark, sf_dir):
    return _gram_index(spark, sf_dir).phrases(table(spark, sf_dir, "benchmark"), "item_id")


def fuzzy_by_index(spark, sf_dir):
    return _gram_index(spark, sf_dir).similar(table(spark, sf_dir, "benchmark"), "item_id").drop("shared")


def appended_index(spark, sf_dir):
    """Passages through an index that was built in two parts."""
    s = _segments(spark, sf_dir, "canonical")
    index = OverlapIndex.create(spark, _folder(spark, "index"), {"doc_id": "long", "ordinal": "int"}, "grams", shard_chars=1_000_000, q=3)
    index = index.append(s.filter("doc_id % 2 = 0")).append(s.filter("doc_id % 2 = 1"))
    return index.phrases(table(spark, sf_dir, "benchmark"), "item_id")


def dictionary_scan(spark, sf_dir):
    return search.dictionary_scan(_segments(spark, sf_dir, "canonical"), KEYWORDS, place=PLACE)


def dictionary_positions(spark, sf_dir):
    return search.keyword_positions(_segments(spark, sf_dir, "canonical"), KEYWORDS, place=PLACE)


def winnow_fingerprints(spark, sf_dir):
    s = _segments(spark, sf_dir, "canonical")
    return s.select(*PLACE, F.explode(fingerprint_values("canonical", hash_name="sha256_64")).alias("fingerprint"))


def winnow_positions(spark, sf_dir):
    """Positions and values of the fingerprints of every benchmark passage."""
    b = table(spark, sf_dir, "benchmark").select("item_id", T.canonical_text("text").alias("canonical"))
    f = b.select("item_id", F.explode(winnow_fingerprints_of("canonical", hash_name="sha256_64")).alias("f"))
    return f.select("item_id", "f.position", F.col("f.value").alias("fingerprint"))


def fingerprint_stats(spark, sf_dir):
    s = _segments(spark, sf_dir, "canonical").select(F.size(fingerprint_values("canonical", hash_name="sha256_64")).alias("n"))
    return s.agg(F.count("*").alias("segments"), F.sum("n").cast("long").alias("fingerprints"))


def fingerprint_candidates(spark, sf_dir):
    return search.search_similar(_segments(spark, sf_dir, "canonical"), _turns(spark, sf_dir), "turn_id", place=PLACE, hash_name="sha256_64")


def compare_witnesses(spark, sf_dir):
    s = _segments(spark, sf_dir, "canonical", "segment_hash")
    return compare.compare_witnesses(compare.profiles(s, "doc_id"), _neighbours(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")


def segment_alignment(spark, sf_dir):
    return compare.align_pairs(_segments(spark, sf_dir), _neighbours(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", hash_name="sha256_64")


def _event_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("witness_id"),
        F.lit("v1").alias("semantic_version"),
        (F.row_number().over(order) - 1).cast("int").alias("ordinal"),
        F.upper("event_type").alias("predicate"),
        F.lit(None).cast("string").alias("actor"),
        F.lit(None).cast("string").alias("patient"),
        F.lit(None).cast("string").alias("segment_id"),
        F.array(F.col("event_type")).alias("tags"),
        F.col("props").alias("payload"),
        F.lit(None).cast("string").alias("state_before"),
        F.lit(None).cast("string").alias("state_after"),
        "user_id",
        "ts",
    )
    return events.add_events(e)


def event_log(spark, sf_dir):
    return _event_log(spark, sf_dir).select("witness_id", "ordinal", "predicate", "payload", "event_id")


def event_filter(spark, sf_dir):
    return events.search_events(_event_log(spark, sf_dir), "PURCHASE", "v1").select("witness_id", "ordinal", "event_id")


def next_event_edges(spark, sf_dir):
    return events.next_event_edges(_event_log(spark, sf_dir))


def _user_pairs(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    u = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    return _neighbours(users, "user_id").select(u("left").alias("left"), u("right").alias("right"))


def semantic_diff(spark, sf_dir):
    return events.semantic_diff(_event_log(spark, sf_dir), _user_pairs(spark, sf_dir))


def slot_mutation(spark, sf_dir):
    return events.slot_mutations(_event_log(spark, sf_dir), _user_pairs(spark, sf_dir))


def _place_edges(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    a = n.select(node("R", "n_regionkey").alias("src"), node("N", "n_nationkey").alias("dst"))
    b = c.select(node("N", "c_nationkey").alias("src"), node("C", "c_custkey").alias("dst"))
    return a.union(b).select("src", "dst", F.lit("HAS").alias("edge_type"), F.lit(1.0).alias("confidence"))


def bfs_depth(spark, sf_dir):
    starts = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.bfs(_place_edges(spark, sf_dir), starts, 3, "HAS")


def dfs_preorder(spark, sf_dir):
    return graph.dfs_preorder(_place_edges(spark, sf_dir), "R0")


def _versions(spark, sf_dir):
    """Versions of three levels: regions, their nations, and each nation's last customer of a market segment."""
    place = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    config = lambda c: F.concat(F.lit('{"b": "x", "a": '), F.col(c).cast("string"), F.lit("}")).alias("config")
    rows = r.select(place("R", "r_regionkey").alias("semantic_version"), F.lit(None).cast("string").alias("parent_version"), config("r_regionkey"), F.lit(None).cast("string").alias("description"), F.lit(0).cast("long").alias("seq"))
    rows = rows.union(n.select(place("N", "n_nationkey"), place("R", "n_regionkey"), config("n_nationkey"), F.lit("nation"), F.lit(0).cast("long")))
    segment = F.concat(place("N", "c_nationkey"), F.lit("-"), F.col("c_mktsegment"))
    return rows.union(c.select(segment, place("N", "c_nationkey"), config("c_custkey"), F.lit("segment"), F.col("c_custkey").cast("long")))


def semantic_versions(spark, sf_dir):
    return events.semantic_versions(_versions(spark, sf_dir), "seq")


def version_tree(spark, sf_dir):
    return events.version_tree(semantic_versions(spark, sf_dir))


def version_faults(spark, sf_dir):
    """The versions with some parents astray: those of market segment BUILDING name no version, nations 1 and 2 each other."""
    v = semantic_versions(spark, sf_dir)
    name = F.col("semantic_version")
    astray = F.when(name.endswith("-BUILDING"), "none").when(name == "N1", "N2").when(name == "N2", "N1").otherwise(F.col("parent_version"))
    return events.version_faults(v.withColumn("parent_version", astray))


def strong_components(spark, sf_dir):
    """Components of the places graph with edges back from some customers: how many nodes each has, by its least node."""
    part = graph.components(_cyclic_edges(spark, sf_dir))
    return part.groupBy("component").agg(F.min("node").alias("least_node"), F.count("*").alias("nodes")).drop("component")


def edge_upsert(spark, sf_dir):
    """Edges between nations and market segments: those of odd customers stand, even ones are put over them."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("src"), F.col("c_mktsegment").alias("dst"), F.lit("HAS").alias("edge_type"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey").cast("double")).alias("confidence"), F.lit(None).cast("string").alias("provenance_json"), "c_custkey")
    old = rows.filter("c_custkey % 2 = 1").groupBy("src", "dst", "edge_type").agg(F.max("confidence").alias("confidence")).withColumn("provenance_json", F.lit("old"))
    return graph.put_edges(old, rows.filter("c_custkey % 2 = 0"), "c_custkey")


def _cyclic_edges(spark, sf_dir):
    """The places graph with edges back from some customers to a region."""
    back = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).filter("c_custkey % 50 = 0")
    back = back.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit("HAS").alias("edge_type"), F.lit(1.0).alias("confidence"))
    return _place_edges(spark, sf_dir).union(back)


def cyclic_part(spark, sf_dir):
    return graph.cyclic_part(_cyclic_edges(spark, sf_dir))


def graph_export(spark, sf_dir):
    labels = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node"), F.col("r_name").alias("label"))
    return exports.graph(_place_edges(spark, sf_dir), labels)


def timeline_export(spark, sf_dir):
    return exports.timeline(table(spark, sf_dir, "events"), "ts", "event_type")


def place_export(spark, sf_dir):
    return exports.places(table(spark, sf_dir, "documents"), "lang", "source", "doc_id")


def story_families(spark, sf_dir):
    return corpus.story_families(_witnesses(spark, sf_dir).withColumn("family", F.get_json_object("metadata_json", "$.source")), "family")


def byte_totals(spark, sf_dir):
    return corpus.byte_totals(table(spark, sf_dir, "documents"), "source")


def orphan_references(spark, sf_dir):
    """Labels whose document is no page."""
    p = table(spark, sf_dir, "pages").select("page_id")
    return corpus.orphans(table(spark, sf_dir, "labels"), "doc_id", p, "page_id").select("doc_id", "quality")


def event_rows(spark, sf_dir):
    return events.event_rows(_event_log(spark, sf_dir), "u1", "v1").select("ordinal", "predicate", "event_id")


def multi_predicate(spark, sf_dir):
    return events.with_all_predicates(_event_log(spark, sf_dir), ["PURCHASE", "SIGNUP", "ERROR"])


def earliest_attestation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return events.earliest(e, "event_type", "ts", "event_id")


def event_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events"))


def slot_types(spark, sf_dir):
    """Slot changes where one side writes its numbers as texts."""
    log = _event_log(spark, sf_dir).withColumn("payload", F.when(F.col("user_id") % 2 == 0, F.regexp_replace("payload", r":(\d+)", ':"$1"')).otherwise(F.col("payload")))
    m = events.slot_mutations(log, _user_pairs(spark, sf_dir))
    return m.groupBy("left", "right", "status").agg(F.count("slot").alias("changed"), F.count("*").alias("rows"))


def _fixtures(spark, sf_dir):
    """A fixture for each conversation: turns are segments and events."""
    c = table(spark, sf_dir, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    event = F.to_json(F.struct(F.col("turn").cast("int").alias("ordinal"), F.lit(0).alias("segment_ordinal"), F.upper("role").alias("predicate")))
    per = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t", event.alias("e")))).alias("x"))
    source = F.to_json(F.struct(F.col("conv_id").cast("string").alias("title")))
    return per.select(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("fixture_id"), F.lit("v1").alias("semantic_version"), F.lit("{}").alias("config"), source.alias("source_json"), F.transform("x", lambda v: v["t"]).alias("derived_test_segments"), F.transform("x", lambda v: v["e"]).alias("events"))


def fixture_ingest(spark, sf_dir):
    t = jobs.ingest_fixtures(_fixtures(spark, sf_dir))
    per = lambda df, name: df.groupBy("fixture_id").agg(F.count("*").alias(name))
    edges = t["edge"].groupBy(F.get_json_object("provenance_json", "$.fixture_id").alias("fixture_id")).agg(F.count("*").alias("n_edges"))
    return per(t["segment"], "n_segments").join(per(t["event"], "n_events"), "fixture_id", "left").join(edges, "fixture_id", "left").na.fill(0)


def fixture_pairs(spark, sf_dir):
    """Events of neighbouring conversations, aligned through the ingested tables."""
    t = jobs.ingest_fixtures(_fixtures(spark, sf_dir))
    w = t["witness"].select("witness_id", F.substring("fixture_id", 2, 20).cast("long").alias("conv_id"))
    pairs = w.select(F.col("witness_id").alias("left"), F.col("conv_id").alias("left_conv")).join(w.select(F.col("witness_id").alias("right"), F.col("conv_id").alias("right_conv")), F.col("right_conv") == F.col("left_conv") + 1)
    _, diff = jobs.compare_fixture_pairs(t, pairs.select("left", "right"))
    return diff.join(pairs, ["left", "right"]).groupBy("left_conv", "right_conv", "status").agg(F.count("*").alias("events"))


def _blocks(spark, sf_dir):
    return legacy.output_blocks(_turns(spark, sf_dir), "turn_id")


def legacy_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("turn_id", "ordinal", F.sha2("text", 256).alias("block_hash"))


def block_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.upper("lang"), F.lit(" FACT LOCK: todo "), F.coalesce("text", F.lit(""))).alias("text"))
    b = legacy.output_blocks(d, "doc_id")
    return b.select("doc_id", "ordinal", F.array_join(legacy.labels(F.col("text")), ",").alias("labels"))


def block_terms(spark, sf_dir):
    b = legacy.output_blocks(table(spark, sf_dir, "documents"), "doc_id")
    return b.select("doc_id", "ordinal", F.array_join(legacy.dictionary_hits(T.canonical_of_normalized("text"), KEYWORDS), ",").alias("terms"))


def review_queue(spark, sf_dir):
    b = _blocks(spark, sf_dir).withColumn("block_id", F.concat("turn_id", F.lit("#"), F.col("ordinal").cast("string")))
    q = legacy.review_queue(b, _segments(spark, sf_dir, "canonical"), "block_id", place=PLACE, hash_name="sha256_64")
    best = F.col("candidate_segments")[0]
    return q.select("block_id", "resolution_status", F.coalesce(F.size("candidate_segments"), F.lit(0)).cast("long").alias("n_candidates"), best["doc_id"].alias("best_doc_id"), best["ordinal"].alias("best_ordinal"))


def _outputs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("source_json", T.fixed_json("lang", "source"))
    return legacy.identified(d.withColumn("text", F.when(F.col("doc_id") % 10 != 0, F.col("text"))))


def legacy_records(spark, sf_dir):
    r = legacy.records_of(_outputs(spark, sf_dir), KEYWORDS)
    return r.select("output_id", "output_hash", "block_id", "ordinal", "block_hash", F.array_join("labels", ",").alias("labels"), F.array_join("dictionary_hits", ",").alias("terms"))


def legacy_index(spark, sf_dir):
    """Every output, those without a text too."""
    o = _outputs(spark, sf_dir)
    return legacy.index(o, legacy.records_of(o)).select("output_id", "output_hash", "block_count", "bundle_path")


def legacy_counts(spark, sf_dir):
    o = _outputs(spark, sf_dir)
    return legacy.block_counts(legacy.index(o, legacy.records_of(o)))


def audited_resolutions(spark, sf_dir):
    """Documents as queue items, their labels as audited verdicts."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    queue = d.select(F.col("doc_id").alias("block_id"), F.lit("UNRESOLVED_NO_MATCH").alias("resolution_status"))
    verdict = F.when(F.col("toxic") == 1, "CONTRADICTED").when(F.col("quality") == 1, "SUPPORTED").otherwise("UNRESOLVED")
    evidence = F.when(verdict != "UNRESOLVED", F.array(F.col("doc_id").cast("string")))
    decisions = labels.select(F.col("doc_id").alias("block_id"), verdict.alias("verdict"), evidence.alias("evidence_segment_ids"), F.lit("reviewer").alias("reviewer"), F.lit(None).cast("string").alias("note"))
    out = legacy.apply_resolutions(queue, decisions, "block_id")
    return out.select("block_id", "resolution_status", F.array_join("evidence_segment_ids", ",").alias("evidence"), "resolution_note", "resolution_guard")


def _archive(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    key = F.col("doc_id").cast("string")
    m = d.select(key.alias("source_id"), F.concat(F.lit("doc:"), key).alias("url"), F.concat("source", F.lit(".txt")).alias("filename"), F.when(F.col("lang") == "en", "text").otherwise("").alias("expected_kind"))
    status = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "OK_PDF").otherwise("OK_TEXT")).otherwise(F.when(F.col("toxic") == 1, "").otherwise("DOWNLOAD_FAILED"))
    r = labels.select(key.alias("source_id"), status.alias("status"), F.lit("src0.txt").alias("filename"), F.col("quality").cast("string").alias("size_bytes"), F.sha2(key, 256).alias("sha256"), F.concat(F.lit("doc:"), key).alias("source_url"))
    return acquisition.join_records(acquisition.check_manifest(m), acquisition.check_results(r))


def archive_join(spark, sf_dir):
    conflict = F.col("result_filename_conflict.result")
    return _archive(spark, sf_dir).select("source_id", "source_kind", "acquisition_status", "source_sha256", "source_size_bytes", "bridge_status", conflict.alias("other_filename"), F.col("kind_mismatch.expected_status").alias("expected_status"))


def archive_summary(spark, sf_dir):
    return acquisition.summary(_archive(spark, sf_dir))


def provenance_alerts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    values = {"collection_location": F.col("lang"), "publication_section_label": F.upper("source"), "collector": F.col("source"), "narrator": F.concat(F.lit("N. "), F.col("lang"))}
    record = F.struct(*[values.get(f, F.lit(None).cast("string")).alias(f) for f in provenance.FIELDS])
    d = d.select("doc_id", record.alias("r"), "text")
    p = d.select(F.col("doc_id").alias("left_id"), F.col("r").alias("left"), F.col("text").alias("a")).join(d.select(F.col("doc_id").alias("right_id"), F.col("r").alias("right"), F.col("text").alias("b")), F.col("right_id") == F.col("left_id") + 1)
    p = p.select("left_id", "right_id", "left", "right", F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.9).alias("text_similarity"), F.lit(0.9).alias("rare_sequence_overlap"))
    out = provenance.compare_provenance(p, aliases={"src1": "src2", "src2": "src3"})
    own = F.size(provenance.internal_conflicts("left"))
    return out.select("left_id", "right_id", "same_collector", "same_narrator", "geography_conflict", "publication_relabel", F.array_join(F.transform("field_deltas", lambda x: x["field"]), ",").alias("deltas"), "alert", "severity", own.cast("long").alias("left_conflicts"))


def bundle_verify(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("source_json", T.fixed_json("lang", "source"))
    b = bundle.build_bundles(d, keep=("doc_id", "lang"))
    b = b.withColumn("doc_hash", F.when(F.col("lang") == "de", F.sha2(F.lit("tampered"), 256)).otherwise(F.col("doc_hash")))
    return bundle.verify_bundles(b).select("doc_id", "ok", F.array_join("errors", ",").alias("errors"), F.col("segment_count").cast("long").alias("segment_count"), "merkle_root")


def _built(spark, sf_dir):
    return bundle.build_bundles(table(spark, sf_dir, "documents").withColumn("source_json", T.fixed_json("lang", "source")), keep=("doc_id",))


def bundle_ingest(spark, sf_dir):
    w = bundle.ingest_bundles(_built(spark, sf_dir))
    return w.select("witness_id", "doc_hash", F.size("segments").cast("long").alias("n_segments"))


def bundle_artifacts(spark, sf_dir):
    """The files of every bundle, and the hash of the normalised text's file."""
    f = writers.bundle_files(_built(spark, sf_dir).withColumn("folder_", F.col("doc_id").cast("string")), "folder_")
    return f.groupBy("folder").agg(F.count("*").alias("files"), F.max(F.when(F.col("name") == "normalized.txt", F.sha2("content", 256))).alias("normalized_file"))


def source_stubs(spark, sf_dir):
    s = acquisition.source_stubs(_archive(spark, sf_dir), collection="test")
    return s.select("source_id", "acquisition_status", "collection", "raw_source_committed", "source_layer")


def listed_targets(spark, sf_dir):
    """Pages as listed files: those that may be fetched and are not done."""
    p = table(spark, sf_dir, "pages").select(F.concat("url", F.lit("/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".PDF").otherwise(".txt")).alias("path"), F.when(F.col("page_id") % 5 == 0, 0).otherwise(F.length("html")).cast("long").alias("size"), "page_id")
    return acquisition.pending_files(acquisition.listed_files(p, [".pdf"]), p.filter("page_id % 2 = 0")).select("page_id", "path", "size")


def _folder(spark, name):
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_scan(spark, sf_dir):
    """Nations as text files, written and scanned; other endings are left out."""
    n, path = table(spark, sf_dir, "nation"), _folder(spark, "files")
    name = F.when(F.col("n_nationkey") % 3 == 0, "a.pdf").when(F.col("n_nationkey") % 3 == 1, "b.MD").otherwise("c.txt")
    files = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("folder"), name.alias("name"), F.concat(F.lit("# "), "n_name", F.lit("\n\nFACT: "), "n_name").alias("content"))
    writers.write_files(files, path)
    found = readers.text_files(spark, path)
    return found.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.sha2("text", 256).alias("text_hash"))


def bundle_read(spark, sf_dir):
    """Bundles of nations, written, found by their manifests, read and checked."""
    n, path = table(spark, sf_dir, "nation"), _folder(spark, "bundles")
    key = F.col("n_nationkey").cast("string")
    d = n.select(F.concat("n_name", F.lit("\n\n region  "), F.col("n_regionkey").cast("string")).alias("text"), F.to_json(F.struct(key.alias("nation"))).alias("source_json"), F.array(F.to_json(F.struct(key.alias("seen")))).alias("ev"))
    writers.bundles(bundle.build_bundles(d, events="ev"), path)
    checked = bundle.verify_bundles(readers.bundles(spark, path))
    return checked.select("doc_hash", "ok", F.col("segment_count").cast("long").alias("segment_count"), "semantic_events_included", F.get_json_object("source_json", "$.nation").alias("nation"))


def manifest_read(spark, sf_dir):
    """Customers as a manifest and results in tab-separated files, read and joined."""
    c, m, r = table(spark, sf_dir, "customer"), _folder(spark, "manifest"), _folder(spark, "results")
    key = F.col("c_custkey").cast("string")
    manifest = c.select(F.concat(F.lit(" "), key).alias("source_id"), F.concat(F.lit("u"), key).alias("url"), F.concat(key, F.lit(".pdf")).alias("filename"), F.when(F.col("c_custkey") % 2 == 0, "TEXT").otherwise("PDF").alias("expected_kind"))
    results = c.filter("c_custkey % 3 <> 0").select(key.alias("source_id"), F.lit("OK_PDF").alias("status"), F.concat(key, F.lit(".pdf")).alias("filename"), key.alias("size_bytes"), F.sha2(key, 256).alias("sha256"), F.concat(F.lit("u"), key).alias("source_url"))
    manifest.write.csv(m, sep="\t", header=True)
    results.write.csv(r, sep="\t", header=True)
    found = acquisition.join_records(readers.archive_manifest(spark, m), readers.archive_results(spark, r))
    return found.groupBy("acquisition_status").agg(F.count("*").alias("records"), F.sum("source_size_bytes").cast("long").alias("bytes"))


def segments_read(spark, sf_dir):
    """Segments of conversations as lines of JSON, written and read."""
    path = _folder(spark, "segments")
    t = table(spark, sf_dir, "conversations").select(F.col("turn").cast("int").alias("ordinal"), F.sha2("text", 256).alias("segment_hash"), "text")
    writers.jsonl(t, path)
    s = readers.segments_jsonl(spark, path)
    return s.groupBy("ordinal").agg(F.count("*").alias("segments"), F.count_if(F.sha2("text", 256) == F.col("segment_hash")).alias("intact"))


def unknown_edge_types(spark, sf_dir):
    return graph.unknown_edge_types(_place_edges(spark, sf_dir))


def repeated_texts(spark, sf_dir):
    """Texts that more than one document has: what a unique key over them would refuse."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_hash"))
    return corpus.uniqueness_violations(d.filter("text_hash is not null"), "text_hash")


QUERIES = [
    normalize_canonical, segments, witness_ids, segment_ids, merkle_roots, qgram_postings, gram_df, exact_segment_dups, exact_segment_lookup,
    phrase_search, phrase_short, fuzzy_search, dictionary_scan, dictionary_positions, winnow_fingerprints, fingerprint_stats, fingerprint_candidates,
    compare_witnesses, segment_alignment, event_log, event_filter, next_event_edges, semantic_diff, slot_mutation, bfs_depth, dfs_preorder, version_tree,
    witness_lookup, gram_index, phrase_by_index, fuzzy_by_index, appended_index, winnow_positions, semantic_versions, version_faults, strong_components, edge_upsert, cyclic_part, graph_export, timeline_export, place_export, story_families, byte_totals, orphan_references,
    event_rows, slot_types, fixture_ingest, fixture_pairs, legacy_records, legacy_index, legacy_counts, audited_resolutions, bundle_ingest, bundle_artifacts, source_stubs, listed_targets, file_scan, bundle_read, manifest_read, segments_read, unknown_edge_types, repeated_texts,
    multi_predicate, earliest_attestation, event_windows, legacy_blocks, block_labels, block_terms, review_queue, archive_join, archive_summary, provenance_alerts, bundle_verify,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}
