"""Operators of the corpus engine on small cases, with the edge cases that tables of prose do not have."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import acquisition, bundle, compare, corpus, events, graph, legacy, provenance, search
from quillspan.sources import readers, writers
from quillspan.streaming import ingest


@pytest.fixture(scope="module")
def corpus_tables(spark):
    docs = [
        (1, "The river spirit took a silver bell.\n\nThree sisters crossed the bridge at night.", '{"k":1}'),
        (2, "The river spirit took a silver bell.\n\nNobody crossed the bridge.", '{"k":2}'),
        (3, "The river spirit took a silver bell.\n\nNobody crossed the bridge.", '{"k":2}'),
        (4, "短い話。銀の鈴。\n\nab", '{"k":3}'),
        (5, "", '{"k":4}'),
    ]
    w = corpus.add_witnesses(spark.createDataFrame(docs, "doc_id int, text string, metadata_json string"), order="doc_id").cache()
    return w, corpus.segments(w, "doc_id").cache()


def test_witnesses_are_content_addressed(spark, corpus_tables):
    w, s = corpus_tables
    assert w.count() == 4 and sorted(r["doc_id"] for r in w.collect()) == [1, 2, 4, 5]
    assert s.count() == 7 and corpus.uniqueness_violations(s, "witness_id", "ordinal").isEmpty()
    assert corpus.orphans(s, "witness_id", w, "witness_id").isEmpty()
    one = w.filter("doc_id = 1").first()
    assert corpus.witness(w, one["witness_id"]).first()["merkle_root"] == one["merkle_root"]
    assert corpus.witness(w, "none").isEmpty()
    same = corpus.repeated_segments(s).first()
    assert same["copies"] == 2
    hits = corpus.exact_segment_hash(s, spark.createDataFrame([(same["segment_hash"],)], "segment_hash string"))
    assert {r["doc_id"] for r in hits.collect()} == {1, 2} and {r["score"] for r in hits.collect()} == {1.0}


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, seq int")
    assert sorted(map(tuple, corpus.upsert(old, new, "k", seq="seq").collect())) == [("a", 1), ("b", 4), ("c", 5)]
    assert sorted(map(tuple, corpus.append_new(old, new.filter("seq = 1"), "k").collect())) == [("a", 1), ("b", 2), ("c", 5)]


def test_searches(spark, corpus_tables):
    _, s = corpus_tables
    place = ("doc_id", "ordinal")
    q = spark.createDataFrame([(1, "silver bell"), (2, "銀の"), (3, "..."), (4, "not there at all"), (5, "b")], "q int, text string")
    hits = {(r["q"], r["doc_id"], r["ordinal"]) for r in search.search_phrase(s, q, "q", place=place).collect()}
    assert {(1, 1, 0), (1, 2, 0), (2, 4, 0), (5, 4, 1)} <= hits and not {h for h in hits if h[0] in (3, 4)}
    assert search.search_phrase(s, q, "q", limit=1, place=place).filter("q = 1").collect()[0]["doc_id"] == 1
    assert search.search_phrase(s, q.limit(0), "q", place=place).isEmpty()
    fuzzy = search.search_fuzzy(s, q, "q", place=place).filter("q = 1").orderBy(F.desc("score")).collect()
    assert fuzzy[0]["ordinal"] == 0 and 0 < fuzzy[0]["score"] <= 1
    found = search.dictionary_scan(s, ["bridge", "BRIDGE!", "nothing", "...", "ab"], place=place).collect()
    per = {}
    for r in found:
        per.setdefault(r["keyword"], set()).add(r["doc_id"])
    assert per == {"bridge": {1, 2}, "BRIDGE!": {1, 2}, "nothing": {None}, "...": {None}, "ab": {4}}
    assert search.KeywordAutomaton(["aba", "ba", "BA"]).scan("ab aba") == [(2, "aba"), (2, "ba"), (2, "BA"), (4, "aba"), (4, "ba"), (4, "BA")]


def test_fingerprint_index(spark, corpus_tables):
    _, s = corpus_tables
    with pytest.raises(ValueError, match="not been built"):
        search.fingerprint_options(s)
    index = search.build_fingerprint_index(s, "doc_id", "ordinal", k=4, window=3)
    q = spark.createDataFrame([(1, "The river spirit took a silver bell."), (2, "")], "q int, text string")
    hits = search.search_fingerprints(index, q, "q", place=("doc_id", "ordinal")).filter("q = 1").orderBy(F.desc("fingerprint_jaccard"), "doc_id").collect()
    assert [(r["doc_id"], r["fingerprint_jaccard"]) for r in hits[:2]] == [(1, 1.0), (2, 1.0)]


def test_compare_and_align(spark, corpus_tables):
    _, s = corpus_tables
    pairs = spark.createDataFrame([(1, 2), (1, 1), (5, 99)], "left int, right int")
    r = {(x["left"], x["right"]): x for x in compare.compare_witnesses(compare.profiles(s, "doc_id"), pairs, "doc_id").collect()}
    assert r[1, 2]["exact_segment_jaccard"] == pytest.approx(1 / 3) and r[1, 1]["qgram_jaccard"] == 1.0
    assert (r[5, 99]["right_segments"], r[5, 99]["right_merkle_root"], r[5, 99]["qgram_jaccard"]) == (0, None, 0.0)
    a = [T.canonical_plain(x) for x in ("the moon rose over the hill", "a dog barked twice", "they married in the spring")]
    b = [T.canonical_plain(x) for x in ("something new happened here", "the moon rose over the hill", "rain fell for days", "they married in the spring")]
    assert [(i, j) for i, j, _ in compare.align(a, b, k=4, window=3)] == [(0, 1), (2, 3)]
    assert compare.align([], b) == [] and compare.align(a, []) == []
    m = compare.align_pairs(s, pairs, "doc_id").filter("left = 1 and right = 1").collect()
    assert [(x["left_ordinal"], x["right_ordinal"], x["score"]) for x in m] == [(0, 0, 1.0), (1, 1, 1.0)]


EVENT = "witness_id string, semantic_version string, ordinal int, predicate string, actor string, patient string, segment_id string, tags array<string>, payload string, state_before string, state_after string"


def test_event_ids_follow_canonical_json(spark):
    import hashlib

    rows = [("w", "v1", 0, "A", None, 'q"é', None, ["b", "a"], '{"y": 1, "x": "ß"}', None, '{"s":2.50}'), ("w", "v1", 1, "B", "x", None, "seg", None, None, None, None)]
    got = events.add_events(spark.createDataFrame(rows, EVENT)).orderBy("ordinal").collect()
    for r, e in zip(rows, got):
        obj = dict(zip(("witness_id", "semantic_version", "ordinal", "predicate", "actor", "patient", "segment_id"), r[:7])) | {"tags": sorted(r[7] or []), "payload": json.loads(r[8] or "{}"), "state_before": json.loads(r[9] or "{}"), "state_after": json.loads(r[10] or "{}")}
        assert e["event_id"] == hashlib.sha256(json.dumps(obj, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_event_diffs(spark):
    def row(w, o, p, payload="{}", actor=None):
        return (w, "v1", o, p, actor, None, None, [], payload, None, None)

    rows = [row("l", 0, "A", '{"n":"1"}'), row("l", 1, "B"), row("l", 2, "A", '{"n":"2"}'), row("r", 0, "A", '{"n":"1"}', "x"), row("r", 1, "C"), row("r", 2, "A", '{"n":"3","m":"1"}')]
    e = events.add_events(spark.createDataFrame(rows, EVENT))
    pairs = spark.createDataFrame([("l", "r")], "left string, right string")
    diff = {(r["predicate"], r["occurrence"]): (r["status"], r["changed"]) for r in events.semantic_diff(e, pairs).collect()}
    assert diff == {("A", 0): ("retained", "actor"), ("A", 1): ("retained", "payload"), ("B", 0): ("removed", ""), ("C", 0): ("added", "")}
    slots = {(r["predicate"], r["slot"]): (r["status"], r["left_value"], r["right_value"]) for r in events.slot_mutations(e, pairs).collect()}
    assert slots == {("A", "n"): ("retained", "2", "3"), ("A", "m"): ("retained", None, "1"), ("B", None): ("removed", None, None), ("C", None): ("added", None, None)}
    assert events.next_event_edges(e).count() == 4
    assert [r["predicate"] for r in events.search_events(e, semantic_version="v1").collect()] == ["A", "B", "A", "A", "C", "A"]
    assert [r["witness_id"] for r in events.with_all_predicates(e, ["A", "C"]).collect()] == ["r"]
    v = events.semantic_versions(spark.createDataFrame([("v1", None, '{"b":1, "a":2}', None, 1), ("v1", "v0", '{"a":2,"b":1}', "d", 2)], "semantic_version string, parent_version string, config string, description string, seq int"), "seq").first()
    assert (v["parent_version"], v["description"]) == ("v0", "d")


def test_graph(spark):
    def edges(*pairs, kind="T"):
        return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src string, dst string, edge_type string")

    starts = spark.createDataFrame([("a",), ("lonely",)], "node string")
    g = edges(("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f")).union(edges(("a", "z"), kind="U"))
    got = {(r["start"], r["node"]): r["depth"] for r in graph.bfs(g, starts, 2, "T").collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2, ("lonely", "lonely"): 0}
    assert graph.bfs(g, starts, None).count() == 8
    walk = lambda e, s, t=None: [r["node"] for r in graph.dfs_preorder(e, s, t).orderBy("position").collect()]
    assert walk(g, "a", "T") == ["a", "b", "c", "d", "e", "f"]
    assert walk(edges(("a", "c"), ("a", "b"), ("b", "c"), ("c", "d")), "a") == ["a", "b", "c", "d"]
    assert walk(g, "nowhere") == ["nowhere"]
    fan = edges(*[("r", f"n{k:02}") for k in range(40)], *[(f"n{k:02}", f"n{k:02}x") for k in range(40)])
    assert walk(fan, "r") == ["r", *[n for k in range(40) for n in (f"n{k:02}", f"n{k:02}x")]]
    assert [r["position"] for r in graph.dfs_preorder(fan, "r").orderBy("position").collect()] == list(range(81))
    old = g.withColumns({"confidence": F.lit(1.0), "provenance_json": F.lit("{}")})
    new = spark.createDataFrame([("a", "b", "T", 0.5, None, 1), ("q", "r", "T", None, None, 1)], "src string, dst string, edge_type string, confidence double, provenance_json string, seq int")
    put = {(r["src"], r["dst"]): r["confidence"] for r in graph.put_edges(old, new, "seq").collect()}
    assert put["a", "b"] == 0.5 and put["q", "r"] == 1.0 and len(put) == 9
    assert {r["edge_type"] for r in graph.unknown_edge_types(g).collect()} == {"T", "U"}


def record(**kw):
    return tuple(kw.get(f) for f in provenance.FIELDS)


def test_provenance(spark):
    fields = ", ".join(f"{f}: string" for f in provenance.FIELDS)
    a = record(collector="Zhang San", narrator="Old Li", collection_location="East Village", publication_section_label="West County")
    b = record(collector="zhang-san", narrator="X", collection_location="North Town", publication_section_label="East Village")
    c = record(collector="Wang", narrator="Y", collection_location="East Village")
    d = record(collector="Z. S.", collection_location="East Village", publication_section_label="East Village")
    rows = [(1, a, b, 0.9, 0.0), (2, a, c, 0.9, 0.9), (3, a, d, 0.9, 0.0), (4, d, d, 0.9, 0.0), (5, a, b, 0.5, 1.0), (6, c, c, 0.84, 1.0)]
    df = spark.createDataFrame(rows, f"id int, left struct<{fields}>, right struct<{fields}>, text_similarity double, rare_sequence_overlap double")
    out = {r["id"]: r for r in provenance.compare_provenance(df, aliases={"Z. S.": "zs", "zs": "Zhang San", "loop": "pool", "pool": "loop"}).collect()}
    assert (out[1]["alert"], out[1]["severity"]) == ("PSEUDOREPLICATION_ALERT", "HIGH")
    assert (out[2]["alert"], out[2]["severity"]) == ("SAME_OCCURRENCE_CANDIDATE", "MEDIUM") and out[2]["publication_relabel"]
    assert out[3]["same_collector"] and out[3]["alert"] == "PSEUDOREPLICATION_ALERT"
    assert out[4]["alert"] == "TEXTUAL_DEPENDENCE_CANDIDATE" and out[5]["alert"] is None and out[6]["alert"] is None
    assert [x["field"] for x in out[1]["field_deltas"]] == ["collection_location", "publication_section_label", "narrator"]
    own = df.select("id", F.size(provenance.internal_conflicts("left")).alias("n")).collect()
    assert {r["id"]: r["n"] for r in own}[1] == 1
    closed = provenance.resolve_aliases({"loop": "pool", "pool": "loop", "A": "B", "B": "C"})
    assert closed["a"] == "c" and closed["loop"] == "loop"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_acquisition(spark, tmp_path):
    m = write(f"{tmp_path}/m.tsv", "source_id\turl\tfilename\texpected_kind\ns1\tu1\tf1\tpdf\ns2\tu2\tf2\nname\tu3\tf3\tTEXT\ns4\tu4\tf4\tTEXT\n\t\t\t\n")
    r = write(f"{tmp_path}/r.tsv", "source_id\tstatus\tfilename\tsize_bytes\tsha256\tsource_url\ns1\tOK_PDF\tother\t12\tabc\tu1\ns2\tDOWNLOAD_FAILED\t\t\t\t\nname\tOK_PDF\tf3\t\tx\tuX\ngone\tOK_PDF\tf\t1\tx\tu\n")
    out = {x["source_id"]: x for x in acquisition.join_records(readers.archive_manifest(spark, m), readers.archive_results(spark, r)).collect()}
    assert {k: v["acquisition_status"] for k, v in out.items()} == {"s1": "ACQUIRED_VERIFIED_BY_BRIDGE", "s2": "DOWNLOAD_FAILED", "name": "SOURCE_KIND_MISMATCH", "s4": "FETCH_NOT_RUN_OR_RESULT_MISSING"}
    assert out["s1"]["source_size_bytes"] == 12 and out["s1"]["result_filename_conflict"]["result"] == "other" and out["s2"]["source_sha256"] is None
    assert out["name"]["result_url_conflict"]["result"] == "uX" and out["name"]["kind_mismatch"]["expected_status"] == "OK_TEXT"
    records = acquisition.join_records(readers.archive_manifest(spark, m), readers.archive_results(spark, r))
    assert acquisition.summary(records).first()["verified"] == 1
    stubs = acquisition.source_stubs(records, source_layer="X")
    assert stubs.first()["source_layer"] == "X" and stubs.first()["raw_source_committed"] is False
    writers.source_stubs(stubs, f"{tmp_path}/stubs")
    writers.jsonl(stubs, f"{tmp_path}/records", order="source_id", single=True)
    assert [json.loads(x["value"])["source_id"] for x in spark.read.text(f"{tmp_path}/records").collect()] == ["name", "s1", "s2", "s4"]
    for bad, what in (("a\tu\tf\tEPUB", "unsupported"), ("a\tu\tf\tPDF\na\tu\tf\tPDF", "duplicate"), ("\tu\tf\tPDF", "empty")):
        with pytest.raises(ValueError, match=what):
            readers.archive_manifest(spark, write(f"{tmp_path}/bad{what}.tsv", f"source_id\turl\tfilename\texpected_kind\n{bad}\n"))
    with pytest.raises(ValueError, match="missing TSV columns"):
        readers.archive_manifest(spark, write(f"{tmp_path}/cols.tsv", "source_id\turl\nx\ty\n"))
    listing = spark.createDataFrame([("b.TXT", 3), ("a.txt", 1), ("c.txt", 0), ("d.bin", 9)], "path string, size long")
    assert [x["path"] for x in acquisition.listed_files(listing, [".txt"]).collect()] == ["a.txt", "b.TXT"]
    assert [x["path"] for x in acquisition.pending_files(listing, listing.filter("size > 1")).collect()] == ["a.txt", "c.txt"]


def test_legacy_blocks_and_queue(spark, corpus_tables):
    text = "intro line\nsecond line\n\n# Heading\nbody FACT: one\r\n\r\n  \nLOCK FACT LOCK: TODO x\n＃ wide"
    rows = [(text, '{"source_path":"a"}'), ("", "{}"), (None, None)]
    df = spark.createDataFrame(rows, "text string, source_json string")
    blocks = legacy.legacy_records(df, terms=["second line", "nothing", "ONE"]).orderBy("ordinal").collect()
    assert [b["text"] for b in blocks] == ["intro line second line", "# Heading", "body FACT: one", "LOCK FACT LOCK: TODO x # wide"]
    # neighbouring labels share a delimiter, so every second one of LOCK FACT LOCK: TODO is found
    assert [b["labels"] for b in blocks] == [["IDEA_CANDIDATE"], ["IDEA_CANDIDATE"], ["FACT"], ["LOCK", "TODO"]]
    assert [b["dictionary_hits"] for b in blocks[:3]] == [["second line"], [], ["ONE"]]
    assert json.loads(blocks[0]["source_json"])["legacy_output_version"] == "legacy-output/v1"
    _, s = corpus_tables
    index = search.build_fingerprint_index(s, "doc_id", "ordinal")
    queue = legacy.review_queue(spark.createDataFrame([("b1", 0, "The river spirit took a silver bell."), ("b2", 1, "unrelated words entirely")], "block_id string, ordinal int, text string").withColumnRenamed("ordinal", "block_ordinal"), index, "block_id", place=("doc_id", "ordinal"))
    status = {r["block_id"]: r["resolution_status"] for r in queue.collect()}
    assert status == {"b1": "UNRESOLVED_CANDIDATES", "b2": "UNRESOLVED_NO_MATCH"} and queue.first()["guard"] == legacy.QUEUE_GUARD
    decide = lambda *r: spark.createDataFrame([r], "block_id string, verdict string, evidence_segment_ids array<string>, reviewer string, note string")
    done = {r["block_id"]: r for r in legacy.apply_resolutions(queue, decide("b1", "SUPPORTED", ["s"], "me", None), "block_id").collect()}
    assert done["b1"]["resolution_status"] == "SUPPORTED" and done["b1"]["resolution_note"] == "" and done["b2"]["resolution_guard"] is None
    with pytest.raises(ValueError, match="requires evidence"):
        legacy.apply_resolutions(queue, decide("b1", "SUPPORTED", [], "me", ""), "block_id")
    with pytest.raises(ValueError, match="invalid verdict"):
        legacy.apply_resolutions(queue, decide("b1", "MAYBE", ["s"], "me", ""), "block_id")


def test_bundles(spark, tmp_path):
    rows = [("First  part.\n\nSecond part.", '{"title":"t"}'), ("single", '{"title":"ü"}'), ("", "{}")]
    built = bundle.build_bundles(spark.createDataFrame(rows, "text string, source_json string"))
    assert bundle.verify_bundles(built).filter("not ok").isEmpty()
    writers.bundles(built, f"{tmp_path}/b")
    back = readers.bundles(spark, f"{tmp_path}/b")
    assert back.count() == 3 and bundle.verify_bundles(back).filter("not ok").isEmpty()
    w = bundle.ingest_bundles(back)
    assert {r["n"] for r in w.select(F.size("segments").alias("n")).collect()} == {1}
    assert sorted(r["n"] for r in bundle.ingest_bundles(back, "artifact").select(F.size("segments").alias("n")).collect()) == [1, 1, 2]
    bad = back.withColumn("normalized", F.concat("normalized", F.lit("!")))
    assert "doc_hash_mismatch" in bundle.verify_bundles(bad).first()["errors"]
    with pytest.raises(ValueError, match="doc_hash_mismatch"):
        bundle.ingest_bundles(bad)
    swapped = back.withColumn("segments", F.reverse("segments"))
    errors = {e for r in bundle.verify_bundles(swapped).collect() for e in r["errors"]}
    assert {"segment_ordinal_mismatch:0", "segment_ordinal_mismatch:1", "merkle_root_mismatch", "normalized_reconstruction_mismatch"} <= errors


def test_files_and_fixtures(spark, tmp_path):
    write(f"{tmp_path}/x/a.MD", "# t\n\nbody")
    write(f"{tmp_path}/x/sub/b.txt", "plain")
    write(f"{tmp_path}/x/c.bin", "no")
    assert sorted(r["text"] for r in readers.text_files(spark, f"{tmp_path}/x").collect()) == ["# t\n\nbody", "plain"]
    f = write(f"{tmp_path}/f/f.json", json.dumps({"fixtures": [{"fixture_id": "i", "semantic_version": "v", "source": {"title": "t"}, "derived_test_segments": ["one", "two"], "events": [{"ordinal": 0}]}]}))
    docs = bundle.load_fixture_documents(readers.fixtures(spark, f))
    w = corpus.add_witnesses(docs).first()
    assert w["segments"] == ["one", "two"] and json.loads(w["metadata_json"])["fixture_kind"] == "DERIVED_PUBLIC_SAFE_BENCHMARK"
    assert set(readers.empty_tables(spark)) == {"witness", "segment", "gram", "semantic_version", "event", "edge", "fingerprint_meta", "fingerprint"}


def test_streaming_ingest_is_incremental(spark, tmp_path):
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    put = lambda *rows: spark.createDataFrame(rows, "text string, metadata_json string").coalesce(1).write.mode("append").parquet(src)
    put(("one\ntwo", "{}"), ("three", "{}"))
    for _ in range(2):
        ingest.ingest(ingest.document_stream(spark, src), out, state).awaitTermination(60)
        assert spark.read.parquet(f"{out}/witness").count() == 2
    put(("three", "{}"), ("four", "{}"))
    ingest.ingest(ingest.document_stream(spark, src), out, state).awaitTermination(60)
    assert spark.read.parquet(f"{out}/witness").count() == 3 and spark.read.parquet(f"{out}/segment").count() == 4


def test_command_line(spark, tmp_path, capsys):
    from quillspan import cli

    at = f"{tmp_path}/corpus"
    meta, text = write(f"{tmp_path}/m.json", '{"b": 1, "a": 2}'), write(f"{tmp_path}/t.txt", "A silver bell rang.\n\nThen silence.")
    call = lambda *a: cli.run(spark, cli.build_parser().parse_args([at, *a]))
    call("init")
    call("ingest", "--text", text, "--meta", meta)
    call("ingest", "--text", text, "--meta", meta)
    capsys.readouterr()
    call("phrase", "Silver Bell")
    call("fuzzy", "silver bells")
    call("dictionary", "silence", "absent")
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert lines[0]["ordinal"] == 0 and lines[1]["score"] == round(lines[1]["score"], 6)
    assert {"keyword": "silence", "hits": 1} in lines and {"keyword": "absent", "hits": 0} in lines


def test_queries_match_their_sql(spark):
    """A few registered queries against DuckDB on the smallest tables."""
    import duckdb
    import pandas as pd

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    from quillspan.plans.oracle import oracle_sql
    from quillspan.plans.queries import queries

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    made, sql = queries(), oracle_sql()
    assert set(made) - set(sql) == {"segment_alignment"}
    plain = lambda v: None if pd.isna(v) else round(v, 9) if isinstance(v, float) else str(v)
    for name in ("segments", "merkle_roots", "phrase_search", "fuzzy_search", "dictionary_scan", "fingerprint_candidates", "slot_mutation", "bfs_depth", "block_labels", "archive_join", "bundle_verify"):
        p, r = made[name](spark, sf).toPandas(), con.execute(sql[name]).df()
        assert sorted(p.columns) == sorted(r.columns), name
        rows = lambda d, c=sorted(p.columns): sorted((tuple(plain(v) for v in x) for x in d[c].astype(object).values.tolist()), key=repr)
        assert [[str(v).removesuffix(".0") for v in x] for x in rows(p)] == [[str(v).removesuffix(".0") for v in x] for x in rows(r)], name


def test_alignment_has_the_best_score(spark):
    """The path's score is the best there is, by plain recursion."""
    import functools
    import random

    rng = random.Random(8)
    for _ in range(60):
        n, m = rng.randrange(0, 6), rng.randrange(0, 6)
        gains = [{j: rng.choice([0.2, 0.5, 1.0]) for j in range(m) if rng.random() < 0.4} for _ in range(n)]

        @functools.cache
        def best(i, j, gains=gains):
            ways = []
            if i and j:
                ways.append(best(i - 1, j - 1) + gains[i - 1].get(j - 1, -0.05))
            ways += [best(i - 1, j) - 0.05] if i else []
            ways += [best(i, j - 1) - 0.05] if j else []
            return max(ways, default=0.0)

        path = compare.best_path(gains, m, 0.05)
        assert all(a < c and b < d for (a, b), (c, d) in zip(path, path[1:]))
        assert abs(sum(gains[i].get(j, -0.05) for i, j in path) - 0.05 * (n + m - 2 * len(path)) - best(n, m)) < 1e-9


def test_alignment_in_blocks_is_that_of_the_whole_table():
    """Any block size gives the same path, ties included, and moves of one block alone are held."""
    import random
    import tracemalloc

    rng = random.Random(21)
    for _ in range(150):
        n, m = rng.randrange(0, 24), rng.randrange(0, 24)
        gains = [{j: rng.choice([0.2, 0.5, 1.0]) for j in range(m) if rng.random() < 0.2} for _ in range(n)]
        whole = compare.best_path(gains, m, 0.05, block=n + 1)
        assert all(compare.best_path(gains, m, 0.05, block=b) == whole for b in (1, 2, 5, None))
        assert all(0 <= i < n and 0 <= j < m for i, j in whole)
    n = 5000
    gains = [{(i * 7919) % n: 0.3, i: 0.9} for i in range(n)]
    tracemalloc.start()
    path = compare.best_path(gains, n, 0.05)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert path == [(i, i) for i in range(n)] and peak < n * n / 4


def test_cycles_and_checked_events_and_typed_slots(spark):
    edges = spark.createDataFrame([(a, b, "E", 1.0) for a, b in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "a"), ("s", "s")]], "src string, dst string, edge_type string, confidence double")
    assert {tuple(r) for r in graph.cyclic_part(edges).select("src", "dst").collect()} == {("a", "b"), ("b", "c"), ("c", "a"), ("s", "s")}
    assert graph.cyclic_part(edges.filter("src in ('d', 'x')")).isEmpty()
    schema = "witness_id string, semantic_version string, ordinal int, predicate string, actor string, patient string, segment_id string, tags array<string>, payload string, state_before string, state_after string"
    rows = [("w1", "v1", 0, "P", None, None, None, None, '{"n": 1, "s": "x", "o": {"b": 1, "a": 2}}', None, None), ("w2", "v1", 0, "P", None, None, None, None, '{"n": "1", "s": "x", "o": {"a": 2, "b": 1}, "z": null}', None, None)]
    e = spark.createDataFrame(rows, schema)
    witnesses, versions = spark.createDataFrame([("w1",), ("w2",)], "witness_id string"), spark.createDataFrame([("v1",)], "semantic_version string")
    log = events.add_checked(e, witnesses, versions)
    assert [(r["slot"], r["left_value"], r["right_value"]) for r in events.slot_mutations(log, spark.createDataFrame([("w1", "w2")], "left string, right string")).collect()] == [("n", "1", "1")]
    with pytest.raises(ValueError, match="unknown witness_id: w2"):
        events.add_checked(e, witnesses.limit(1), versions)


def test_bundles_with_events(spark, tmp_path):
    import json

    docs = spark.createDataFrame([("A text.", '{"t": 1}', ['{"predicate": "P", "ordinal": 0}']), ("Other.", "{}", None)], "text string, source_json string, ev array<string>")
    writers.bundles(bundle.build_bundles(docs, events="ev", include_raw=True), f"{tmp_path}/b")
    found = sorted((tmp_path / "b").iterdir(), key=lambda p: (p / "normalized.txt").read_text())
    assert [(p / "semantic-events.jsonl").exists() for p in found] == [True, False]
    assert (found[0] / "semantic-events.jsonl").read_text() == '{"ordinal":0,"predicate":"P"}\n' and (found[0] / "raw.txt").read_text() == "A text."
    manifest = json.loads((found[0] / "manifest.json").read_text())
    assert manifest["artifacts"]["semantic_events"] == "semantic-events.jsonl" and manifest["semantic_events_included"] and manifest["segment_count"] == 1


def test_keywords_are_found_in_many_texts_at_once(spark):
    """Hits of joined texts are those of single ones: none over an end, overlapping ones and keywords of one form each."""
    import random

    rng = random.Random(3)
    for keywords in (["ab", "A b", "ba", "aba", "bb"], ["zz"], ["", "-"], []):
        machine = search.KeywordAutomaton(keywords)
        texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 9]))) for _ in range(200)]
        owner, ends, raws = machine.scan_all(texts)
        assert sorted(zip(owner.tolist(), ends.tolist(), raws.to_pylist(), strict=True)) == sorted((i, e, r) for i, t in enumerate(texts) for e, r in machine.scan_canonical(t))
    assert len(machine.scan_all([])[0]) == 0
    segs = spark.createDataFrame([(1, 0, "xab"), (1, 1, None), (2, 0, "ba"), (3, 0, "")], "doc_id long, ordinal int, canonical string").coalesce(1)
    hits = search.keyword_positions(segs, ["ab", "a", "zz"], ("doc_id", "ordinal"))
    assert sorted(map(tuple, hits.collect())) == [(1, 0, "a", 1), (1, 0, "ab", 2), (2, 0, "a", 1)]
    assert "MapInPandas" not in hits._jdf.queryExecution().executedPlan().toString()
