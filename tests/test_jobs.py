"""Jobs from end to end, on a fixture of the shape of a gold set."""

import json

from pyspark.sql import functions as F

from quillspan.operators import corpus, graph, legacy
from quillspan.plans import jobs
from quillspan.sources import readers

FIXTURE = {
    "fixtures": [
        {
            "fixture_id": f"f{k}",
            "semantic_version": "v1",
            "source": {"title": f"tale {k}", "pages": [1, 2]},
            "derived_test_segments": ["The spirit asks for hair.", "The rope breaks.", *(["They wash the bell."] if k else [])],
            "events": [{"ordinal": o, "segment_ordinal": o % 2, "predicate": p, "payload": {"owner": "a" if k else "b"} if p == "CUT" else None, "tags": ["y", "x"]} for o, p in enumerate(["ASK", "CUT", "FALL"] + ["WASH", "FEAST"] * k)],
        }
        for k in (0, 1)
    ]
}


def test_fixture_round_trip(spark, tmp_path):
    path = tmp_path / "fixtures.json"
    path.write_text(json.dumps(FIXTURE))
    tables = {k: v.cache() for k, v in jobs.ingest_fixtures(readers.fixtures(spark, str(path))).items()}
    assert {k: v.count() for k, v in tables.items()} == {"witness": 2, "segment": 5, "semantic_version": 1, "event": 8, "edge": 6}
    assert tables["event"].filter("segment_id is null").isEmpty()
    assert corpus.orphans(tables["event"], "witness_id", tables["witness"], "witness_id").isEmpty()
    ids = {r["fixture_id"]: r["witness_id"] for r in tables["witness"].collect()}
    pairs = spark.createDataFrame([(ids["f0"], ids["f1"])], "left string, right string")
    text, diff = jobs.compare_fixture_pairs(tables, pairs)
    assert text.first()["exact_segment_jaccard"] == 2 / 3
    status = {(r["predicate"], r["status"], r["changed"]) for r in diff.collect()}
    assert status == {("ASK", "retained", ""), ("CUT", "retained", "payload"), ("FALL", "retained", ""), ("WASH", "added", ""), ("FEAST", "added", "")}
    chain = [r["event_id"] for r in tables["event"].filter("fixture_id = 'f1'").orderBy("place").collect()]
    walk = graph.bfs(tables["edge"], spark.createDataFrame([(chain[0],)], "node string"), None, "NEXT_EVENT").orderBy("depth").collect()
    assert [r["node"] for r in walk] == chain
    assert [r["node"] for r in graph.dfs_preorder(tables["edge"], chain[0]).orderBy("position").collect()] == chain


def test_export_scan_and_review(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("# Notes\n\nFACT: the rope breaks in every version of the tale\n")
    (tmp_path / "in/sub/b.TXT").write_text("nothing of note")
    counts = jobs.scan_exports(spark, str(tmp_path / "in"), str(tmp_path / "out"), terms=["rope"]).first()
    assert (counts["files"], counts["blocks"]) == (2, 3)
    back = spark.read.json(f"{tmp_path}/out/blocks")
    assert "text" in back.columns and {json.loads(r["source_json"])["source_path"] for r in back.collect()} == {"a.md", "sub/b.TXT"}
    jobs.scan_exports(spark, str(tmp_path / "in"), str(tmp_path / "hashes"), include_text=False)
    assert "text" not in spark.read.json(f"{tmp_path}/hashes/blocks").columns
    assert spark.read.json(f"{tmp_path}/out/LEGACY_INDEX").count() == 2
    segs = corpus.segments(corpus.add_witnesses(spark.createDataFrame([("The rope breaks in every version of the tale.", "{}")], "text string, metadata_json string")))
    blocks = legacy.legacy_records(readers.text_files(spark, str(tmp_path / "in")).withColumn("source_json", F.lit("{}")))
    queue = {r["text"]: r for r in jobs.review(segs, blocks).collect()}
    hit = queue["FACT: the rope breaks in every version of the tale"]
    assert hit["resolution_status"] == "UNRESOLVED_CANDIDATES" and hit["candidate_segments"][0]["segment_id"] == segs.first()["segment_id"]
    assert queue["nothing of note"]["resolution_status"] == "UNRESOLVED_NO_MATCH"


def test_archive_bridge(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("source_id\turl\tfilename\ns1\tu\tf\ns2\tu\tf\n")
    (tmp_path / "r.tsv").write_text("source_id\tstatus\tfilename\tsize_bytes\tsha256\tsource_url\ns1\tOK_PDF\tf\t3\tabc\tu\n")
    assert jobs.archive_bridge(spark, f"{tmp_path}/m.tsv", f"{tmp_path}/r.tsv", f"{tmp_path}/stubs", f"{tmp_path}/rec") == {"records": 2, "verified": 1, "source_stubs": 2}
    assert jobs.archive_bridge(spark, f"{tmp_path}/m.tsv", None, f"{tmp_path}/stubs2")["verified"] == 0
