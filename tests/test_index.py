"""The stored index and its snapshots against the scans and against plain counting."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import corpus, legacy, search
from quillspan.operators.overlap_index import OverlapIndex, best, gram_lists, size_of
from quillspan.sources.snapshots import Conflict, Snapshots, children

PLACE = ("doc_id", "ordinal")
TYPES = {"doc_id": "long", "ordinal": "int"}


def corpus_rows(n=60, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7))) for _ in range(40)]
    docs = [(k, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(3))) for k in range(n)]
    return docs + [(900, ""), (901, None), (902, docs[0][1]), (903, "ab"), (904, "日本語の文 " * 5)]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def segs(spark):
    return corpus.document_segments(spark.createDataFrame(corpus_rows(), "doc_id long, text string"), "doc_id").persist()


@pytest.fixture(scope="module")
def asked(spark):
    docs = corpus_rows()
    texts = [" ".join((docs[k][1] or "").split()[3:6]) for k in range(12)] + ["nothing like it here", "", "ab", "c", "日本語", docs[5][1]]
    return spark.createDataFrame(list(enumerate(texts)), "q long, text string")


def test_best_is_what_counting_gives():
    rng = random.Random(5)
    for _ in range(600):
        n, k = rng.randrange(1, 300), rng.choice([1, 3, 10, 200])
        lists = [np.array(sorted(rng.sample(range(n), rng.randrange(1, n + 1) if rng.random() < 0.3 else min(n, rng.randrange(1, 9)))), np.int32) for _ in range(rng.randrange(1, 40))]
        least = rng.choice([1, 1, 2])
        counts = Counter(int(x) for own in lists for x in own)
        expected = sorted(((x, c) for x, c in counts.items() if c >= least), key=lambda r: (-r[1], r[0]))[:k]
        some, shared = best(lists, n, k, least)
        assert sorted(zip(some.tolist(), shared.tolist(), strict=True)) == sorted(expected)


def test_common_lists_are_only_looked_up(monkeypatch):
    """A list of all segments is not added when the k best are settled by rarer ones."""
    added = []
    count = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, **k: added.append(len(x)) or count(x, **k))
    n = 50_000
    rare = [np.arange(10, dtype=np.int32) * 7 for _ in range(6)]
    common = [np.arange(n, dtype=np.int32) for _ in range(3)]
    some, shared = best(rare + common, n, 10)
    assert some.tolist() == [7 * i for i in range(10)] and set(shared.tolist()) == {9}
    assert max(added) < n


def test_gram_lists_are_what_single_texts_give():
    """Also for alphabets whose grams do not fit one number, and for texts shorter than a gram."""
    rng = random.Random(11)
    for q, letters in ((1, "ab"), (3, "abcdef"), (3, "".join(map(chr, range(0x4E00, 0x5200))) + "\U0001f600"), (9, "".join(map(chr, range(1, 2000))))):
        for _ in range(20):
            texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))) for _ in range(rng.randrange(0, 30))]
            expected: dict[str, list] = {}
            for i, t in enumerate(texts):
                for g in {t[j : j + q] for j in range(max(1, len(t) - q + 1))} if t else ():
                    expected.setdefault(g, []).append(i)
            tokens, ends, owners, sizes = gram_lists(texts, q)
            assert {t: owners[a:b].tolist() for t, a, b in zip(tokens, ends, ends[1:], strict=False)} == expected
            assert len(tokens) == len(expected) and sizes.tolist() == [sum(i in x for x in expected.values()) for i in range(len(texts))]


@pytest.mark.parametrize("shard_chars,folder_postings", [(4_000_000, 400_000), (1500, 300)])
def test_index_agrees_with_the_scans(spark, tmp_path, segs, asked, shard_chars, folder_postings):
    path = f"file://{tmp_path}/grams"
    index = OverlapIndex.create(spark, path, TYPES, "grams", shard_chars, folder_postings, q=3).append(segs)
    for rarest in (1, 3, 100):
        assert rows(index.phrases(asked, "q", rarest=rarest)) == rows(search.search_phrase(segs, asked, "q", place=PLACE))
    assert rows(index.phrases(asked, "q", limit=2)) == rows(search.search_phrase(segs, asked, "q", limit=2, place=PLACE))
    for most in (200, 7):
        plain = search.search_fuzzy(segs, asked, "q", candidate_limit=most, place=PLACE).select("q", *PLACE, "score")
        assert rows(index.similar(asked, "q", candidate_limit=most).drop("shared")) == rows(plain)
    assert rows(index.postings()) == rows(corpus.postings(segs, *PLACE))


def test_a_phrase_reads_little_of_the_index(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    docs = [(k, " ".join(rng.choice(words[:60]) for _ in range(200)) + " " + words[k % 3000]) for k in range(1500)]
    segs = corpus.document_segments(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id")
    index = OverlapIndex.create(spark, f"file://{tmp_path}/grams", TYPES, "grams", 100_000, 10_000, q=3).append(segs)
    tokens = index.frequencies().filter("n <= 2").limit(3)
    read, whole = size_of(spark, index.folders(tokens)), size_of(spark, [f"{index.path}/lists"])
    assert 0 < read < 0.05 * whole
    query = spark.createDataFrame([(1, words[700] + " ")], "q long, text string")
    assert [(r["doc_id"], r["score"]) for r in index.phrases(query, "q").collect()] == [(700, 1.0)]


def test_appends_compaction_and_versions(spark, tmp_path, segs, asked):
    path = f"file://{tmp_path}/grams"
    empty = OverlapIndex.create(spark, path, TYPES, "grams", 2000, 500, q=3)
    assert rows(empty.phrases(asked, "q")) == rows(empty.similar(asked, "q")) == []
    half = empty.append(segs.filter("doc_id % 2 = 0"))
    whole = half.append(segs.filter("doc_id % 2 = 1"))
    expected = rows(search.search_fuzzy(segs, asked, "q", place=PLACE).select("q", *PLACE, "score"))
    assert rows(whole.similar(asked, "q").drop("shared")) == expected
    assert rows(half.similar(asked, "q").drop("shared")) == rows(search.search_fuzzy(segs.filter("doc_id % 2 = 0"), asked, "q", place=PLACE).select("q", *PLACE, "score"))
    with pytest.raises(Conflict):  # half has been appended to already; the part that was written stays unnamed
        half.append(segs.filter("doc_id = 1"))
    one = whole.compact()
    assert len(one.meta["parts"]) == 1 and rows(one.similar(asked, "q").drop("shared")) == expected
    assert rows(OverlapIndex(spark, path, half.version).similar(asked, "q")) == rows(half.similar(asked, "q"))
    assert one.vacuum() > 0 and rows(one.phrases(asked, "q")) == rows(search.search_phrase(segs, asked, "q", place=PLACE))
    assert [name for name, _, _ in children(spark, f"{path}/lists")] == [f"part={one.meta['parts'][0]}"]
    assert not [name for name, _, _ in children(spark, path) if name.startswith("_stage")]


def test_a_failed_append_leaves_the_old_version(spark, tmp_path, segs, asked):
    path = f"file://{tmp_path}/grams"
    index = OverlapIndex.create(spark, path, TYPES, "grams", q=3).append(segs)
    broken = segs.withColumn("canonical", F.when(F.col("doc_id") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("canonical")))
    with pytest.raises(Exception, match="broken"):
        index.append(broken)
    again = OverlapIndex(spark, path)
    assert again.version == index.version and rows(again.phrases(asked, "q")) == rows(index.phrases(asked, "q"))


def test_fingerprint_index_and_review(spark, tmp_path, segs, asked):
    options = {"k": 4, "window": 3, "hash": "blake2b64"}
    index = OverlapIndex.create(spark, f"file://{tmp_path}/prints", TYPES, "fingerprints", 1500, 300, texts=False, **options).append(segs)
    plain = search.build_fingerprint_index(segs, *PLACE, k=4, window=3)
    for least in (1, 3):
        expected = search.search_fingerprints(plain, asked, "q", min_shared=least, place=PLACE)
        assert rows(index.similar(asked, "q", least=least)) == rows(expected)
    assert OverlapIndex(spark, index.path).meta["options"] == options  # kept beside the data
    blocks = asked.select(F.col("q").alias("block_id"), "text")
    queue = [legacy.review_queue(blocks, i, "block_id", place=PLACE).select("block_id", "resolution_status", "candidate_segments") for i in (index, plain)]
    assert rows(queue[0]) == rows(queue[1])
    with pytest.raises(ValueError, match="has not been built"):
        OverlapIndex(spark, f"file://{tmp_path}/nothing")
    with pytest.raises(ValueError, match="keeps no texts"):
        index.texts()


def test_snapshots(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/table")
    assert table.read() == (0, {})
    assert table.commit(0, {"a": 1}) == 1 and table.commit(1, {"a": "ü"}) == 2
    assert table.read() == (2, {"a": "ü"}) and table.read(1) == (1, {"a": 1})
    with pytest.raises(Conflict):
        table.commit(1, {"a": 3})
    assert table.read() == (2, {"a": "ü"})
    assert [name for name, _, _ in children(spark, f"{table.path}/_snapshots") if "draft" in name] == []


def test_fingerprint_rows_are_made_once(spark):
    """The plan makes each text's fingerprints once; texts without any, and copies, keep their results."""
    from quillspan.operators import search

    segs = spark.createDataFrame([(1, 0, "abcdefghijklmnopqrstuvwxyz"), (1, 1, ""), (2, 0, "abcdefghijklmnopqrstuvwxyz"), (3, 0, None)], "doc_id long, ordinal int, canonical string")
    index = search.build_fingerprint_index(segs, "doc_id", "ordinal")
    assert index._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    queries = spark.createDataFrame([("a", "abcdefghijklmnopqrstuvwxyz"), ("b", ""), ("c", None)], "q string, text string")
    got = search.search_fingerprints(index, queries, "q", place=("doc_id", "ordinal")).collect()
    assert sorted((r["q"], r["doc_id"], r["ordinal"], r["fingerprint_jaccard"]) for r in got) == [("a", 1, 0, 1.0), ("a", 2, 0, 1.0)]


def test_a_batch_sends_on_no_more_hits_than_the_limit(spark):
    """Hits of a common phrase are cut where they are found; the first by place stay, whatever the order of rows."""
    from quillspan.operators import search

    segs = spark.createDataFrame([(i * 37 % 500, 0, "abcabc") for i in range(500)], "doc_id long, ordinal int, canonical string").coalesce(1)
    queries = spark.createDataFrame([("a", "ab"), ("b", "ab"), ("c", "zz")], "q string, text string")
    hits = search.search_phrase(segs, queries, "q", limit=5, place=("doc_id", "ordinal"))
    assert sorted((r["q"], r["doc_id"]) for r in hits.collect()) == [(q, i) for q in "ab" for i in range(5)]
    kept = []
    segs_ = type("Rows", (), {"select": lambda self, *c: self, "dtypes": segs.select("doc_id", "ordinal").dtypes, "sparkSession": spark, "mapInPandas": lambda self, scan, schema: kept.append(scan) or spark.createDataFrame([], schema)})()
    search.search_phrase(segs_, queries, "q", limit=5, place=("doc_id", "ordinal"))
    assert sum(map(len, kept[0](iter([segs.toPandas()])))) == 10


def test_packed_lists_keep_their_numbers():
    """Gaps take one, two or four bytes; common tokens take one byte a segment."""
    from quillspan.operators.overlap_index import packed, unpacked

    rng = random.Random(4)
    lists = [sorted(rng.sample(range(top), rng.randrange(1, min(top, 300)))) for top in (2, 200, 60_000, 5_000_000) for _ in range(20)] + [[0], [255], [256], [65_535], [65_536], list(range(40_000))]
    rng.shuffle(lists)
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    order, sizes, data = packed(ends, np.concatenate(lists).astype(np.int32))
    got = [unpacked(b, int(n)).tolist() for b, n in zip(data.to_pylist(), sizes, strict=True)]
    assert got == [lists[i] for i in order] and sorted(order) == list(range(len(lists)))
    assert len(data[order.tolist().index(lists.index(list(range(40_000))))].as_py()) == 40_000
    assert len(packed(np.zeros(1, np.int32), np.zeros(0, np.int32))[2]) == 0


def test_lists_are_stored_as_bytes(spark, tmp_path, segs):
    index = OverlapIndex.create(spark, f"file://{tmp_path}/grams", TYPES, "grams", 1500, 300, q=3).append(segs)
    assert dict(spark.read.parquet(f"{index.path}/lists").dtypes)["ids"] == "binary"
    assert {r["token"]: r["n"] for r in index.frequencies().groupBy("token").agg(F.sum("n").alias("n")).collect()} == {r["token"]: r["n"] for r in index.lists().groupBy("token").agg(F.sum(F.size("ids")).alias("n")).collect()}
    meta = index.meta | {"format": 1}
    Snapshots(spark, index.path).commit(index.version, meta)
    with pytest.raises(ValueError, match="another format"):
        OverlapIndex(spark, index.path)


def test_many_candidates_are_added_up_and_not_looked_up(monkeypatch):
    """Where nearly every segment can still win, one pass over the lists costs less than a look at each list for each segment."""
    rng = np.random.default_rng(2)
    lists = [np.flatnonzero(rng.random(4000) < 0.4) for _ in range(120)]
    looked, search_in = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, **k: looked.append(np.size(v)) or search_in(a, v, **k))
    some, shared = best(lists, 4000, 50)
    counts = np.bincount(np.concatenate(lists), minlength=4000)
    assert sorted(zip((-shared).tolist(), some.tolist(), strict=True)) == sorted(zip((-counts).tolist(), range(4000), strict=True))[:50]
    assert sum(looked) < 4000


def test_texts_stay_where_they_are_when_phrases_have_few_candidates(spark, tmp_path, segs, asked):
    """Texts too large to be sent whole are not shuffled either, if the candidates are small enough to be sent."""
    index = OverlapIndex.create(spark, f"file://{tmp_path}/grams", TYPES, "grams", 800, 300, q=3).append(segs)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size_of(spark, [f"{index.path}/texts"]) // 2))
    try:
        plan = index.phrases(asked.filter("char_length(text) > 3"), "q")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "canonical" in plan and "hashpartitioning(part" not in plan


def test_similar_segments_are_what_the_index_finds(spark, segs, asked, tmp_path):
    """Copies on both sides, limits that fall among copies and among equal counts, and keys given twice."""
    plain = search.build_fingerprint_index(segs, *PLACE, k=4, window=3)
    many = segs
    for i in range(1, 5):
        many = many.unionByName(segs.withColumn("doc_id", (F.col("doc_id") * 7 + i * 10_000).cast("long")))
    double = asked.unionByName(asked.withColumn("q", (F.col("q") + 100).cast("long")))
    whole = search.build_fingerprint_index(many, *PLACE, k=4, window=3)
    for s, index in ((segs, plain), (many, whole)):
        for most, limit, least in ((200, 20, 1), (7, 5, 1), (3, 3, 2)):
            expected = search.search_fingerprints(index, double, "q", limit=limit, candidate_limit=most, min_shared=least, place=PLACE)
            got = search.search_similar(s, double, "q", limit=limit, candidate_limit=most, min_shared=least, place=PLACE, k=4, window=3)
            assert rows(got) == rows(expected) and got.columns == expected.columns
    again = search.search_similar(many, asked.unionByName(asked), "q", place=PLACE, k=4, window=3)
    assert rows(again) == rows(search.search_fingerprints(whole, asked, "q", place=PLACE))
    blocks = double.select(F.col("q").alias("block_id"), "text")
    queue = [legacy.review_queue(blocks, i, "block_id", place=PLACE).select("block_id", "resolution_status", "candidate_segments") for i in (many, search.build_fingerprint_index(many, *PLACE))]
    assert rows(queue[0]) == rows(queue[1])


def test_pairs_do_not_grow_with_the_square_of_copies(spark, segs, asked, monkeypatch):
    """What is kept of segments and queries is a row a class; segments without a query's fingerprint do not leave the scan."""
    kept = []
    write = search.cut
    monkeypatch.setattr(search, "cut", lambda df: kept.append(write(df)) or kept[-1])
    counts = []
    for copies in (1, 6):
        s, q = segs, asked
        for i in range(1, copies):
            s = s.unionByName(segs.withColumn("doc_id", F.col("doc_id") + i * 10_000))
            q = q.unionByName(asked.withColumn("q", F.col("q") + i * 10_000))
        del kept[:]
        search.search_similar(s, q, "q", place=PLACE, k=4, window=3)
        counts.append([df.count() for df in kept[1:]])
    assert counts[0] == counts[1] and counts[0][1] < segs.count()
