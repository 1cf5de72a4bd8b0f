"""Batched corpus search: phrases, fuzzy q-gram ratio, keyword dictionaries, fingerprints.

Searches take a table of queries. Phrase, dictionary and fuzzy search send the queries to
the segments, in blocks of at most `QUERY_BLOCK` (the block is what is broadcast, so its
size is bounded), scan each segment once, and keep the top rows of each query in every
partition before the ranking shuffles. Fingerprint search joins postings. Searches of a stored index
are in `overlap_index`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillspan.functions import fingerprint as FP
from quillspan.functions.text import canonical_plain, canonical_text, pieces
from quillspan.operators.graph import cut

QUERY_BLOCK = 5000
FUZZY_BLOCK = 500


class KeywordAutomaton:
    """Aho-Corasick automaton over canonical keywords; hits are (end index, keyword as given)."""

    def __init__(self, keywords):
        import ahocorasick

        self._given: dict[str, list[str]] = {}
        for raw in keywords:
            canonical = canonical_plain(raw)
            if canonical:
                self._given.setdefault(canonical, []).append(raw)
        self._machine = ahocorasick.Automaton()
        self._raws = list(self._given.values())
        for number, canonical in enumerate(self._given):
            self._machine.add_word(canonical, number)
        if self._given:
            self._machine.make_automaton()

    def scan_canonical(self, canonical: str):
        if self._given and canonical:
            for end, found in self._machine.iter(canonical):
                for raw in self._raws[found]:
                    yield end, raw

    def scan_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(text numbers, end indexes, keywords) of all hits in some canonical texts, which are read as one text.

        They are joined by a sign that no keyword has, so no hit goes over an end.
        """
        joined = "\n".join(texts)
        hits = np.fromiter(self._machine.iter(joined) if self._given and joined else (), [("end", np.int64), ("found", np.int64)])
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        owner = np.searchsorted(first, hits["end"], side="right") - 1
        ends, found = hits["end"] - first[owner], hits["found"]
        # a hit counts for every keyword of its canonical form
        sizes = np.array([len(x) for x in self._raws], np.int64)
        at = np.repeat(np.arange(len(found)), sizes[found])
        nth = np.arange(len(at)) - np.repeat(np.cumsum(sizes[found]) - sizes[found], sizes[found])
        raws = pa.array([x for own in self._raws for x in own], pa.string()).take(pa.array((np.cumsum(sizes) - sizes)[found[at]] + nth))
        return owner[at], ends[at], raws

    def scan(self, text: str) -> list[tuple[int, str]]:
        return list(self.scan_canonical(canonical_plain(text)))


def _blocks(queries: DataFrame, key: str, text: str, size: int):
    """(key, canonical) lists of at most `size` queries, read one after the other."""
    block = []
    for r in queries.select(F.col(key).alias("k"), canonical_text(text).alias("c")).orderBy("k").toLocalIterator():
        if r["c"]:
            block.append((r["k"], r["c"]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    for p in parts:
        empty = p if empty is None else empty.unionByName(p)
    return empty


def _row_number(partition: list[str], *order):
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def search_phrase(segs: DataFrame, queries: DataFrame, key: str, text: str = "text", limit: int = 50, place: tuple = ("witness_id", "ordinal")) -> DataFrame:
    """key, place..., score 1.0: segments whose canonical text holds the query's, the first `limit` by place."""
    kind, parts = dict(queries.dtypes)[key], []
    types = ", ".join(f"{c} {t}" for c, t in segs.select(*place).dtypes)
    for block in _blocks(queries, key, text, QUERY_BLOCK):
        needles: dict[str, list] = {}
        for k, c in block:
            needles.setdefault(c, []).append(k)

        def scan(batches, needles=needles):
            machine = KeywordAutomaton(needles)
            for pdf in batches:
                # a batch's hits beyond the first `limit` of a needle, by place, cannot be among the first of all
                rows, met = [], dict.fromkeys(needles, 0)
                for row in pdf.sort_values(list(place), na_position="first", kind="stable").itertuples(index=False):
                    for needle in {raw for _, raw in machine.scan_canonical(row[-1] or "")}:
                        if met[needle] < limit:
                            met[needle] += 1
                            rows += [(k, *row[:-1]) for k in needles[needle]]
                yield pd.DataFrame(rows, columns=[key, *place])

        parts.append(segs.select(*place, "canonical").mapInPandas(scan, f"{key} {kind}, {types}"))
    hits = _union(parts, segs.sparkSession.createDataFrame([], f"{key} {kind}, {types}"))
    ranked = hits.withColumn("n_", _row_number([key], *place)).filter(F.col("n_") <= limit)
    return ranked.drop("n_").withColumn("score", F.lit(1.0))


def search_fuzzy(segs: DataFrame, queries: DataFrame, key: str, text: str = "text", limit: int = 20, candidate_limit: int = 200, q: int = 3, place: tuple = ("witness_id", "ordinal")) -> DataFrame:
    """key, place..., score: best q-gram ratios among the `candidate_limit` segments with most grams in common.

    The grams of a block of queries are one matrix; a segment's overlaps with all of them
    are the sum of its grams' rows, so postings are neither built nor shuffled.
    """
    kind, parts = dict(queries.dtypes)[key], []
    types = ", ".join(f"{c} {t}" for c, t in segs.select(*place).dtypes)
    for block in _blocks(queries, key, text, FUZZY_BLOCK):
        grams = [{c[i : i + q] for i in range(max(1, len(c) - q + 1))} for _, c in block]
        column: dict[str, int] = {}
        for g in grams:
            for x in g:
                column.setdefault(x, len(column))
        matrix = np.zeros((len(column), len(block)), np.int32)
        for j, g in enumerate(grams):
            matrix[[column[x] for x in g], j] = 1
        sizes = np.array([len(g) for g in grams])

        def scan(batches, matrix=matrix, column=column, sizes=sizes, ids=[k for k, _ in block]):
            for pdf in batches:
                overlaps, counts = [], []
                for c in pdf["canonical"]:
                    c = c or ""
                    own = {c[i : i + q] for i in range(max(1, len(c) - q + 1))} if c else set()
                    at = [column[x] for x in own if x in column]
                    overlaps.append(matrix[at].sum(axis=0) if at else np.zeros(len(ids), np.int32))
                    counts.append(len(own))
                overlap, count = np.array(overlaps), np.array(counts)
                places = pdf[list(place)].to_records(index=False)
                by_place = np.argsort(places, kind="stable")
                rank = np.empty(len(pdf), np.int64)
                rank[by_place] = np.arange(len(pdf))
                rows, cols = [], []
                for j in range(len(ids)):
                    some = np.flatnonzero(overlap[:, j] > 0)
                    if len(some) > candidate_limit:
                        some = some[np.lexsort((rank[some], -overlap[some, j]))[:candidate_limit]]
                    rows.append(some)
                    cols.append(np.full(len(some), j))
                i, j = np.concatenate(rows), np.concatenate(cols)
                out = pdf[list(place)].iloc[i].reset_index(drop=True)
                out.insert(0, key, [ids[x] for x in j])
                out["overlap"] = overlap[i, j]
                out["score"] = overlap[i, j] / (sizes[j] + count[i] - overlap[i, j])
                yield out

        parts.append(segs.select(*place, "canonical").mapInPandas(scan, f"{key} {kind}, {types}, overlap int, score double"))
    hits = _union(parts, None)
    if hits is None:
        return segs.sparkSession.createDataFrame([], f"{key} {kind}, {types}, score double")
    first = hits.withColumn("n_", _row_number([key], F.desc("overlap"), *place)).filter(F.col("n_") <= candidate_limit)
    return first.withColumn("n_", _row_number([key], F.desc("score"), *place)).filter(F.col("n_") <= limit).drop("n_", "overlap")


def keyword_positions(segs: DataFrame, keywords: list[str], place: tuple = ("witness_id", "ordinal")) -> DataFrame:
    """place..., keyword, end_index of every occurrence (overlapping ones too) in the canonical text."""
    schema = ", ".join(f"{c} {t}" for c, t in segs.select(*place).dtypes) + ", keyword string, end_index int"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def scan(batches):
        machine = KeywordAutomaton(keywords)
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.num_columns - 1), "")
            for low, high in pieces(pc.binary_length(texts).to_pylist()):
                owner, ends, raws = machine.scan_all(texts.slice(low, high - low).to_pylist())
                at = pa.array(owner + low)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(place))), raws, pa.array(ends, pa.int32())], schema=arrow)

    return segs.select(*place, "canonical").mapInArrow(scan, schema)


def dictionary_scan(segs: DataFrame, keywords: list[str], limit_per_keyword: int = 100, place: tuple = ("witness_id", "ordinal")) -> DataFrame:
    """keyword, place...: at most one hit a segment and keyword, the first `limit_per_keyword` by place; keywords without a hit keep a row of nulls."""
    hits = keyword_positions(segs, keywords, place).select("keyword", *place).distinct()
    top = hits.withColumn("n_", _row_number(["keyword"], *place)).filter(F.col("n_") <= limit_per_keyword).drop("n_")
    listed = segs.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keywords)], "keyword string")
    return listed.join(top, "keyword", "left")


def build_fingerprint_index(segs: DataFrame, *key: str, k: int = 12, window: int = 8, hash_name: str = "blake2b64") -> DataFrame:
    """key..., fingerprint, n_fingerprints: one row for each segment and distinct fingerprint.

    Options used in the build travel in the column metadata of `fingerprint`, so that a search
    of an index that was not built fails and queries are cut the same way.
    """
    values = segs.select(*key, FP.fingerprint_values("canonical", k, window, hash_name).alias("f"))
    options = {"k": k, "window": window, "hash": hash_name}
    # an inner explode would be filtered by the array's size first, which makes all fingerprints twice
    rows = values.select(*key, F.size("f").alias("n_fingerprints"), F.explode_outer("f").alias("f")).filter("f is not null")
    return rows.select(*key, "n_fingerprints", F.col("f").alias("fingerprint", metadata=options))


def fingerprint_options(index: DataFrame) -> dict:
    found = index.schema["fingerprint"].metadata if "fingerprint" in index.columns else {}
    if not {"k", "window", "hash"} <= set(found):
        raise ValueError("fingerprint index has not been built")
    return found


def search_fingerprints(index: DataFrame, queries: DataFrame, key: str, text: str = "text", limit: int = 20, candidate_limit: int = 200, min_shared: int = 1, place: tuple = ("witness_id", "ordinal"), last: str | None = None) -> DataFrame:
    """key, place..., shared_fingerprints, fingerprint_jaccard of the best candidates of each query."""
    o = fingerprint_options(index)
    values = FP.fingerprint_values(canonical_text(text), o["k"], o["window"], o["hash"])
    own = queries.select(key, values.alias("f")).select(key, F.size("f").alias("n_query"), F.explode_outer("f").alias("fingerprint")).filter("fingerprint is not null")
    shared = own.join(index, "fingerprint").groupBy(key, *place).agg(F.count("*").alias("shared_fingerprints"), F.first("n_query").alias("n_query"), F.first("n_fingerprints").alias("n_fingerprints"))
    shared = shared.filter(F.col("shared_fingerprints") >= min_shared)
    return _best(shared, key, limit, candidate_limit, place, last)


def _best(shared: DataFrame, key: str, limit: int, candidate_limit: int, place: tuple, last: str | None) -> DataFrame:
    """Of the `candidate_limit` rows of a key with most in common the first `limit` by ratio."""
    first = shared.withColumn("n_", _row_number([key], F.desc("shared_fingerprints"), *place)).filter(F.col("n_") <= candidate_limit)
    ratio = F.col("shared_fingerprints") / (F.col("n_query") + F.col("n_fingerprints") - F.col("shared_fingerprints"))
    order = (F.desc("fingerprint_jaccard"), F.desc("shared_fingerprints"), *([last] if last else place))
    ranked = first.withColumn("fingerprint_jaccard", ratio).withColumn("n_", _row_number([key], *order)).filter(F.col("n_") <= limit)
    return ranked.select(key, *place, "shared_fingerprints", "fingerprint_jaccard")


def _wanted(rows: DataFrame):
    """Broadcast map of the last FP.WANTED_BITS bits of the numbers f_ in some rows; of a fixed size."""
    at = F.col("f_").bitwiseAND((1 << FP.WANTED_BITS) - 1) + 1
    blocks = rows.groupBy(F.bitmap_bucket_number(at).alias("b_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = bytearray(1 << FP.WANTED_BITS - 3)
    for r in blocks.toLocalIterator():
        size = len(r["bits"])
        bits[(r["b_"] - 1) * size : r["b_"] * size] = r["bits"]
    return rows.sparkSession.sparkContext.broadcast(bytes(bits))


def search_similar(segs: DataFrame, queries: DataFrame, key: str, text: str = "text", limit: int = 20, candidate_limit: int = 200, min_shared: int = 1, place: tuple = ("witness_id", "ordinal"), last: str | None = None, k: int = 12, window: int = 8, hash_name: str = "blake2b64") -> DataFrame:
    """What search_fingerprints gives for the index of segs (place..., canonical), without the index.

    Texts with one set of fingerprints (copies) are one class, on both sides, so that pairs do not grow with the
    square of the copies. Only fingerprints that a query may have leave the scan of the segments. Classes of segments
    are numbered by their first place, which decides ties; of a class the first `candidate_limit` places can be
    among the best, and none of it where classes with more in common have as many.
    """
    sets = lambda c, wanted=None: FP.fingerprint_sets(c, k, window, hash_name, wanted).alias("x_")
    parts = [F.col(f"x_.{x}").alias(f"{x}_") for x in "cnf"]
    own = cut(queries.select(key, sets(canonical_text(text))).select(key, *parts))
    asked = own.filter("n_ > 0").groupBy("c_").agg(F.first("n_").alias("n_query"), F.first("f_").alias("f_"))
    asked = cut(asked.withColumn("q_", F.monotonically_increasing_id()))
    wanted = asked.select("q_", F.explode("f_").alias("f_"))

    met = segs.select(*place, sets("canonical", _wanted(wanted))).select(*place, *parts).filter(F.size("f_") > 0)
    met = met.withColumn("r_", F.dense_rank().over(Window.partitionBy("c_").orderBy(*place))).filter(F.col("r_") <= candidate_limit)
    classes = met.groupBy("c_").agg(F.first("n_").alias("n_fingerprints"), F.first("f_").alias("f_"), F.sort_array(F.collect_set(F.struct(*place))).alias("places_"))
    classes = cut(classes.orderBy(F.col("places_")[0]).select(F.monotonically_increasing_id().alias("s_"), "n_fingerprints", "f_", "places_"))

    pairs = wanted.join(classes.select("s_", F.size("places_").alias("m_"), F.explode("f_").alias("f_")), "f_").select("q_", "s_", "m_")
    shared = pairs.repartition("q_").groupBy("q_", "s_").agg(F.count("*").alias("shared_fingerprints"), F.first("m_").alias("m_"))
    shared = shared.filter(F.col("shared_fingerprints") >= min_shared)
    top = shared.withColumn("r_", _row_number(["q_"], F.desc("shared_fingerprints"), "s_")).filter(F.col("r_") <= candidate_limit)
    above = Window.partitionBy("q_").orderBy(-F.col("shared_fingerprints")).rangeBetween(Window.unboundedPreceding, -1)
    left = top.withColumn("left_", candidate_limit - F.coalesce(F.sum("m_").over(above), F.lit(0))).filter("left_ > 0").drop("m_", "r_")
    hits = left.join(classes.drop("f_"), "s_").withColumn("p_", F.explode(F.slice("places_", 1, F.col("left_").cast("int"))))
    hits = hits.select("q_", "shared_fingerprints", "n_fingerprints", *(F.col(f"p_.{c}").alias(c) for c in place)).join(asked.select("q_", "n_query"), "q_")
    return own.select(key, "c_").distinct().join(asked.select("c_", "q_"), "c_").join(_best(hits, "q_", limit, candidate_limit, place, last), "q_").select(key, *place, "shared_fingerprints", "fingerprint_jaccard")
