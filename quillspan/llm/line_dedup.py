"""Line dedup: winnowing over line hashes.

A line's hash is that of its stripped bytes, 128 bits; lines without a word are skipped.
From every line runs the shortest gram of whole lines with `gram_words` words or more, and
the shortest window with `run_words` or more. Each window selects its least gram hash, the
first of equal ones, as its fingerprint. A run of `run_words` that two places share holds
a whole window, so both places select the same fingerprint: no such run is missed.

Only the selected fingerprints and their positions are joined. Where one stands in two
places or more, the match is extended both ways over the line hashes: to the windows that
selected it, those that begin at an earlier line and those that end at a later one, as
long as a window's lines equal an earlier place's. These windows cover exactly the
runs of `run_words` words or more that also start at an earlier place (smaller doc_id, or
the same document, further up). The covered lines of all places but the first are deleted,
with blank lines between them. Windows are equal if 128 bits over their line hashes are.

Texts are read twice, for the hashes and for the cut; all between works on line hashes.
Hot lines (in a third of all documents, say) are summed with map-side combine: only the
first position of a window is kept, and occurrences meet it in a join that adaptive
execution may split. Pairs of occurrences are never formed.

Defined cases: null texts have no lines and stay null; texts without a word stay as they
are. A null doc_id comes before all others. Rows equal in doc_id and text are one
document and are treated alike. Ties cannot occur, since positions differ. Very long
texts are read whole. An empty table gives an empty one. `remove_repeated_lines` keeps
all other columns of the input, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, trimmed

GRAM_WORDS, RUN_WORDS = 20, 50
_BLANKS = b" \t\n\r\x0b\x0c"


def line_hashes(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """128-bit hashes, word counts and numbers of the lines that have a word."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    words = np.array([len(line.split()) for line in lines], np.int32)
    at = np.flatnonzero(words).astype(np.int32)
    return b"".join(xxhash.xxh3_128_digest(lines[i].strip(_BLANKS)) for i in at.tolist()), words[at], at


def spans(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, end) of the shortest runs of lines with `least` words: one that begins and one that ends at each line."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    ahead = np.searchsorted(total, total[:-1] + least).tolist()
    back = (np.searchsorted(total, total[1:] - least, side="right") - 1).tolist()
    return sorted({(i, j) for i, j in enumerate(ahead) if j <= len(words)} | {(i, j + 1) for j, i in enumerate(back) if i >= 0})


def select(hashes: bytes, words: np.ndarray, gram_words: int, run_words: int) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """(first line, end, selected position) of every window, and the gram hash at each selected position."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    ends = np.searchsorted(total, total[:-1] + gram_words).tolist()
    grams = [xxhash.xxh3_64_intdigest(hashes[16 * i : 16 * j]) if j <= len(words) else None for i, j in enumerate(ends)]
    found, picked = [], {}
    for i, j in spans(words, run_words):
        at, k = i, i + 1
        while k < j and ends[k] <= j:
            if grams[k] < grams[at]:
                at = k
            k += 1
        found.append((i, j, at))
        picked[at] = grams[at]
    return found, picked


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def repeated_ranges(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, text_hash, ranges: line ranges (low, high) of each document that repeat an earlier place."""

    def scan(batches):
        names = ["doc_id", "text_hash", "hashes", "words", "lines", "picks"]
        for pdf in batches:
            rows = []
            for d, h, t in zip(pdf["doc_id"], pdf["text_hash"], pdf["text"], strict=True):
                hashes, words, at = line_hashes(t)
                if words.sum() >= run_words:
                    picked = select(hashes, words, gram_words, run_words)[1]
                    rows.append((d, h, hashes, words.tobytes(), at.tobytes(), [{"fingerprint": _signed(f), "at": i} for i, f in picked.items()]))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    def extend(batches):
        for pdf in batches:
            rows = []
            for d, h, hashes, words, at, joined in zip(pdf["doc_id"], pdf["text_hash"], pdf["hashes"], pdf["words"], pdf["lines"], pdf["joined"], strict=True):
                joined, at = set(joined.tolist()), np.frombuffer(at, np.int32)
                for i, j, k in select(hashes, np.frombuffer(words, np.int32), gram_words, run_words)[0]:
                    if k in joined:
                        x = xxhash.xxh3_128_intdigest(hashes[16 * i : 16 * j])
                        rows.append((_signed(x >> 64), _signed(x & (1 << 64) - 1), d, h, at[i], at[j - 1]))
            yield pd.DataFrame(rows, columns=["w1", "w2", "doc_id", "text_hash", "low", "high"]).astype({"doc_id": "Int64"})

    own = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    picks = "array<struct<fingerprint: long, at: int>>"
    lines = materialize(own.mapInPandas(lambda it: trimmed(scan(it)), f"doc_id long, text_hash long, hashes binary, words binary, lines binary, picks {picks}"), "lines")
    # fingerprints that stand in two places or more
    placed = lines.select("doc_id", "text_hash", F.explode("picks").alias("x")).select("doc_id", "text_hash", "x.fingerprint", "x.at")
    place = F.struct("doc_id", "text_hash", "at")
    shared = placed.groupBy("fingerprint").agg(F.min(place).alias("p0"), F.max(place).alias("p1")).filter("p0 <> p1").select(F.col("fingerprint").alias("fingerprint_"))
    joined = placed.join(shared, F.col("fingerprint") == F.col("fingerprint_")).groupBy(F.col("doc_id").alias("doc_id_"), F.col("text_hash").alias("text_hash_")).agg(F.collect_set("at").alias("joined"))
    met = lines.join(joined, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_hash") == F.col("text_hash_"))).select("doc_id", "text_hash", "hashes", "words", "lines", "joined")
    found = materialize(met.mapInPandas(lambda it: trimmed(extend(it)), "w1 long, w2 long, doc_id long, text_hash long, low int, high int"), "windows")
    place = F.struct("doc_id", "text_hash", "low")
    first = found.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select(F.col("w1").alias("w1_"), F.col("w2").alias("w2_"), "first")
    later = found.join(first, (F.col("w1") == F.col("w1_")) & (F.col("w2") == F.col("w2_"))).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))


def drop_ranges(text: str | None, ranges) -> tuple[str | None, int, int]:
    """The text without the lines in the ranges, how many lines went and in how many runs."""
    if text is None or ranges is None or not len(ranges):
        return text, 0, 0
    lines = text.split("\n")
    steps = np.zeros(len(lines) + 1, np.int64)
    for r in ranges:
        steps[r["low"]] += 1
        steps[r["high"] + 1] -= 1
    gone = np.cumsum(steps[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return "\n".join(line for line, x in zip(lines, gone.tolist(), strict=True) if not x), int(gone.sum()), runs


def remove_repeated_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """All rows and columns of docs, text without repeated runs, and as last column a struct (n_lines, n_removed, n_runs).

    It is named dedup_, with more underscores if docs has such a column.
    """
    doc, digest, found, made, report = fresh(docs, "doc_id__", "text_hash__", "ranges__", "cut__", "dedup_")
    ranges = repeated_ranges(docs, gram_words, run_words).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(digest), F.col("ranges").alias(found))
    joined = docs.join(ranges, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(digest)), "left")

    @F.pandas_udf("text string, n_removed long, n_runs long")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([drop_ranges(t, r) for t, r in zip(texts, found, strict=True)], columns=["text", "n_removed", "n_runs"])

    def own(text) -> list:
        return [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]

    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines")
    none = F.lit(0).cast("long")
    # rows without a range skip Python
    kept = joined.filter(F.col(found).isNull()).select(*own(F.col("text")), F.struct(lines, none.alias("n_removed"), none.alias("n_runs")).alias(report))
    changed = joined.filter(F.col(found).isNotNull()).withColumn(made, cut("text", found))
    changed = changed.select(*own(F.col(f"{made}.text")), F.struct(lines, F.col(f"{made}.n_removed").alias("n_removed"), F.col(f"{made}.n_runs").alias("n_runs")).alias(report))
    return kept.union(changed)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, kept_chars, kept_sha256 of every document."""
    out = remove_repeated_lines(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "dedup_.n_lines", "dedup_.n_removed", "dedup_.n_runs", F.char_length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))
