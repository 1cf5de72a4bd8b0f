"""Comparing documents pair by pair: segment and q-gram overlap, ordered alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import fingerprint as FP
from quillspan.functions import text as T


def profiles(segs: DataFrame, key: str) -> DataFrame:
    """key, hashes (distinct segment hashes), n_segments, leaves in order, grams of the joined canonical text."""
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "segment_hash", "canonical")))
    p = segs.groupBy(key).agg(ordered.alias("s"))
    leaves = F.transform("s", lambda x: x["segment_hash"])
    joined = F.array_join(F.transform("s", lambda x: x["canonical"]), "")
    return p.select(key, F.array_distinct(leaves).alias("hashes"), F.size("s").alias("n_segments"), T.merkle_root(leaves).alias("merkle_root"), T.qgrams(joined).alias("grams"))


def compare_witnesses(profile: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """left, right, exact_segment_jaccard, qgram_jaccard, segment counts and roots of each pair; absent sides count 0 segments."""
    def side(name: str) -> DataFrame:
        return profile.select(F.col(key).alias(f"{name}_key"), *[F.col(c).alias(f"{name}_{c}") for c in ("hashes", "n_segments", "merkle_root", "grams")])

    p = pairs.join(side("left"), F.col("left") == F.col("left_key"), "left").join(side("right"), F.col("right") == F.col("right_key"), "left")
    none = F.array().cast("array<string>")
    arrays = {c: F.coalesce(c, none) for c in ("left_hashes", "right_hashes", "left_grams", "right_grams")}
    return p.select(
        "left",
        "right",
        T.jaccard(arrays["left_hashes"], arrays["right_hashes"]).alias("exact_segment_jaccard"),
        T.jaccard(arrays["left_grams"], arrays["right_grams"]).alias("qgram_jaccard"),
        F.coalesce("left_n_segments", F.lit(0)).cast("long").alias("left_segments"),
        F.coalesce("right_n_segments", F.lit(0)).cast("long").alias("right_segments"),
        "left_merkle_root",
        "right_merkle_root",
    )


#: Ways to step back through the table, and the unit of scores: whole numbers, so that equal paths are equal.
MATCH, SKIP_LEFT, SKIP_RIGHT = range(3)
UNIT = 1 << 40


def similarities(left: list[str], right: list[str], k: int, window: int, hash_name: str) -> list[dict[int, float]]:
    """For each left segment the right segments that share a fingerprint, with their fingerprint ratio."""
    prints = FP.window_sets(FP.GramHashes(k, hash_name).rolling([*left, *right]), window)
    return ratios(prints[: len(left)], prints[len(left) :])


def ratios(a: list[np.ndarray], b: list[np.ndarray]) -> list[dict[int, float]]:
    """similarities of segments given as sorted distinct fingerprints."""
    sizes = np.array([len(x) for x in b], np.int64)
    value, place = np.concatenate([np.zeros(0, np.uint64), *b]), np.repeat(np.arange(len(b)), sizes)
    order = np.argsort(value, kind="stable")
    value, place = value[order], place[order]
    ends = np.cumsum([0, *map(len, a)])
    every = np.concatenate([np.zeros(0, np.uint64), *a])
    lows, highs = np.searchsorted(value, every, "left"), np.searchsorted(value, every, "right")
    shared = np.append(0, np.cumsum(highs > lows))[ends]  # most segments share nothing with the other side
    out = [{} for _ in a]
    for i in np.flatnonzero(shared[1:] > shared[:-1]).tolist():
        own, low, high = a[i], lows[ends[i] : ends[i + 1]], highs[ends[i] : ends[i + 1]]
        met = np.concatenate([np.zeros(0, np.int64), *(place[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True) if y > x)])
        near, common = np.unique(met, return_counts=True)
        out[i] = dict(zip(near.tolist(), (common / (len(own) + sizes[near] - common)).tolist(), strict=True))
    return out


def _next_row(score: np.ndarray, gain: dict[int, float], gap: int, along: np.ndarray):
    """The row of scores after `score`, with the two ways into each cell that do not come along the row."""
    step = np.full(len(score) - 1, -gap, np.int64)
    for j, g in gain.items():
        if j < len(step):
            step[j] = round(g * UNIT)
    diagonal, down = np.append(score[0] - gap, score[:-1] + step), score - gap
    return np.maximum.accumulate(np.maximum(diagonal, down) + along) - along, diagonal, down


def best_path(gains: list[dict[int, float]], width: int, gap_penalty: float, block: int | None = None) -> list[tuple[int, int]]:
    """Pairs (row, column) of the diagonal steps of the best order-preserving path.

    A diagonal step earns its gain, or costs the penalty where there is none; a skipped row
    or column costs the penalty. A row of the table is three array operations: the step
    along the row is a running maximum, since every skip costs the same. Of equal ways a
    diagonal is taken first, then a skipped row.

    Only each `block`-th row of scores is kept. The way back computes the rows between two
    of them again, up to the column it has come to, and holds moves for those alone: memory
    grows with columns times the root of the rows, and the path is that of the whole table.
    """
    gap = round(gap_penalty * UNIT)
    along = gap * np.arange(width + 1, dtype=np.int64)
    block = block or max(1, math.isqrt(8 * len(gains)))  # kept scores take 8 bytes, moves one
    score, kept = -along, []
    for i, gain in enumerate(gains):
        if i % block == 0:
            kept.append(score)
        score = _next_row(score, gain, gap, along)[0]
    pairs, row, column = [], len(gains), width
    while kept:
        low = (len(kept) - 1) * block
        score, here = kept.pop()[: column + 1], along[: column + 1]
        moves = np.empty((row - low, column + 1), np.int8)
        for i in range(low, row):
            score, diagonal, down = _next_row(score, gains[i], gap, here)
            moves[i - low] = np.where(score == diagonal, MATCH, np.where(score == down, SKIP_LEFT, SKIP_RIGHT))
            moves[i - low, 0] = SKIP_LEFT
        while row > low:
            move = moves[row - 1 - low, column]
            row -= move != SKIP_RIGHT
            column -= move != SKIP_LEFT
            if move == MATCH:
                pairs.append((row, column))
    return pairs[::-1]


def align(left: list[str], right: list[str], k: int = 8, window: int = 5, min_similarity: float = 0.15, gap_penalty: float = 0.05, hash_name: str = "blake2b64") -> list[tuple[int, int, float]]:
    """Order-preserving alignment of canonical segments by fingerprint ratio: (left, right, ratio) of the matches.

    Memory grows with the segments of one document times the root of the other's.
    """
    return _matches(similarities(left, right, k, window, hash_name), len(right), min_similarity, gap_penalty)


def _matches(similar: list[dict[int, float]], width: int, min_similarity: float = 0.15, gap_penalty: float = 0.05) -> list[tuple[int, int, float]]:
    gains = [{j: s for j, s in row.items() if s >= min_similarity} for row in similar]
    if not any(gains):
        return []
    return [(i, j, gains[i][j]) for i, j in best_path(gains, width, gap_penalty) if j in gains[i]]


def align_pairs(segs: DataFrame, pairs: DataFrame, key: str, k: int = 8, window: int = 5, hash_name: str = "blake2b64", **options) -> DataFrame:
    """left, right, left_ordinal, right_ordinal, score of the matched segments of each pair.

    Hashing takes most of the time, so the pairs of some million signs are hashed together, and a gram of theirs once.
    """
    ordered = segs.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "canonical"))), lambda x: x["canonical"]).alias("c"))
    p = pairs.join(ordered.select(F.col(key).alias("left"), F.col("c").alias("a")), "left").join(ordered.select(F.col(key).alias("right"), F.col("c").alias("b")), "right")

    @F.pandas_udf("array<struct<left_ordinal:int,right_ordinal:int,score:double>>")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hashes = FP.GramHashes(k, hash_name)
        for a, b in batches:
            rows, out = list(zip(a, b, strict=True)), []
            for low, high in T.pieces([sum(map(len, x)) + sum(map(len, y)) for x, y in rows]):
                texts = [t for row in rows[low:high] for side in row for t in side]
                prints, at = FP.window_sets(hashes.rolling(texts), window), 0
                for x, y in rows[low:high]:
                    mid, end = at + len(x), at + len(x) + len(y)
                    found = _matches(ratios(prints[at:mid], prints[mid:end]), len(y), **options)
                    out.append([{"left_ordinal": i, "right_ordinal": j, "score": s} for i, j, s in found])
                    at = end
            yield pd.Series(out, dtype=object)

    return p.select("left", "right", F.explode(match("a", "b")).alias("m")).select("left", "right", "m.*")
