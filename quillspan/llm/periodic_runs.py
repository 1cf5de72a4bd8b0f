"""Periodic run detection after Kolpakov and Kucherov.

A run is a stretch of consecutive words with smallest period q and at least
max(24, 3 q) words that no neighbouring word extends with that period. For each text:

1. A suffix automaton of the words, each state with the first place where its strings end, gives the
   LZ factors: the longest prefix of the rest that also starts earlier (overlaps count),
   or a new word.
2. Main's algorithm finds the runs that begin at or before a factor's start and end in it. Let b be
   the start, v the factor and u the one before. A boundary of factors may not stand in a run behind
   its first period unless the run ends in the factor that begins there, since the copy one period
   before would have made that factor longer. So such a run reaches back from b by less than |u| + q,
   and q < (|u| + |v|) / 2. Four Z functions over that range give, for each q, how far the words
   agree with those q further, in both directions from the boundary. Runs that begin in the factor and
   end with it come from a Z function of the factor backwards.
3. Runs inside a factor, with a word of it on either side, are copied from its earlier occurrence,
   from left to right, so that a factor that overlaps its own source copies what it has just copied.

Every run is of one of these kinds. Of several periods of the same stretch the smallest counts.

Words that stand in no window of 16 words found twice in the text cannot belong to a
run (a run's words but those of its last 16 begin such a window, with the next one a period further), so
only the stretches covered by repeated windows are factorised; runs lie inside stretches, with the
same ends. Texts are independent rows: nothing is shuffled, and a task holds one text's automaton.

Defined cases: null and empty texts have no words and no runs; their digests are those of
empty strings. A null doc_id is never altered by the contract's rule. Repeated rows are
reported one by one. Ties of the greatest exponent go to the smallest start, then the
smallest period. Very long texts are read whole, in linear time. An empty table gives an empty
one. Other columns, whatever their names, pass through `collapse_runs` untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_TIMES, WINDOW = 24, 3, 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
Run = tuple[int, int, int]  # start, end, period


def stretches(words: list[bytes], window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, end) of the words covered by windows that stand twice or more in the list."""
    n = len(words)
    if n <= window:
        return []
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    size = 1
    while size < window:  # hashes of twice as many words
        step = min(size, window - size)
        h = (h[:-step] * _MIX ^ h[:-step] >> np.uint64(29)) + h[step:]
        size += step
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(h, twice))
    cuts = np.flatnonzero(np.diff(at) > window)
    firsts, lasts = np.concatenate([at[:1], at[cuts + 1]]), np.concatenate([at[cuts], at[-1:]])
    return [(a, b + window) for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)]


def automaton(w: list[int]) -> tuple[list[dict], list[int]]:
    """Suffix automaton: transitions of each state, and the first place (exclusive) where its strings end."""
    moves: list[dict] = [{}]
    link, length, first = [-1], [0], [0]
    last = 0
    for i, c in enumerate(w):
        new = len(moves)
        moves.append({})
        length.append(i + 1)
        first.append(i + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link.append(q)
            else:
                link.append(new + 1)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = new + 1
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = new + 1
                    p = link[p]
        last = new
    return moves, first


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """LZ factors as (start, end, start of an earlier occurrence or -1)."""
    moves, first = automaton(w)
    out, i, n = [], 0, len(w)
    while i < n:
        state, j = 0, i
        while j < n:
            to = moves[state].get(w[j])
            # the state's string has j + 1 - i words; its first occurrence must start before i
            if to is None or first[to] > j:
                break
            state, j = to, j + 1
        out.append((i, j, first[state] - (j - i)) if j > i else (i, i + 1, -1))
        i = max(j, i + 1)
    return out


def z_function(s: list[int]) -> list[int]:
    """For each place, how many words agree with those at the beginning."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _long(start: int, end: int, q: int) -> bool:
    return end - start >= LEAST_WORDS and end - start >= LEAST_TIMES * q


def crossing(w: list[int], b: int, end: int, before: int) -> list[Run]:
    """Runs that begin at or before b and end behind it, at most at `end`; `before` is the length of the factor before b."""
    size = end - b
    most = (size + before) // 2 + 1
    low = max(0, b - before - most)
    t, u = w[low:b], w[b:end]
    found = []

    def check(start: int, stop: int, q: int) -> None:
        # a stretch that meets the range's ends is whole only if the next word breaks it
        if _long(start, stop, q) and b < stop and (stop == len(w) or stop < end or w[stop] != w[stop - q]) and (start == 0 or w[start - 1] != w[start - 1 + q]):
            found.append((start, stop, q))

    mark = [-1]
    ahead = z_function(u)  # u against itself
    behind = z_function(t[::-1] + mark + (t + u)[::-1])  # what ends before b against what ends in u
    cross = z_function(u + mark + t + u)  # u against what begins in t
    back = z_function(t[::-1])  # t against itself, from its end
    for q in range(1, min(most, size) + 1):  # a period's worth of words behind b
        stop = b + q + (ahead[q] if q < size else 0)
        check(b - min(behind[len(t) + 1 + size - q], len(t)), stop, q)
    for q in range(1, min(most, len(t)) + 1):  # a period's worth before b
        same = min(cross[size + 1 + len(t) - q], size)
        if same:
            check(b - q - (back[q] if q < len(t) else 0), b + same, q)
    return found


def ending(w: list[int], b: int, end: int) -> list[Run]:
    """Runs that begin behind b and end at `end`, where the factor of both ends."""
    back = z_function(w[b:end][::-1])
    size, found = end - b, []
    for q in range(1, size // LEAST_TIMES + 1):
        start = end - q - back[q]
        if start > b and _long(start, end, q) and (end == len(w) or w[end] != w[end - q]):
            found.append((start, end, q))
    return found


def runs_of(w: list[int]) -> list[Run]:
    """All runs of a list of word numbers, by start and end."""
    known: dict[tuple[int, int], int] = {}
    order: list[tuple[int, int]] = []  # sorted

    def add(start: int, end: int, q: int) -> None:
        if (start, end) not in known:
            insort(order, (start, end))
            known[start, end] = q
        else:
            known[start, end] = min(q, known[start, end])

    before = 0
    for b, end, source in factors(w):
        size = end - b
        # a run has at least 16 words behind its first period, all of them in this factor and the one before
        if size + before >= LEAST_WORDS - LEAST_WORDS // LEAST_TIMES:
            for run in crossing(w, b, end, before):
                add(*run)
        if size > LEAST_WORDS:
            for run in ending(w, b, end):
                add(*run)
            shift, k = b - source, bisect_left(order, (source + 1, 0))
            while k < len(order) and order[k][0] < source + size:
                start, stop = order[k]
                if stop < source + size:
                    add(start + shift, stop + shift, known[start, stop])
                k += 1
        before = size
    return [(s, e, known[s, e]) for s, e in order]


def find_runs(words: list[bytes]) -> list[Run]:
    """Runs of a text's words, by start, then by period."""
    found = []
    for a, b in stretches(words):
        ids: dict[bytes, int] = {}
        found += [(a + s, a + e, q) for s, e, q in runs_of([ids.setdefault(x, len(ids)) for x in words[a:b]])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(runs: list[Run], n: int) -> np.ndarray:
    """Which words a run repeats: those behind its first period."""
    steps = np.zeros(n + 1, np.int64)
    for s, e, q in runs:
        steps[s + q] += 1
        steps[e] -= 1
    return np.cumsum(steps[:-1]) > 0


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def altered(words: list[bytes], doc_id) -> list[bytes]:
    """The contract's rule: a tenth of the documents repeat a part of their words."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def _sum(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def greatest(runs: list[Run]) -> Run | None:
    """The run with the greatest exponent, compared exactly; of equal ones the first, then that of the smallest period."""
    best = None
    for s, e, q in runs:
        if best is None or (e - s) * best[2] > (best[1] - best[0]) * q:
            best = (s, e, q)
    return best


_REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent, and digests of all runs and of the words without repeats."""
    names = [c.split()[0] for c in _REPORT.split(", ")]

    def measure(batches):
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                doc_id = None if doc_id is None or doc_id != doc_id else int(doc_id)
                words = altered(split_words(text), doc_id)
                runs = find_runs(words)
                best = greatest(runs)
                listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
                if runs:
                    words = [x for x, gone in zip(words, dropped(runs, len(words)).tolist(), strict=True) if not gone]
                place = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
                rows.append((doc_id, len(runs), *place, _sum(listed.encode()), _sum(b" ".join(words))))
            yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(["doc_id", "start", "length", "period", "exponent_milli"], "Int64"))

    # ids travel as text, since a column of numbers with a null would come as floats
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return own.mapInPandas(measure, _REPORT)


def run_column(text) -> F.Column:
    """array<struct<start, stop, period>> of a text column's runs, in words."""

    @F.pandas_udf("array<struct<start:int,stop:int,period:int>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "stop": e, "period": q} for s, e, q in find_runs(split_words(t))] for t in texts], dtype=object)

    return found(text)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """The same rows and columns; texts with runs keep each run's first period only, their words joined by blanks."""

    @F.pandas_udf("string")
    def collapse(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = split_words(t)
            runs = find_runs(words)
            if runs:
                t = b" ".join(x for x, gone in zip(words, dropped(runs, len(words)).tolist(), strict=True) if not gone).decode("utf-8", "surrogatepass")
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.select(*[collapse("text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
