"""Winnowing fingerprints of canonical texts, as columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # CPython's own SHA-256 takes three fifths of the time of OpenSSL's for a dozen bytes
    from _sha2 import sha256
except ImportError:
    from hashlib import sha256

#: Hash functions by name: BLAKE2b-64 is the exchange form, SHA-256's first 64 bits what SQL can recompute.
HASHES = {
    "blake2b64": lambda b: hashlib.blake2b(b, digest_size=8).digest(),
    "sha256_64": lambda b: sha256(b).digest()[:8],
}


def rolling_hashes(canonical: str, k: int = 12, hash_name: str = "blake2b64") -> np.ndarray:
    """64-bit hashes of all k-grams by position; one for a text of at most k characters."""
    if not canonical:
        return np.zeros(0, np.uint64)
    if k <= 0:
        raise ValueError("k must be positive")
    h = HASHES[hash_name]
    if canonical.isascii():
        raw = canonical.encode()
        grams = [raw[i : i + k] for i in range(max(1, len(raw) - k + 1))]
    else:
        grams = [canonical[i : i + k].encode("utf-8") for i in range(max(1, len(canonical) - k + 1))]
    return np.frombuffer(b"".join(map(h, grams)), ">u8").astype(np.uint64)


def winnow(hashes: np.ndarray, window: int = 8) -> np.ndarray:
    """Positions of the right-most minimum of every window, each once in a row."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    if window <= 0:
        raise ValueError("window must be positive")
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())])
    slides = np.lib.stride_tricks.sliding_window_view(hashes, window)
    at = np.arange(len(slides)) + window - 1 - slides[:, ::-1].argmin(axis=1)
    return at[np.append(True, at[1:] != at[:-1])]


def window_minima(hashes: np.ndarray, window: int = 8) -> np.ndarray:
    """The distinct values that winnow selects, sorted: minima of all windows, by doubling."""
    if window <= 0:
        raise ValueError("window must be positive")
    least, size = hashes, 1
    while size < min(window, len(hashes)):
        step = min(size, min(window, len(hashes)) - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    return np.unique(least)


class GramHashes:
    """Rolling hashes of lists of texts, in which equal k-grams are hashed once.

    Grams that a list has twice or more are remembered for later lists, `most` of them at the utmost. This is
    so for ASCII texts and k up to 8, whose grams are numbers of 64 bits; other texts go by rolling_hashes.
    """

    def __init__(self, k: int = 12, hash_name: str = "blake2b64", most: int = 1 << 20):
        self.k, self.hash_name, self.most = k, hash_name, most
        self.grams, self.values = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def rolling(self, texts: list[str]) -> list[np.ndarray]:
        k = self.k
        out = [None if 0 < k <= 8 and len(t) > k and t.isascii() else rolling_hashes(t, k, self.hash_name) for t in texts]
        raw = "".join(t for t, h in zip(texts, out, strict=True) if h is None).encode()
        if raw:
            grams = np.ndarray(len(raw) - k + 1, "<u8", raw + bytes(8), 0, (1,)) & np.uint64((1 << 8 * k) - 1)
            values, low = self._values(grams), 0
            for i, t in enumerate(texts):
                if out[i] is None:
                    out[i] = values[low : low + len(t) - k + 1]
                    low += len(t)
        return out

    def _values(self, grams: np.ndarray) -> np.ndarray:
        some, place, counts = np.unique(grams, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.grams, some)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == some if len(self.grams) else np.zeros(len(some), bool)
        raw, h = some[~known].astype("<u8").tobytes(), HASHES[self.hash_name]
        values = np.empty(len(some), np.uint64)
        values[known] = self.values[at[known]]
        values[~known] = np.frombuffer(b"".join(h(raw[i : i + self.k]) for i in range(0, len(raw), 8)), ">u8")
        new = ~known & (counts > 1)
        if len(self.grams) + int(new.sum()) <= self.most:
            both = np.concatenate([self.grams, some[new]])
            order = np.argsort(both, kind="stable")
            self.grams, self.values = both[order], np.concatenate([self.values, values[new]])[order]
        return values[place]


def window_sets(hashes: list[np.ndarray], window: int = 8) -> list[np.ndarray]:
    """What window_minima gives for each of some texts, in whole arrays over all of them."""
    if window <= 0:
        raise ValueError("window must be positive")
    size = np.array([len(h) for h in hashes], np.int64)
    least = np.concatenate([np.zeros(0, np.uint64), *hashes])
    first, owner = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    left = np.repeat(first + size, size) - np.arange(len(least))
    whole, span = np.flatnonzero((size > 0) & (size < window)), 1
    if len(whole):  # one window, which is all of the text
        ends = np.stack([first[whole], first[whole] + size[whole]], axis=1).ravel()
        short = np.minimum.reduceat(np.append(least, least[:1]), ends)[::2]
    while span < window and span < len(least):
        step = min(span, window - span)
        least = np.append(np.minimum(least[:-step], least[step:]), least[-step:])
        span += step
    starts = left >= window
    if len(whole):
        least[first[whole]] = short
        starts[first[whole]] = True
    least, owner = least[starts], owner[starts]
    for order in (None, "sorted"):  # neighbouring windows mostly share their minimum
        if order:
            by = np.lexsort((least, owner))
            least, owner = least[by], owner[by]
        if len(least):
            new = np.append(True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]))
            least, owner = least[new], owner[new]
    return np.split(least, np.cumsum(np.bincount(owner, minlength=len(size)))[:-1]) if len(size) else []


def winnow_fingerprints(canonical, k: int = 12, window: int = 8, hash_name: str = "blake2b64") -> Column:
    """array<struct<position, value>>; values as 16 hex digits, which sort as the unsigned number does."""

    @F.pandas_udf("array<struct<position:int,value:string>>")
    def select(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            h = rolling_hashes(t or "", k, hash_name)
            out.append([{"position": int(p), "value": f"{int(h[p]):016x}"} for p in winnow(h, window)])
        return pd.Series(out)

    return select(canonical)


def fingerprint_values(canonical, k: int = 12, window: int = 8, hash_name: str = "blake2b64") -> Column:
    """Distinct fingerprint values of a canonical text, as sorted 16-digit hex."""

    @F.arrow_udf("array<string>")
    def values(texts: pa.Array) -> pa.Array:
        # each text and each value is a Python object only while it is read
        found = [pa.array([f"{v:016x}" for v in window_minima(rolling_hashes(t.as_py() or "", k, hash_name), window).tolist()], pa.string()) for t in texts]
        ends = np.cumsum([0, *map(len, found)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([pa.array([], pa.string()), *found]))

    return values(canonical)


#: Bits of the map of wanted fingerprints: 16 MB, whatever the input.
WANTED_BITS = 27


def fingerprint_sets(canonical, k: int = 12, window: int = 8, hash_name: str = "blake2b64", wanted=None) -> Column:
    """struct<c, n, f>: 16 bytes that name the set of a text's fingerprints, how many they are, and the fingerprints as 64-bit numbers.

    wanted: a broadcast map of bits; of f only fingerprints stay whose last WANTED_BITS bits number a set one.
    """

    @F.arrow_udf("struct<c:binary,n:int,f:array<bigint>>")
    def sets(texts: pa.Array) -> pa.Array:
        bits = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        names, counts, found = [], [], []
        for t in texts:
            values = window_minima(rolling_hashes(t.as_py() or "", k, hash_name), window)
            names.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
            counts.append(len(values))
            if bits is not None:
                at = values & np.uint64((1 << WANTED_BITS) - 1)
                values = values[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            found.append(values.view(np.int64))
        ends = np.cumsum([0, *map(len, found)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
        return pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(counts, pa.int32()), lists], ["c", "n", "f"])

    # else a filter on the result would be evaluated before it, and all fingerprints made twice
    return sets.asNondeterministic()(canonical)
