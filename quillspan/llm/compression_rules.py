"""Quality rules: compression bands.

Zstandard ratios (bytes over compressed bytes) of the whole document and of its
chunks, the last one shorter, are held against limits that depend on the length: above the upper limit a
text repeats itself, below the lower one it is noise (encoded blobs, random letters).
Word, symbol, line and repetition counts come with them as base rules.

Defined cases: null and empty texts have no words, fail the base rules and are not
kept. Repeated rows and ties are judged alike, each by its own text. Very long texts
are compressed whole, and chunk by chunk besides; a text of one chunk is compressed once.
A rest too short for the limits' table is part of the chunk before it. An empty table gives an empty one.
Other columns, whatever their names, pass through `keep_compressible` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SYMBOLS = b"#*$%&|<>"
_RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_bytes long, ratio double, n_chunks long, n_bad_chunks long"
)


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by floor(log2(bytes)); outside the table the nearest entry holds.

    Prose in alphabetic scripts compresses at level 3 to ratios of about 1.2 at 128
    bytes, 1.6 at 256, 2.0 at 1 KB, 2.2 at 4 KB and 2.5 at 64 KB. The upper limits lie
    15 to 25 percent above that. Random letters in words come to 1.39 at 243 bytes, 1.58 at 844, 1.65 at 1.7 KB,
    1.69 at 4 and 10 KB and 1.72 at 42 KB (base64 to 1.33), prose at least to 1.43 from 512 bytes, 1.69 from 1 KB, 1.92 from
    2 KB, 2.07 for chunks of 4 KB and 2.2 from 8 KB (11,000 documents). The lower limits
    lie between the two from 2 KB on; below that the two overlap or nearly, and the limits reject encoded bytes only.
    """

    level: int = 3
    lowest: tuple = ((6, 0.8), (7, 1.0), (8, 1.12), (9, 1.28), (10, 1.4), (11, 1.7), (12, 1.75), (13, 1.77), (14, 1.8))
    highest: tuple = ((6, 1.6), (7, 1.75), (8, 1.95), (9, 2.15), (10, 2.3), (11, 2.45), (12, 2.55), (13, 2.65), (14, 2.8), (15, 2.95), (16, 3.1), (17, 3.3))
    chunk: int = 4096
    chunk_lowest: float = 1.75
    chunk_highest: float = 2.6
    bad_chunk_share: float = 0.25  # of the bytes

    @staticmethod
    def _at(limits: tuple, n: int) -> float:
        at = min(max(n.bit_length() - 1, limits[0][0]), limits[-1][0])
        return dict(limits)[at]

    def limits(self, n: int) -> tuple[float, float]:
        return self._at(self.lowest, n), self._at(self.highest, n)

    def chunk_limits(self, n: int) -> tuple[float, float]:
        return self.limits(n) if n < self.chunk else (self.chunk_lowest, self.chunk_highest)

    def chunks(self, n: int) -> list[tuple[int, int]]:
        """(first byte, end) of the chunks that n bytes fall into."""
        starts = list(range(0, n, self.chunk))
        if len(starts) > 1 and n - starts[-1] < 1 << self.lowest[0][0]:
            starts.pop()
        return list(zip(starts, [*starts[1:], n], strict=False))


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words that stand in a window of n words found twice or more."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    windows = code[: len(code) - n + 1]
    for k in range(1, n):
        windows = np.unique(windows * len(ids) + code[k : len(code) - n + 1 + k], return_inverse=True)[1]
    twice = np.bincount(windows)[windows] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(code), bool)
    for k in range(n):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def judge(text: str | None, bands: Bands, zstd: zstandard.ZstdCompressor) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at exactly the six white-space characters of a word's definition
    n_words = len(words)
    word_chars = sum(map(len, words)) if raw.isascii() else sum(len(w.decode("utf-8", "surrogatepass")) for w in words)
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += bool(line.strip())
        else:
            seen.add(line)
    repeats = repeated_words(words)
    base_failed = n_words < 50 or 100 * repeats > 50 * n_words
    ratio, bad, bad_bytes = 0.0, 0, 0
    chunks = bands.chunks(len(raw))
    if raw:
        ratio = len(raw) / len(zstd.compress(raw))
        for at, end in chunks:
            r = (end - at) / len(zstd.compress(raw[at:end])) if len(chunks) > 1 else ratio
            low, high = bands.chunk_limits(end - at)
            if not low <= r <= high:
                bad += 1
                bad_bytes += end - at
    low, high = bands.limits(max(1, len(raw)))
    kept = not base_failed and low <= ratio <= high and bad_bytes <= bands.bad_chunk_share * len(raw)
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    return n_words, word_chars, symbols, dup_lines, repeats, base_failed, kept, len(raw), ratio, len(chunks), bad


def quality_column(text, bands: Bands = Bands()) -> F.Column:
    """Counts and verdict of a text column, as a struct."""

    @F.pandas_udf(_RESULT)
    def measure(texts: pd.Series) -> pd.DataFrame:
        zstd = zstandard.ZstdCompressor(level=bands.level)
        names = [c.split()[0] for c in _RESULT.split(", ")]
        return pd.DataFrame([judge(t, bands, zstd) for t in texts], columns=names)

    return measure(text)


def quality_table(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    return docs.select("doc_id", quality_column(F.col("text"), bands).alias("q")).select("doc_id", "q.*")


def keep_compressible(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return docs.filter(quality_column(F.col("text"), bands)["kept"])
