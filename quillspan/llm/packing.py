"""Packing documents into token sequences by cutting-stock column generation.

Documents are tokenised whole, ended by an end token and cut into pieces of at most
`width` tokens. The lengths of the pieces, in steps of `step` tokens, form a histogram.
A linear program over patterns (how many pieces of each length share a sequence) covers
it with as few sequences as possible; patterns are priced by a knapsack dynamic program
and enter while they help. Patterns are used as often as the solution says, rounded
down; the few pieces left are packed largest first. Pieces are then ranked within their
length class and the ranks are dealt to the slots of the patterns.

Only the histogram (width/step numbers) and the patterns reach the driver. Ranks come
from counts of hashed cells of about `CELL` pieces, so that no length class, however
many copies of a text it holds, is sorted in one task.

Defined cases: null and empty texts are the end token alone. Repeated rows are packed as
often as they stand. Very long texts give many pieces. An empty table gives an empty
one. Other columns are not read. doc_id may be null.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, single_threaded_blas, text_blocks, trimmed

WIDTH, STEP, END_ID = 2048, 8, 1
CELL = 5000
#: Odd words whose ids a worker remembers, characters encoded at once, and characters of a word from which on it is no plain one.
CACHE, BLOCK, LONG_WORD = 50_000, 1_000_000, 500
_PIECE = "start long, length long, ids_crc32 long, doc_tokens long"
# What the tokenizer's file calls the end of a word, white space, and the contractions it cuts off.
_END = "</w>"
_GAP = re.compile(r"[\x20\x09-\x0D]")
_CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")
#: Kinds of signs; the table ends with one entry for all that is beyond it.
_ODD, _SPACE, _LETTER, _DIGIT, _SIGN = range(5)


def _kind(c: str) -> int:
    if _GAP.match(c):
        return _SPACE
    category = unicodedata.category(c)[0]
    if category in "CZM" or c == "\u0130":
        return _ODD
    return _LETTER if category == "L" else _DIGIT if category == "N" else _SIGN


_KINDS = np.array([*(_kind(chr(i)) for i in range(0x250)), _ODD], np.uint8)
_LOWERED = np.array([ord(chr(i).lower()) if i != 0x130 else i for i in range(0x250)], np.uint32)


class TextEncoder:
    """Token ids of whole texts, as the tokenizer gives them.

    The tokenizer lowers letters, cuts a text into runs of letters, single digits and runs
    of other signs (English contractions apart), drops white space, and merges the bytes of
    each run, whose last byte is marked as such. Plain texts (Latin letters and ASCII) take
    the same steps here: a blank is set after each run, where it serves as the mark, and
    the merges are looked up by a byte-pair encoder that takes a whole block of text at
    once. Words with any other sign go to the tokenizer itself, and so do texts that may
    hold one of its special tokens.

    Only tokenizers of this form are taken; `check` compares both ways on sample words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # byte-level vocabularies name each byte by a printable sign: its own, or the next free one from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        of_sign = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks: dict[bytes, int] = {}
        for name, i in vocabulary.items():
            ended = name.endswith(_END) and len(name) > len(_END)
            ranks[bytes(of_sign[c] for c in name.removesuffix(_END if ended else "")) + (b" " if ended else b"")] = i
        # the mark is joined to its byte before any other merge, so these pairs come first; then merges by their number
        order = sorted(ranks, key=lambda b: (not (len(b) == 2 and b.endswith(b" ")), ranks[b]))
        self.ids_by_rank = np.array([*(ranks[b] for b in order), 0], np.uint32)
        mergeable = {b: k for k, b in enumerate(order)}
        mergeable[b" "] = len(order)  # the encoder wants every byte; a blank never stands alone
        self.pairs = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=mergeable, special_tokens={})
        self.words: dict[str, np.ndarray] = {}
        self.check()

    def check(self) -> None:
        for t in ("It's the year 2024, isn't it?", "Ünïcode wörds -- (and) ### *** 12.5% éèê;ß", "internationalization of antidisestablishmentarianism"):
            if self.ids(t).tolist() != self.model.encode(t, add_special_tokens=False).ids:
                raise ValueError("the tokenizer is not of the kind that packing takes")

    def ids(self, text: str) -> np.ndarray:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        return [np.concatenate([np.zeros(0, np.uint32), *self._parts(t)]) for t in texts]

    def _own(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def _parts(self, text: str):
        if "<|" in text:
            yield self._own(text)
            return
        at = 0
        while at < len(text):
            to = at + BLOCK
            if to < len(text):  # cut at a blank, so that no run is cut
                blank = _GAP.search(text, to)
                to = blank.start() if blank else len(text)
            yield from self._block(text[at:to])
            at = to

    def _block(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _KINDS[np.minimum(code, len(_KINDS) - 1)]
        odd = np.flatnonzero(kind == _ODD)
        blank = kind == _SPACE
        gaps = np.concatenate([[-1], np.flatnonzero(blank), [len(code)]])
        far = np.flatnonzero(np.diff(gaps) > LONG_WORD)
        if not len(odd) and not len(far):
            yield self._plain(text, code, kind)
            return
        # words with an odd sign, and very long ones, go to the tokenizer, the stretches between them do not
        word = np.unique(np.concatenate([np.searchsorted(gaps, odd) - 1, far]))
        at = 0
        for w in word.tolist():
            low, high = int(gaps[w]) + 1, int(gaps[w + 1])
            if low > at:
                yield self._plain(text[at:low], code[at:low], kind[at:low])
            yield self._word(text[low:high])
            at = high
        if at < len(text):
            yield self._plain(text[at:], code[at:], kind[at:])

    def _word(self, word: str) -> np.ndarray:
        if word not in self.words:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = self._own(word)
        return self.words[word]

    def _plain(self, text: str, code: np.ndarray, kind: np.ndarray) -> np.ndarray:
        # a run ends where the kind changes, and after each digit
        ends = np.empty(len(kind), bool)
        ends[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=ends[:-1])
        ends |= kind == _DIGIT
        if "'" in text:
            for m in _CONTRACTION.finditer(text.lower()):
                if m.start() == 0 or kind[m.start() - 1] != _SIGN:
                    ends[m.start() : m.end()] = False
                    ends[m.end() - 1] = True
                    if m.start():
                        ends[m.start() - 1] = True
        ends &= kind != _SPACE
        keep = kind != _SPACE
        if not keep.any():
            return np.zeros(0, np.uint32)
        # each run and a blank: place of every kept sign, counted with the blanks before it
        ends, code = ends[keep], _LOWERED[code[keep]]
        place = np.arange(len(code)) + np.cumsum(ends) - ends
        spaced = np.full(len(code) + int(ends.sum()), 32, np.uint32)
        spaced[place] = code
        return self.ids_by_rank[self.pairs.encode_to_numpy(spaced.tobytes().decode("utf-32-le"), disallowed_special=())]


@functools.cache
def shared_encoder(path: str) -> TextEncoder:
    """One encoder for all tasks of a worker."""
    return TextEncoder(path)


def cut_pieces(docs: DataFrame, tokenizer: str, width: int = WIDTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""

    def cut(batches):
        encoder = shared_encoder(tokenizer)
        for pdf in batches:
            rows, doc_ids = [], pdf["doc_id"].tolist()
            texts = [t or "" for t in pdf["text"]]
            for a, b in text_blocks(texts, BLOCK):
                for doc_id, ids in zip(doc_ids[a:b], encoder.ids_of(texts[a:b]), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for at in range(0, len(ids), width):
                        piece = ids[at : at + width]
                        rows.append((doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(lambda it: trimmed(cut(it)), f"doc_id long, {_PIECE}")


def best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack: how many items of each size, within the room, are worth most."""
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    for w in range(1, room + 1):
        fits = np.searchsorted(sizes, w, side="right")
        best[w], pick[w] = best[w - 1], -1
        if fits:
            worth = value[:fits] + best[w - sizes[:fits]]
            k = int(worth.argmax())
            if worth[k] > best[w] + 1e-12:
                best[w], pick[w] = worth[k], k
    pattern, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            pattern[pick[w]] += 1
            w -= sizes[pick[w]]
    return float(best[room]), pattern


def invert(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan inverse with row pivoting."""
    m = len(a)
    work = np.hstack([a.astype(float), np.eye(m)])
    for k in range(m):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        if pivot != k:
            work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= factor[:, None] * work[k]
    return work[:, m:]


def solve_patterns(sizes: np.ndarray, counts: np.ndarray, room: int, most_rounds: int = 4000) -> list[tuple[int, np.ndarray]]:
    """Patterns with how often each is used, covering exactly `counts` pieces of each size.

    Column generation on min sum(x) subject to patterns @ x = counts, by the revised
    simplex method with an explicit inverse. Stopping early would only cost fill.
    """
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / (room // sizes))
    x = counts * inverse.diagonal()
    single_threaded_blas()
    for rounds in range(most_rounds):
        if rounds % 200 == 199:  # keep rounding errors small
            inverse = invert(basis)
            x = np.maximum(inverse @ counts, 0)
        value, pattern = best_pattern(inverse.sum(axis=0), sizes, room)
        if value <= 1 + 1e-9:
            break
        step = inverse @ pattern
        rising = step > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, x / np.where(rising, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = pattern
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    rest = counts.astype(np.int64).copy()
    used: list[tuple[int, np.ndarray]] = []
    for k in np.argsort(-x):
        pattern = basis[:, k].round().astype(np.int64)
        has = pattern > 0
        times = min(int(x[k] + 1e-6), int((rest[has] // pattern[has]).min())) if has.any() else 0
        if times > 0:
            used.append((times, pattern))
            rest -= times * pattern
    while rest.any():  # what rounding leaves: largest first
        pattern, space = np.zeros(m, np.int64), room
        for k in range(m - 1, -1, -1):
            n = min(int(rest[k]), space // int(sizes[k]))
            pattern[k], space = n, space - n * int(sizes[k])
        has = pattern > 0
        times = int((rest[has] // pattern[has]).min())
        used.append((times, pattern))
        rest -= times * pattern
    return used


def pack(docs: DataFrame, tokenizer: str, width: int = WIDTH, step: int = STEP) -> DataFrame:
    """One row a piece: its place in its document and in its sequence."""
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, tokenizer, width), "pieces")
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / step))
    histogram = sorted((r["class"], r["count"]) for r in pieces.groupBy("class").count().collect())  # width/step rows at most
    layout, sequence, ranks = [], 0, dict.fromkeys((c for c, _ in histogram), 0)
    if histogram:
        sizes, counts = (np.array(x, np.int64) for x in zip(*histogram, strict=True))
        for times, pattern in solve_patterns(sizes, counts, width // step):
            for c, n in zip(sizes.tolist(), pattern.tolist(), strict=True):
                if n:
                    layout.append((c, ranks[c], ranks[c] + n * times, n, sequence))
                    ranks[c] += n * times
            sequence += times
    layout_df = spark.createDataFrame(layout, "class_ long, low long, high long, each long, base long")
    cells = max(1, -(-sum(n for _, n in histogram) // CELL))
    pieces = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32"), F.lit(cells)))
    pieces = pieces.withColumn("nth", F.row_number().over(Window.partitionBy("class", "cell").orderBy("doc_id", "start", "ids_crc32")) - 1)
    before = Window.partitionBy("class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = pieces.groupBy("class", "cell").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    per_cell = per_cell.select(F.col("class").alias("class_"), F.col("cell").alias("cell_"), "first")
    ranked = pieces.join(per_cell, (F.col("class") == F.col("class_")) & (F.col("cell") == F.col("cell_"))).withColumn("rank", F.col("first") + F.col("nth")).drop("class_")
    # the layout has a few rows for each pattern: bounded by (width/step) squared, whatever the input
    placed = ranked.join(F.broadcast(layout_df), (F.col("class") == F.col("class_")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
