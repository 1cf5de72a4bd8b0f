"""Suffix-array dedup by bucket-pointer refinement.

A byte is removed if a string of `length` bytes that covers it also starts earlier: in a
document with a smaller doc_id, or in the same one further up. Texts are UTF-8 bytes, and
strings are judged on the input.

1. Of every window of `length` bytes the least of its `gram`-byte hashes is the anchor.
   Windows that follow each other and share an anchor are one run; equal windows have
   equal anchors. So a run with its bytes (its context) stands for 30 suffixes or so.
2. Runs are dealt out by anchor and sorted. Contexts equal in two hashes, 128 bits, beside
   the anchor's 48 are one class, whose later places are removed as a whole; anchors with
   one class are done. The first places of classes that share an anchor are left open.
3. The suffixes of open runs are refined: initial buckets hold equal `Q`-byte strings, and
   each round sorts a bucket's suffixes by the bucket numbers at a later offset. Numbers
   refined in one round are the ones that the next round reads there, so that a round
   doubles the bytes that a number stands for: Q, 2Q, and so on to `length`. Only suffixes
   in buckets of two or more go on. All but a bucket's first place are removed.

Hot contexts (copies, common passages) are cut to one row for each batch before the
shuffle. Anchors with more than `HOT` open contexts are cut into single windows, dealt out
by the hash of the window: rows grow in proportion, and none is resolved in a single task.

Defined cases: null texts are empty. Texts shorter than `length` lose nothing. Null
doc_ids come first. Rows equal in doc_id and text are one document. Repeated windows that
overlap count. An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, trimmed

LENGTH, GRAM, Q = 100, 24, 25
HOT = 20_000
#: Bytes that are hashed or refined at once.
BLOCK = 1 << 19
#: Bytes of documents that are Python objects at once.
PIECE = 1 << 22
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse, n at least; one table a base, which grows when a longer text comes."""
    if base not in _tables or len(_tables[base][0]) < n:
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(n, base, _U), np.full(n, inverse, _U)
        up[0] = down[0] = 1
        _tables[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _tables[base]


@functools.cache
def _values(seed: int) -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=_U) * _U(seed))


class Hashes:
    """Hashes of all byte ranges of one buffer, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray, base: int):
        size = 1 << max(16, int(len(data)).bit_length())
        self.up, down = _powers(base, size)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_values(base)[data] * down[: len(data)], out=self.sums[1:])

    def of(self, low, high) -> np.ndarray:
        return _mix((self.sums[high] - self.sums[low]) * self.up[low])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Minimizers of all windows of `length` bytes inside the documents of one buffer.

    ends: where each document ends. Returns (low, high, at): the first and the last start
    of a run of windows whose least gram hash stands at byte `at`.
    """
    n, w = len(data), length - gram + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (None, None)
    one, two = Hashes(data, _B1), Hashes(data, _B2)
    starts = np.arange(n - gram + 1)
    keys = (one.of(starts, starts + gram) & _U(0xFFFFFFFF00000000)) | starts.astype(_U)
    least, have = keys, 1
    while have * 2 <= w:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < w:
        k = w - have
        least = np.minimum(least[:-k], least[k:])
    at = (least & _U(0xFFFFFFFF)).astype(np.int64)  # of the window that starts at each byte
    owner = np.searchsorted(ends, np.arange(len(at)), side="right")
    good = np.arange(len(at)) + length <= ends[owner]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    new |= ~good
    lows = np.flatnonzero(new & good)
    bound = np.append(np.flatnonzero(new), len(at))
    highs = bound[np.searchsorted(bound, lows, side="right")] - 1
    return lows, highs, at[lows], one, two


def _scan(batches, length: int, gram: int):
    """Runs of a batch's documents: the first of each context in the batch, the others as removed (c null)."""
    for pdf in batches:
        pdf = pdf.sort_values(["doc_id", "th"], na_position="first", kind="stable").drop_duplicates(["doc_id", "th"])
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
        parts, at = [], 0
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= BLOCK):
                size += len(raw[to])
                to += 1
            sizes = np.array([len(x) for x in raw[at:to]])
            ends = np.cumsum(sizes)
            low, high, anchor, one, two = anchors(np.frombuffer(b"".join(raw[at:to]), np.uint8), ends, length, gram)
            if len(low):
                doc = np.searchsorted(ends, low, side="right")
                begin = ends[doc] - sizes[doc]
                shape = _mix((anchor - low).astype(_U) * _U(_B1) + (high - low).astype(_U))
                parts.append((one.of(anchor, anchor + gram) >> _U(16), two.of(low, high + length) ^ shape, one.of(low, high + length) + shape, doc + at, low - begin, high - begin))
            at = to
        if not parts:
            continue
        g, c, c2, doc, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((low, doc, c2, c, g))
        g, c, c2, doc, low, high = (x[order] for x in (g, c, c2, doc, low, high))
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])
        ids, ths = pdf["doc_id"].astype("Int64").array, pdf["th"].to_numpy(np.int64)
        key = np.where(first, g, _mix(g + low.astype(_U) + doc.astype(_U)) >> _U(16))
        out = pd.DataFrame({"g": key.view(np.int64), "c": pd.array(c.view(np.int64), "Int64"), "c2": np.where(first, c2.view(np.int64), 0), "doc_id": ids[doc], "th": ths[doc], "low": low, "high": high})
        out.loc[~first, "c"] = pd.NA
        yield out


def _resolve(batches):
    """From runs sorted by anchor, context and place: removed runs (kind 1) and open ones (kind 2)."""
    held: pd.DataFrame | None = None  # first place of the last context so far
    held_open = False
    for pdf in batches:
        plain = pdf["c"].isna().to_numpy()
        if plain.any():
            yield pdf[plain].drop(columns=["c", "c2"]).assign(kind=1)
        pdf = pdf[~plain]
        if not len(pdf):
            continue
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        g, c, c2 = pdf["g"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64), pdf["c2"].to_numpy(np.int64)
        new_g = np.ones(len(g), bool)
        new_g[1:] = g[1:] != g[:-1]
        first = new_g.copy()
        first[1:] |= (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])
        starts = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        lead = starts[run]  # the first place of each row's context
        doc, blank = pdf["doc_id"].fillna(0).to_numpy(np.int64), pdf["doc_id"].isna().to_numpy()
        th, low = pdf["th"].to_numpy(np.int64), pdf["low"].to_numpy(np.int64)
        same = (doc == doc[lead]) & (blank == blank[lead]) & (th == th[lead]) & (low == low[lead])
        yield pdf[~same].drop(columns=["c", "c2"]).assign(kind=1)
        shares = ~new_g[starts]  # has a context before it in its anchor
        is_open = shares.copy()
        is_open[:-1] |= shares[1:]
        if held is not None:
            is_open[0] |= held_open
        yield pdf.iloc[starts[:-1][is_open[:-1]]].drop(columns=["c", "c2"]).assign(kind=2)
        held, held_open = pdf.iloc[[starts[-1]]], bool(is_open[-1])
    if held is not None and held_open:
        yield held.drop(columns=["c", "c2"]).assign(kind=2)


def refine(data: np.ndarray, group: np.ndarray, starts: np.ndarray, length: int = LENGTH, q: int = Q) -> np.ndarray:
    """Bucket numbers of the strings of `length` bytes at `starts`, equal for equal (group, string).

    Singletons get numbers of their own. group: of each start.
    """
    # how many bytes a bucket number stands for in each round; the last two numbers may overlap
    spans = [min(q, length)]
    while spans[-1] < length:
        spans.append(min(2 * spans[-1], length))
    # which places a round must number: those at which the rounds after it read
    places = [np.unique(starts)]
    for span, wide in zip(spans[-2::-1], spans[:0:-1], strict=True):
        places.append(np.unique(np.concatenate([places[-1], places[-1] + (wide - span)])))
    places.reverse()
    # initial buckets: strings equal in two hashes
    one, two = (np.unique(Hashes(data, base).of(places[0], places[0] + spans[0]), return_inverse=True)[1].astype(np.int64) for base in (_B1, _B2))
    bucket = np.unique(one * (len(two) + 1) + two, return_inverse=True)[1].astype(np.int64)
    for k in range(1, len(spans)):
        # refine: sort by the pair of a place's number and the number, as refined by now, at the later offset
        here = np.searchsorted(places[k - 1], places[k])
        later = np.searchsorted(places[k - 1], places[k] + (spans[k] - spans[k - 1]))
        pair = bucket[here] * (len(places[k - 1]) + 1) + bucket[later]
        many = np.bincount(bucket, minlength=1)[bucket[here]] > 1  # a place alone in its bucket is settled
        refined = np.arange(len(pair), dtype=np.int64)
        numbers = np.unique(pair[many], return_inverse=True)[1]
        refined[many] = len(pair) + numbers
        bucket = np.unique(refined, return_inverse=True)[1].astype(np.int64)
    number = bucket[np.searchsorted(places[-1], starts)]
    own = np.unique(group, return_inverse=True)[1].astype(np.int64)
    return np.unique(own * (int(number.max(initial=0)) + 1) + number, return_inverse=True)[1].astype(np.int64)


class Seen:
    """Windows of an anchor that earlier batches held, told apart by two hashes."""

    def __init__(self):
        self.one, self.two = np.zeros(0, _U), np.zeros(0, _U)

    def add(self, one: np.ndarray, two: np.ndarray) -> None:
        one, two = np.concatenate([self.one, one]), np.concatenate([self.two, two])
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.one, self.two = one[new], two[new]

    def has(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.one, one, "left"), np.searchsorted(self.one, one, "right")
        found = np.zeros(len(one), bool)
        for step in range(int((high - low).max(initial=0))):  # more than one only where the first hash collides
            at = low + step
            mine = np.flatnonzero(at < high)
            found[mine] |= self.two[at[mine]] == two[mine]
        return found


def _refine(batches, length: int):
    """From open contexts sorted by anchor, salt and place: runs of windows that start earlier too."""
    last, seen = None, Seen()
    for pdf in _grown(batches):
        raw = pdf["context"].tolist()
        sizes = np.array([len(x) for x in raw])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = sizes - length + 1
        row = np.repeat(np.arange(len(raw)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = (ends - sizes)[row] + within
        h, h2 = (Hashes(data, base).of(at, at + length) for base in (_B2, _B1))
        key = _mix(pdf["g"].to_numpy(np.int64).view(_U)) + pdf["salt"].to_numpy(np.int64).astype(_U)
        bucket = refine(data, key[row], at, length)
        order = np.argsort(bucket, kind="stable")
        again = np.zeros(len(row), bool)
        again[order[1:]] = bucket[order[1:]] == bucket[order[:-1]]
        if last is not None:
            old = np.flatnonzero(key[row] == last)
            again[old] |= seen.has(h[old], h2[old])
        if key[-1] != last:
            seen = Seen()
        tail = key[row] == key[-1]
        seen.add(h[tail], h2[tail])
        last = key[-1]
        # neighbouring windows as one range
        row, within = row[again], within[again]
        cut = np.ones(len(row), bool)
        cut[1:] = (row[1:] != row[:-1]) | (within[1:] != within[:-1] + 1)
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(row)) - 1
        found = pdf.iloc[row[begin]]
        base = found["low"].to_numpy(np.int64)
        yield pd.DataFrame({"doc_id": found["doc_id"].to_numpy(), "th": found["th"].to_numpy(), "low": base + within[begin], "high": base + within[end]}).astype({"doc_id": "Int64"})


def _grown(batches):
    """Batches put together until they have about BLOCK bytes of contexts."""
    parts, size = [], 0
    for pdf in batches:
        for at in range(0, len(pdf), 2000):
            part = pdf.iloc[at : at + 2000]
            parts.append(part)
            size += sum(map(len, part["context"]))
            if size >= BLOCK:
                yield pd.concat(parts, ignore_index=True)
                parts, size = [], 0
    if size:
        yield pd.concat(parts, ignore_index=True)


def _pieces(batches):
    """Arrow batches cut to about PIECE bytes each, at least a row: what a task holds as Python objects does not grow with a batch."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), np.int64)
        if batch.num_rows:
            block = (np.cumsum(sizes) - sizes) // PIECE
            starts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(sizes))
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield batch.slice(low, high - low)


def _rows(piece, name: str):
    """(document's bytes, first and last place in the arrays of its list), one a row, and the list's fields as arrays."""
    lists = piece.column(name)
    ends, values = lists.offsets.to_numpy().tolist(), lists.values
    fields = {f.name: values.field(f.name).to_numpy(zero_copy_only=False) for f in values.type}
    return zip(piece.column("text").cast(pa.large_binary()), ends[:-1], ends[1:], strict=True), fields


_CONTEXTS = pa.schema([("g", pa.int64()), ("salt", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("low", pa.int32()), ("context", pa.binary())])
_LEFT = pa.schema([("doc_id", pa.int64()), ("text_bytes", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])


def _contexts(batches, length: int):
    """Open runs with their bytes; those of hot anchors as single windows."""
    for piece in _pieces(batches):
        ids, ths = piece.column("doc_id").to_pylist(), piece.column("th").to_pylist()
        rows, size = [], 0
        texts, x = _rows(piece, "open")
        for doc_id, th, (text, first, last) in zip(ids, ths, texts, strict=True):
            raw = text.as_py()
            for g, salts, low, high in zip(*(x[c][first:last].tolist() for c in ("g", "salts", "low", "high")), strict=True):
                if salts == 1:
                    rows.append((g, 0, doc_id, th, low, raw[low : high + length]))
                    size += high + length - low
                else:
                    for at in range(low, high + 1):
                        window = raw[at : at + length]
                        rows.append((g, xxhash.xxh32_intdigest(window) % salts, doc_id, th, at, window))
                    size += (high + 1 - low) * length
                if size >= PIECE:
                    yield _table(rows, _CONTEXTS)
                    rows, size = [], 0
        if rows:
            yield _table(rows, _CONTEXTS)


def _cut(batches, length: int):
    """Documents without their ranges, and how much went."""
    for piece in _pieces(batches):
        rows = []
        texts, x = _rows(piece, "ranges")
        for doc_id, (text, first, last) in zip(piece.column("doc_id").to_pylist(), texts, strict=True):
            raw = text.as_py()
            if first == last:
                rows.append((doc_id, raw, len(raw), 0, 0))
                continue
            steps = np.zeros(len(raw) + 1, np.int64)
            np.add.at(steps, x["low"][first:last], 1)
            np.add.at(steps, x["high"][first:last] + length, -1)
            gone = np.cumsum(steps[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((doc_id, np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), int(gone.sum()), spans))
        yield _table(rows, _LEFT)


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def document_key() -> F.Column:
    """One number for (doc_id, th), null or not, to partition by."""
    return F.xxhash64("doc_id", "th")


def same_document() -> F.Column:
    """The rest of the key's test, written so that it is no join key and asks for no other partitioning."""
    none = F.lit(-1).cast("long")
    return (F.coalesce("doc_id", none).bitwiseXOR(F.coalesce("doc_id_", none)) == 0) & (F.col("th").bitwiseXOR(F.col("th_")) == 0) & (F.col("doc_id").isNull().cast("int") - F.col("doc_id_").isNull().cast("int") == 0)


def repeated_ranges(docs: DataFrame, keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, th, low, high: ranges of window starts whose windows start earlier too.

    docs: (doc_id, th, text) as read; keyed: the same with a key, hash-partitioned by it.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = "doc_id long, th long, low int, high int"
    runs = docs.mapInPandas(lambda it: trimmed(_scan(it, length, gram)), f"g long, c long, c2 long, {run}")
    dealt = runs.repartition(n, "g").sortWithinPartitions("g", "c", "c2", "doc_id", "th", "low")
    found = materialize(dealt.mapInPandas(_resolve, f"g long, {run}, kind int"), "runs")
    whole = found.filter("kind = 1").select("doc_id", "th", "low", "high")
    open_ = found.filter("kind = 2").drop("kind")
    salts = materialize(open_.groupBy("g").count().filter(F.col("count") > hot).select(F.col("g").alias("g_"), F.ceil(F.col("count") / hot).alias("salts")), "hot")
    if salts.isEmpty():
        open_ = open_.withColumn("salts", F.lit(1).cast("long"))
    else:
        open_ = open_.join(salts, F.col("g") == F.col("g_"), "left").select("g", F.coalesce("salts", F.lit(1)).alias("salts"), "doc_id", "th", "low", "high")
    by_doc = open_.groupBy(document_key().alias("key_"), "doc_id", "th").agg(F.collect_list(F.struct("g", "salts", "low", "high")).alias("open"))

    by_doc = by_doc.withColumnsRenamed({"doc_id": "doc_id_", "th": "th_"})
    got = keyed.join(by_doc, (F.col("key") == F.col("key_")) & same_document())
    got = got.select("doc_id", "th", "text", "open").mapInArrow(lambda it: trimmed(_contexts(it, length)), "g long, salt long, doc_id long, th long, low int, context binary")
    got = got.repartition(n, "g", "salt").sortWithinPartitions("g", "salt", "doc_id", "th", "low")
    return whole.union(got.mapInPandas(lambda it: trimmed(_refine(it, length)), run))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, text_bytes (what is left), n_bytes, n_removed, n_spans of every row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total, different = d.agg(F.count("*"), F.count_distinct("doc_id")).first()
    d = d.withColumn("th", F.lit(0).cast("long") if total == different else F.xxhash64("text"))
    # the texts are dealt out once, for the contexts and for the cuts
    keyed = d.select(document_key().alias("key"), "doc_id", "th", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    ranges = repeated_ranges(d, keyed, length, gram, hot)
    ranges = ranges.groupBy(document_key().alias("key_"), "doc_id", "th").agg(F.collect_list(F.struct("low", "high")).alias("ranges")).withColumnsRenamed({"doc_id": "doc_id_", "th": "th_"})
    joined = keyed.join(ranges, (F.col("key") == F.col("key_")) & same_document(), "left")

    return joined.select("doc_id", "text", "ranges").mapInArrow(lambda it: trimmed(_cut(it, length)), "doc_id long, text_bytes binary, n_bytes long, n_removed long, n_spans long")


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text_bytes", 256).alias("kept_sha256"))
