"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, under a mask.

Rows of the matrix are documents (classes of equal shingle sets, that is: equal in size and
in 128 bits of hash), columns are 64-bit hashes of shingles. The product of the matrix with
its transpose counts shared shingles. It is taken in blocks: a row's columns are cut into
slices of about `SLICE` entries, the rows that meet one row are dealt into tiles, each tile
counts what its rows share with that row in one slice, and the counts of the slices are
summed by pair. A pair links if the sum reaches the ratio t.

Only cells of the product that size-derived bounds leave open are counted. A pair needs at
least t times the larger size, so a row needs only its first n - ceil(t n) + 1 entries in
an order that all rows share (rare shingles first): two rows that reach t meet in one of
those columns at least. A pair that meets is discarded by its sizes alone, by the column's
place in both rows' order (in the first shared column, no more entries can be shared than
follow), or by a sketch with the parity of each row's entries in some hundred cells, which
differs in no more cells than the rows differ in entries.

Only components are asked for, so a column of m rows is not multiplied out into m^2
pairs. Each row is multiplied with its column's first row; linked rows join components; and
only rows of one column that still are in different components are held against each
other, in blocks of bounded size, for the bounds to leave the few pairs that are multiplied.
Every link either is counted so, or joins rows that are connected already.

The order of columns comes from counts of the shingles that stand in several documents
of those that a task sees together, over all documents. The order never changes the result, only the number of
pairs, so its table is cut to `ORDERED` entries, a fixed size.

Defined cases: null texts and texts without words have no shingle and link with nothing;
texts with fewer words than a shingle are one shingle, their whole sequence. Rows that repeat a
doc_id are one document: their texts link it all alike. A null doc_id links with nothing
and has a null component. Very long texts count whole. An empty table gives an empty
one; further columns are not read. `keep_first` leaves all columns as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, trimmed
from .components import components
from .suffix_dedup import Hashes, _mix

WIDTH, PERCENT = 5, 80
ORDERED, BLOCK, POOL = 1 << 20, 1 << 18, 1_500_000
#: Entries of a slice, about, and tiles that the rows which meet one row are dealt into.
SLICE, TILES = 4096, 256
#: Cells of a sketch for rows of up to SMALL entries (doubled with the entries), rows of a column held against each other at once, ids that may be broadcast.
CELLS, SMALL, ROWS, FEW = 512, 1500, 2000, 50_000
_U = np.uint64
_SEEDS = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash): the distinct shingles of each text, sorted by owner and hash."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    ends = np.cumsum([len(x) + 1 for x in raw])
    blank = _BLANK[data]
    word = ~blank
    begin = np.flatnonzero(word & np.append(True, blank[:-1]))
    end = np.flatnonzero(word & np.append(blank[1:], True)) + 1
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    h = Hashes(data, 0x9E3779B97F4A7C15).of(begin, end)
    owner = np.searchsorted(ends, begin, side="right")
    m = len(h) - width + 1
    parts = []
    if m > 0:
        s = np.zeros(m, _U)
        for k in range(width):
            s = s * _SEEDS[0] + h[k : k + m] * _SEEDS[k % len(_SEEDS)]
        whole = owner[:m] == owner[width - 1 :]
        parts.append((owner[:m][whole], _mix(s[whole])))
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    for n in range(1, width):  # texts with fewer words than a shingle
        short = np.flatnonzero(count == n)
        if len(short):
            s = np.full(len(short), n, _U)
            for k in range(n):
                s = (s + h[first[short] + k]) * _SEEDS[-1 - n % 4] + _SEEDS[k]
            parts.append((short, _mix(s)))
    owner, s = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    order = np.lexsort((s, owner))
    owner, s = owner[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (s[1:] != s[:-1])
    return owner[new], s[new]


def _blocks(pdf: pd.DataFrame):
    at, texts = 0, pdf["text"].tolist()
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= BLOCK):
            size += len(texts[to] or "")
            to += 1
        yield at, to, texts[at:to]
        at = to


def sketches(owner: np.ndarray, s: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each row the parity of its entries in each cell; long rows have more cells, a power of two times as many."""
    cells = np.where(n > SMALL, CELLS << np.ceil(np.log2(np.maximum(n, 1) / SMALL)).clip(0).astype(np.int64), CELLS)
    begin = np.cumsum(cells) - cells
    odd = np.bincount(begin[owner] + (s.astype(np.int64) & (cells[owner] - 1)), minlength=int(cells.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [packed[x // 8 : (x + c) // 8] for x, c in zip(begin.tolist(), cells.tolist(), strict=True)]


def signatures(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart: two sums over each set's entries."""
    stop, out = np.cumsum(n), []
    for seed in (_SEEDS[1], _SEEDS[2]):
        total = np.concatenate([[_U(0)], np.cumsum(_mix((s + seed) * seed))])
        out.append(_mix(total[stop] - total[stop - n]).view(np.int64))
    return out[0], out[1]


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the number of entries that only one of two rows has."""
    if len(a) > len(b):
        a, b = b, a
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    width = len(b) * 8
    while width > len(a) * 8:  # a longer sketch folds onto a shorter one
        width //= 2
        y = (y >> width) ^ (y & ((1 << width) - 1))
    return (x ^ y).bit_count()


def _summarize(batches, width: int):
    """kind 0: a document's number of shingles, a hash and a sketch of its set; kind 1: a shingle and its documents among those seen together (about POOL shingles)."""
    pool, size = [], 0

    def often():
        shingle, count = np.unique(np.concatenate(pool), return_counts=True)
        twice = count >= 2
        return pd.DataFrame({"kind": 1, "id": pd.array(shingle[twice].view(np.int64), "Int64"), "n": count[twice], "sig": 0, "sig2": 0, "sketch": None})

    for pdf in batches:
        ids = pdf["doc_id"].astype("Int64").array
        for at, to, texts in _blocks(pdf):
            owner, s = shingle_sets(texts, width)
            n = np.bincount(owner, minlength=to - at)
            sig, sig2 = signatures(s, n)
            yield pd.DataFrame({"kind": 0, "id": ids[at:to], "n": n, "sig": sig, "sig2": sig2, "sketch": sketches(owner, s, n)})
            pool.append(s)
            size += len(s)
            if size > POOL:
                yield often()
                pool, size = [], 0
    if pool:
        yield often()


def _prefixes(batches, width: int, percent: int, shared):
    known, counts = shared.value
    for pdf in batches:
        ids = pdf["doc_id"].to_numpy(np.int64)
        for at, _, texts in _blocks(pdf):
            owner, s = shingle_sets(texts, width)
            if not len(s):
                continue
            often = np.zeros(len(s), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, s), len(known) - 1)
                often = np.where(known[place] == s, counts[place], 0)
            order = np.lexsort((s, often, owner))
            owner, s = owner[order], s[order]
            n = np.bincount(owner)
            start = np.cumsum(n) - n
            prefix = n - (percent * n + 99) // 100 + 1
            place = np.arange(len(s)) - start[owner]
            keep = place < prefix[owner]
            yield pd.DataFrame({"s": (s[keep] >> _U(24)).astype(np.int64), "id": ids[at + owner[keep]], "place": place[keep] + 1})


def _folded(sketch: bytes) -> np.ndarray:
    """A sketch folded onto CELLS cells, as 64-bit words; still a lower bound."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, _U).reshape(-1, CELLS // 64), axis=0)


#: Rows of a small block, whose pairs are listed, and pairs that are tested at once.
SMALL_BLOCK, AT_ONCE = 64, 1 << 19
_TRIANGLES = [np.triu_indices(k, 1) for k in range(SMALL_BLOCK + 1)]


class OpenPairs:
    """Pairs of rows that share a block of a column, could link and are in different components: (a, b, n, m)."""

    def __init__(self, rows: pd.DataFrame, percent: int):
        self.percent, self.side = percent, rows["side"].to_numpy()
        self.rep, self.n, self.component, self.place = (rows[c].to_numpy(np.int64) for c in ("rep", "n", "component", "place"))
        self.sketch = rows["sketch"].tolist()
        self.short = np.array([_folded(x) for x in self.sketch], _U).reshape(-1, CELLS // 64)
        keys = rows[["s", "i", "j"]].to_numpy()
        self.bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(rows)]

    def candidates(self, last: int):
        """Index arrays of pairs of the blocks that end by `last`, some at once."""
        left, right, size = [], [], 0
        for low, high in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            if high > last or high - low < 2:
                continue
            if high - low <= SMALL_BLOCK and not self.side[low]:
                x, y = _TRIANGLES[high - low]
                left.append(low + x)
                right.append(low + y)
                size += len(x)
            else:
                side = self.side[low:high]
                ours, theirs = low + np.flatnonzero(side != 2), low + np.flatnonzero(side != 1)
                step = max(1, AT_ONCE // max(1, len(theirs)))
                for at in range(0, len(ours), step):
                    some = ours[at : at + step]
                    x, y = np.repeat(some, len(theirs)), np.tile(theirs, len(some))
                    once = (self.side[x] != 0) | (x < y)
                    yield x[once], y[once]
            if size > AT_ONCE:
                yield np.concatenate(left), np.concatenate(right)
                left, right, size = [], [], 0
        if left:
            yield np.concatenate(left), np.concatenate(right)

    def find(self, last: int) -> pd.DataFrame:
        n, rep, parts = self.n, self.rep, [np.zeros((0, 4), np.int64)]
        for x, y in self.candidates(last):
            some = (100 * np.minimum(n[x], n[y]) >= self.percent * np.maximum(n[x], n[y])) & (self.component[x] != self.component[y])
            x, y = x[some], y[some]
            least = -(-self.percent * (n[x] + n[y]) // (100 + self.percent))  # entries that must be shared
            some = 1 + np.minimum(n[x] - self.place[x], n[y] - self.place[y]) >= least
            x, y, most = x[some], y[some], (n[x] + n[y] - 2 * least)[some]
            some = np.bitwise_count(self.short[x] ^ self.short[y]).sum(axis=1) <= most
            x, y, most = x[some], y[some], most[some]
            sketch, plain = self.sketch, CELLS // 8
            some = np.array([len(sketch[p]) == len(sketch[q]) == plain or apart(sketch[p], sketch[q]) <= k for p, q, k in zip(x.tolist(), y.tolist(), most.tolist(), strict=True)], bool)
            x, y = x[some], y[some]
            turned = rep[x] > rep[y]
            x, y = np.where(turned, y, x), np.where(turned, x, y)
            parts.append(np.stack([rep[x], rep[y], n[x], n[y]], axis=1))
        return pd.DataFrame(np.unique(np.concatenate(parts), axis=0), columns=["a", "b", "n", "m"])


def _open_pairs(batches, percent: int):
    """From rows sorted by column and block; a block may begin in one batch and end in the next."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if len(pdf):
            rows = OpenPairs(pdf, percent)
            yield rows.find(rows.bounds[-2])
            rest = pdf.iloc[rows.bounds[-2] :]
    if rest is not None and len(rest):
        yield OpenPairs(rest, percent).find(len(rest))


def column_blocks(n: int, slice_size: int) -> int:
    """Slices that a row of n entries is cut into: a power of two."""
    return 1 << max(0, (n - 1) // slice_size).bit_length()


def _slices(batches, width: int, percent: int, slice_size: int):
    """Entries of each row, cut by their leading bits: once for each number of slices that a partner's size may ask for."""
    for pdf in batches:
        ids = pdf["id"].to_numpy(np.int64)
        for at, to, texts in _blocks(pdf):
            owner, s = shingle_sets(texts, width)
            n = np.bincount(owner, minlength=to - at)
            sig = signatures(s, n)[0]
            rows = []
            for k, (stop, size) in enumerate(zip(np.cumsum(n).tolist(), n.tolist(), strict=True)):
                own, cuts = s[stop - size : stop], column_blocks(size, slice_size)
                while size and cuts <= column_blocks(100 * size // percent, slice_size):
                    edges = np.searchsorted(own, np.arange(1, cuts, dtype=_U) << _U(64 - cuts.bit_length() + 1)) if cuts > 1 else []
                    for block, part in enumerate(np.split(own, edges)):
                        rows.append((int(ids[at + k]), int(sig[k]), size, cuts, block, part.tobytes()))
                    cuts *= 2
            yield pd.DataFrame(rows, columns=["id", "sig", "n", "cuts", "block", "entries"])


def _product(batches):
    """Shared entries of a tile's rows with the row they meet, in one slice.

    Batches are sorted by tile and side: the row itself (side 0) comes before those that meet it.
    """
    key, held = None, []
    for pdf in batches:
        keys = pdf[["b", "tile", "cuts", "block"]].to_numpy()
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = [0, *cut.tolist(), len(pdf)]
        side, entries = pdf["side"].to_numpy(), pdf["entries"].tolist()
        ids, sig, n = (pdf[c].to_numpy(np.int64) for c in ("id", "sig", "n"))
        parts = []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if low == high:
                continue
            if key != tuple(keys[low]):
                key, held = tuple(keys[low]), []
            first = low + int((side[low:high] == 0).sum())
            held += [(sig[k], n[k], np.frombuffer(entries[k], _U)) for k in range(low, first)]
            if first == high:
                continue
            size = np.array([len(x) // 8 for x in entries[first:high]])
            column, row = np.frombuffer(b"".join(entries[first:high]), _U), np.repeat(np.arange(high - first), size)
            for sig_b, m, own in held:
                found = np.searchsorted(own, column) if len(own) else np.zeros(len(column), np.int64)
                same = own[np.minimum(found, len(own) - 1)] == column if len(own) else np.zeros(len(column), bool)
                shared = np.bincount(row[same], minlength=high - first)
                parts.append(pd.DataFrame({"a": ids[first:high], "sig_a": sig[first:high], "n": n[first:high], "b": int(key[0]), "sig_b": int(sig_b), "m": int(m), "cuts": int(key[2]), "shared": shared}))
        if parts:
            yield pd.concat(parts, ignore_index=True)


def shared_counts(pairs: DataFrame, d: DataFrame, percent: int, width: int, slice_size: int = SLICE) -> DataFrame:
    """Linked pairs (a, b) among (a, b, n, m): shared entries summed over the slices of both rows."""
    spark = d.sparkSession
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "ids")
    few = ids.count() <= FEW  # otherwise both sides are dealt out
    texts = d.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("c")).select(F.col("c").alias("id"), "text")
    slices = materialize(texts.mapInPandas(lambda it: trimmed(_slices(it, width, percent, slice_size)), "id long, sig long, n long, cuts int, block int, entries binary").dropDuplicates(["id", "sig", "cuts", "block"]), "slices")
    over = F.floor((F.greatest("n", "m") - 1) / slice_size)
    cuts = F.when(over > 0, F.pow(F.lit(2), F.length(F.bin(over)))).otherwise(F.lit(1)).cast("int")
    met = pairs.select("a", "b", cuts.alias("cuts"), F.pmod(F.xxhash64("a"), F.lit(TILES)).cast("int").alias("tile")).distinct()
    rows = met.join(slices.withColumnRenamed("cuts", "cuts_"), (F.col("a") == F.col("id")) & (F.col("cuts") == F.col("cuts_")))
    own = met.select("b", "cuts", "tile").distinct().join(slices.withColumnRenamed("cuts", "cuts_"), (F.col("b") == F.col("id")) & (F.col("cuts") == F.col("cuts_")))
    columns = ["b", "tile", "cuts", "block", "id", "sig", "n", "entries"]
    dealt = own.select(*columns, F.lit(0).alias("side")).union(rows.select(*columns, F.lit(1).alias("side")))
    keys = ["b", "tile", "cuts", "block"]
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "side")
    counts = dealt.mapInPandas(lambda it: trimmed(_product(it)), "a long, sig_a long, n long, b long, sig_b long, m long, cuts int, shared long")
    total = counts.groupBy("a", "sig_a", "b", "sig_b", "cuts").agg(F.sum("shared").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
    return materialize(total.filter(100 * F.col("shared") >= percent * (F.col("n") + F.col("m") - F.col("shared"))).select("a", "b").distinct(), "links")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, ordered: int = ORDERED, slice_size: int = SLICE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = materialize(d.mapInPandas(lambda it: trimmed(_summarize(it, width)), "kind int, id long, n long, sig long, sig2 long, sketch binary"), "sets")
    sizes = made.filter("kind = 0").select(F.col("id").alias("doc_id"), "n", "sig", "sig2", "sketch")
    top = made.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).filter("n >= 4").orderBy(F.desc("n"), "id").limit(ordered).toPandas()
    shingle = top["id"].to_numpy(np.int64).view(_U)
    order = np.argsort(shingle)
    shared = spark.sparkContext.broadcast((shingle[order], top["n"].to_numpy(np.int64)[order]))  # `ordered` entries at most
    # equal sets are one class, named by its smallest doc_id
    some = sizes.filter("n > 0 and doc_id is not null")
    classes = some.groupBy("n", "sig", "sig2").agg(F.min("doc_id").alias("rep"))
    member = some.drop("sketch").join(classes.withColumnsRenamed({"n": "n_", "sig": "sig_", "sig2": "sig2_"}), (F.col("n") == F.col("n_")) & (F.col("sig") == F.col("sig_")) & (F.col("sig2") == F.col("sig2_")))
    member = materialize(member.select("doc_id", "n", "rep").distinct(), "classes")
    # columns with two rows or more
    cells = d.filter("doc_id is not null and text is not null").mapInPandas(lambda it: trimmed(_prefixes(it, width, percent, shared)), "s long, id long, place long")
    cells = materialize(cells, "cells")
    column = cells.groupBy("s").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").select(F.col("s").alias("s_"), "first")
    shared_cells = cells.join(column, F.col("s") == F.col("s_")).select("s", "id", "first", "place")
    name = member.select(F.col("doc_id").alias("id_"), F.col("rep"), F.col("n"))
    named = shared_cells.join(name, F.col("id") == F.col("id_")).select("s", "rep", "n", "first", "place")
    named = named.join(name.select(F.col("id_").alias("f_"), F.col("rep").alias("pivot"), F.col("n").alias("pivot_n")), F.col("first") == F.col("f_")).select("s", "rep", "n", "pivot", "pivot_n", "place").distinct()
    named = materialize(named, "columns")
    sized = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    pairs = named.filter((F.col("rep") != F.col("pivot")) & sized).select(F.col("rep").alias("a"), F.col("pivot").alias("b"), F.col("n"), F.col("pivot_n").alias("m")).distinct()
    sketch = sizes.join(member.filter("doc_id = rep").select(F.col("rep")), F.col("doc_id") == F.col("rep")).groupBy("rep").agg(F.first("sketch").alias("sketch"))
    sketch = materialize(sketch, "sketches")

    @F.pandas_udf("int")
    def difference(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([apart(a, b) for a, b in zip(x, y, strict=True)], dtype="int32")

    pairs = pairs.join(sketch.select(F.col("rep").alias("x_"), F.col("sketch").alias("x")), F.col("a") == F.col("x_")).join(sketch.select(F.col("rep").alias("y_"), F.col("sketch").alias("y")), F.col("b") == F.col("y_"))
    least = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    pairs = materialize(pairs.filter(difference("x", "y") <= F.col("n") + F.col("m") - 2 * least).select("a", "b", "n", "m"), "pairs")
    edges = shared_counts(pairs, d, percent, width, slice_size)
    # a doc_id that repeats with other texts joins their classes
    several = member.groupBy(F.col("doc_id").alias("d_")).agg(F.min("rep").alias("b"), F.max("rep").alias("last")).filter("b <> last")
    edges = materialize(edges.union(member.join(several, F.col("doc_id") == F.col("d_")).filter("rep <> b").select("rep", "b")), "links")
    grouped = components(edges)
    # columns that still hold rows of different components
    placed = named.filter("rep <> pivot").join(grouped, F.col("rep") == F.col("node"), "left").select("s", "rep", "n", "place", F.coalesce("component", "rep").alias("component"))
    open_columns = placed.groupBy("s").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("rows")).filter("c0 <> c1").select(F.col("s").alias("s_"), F.ceil(F.col("rows") / ROWS).cast("int").alias("parts"))
    rows = placed.join(open_columns, F.col("s") == F.col("s_")).join(sketch.withColumnRenamed("rep", "rep_"), F.col("rep") == F.col("rep_")).select("s", "rep", "n", "place", "component", "sketch", "parts")
    # a long column is cut into parts; each part meets itself (side 0) and every later part (1 on the left, 2 on the right)
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(part, k).alias("i"), F.greatest(part, k).alias("j"), F.when(part == k, 0).when(part < k, 1).otherwise(2).alias("side")))
    rows = rows.withColumn("meet", F.explode(meets)).select("s", "meet.i", "meet.j", "meet.side", "rep", "n", "place", "component", "sketch")
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s", "i", "j").sortWithinPartitions("s", "i", "j")
    more = materialize(dealt.mapInPandas(lambda it: _open_pairs(it, percent), "a long, b long, n long, m long").distinct(), "pairs")
    if not more.isEmpty():
        late = shared_counts(more, d, percent, width, slice_size)
        if not late.isEmpty():
            grouped = components(edges.union(late))
    rep = member.join(grouped, F.col("rep") == F.col("node"), "left").select(F.col("doc_id").alias("d_"), F.coalesce("component", "rep").alias("component"))
    rep = rep.groupBy("d_").agg(F.min("component").alias("component"))
    return sizes.drop("sketch").join(rep, F.col("doc_id") == F.col("d_"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The rows whose doc_id is their component's smallest, one for each doc_id; rows without doc_id stay."""
    (name,) = fresh(docs, "doc_id__")
    total, different = docs.filter("doc_id is not null").agg(F.count("*"), F.count_distinct("doc_id")).first()
    if total != different:
        docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(docs.filter("doc_id is null"))
    gone = jaccard_components(docs, percent, width).filter("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
