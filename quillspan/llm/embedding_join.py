"""Embedding near-dedup: an exact metric range join.

Vectors are scaled to unit length, where cosine >= t means a Euclidean distance of at
most e = sqrt(2 - 2t). Pivots part the vectors: each has its home in the cell of its
nearest pivot, and is copied to every other cell that may hold a partner. By the
triangle inequality a partner x of q with home pivot p_j has d(q, p_j) <= e + radius of
the cell, and, since x is nearer to p_j than to q's own pivot p_i, q lies within e of
the plane between them: (d(q,p_j)^2 - d(q,p_i)^2) <= 2 e d(p_i,p_j). Cells join on their
own: homes against all members, in blocks of bounded size, so that a cell that holds a
third of all vectors is many tasks. Links are counted, not listed: a block returns the
counts of its vectors and a spanning forest of its links.

Pivots are chosen by what they prune. They are spread over a bounded sample, each the
farthest from those before it, and for every number of them the copies and the pairs to
compare are measured on that sample. The number with the fewest pairs is taken, as long as
vectors are copied to `MOST_SPREAD` cells at most in the mean. Where no number of pivots
prunes so well (vectors in many dimensions whose distances are all alike), all vectors are
one cell, whose blocks meet each other once; both ways are exact.

Products are taken in single precision first; its error is bounded, and pairs nearer to
the threshold than the bound are computed again in double precision.

Equal vectors are one class beforehand, however many copies there are.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
and rows without vec_id, link with nothing. Vectors of different length never link.
Rows that repeat a vector are vectors of their own; rows that repeat a vec_id with other
vectors count each vector's links on its own row and share one component. An empty table
gives an empty one; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, single_threaded_blas
from .components import Forest, components

#: Vectors per pivot, the most pivots, the most cells that a vector is copied to in the mean.
PER_PIVOT, MOST_PIVOTS, MOST_SPREAD = 4096, 1024, 3.0
#: Bytes of vectors on either side of a block, rows of it at once, bytes and rows of the sample, pairs computed again at once.
BLOCK_BYTES, STRIP, SAMPLE_BYTES, SAMPLE, AGAIN = 8 << 20, 256, 32 << 20, 4096, 50_000
_SLACK = 1e-9


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))


def _cells_of(d: np.ndarray, home: np.ndarray, apart: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Which cells each vector must be in, by its distances to the pivots."""
    near = (d * d)[np.arange(len(home)), home][:, None]
    away = (d * d - near) / np.maximum(2 * apart[home], 1e-12)
    to = (away <= reach) & (d <= radius + reach)
    to[np.arange(len(home)), home] = True
    return to


def choose_pivots(sample: np.ndarray, n: int, reach: float, per_pivot: int, most_spread: float = MOST_SPREAD) -> np.ndarray:
    """Pivots for n vectors like the sample; one where none prune."""
    k = max(1, min(MOST_PIVOTS, -(-n // per_pivot), len(sample) // 4))
    picked, d = [0], _distances(sample, sample[:1])[:, 0]
    while len(picked) < k:
        picked.append(int(d.argmax()))
        d = np.minimum(d, _distances(sample, sample[picked[-1:]])[:, 0])
    best, fewest = 1, 1.0
    while k > 1:
        pivots = sample[picked[:k]]
        d = _distances(sample, pivots)
        home = d.argmin(axis=1)
        radius = np.full(k, -10.0)
        np.maximum.at(radius, home, d.min(axis=1))
        to = _cells_of(d, home, _distances(pivots, pivots), radius, reach)
        pairs = 2 * (np.bincount(home, minlength=k) * to.sum(axis=0)).sum() / len(sample) ** 2  # a lone cell compares each pair once
        if to.sum() <= most_spread * len(sample) and pairs < fewest:
            best, fewest = k, pairs
        k //= 2
    return sample[picked[:best]]


def link_block(homes: np.ndarray, members: np.ndarray, home_ids: np.ndarray, ids: np.ndarray, home_counts: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each home vector and of each member (others by their counts, itself not), and a spanning forest of them as places (home, member)."""
    names, index = np.unique(np.concatenate([home_ids, ids]), return_inverse=True)
    mine, theirs = index[: len(home_ids)], index[len(home_ids) :]
    label = np.arange(len(names))
    forest, edges = Forest(len(names)), []
    links, back = np.zeros(len(home_ids), np.int64), np.zeros(len(ids), np.int64)
    single = members.astype(np.float32).T.copy()
    error = (homes.shape[1] + 16) * 2.0**-24
    for at in range(0, len(homes), STRIP):
        product = homes[at : at + STRIP].astype(np.float32) @ single
        i, j = np.nonzero(product >= least - error)
        close = np.flatnonzero(product[i, j] <= least + error)
        keep = np.ones(len(i), bool)
        for a in range(0, len(close), AGAIN):
            k = close[a : a + AGAIN]
            keep[k] = np.einsum("ij,ij->i", homes[at + i[k]], members[j[k]]) >= least
        keep &= mine[at + i] != theirs[j]
        i, j = i[keep] + at, j[keep]
        links += np.bincount(i, weights=counts[j], minlength=len(links)).astype(np.int64)
        back += np.bincount(j, weights=home_counts[i], minlength=len(back)).astype(np.int64)
        a, b = label[mine[i]], label[theirs[j]]
        fresh = np.flatnonzero(a != b)
        if len(fresh):
            _, first = np.unique(np.stack([a[fresh], b[fresh]], axis=1), axis=0, return_index=True)
            for k in fresh[first].tolist():
                if forest.join(int(a[k]), int(b[k])):
                    edges.append((int(i[k]), int(j[k])))
            label = np.array([forest.find(x) for x in range(len(names))])
    return links, back, edges


def near_duplicates(vectors: DataFrame, least: float = 0.95, per_pivot: int = PER_PIVOT, block_bytes: int = BLOCK_BYTES, most_spread: float = MOST_SPREAD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)
    v = v.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), F.col("v")).alias("v")).withColumn("h", F.xxhash64("v"))
    v = materialize(v, "vectors")
    classes = v.filter("v is not null").groupBy("h", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + _SLACK
    parts = []
    for r in classes.groupBy(F.size("v").alias("dim")).count().collect():  # one row for each vector length
        dim, n = r["dim"], r["count"]
        own = classes.filter(F.size("v") == dim)
        size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
        sample = _unit([x["v"] for x in own.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(size).select("v").collect()])
        pivots = choose_pivots(sample, n, reach, per_pivot, most_spread)
        block = max(2, block_bytes // (8 * dim))
        parts.append(_cells(own, pivots, reach, least, block) if len(pivots) > 1 else _one_cell(own, n, least, block))
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.union(p)
        found = materialize(found, "links")
    else:
        found = spark.createDataFrame([], _LINK)
    links = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    edges = found.filter("b is not null").select("a", "b")
    named = v.filter("v is not null").join(classes.select(F.col("h").alias("h_"), F.col("v").alias("v_"), "id", "cid", "copies"), (F.col("h") == F.col("h_")) & (F.col("v") == F.col("v_"))).select("vec_id", "h", "id", "cid", "copies")
    named = materialize(named, "named")
    # a vec_id that repeats with another vector joins their classes
    several = named.groupBy(F.col("vec_id").alias("vec_id_")).agg(F.min("id").alias("b"), F.max("id").alias("last")).filter("b <> last")
    joins = named.join(several, F.col("vec_id") == F.col("vec_id_")).filter("id <> b").select(F.col("id").alias("a"), "b")
    member = components(edges.union(joins))
    named = named.join(links, F.col("cid") == F.col("a"), "left").drop("a").join(member, F.col("id") == F.col("node"), "left")
    linked = named.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # rows without a sound vector are their own component, unless their vec_id stands elsewhere with one
    elsewhere = linked.groupBy(F.col("vec_id").alias("vec_id_")).agg(F.min("component_id").alias("component_id"))
    rest = v.filter("v is null").select("vec_id").join(elsewhere, F.col("vec_id") == F.col("vec_id_"), "left")
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = linked.union(rest)
    return out.select("vec_id", F.col("n_links").cast("long"), "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


#: Links of class a where b is null, else an edge between vec_ids a and b.
_LINK = "a long, b long, n long"


def _found(names: np.ndarray, links: np.ndarray, edges: list[tuple[int, int]]) -> pd.DataFrame:
    some = links > 0
    rows = [(x, None, n) for x, n in zip(names[some].tolist(), links[some].tolist(), strict=True)] + [(x, y, 0) for x, y in edges]
    return pd.DataFrame(rows, columns=["a", "b", "n"]).astype("Int64")


def _link(left: pd.DataFrame, right: pd.DataFrame, least: float, both: bool) -> pd.DataFrame:
    single_threaded_blas()
    if not len(left) or not len(right):
        return _found(np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    x, y = (side["cid"].to_numpy(np.int64) for side in (left, right))
    links, back, edges = link_block(_unit(left["v"]), _unit(right["v"]), x, y, left["copies"].to_numpy(np.int64), right["copies"].to_numpy(np.int64), least)
    a, b = left["id"].tolist(), right["id"].tolist()
    edges = [(a[i], b[j]) for i, j in edges]
    return _found(np.concatenate([x, y]), np.concatenate([links, back]), edges) if both else _found(x, links, edges)


def _one_cell(own: DataFrame, n: int, least: float, block: int) -> DataFrame:
    """All vectors in blocks; every two blocks, and each with itself, meet once."""
    blocks = max(1, -(-n // block))
    own = own.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(11)), F.lit(blocks)).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j"), (F.col("block") <= k).alias("left")))
    dealt = own.select("cid", "id", "copies", "v", F.explode(meets).alias("meet")).select("meet.*", "cid", "id", "copies", "v")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["left"]], pdf[~pdf["left"]]
        alone = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        return _link(left, left if alone else right, least, not alone)

    return dealt.groupBy("i", "j").applyInPandas(link, _LINK)


def _cells(own: DataFrame, pivots: np.ndarray, reach: float, least: float, block: int) -> DataFrame:
    """Homes against members of every cell."""
    spark = own.sparkSession
    k = len(pivots)
    apart = _distances(pivots, pivots)

    def home(batches):
        single_threaded_blas()
        for pdf in batches:
            if len(pdf):
                d = _distances(_unit(pdf["v"]), pivots)
                yield pdf.assign(home=d.argmin(axis=1), d=d.min(axis=1))

    columns = "cid long, id long, copies long, v array<double>"
    homes = materialize(own.select("cid", "id", "copies", "v").mapInPandas(home, f"{columns}, home int, d double"), "homes")
    farthest = {r["home"]: r["radius"] for r in homes.groupBy("home").agg(F.max("d").alias("radius")).collect()}  # a row for each pivot
    radius = np.array([farthest.get(j, -10.0) for j in range(k)])

    def replicate(batches):
        single_threaded_blas()
        for pdf in batches:
            if not len(pdf):
                continue
            at = pdf["home"].to_numpy()
            row, cell = np.nonzero(_cells_of(_distances(_unit(pdf["v"]), pivots), at, apart, radius, reach))
            yield pdf[["cid", "id", "copies", "v"]].iloc[row].assign(cell=cell, at_home=cell == at[row])

    spread = materialize(homes.mapInPandas(replicate, f"{columns}, cell int, at_home boolean"), "spread")
    count = spread.groupBy("cell").agg(F.sum(F.col("at_home").cast("long")).alias("h"), F.count("*").alias("m")).collect()  # a row for each pivot
    blocks = spark.createDataFrame([(r["cell"], max(1, -(-r["h"] // block)), max(1, -(-r["m"] // block))) for r in count if r["h"]], "cell_ int, hs long, ms long")
    spread = spread.join(F.broadcast(blocks), F.col("cell") == F.col("cell_")).drop("cell_")
    at = F.pmod(F.xxhash64("cid", F.lit(11)), F.col("hs"))
    of = F.pmod(F.xxhash64("cid", F.lit(12)), F.col("ms"))
    own = ["cid", "id", "copies", "v"]
    left = spread.filter("at_home").select("cell", at.alias("hc"), F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("mc"), F.lit(True).alias("left"), *own)
    right = spread.select("cell", F.explode(F.sequence(F.lit(0), F.col("hs") - 1)).alias("hc"), of.alias("mc"), F.lit(False).alias("left"), *own)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        return _link(pdf[pdf["left"]], pdf[~pdf["left"]], least, False)

    return left.union(right).groupBy("cell", "hc", "mc").applyInPandas(link, _LINK)
