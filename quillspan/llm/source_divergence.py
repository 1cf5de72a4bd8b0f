"""Source divergence audit by two-dimensional group-block tiling.

How far apart are the word frequencies of the sources of a language? Each language keeps the
terms that stand in enough of its documents. Every source gives a kept term the smoothed
share p = 1 + floor(10^9 (count + 2) / (N + 2 V)), with N its count of kept terms and V their
number, and two sources differ by the sum of floor((p - q)^2 / (p + q)) over all kept terms.

Terms are counted in a pass over the texts, batch by batch, then summed by (language, source, term).
The kept terms of a language are dealt into vocabulary chunks by hash and numbered within
them; a source's counts in a chunk are one packed vector (numbers and counts of the terms it
has). Sources are dealt into blocks. A vector goes to the tasks of every pair of blocks that holds its
own, and such a task computes its pair submatrix over successive chunks: it
holds two blocks' shares for one chunk and a matrix of sums, whatever the vocabulary. A pair of blocks is
besides cut into spans of chunks, whose submatrices are added by a last sum, so that few sources
over a large vocabulary are dealt out too. The terms that set a source most apart from its
language come from the same counts by a join and a ranking that keeps the first ten in each partition.

Shares are whole numbers: 1000 x the remainder is divided three times, which stays in 64 bits for
sums below 9 x 10^15. No text, no source and no language is collected anywhere; the pairs
are the result, so their number is that of the sources squared within a language.

Defined cases: null texts, languages and sources are ''. Repeated rows and rows without a doc_id
are documents of their own. A source without terms has the share of count 0 everywhere; a language without kept terms
has differences of 0. Ties are ranked by the item's bytes. Very long texts are counted whole.
An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, trimmed

LEAST_DOCS, TOP, PRIOR = 10, 10, 2
#: Terms of a chunk, sources of a block, chunks of a span, terms held by a counting task.
CHUNK, BLOCK, SPAN, HELD = 4096, 64, 4, 400_000
SALTS = 64

#: Bytes of terms: A-Z become a-z; letters and all bytes from 0x80 stay, everything else parts terms.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _count(batches):
    """Counts and document counts by (lang, source, term); a row without a term for each group seen."""
    uses: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def flush() -> pd.DataFrame:
        rows = []
        for (lang, source), counts in uses.items():
            held = docs[lang, source]
            rows += [(lang, source, t.decode("utf-8", "surrogatepass"), n, held[t]) for t, n in counts.items()]
            rows.append((lang, source, None, 0, 0))
        uses.clear()
        docs.clear()
        return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "docs"], dtype=object)

    size = 0
    for pdf in batches:
        for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"], strict=True):
            own = uses.setdefault((lang, source), Counter())
            found, before = terms(text), len(own)
            own.update(found)
            docs.setdefault((lang, source), Counter()).update(set(found))
            size += len(own) - before
            if size > HELD:
                yield flush()
                size = 0
    yield flush()


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 count / total), count at most total, in 64 bits."""
    out = np.zeros(np.broadcast(count, total).shape, np.int64)
    rest = count
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def shared(count: str, total: str) -> F.Column:
    """share() of two columns, as an expression."""
    rest, digits = count, []
    for _ in range(3):
        digits.append(f"(({rest}) * 1000 div {total})")
        rest = f"({rest}) * 1000 % {total}"
    return F.expr(f"({digits[0]} * 1000 + {digits[1]}) * 1000 + {digits[2]} + 1")


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _tiles(batches):
    """Sums of apart() over the chunks of a span, for the pairs of sources of two blocks.

    Rows: (lang, i, j, span, chunk, m, block, source, total, at, n), sorted by all but the last three.
    """
    key = None
    sums: np.ndarray | None = None
    listed: tuple[list, list] = ([], [])
    chunk = None
    held: tuple[list, list] = ([], [])  # shares of the chunk, by side

    def add():
        nonlocal sums, listed
        left, right = (np.array(held[s], np.int64) for s in ((0, 1) if key[1] != key[2] else (0, 0)))
        if sums is None:
            sums = np.zeros((len(left), len(right)), np.int64)
            listed = (list(names_of[0]), list(names_of[1] if key[1] != key[2] else names_of[0]))
        for a in range(len(left)):
            first = a + 1 if key[1] == key[2] else 0
            if first < len(right):
                sums[a, first:] += apart(left[a], right[first:]).sum(axis=1)

    def done() -> pd.DataFrame:
        a, b = np.nonzero(np.ones(sums.shape, bool) if key[1] != key[2] else np.triu(np.ones(sums.shape, bool), 1))
        rows = [(key[0], listed[0][x], listed[1][y], v) for x, y, v in zip(a.tolist(), b.tolist(), sums[a, b].tolist(), strict=True)]
        return pd.DataFrame(rows, columns=["lang", "source", "other", "value"], dtype=object)

    names_of: tuple[list, list] = ([], [])
    for pdf in batches:
        for lang, i, j, span, c, m, block, source, total, at, n in pdf.itertuples(index=False, name=None):
            if key is not None and (key, chunk) != ((lang, i, j, span), c):
                add()
                held, names_of = ([], []), ([], [])
                if key != (lang, i, j, span):
                    yield done()
                    sums = None
            key, chunk = (lang, i, j, span), c
            side = int(block != i)
            counts = np.full(m, PRIOR, np.int64)
            counts[at] += n
            held[side].append(share(counts, np.int64(total)) if m else counts)
            names_of[side].append(source)
    if key is not None:
        add()
        yield done()


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, chunk: int = CHUNK, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distance to the others of its language, and the terms it uses most beyond it."""
    spark = docs.sparkSession
    own = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    seen = own.mapInPandas(lambda it: trimmed(_count(it)), "lang string, source string, term string, n long, docs long")
    counted = materialize(seen.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")

    # the kept terms of each language, dealt into chunks and numbered there
    kept = counted.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = materialize(kept.select("lang", "term", "lang_n"), "kept")
    langs = counted.filter("term is null").select("lang").distinct()
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sizes = langs.join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    sizes = sizes.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("v") / chunk)).cast("int"))
    # a language's terms meet its sizes in SALTS tasks, not in one
    salted = sizes.select("lang", "chunks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    place = kept.withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(salted, ["lang", "salt"])
    place = place.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    place = place.withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    place = materialize(place.select("lang", "term", "lang_n", "chunk", "at"), "places")

    # each source's counts of kept terms, and their sum
    named = place.withColumnsRenamed({"lang": "lang_", "term": "term_"})
    used = counted.filter("n > 0").join(named, (F.col("lang") == F.col("lang_")) & (F.col("term") == F.col("term_")))
    used = materialize(used.select("lang", "source", "term", "n", "lang_n", "chunk", "at"), "used")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang")
    of_lang = counted.filter("term is null").groupBy("lang").agg(F.count("*").alias("of_lang"))
    groups = groups.join(of_lang, "lang").withColumn("blocks", F.ceil(F.col("of_lang") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    smooth = PRIOR * F.col("v")
    groups = groups.select("lang", "source", "chunks", "blocks", "block", (F.coalesce("total", F.lit(0)) + smooth).alias("total"), (F.col("lang_total") + smooth).alias("lang_total"))
    groups = materialize(groups, "groups")

    # packed vectors, one for each source and chunk, also where the source has none of the chunk's terms
    width = place.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("m"))
    vectors = used.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("x"))
    grid = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    grid = grid.join(width, ["lang", "chunk"], "left").join(vectors, ["lang", "source", "chunk"], "left")
    none = F.array().cast("array<struct<at:int,n:bigint>>")
    grid = grid.withColumn("x", F.coalesce("x", none)).withColumn("m", F.coalesce("m", F.lit(0)))
    # a vector meets every block of its language, its own included
    met = grid.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["lang", "i", "j", "span"]
    dealt = met.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.floor(F.col("chunk") / span).cast("int").alias("span"), "chunk", "m", "block", "source", "total", F.col("x.at").alias("at"), F.col("x.n").alias("n"))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "chunk", "block", "source")
    half = dealt.mapInPandas(lambda it: trimmed(_tiles(it)), "lang string, source string, other string, value long")
    half = half.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))
    pairs = half.select("lang", F.explode(both).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    # the terms that a source uses more than its language does
    rich = used.withColumn("n", F.col("n") + PRIOR).withColumn("lang_n", F.col("lang_n") + PRIOR).join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    rich = rich.select("lang", "source", "term", shared("n", "total").alias("p"), shared("lang_n", "lang_total").alias("q")).filter("p > q")
    value = F.expr("(p - q) * (p - q) div (p + q)")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = rich.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(by_value)).union(best)
