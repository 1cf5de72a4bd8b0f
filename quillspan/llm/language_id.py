"""Language ID: language-bitmask n-gram filters.

Training counts letter n-grams (words padded by one blank) of labelled texts and keeps
the `TOP` most frequent of each language, unless another language has them more than
1/BORROWED times as often. They go into one bit-sliced Bloom filter:
every slot holds a bit for each language, and the AND of an n-gram's slots gives all
languages that contain it at once. A text is scored by one popcount per language over
its n-grams; a language whose bits fill the share f of the slots answers falsely at
the rate f**K, which is taken off, and the counts are divided by the language's own
hit rate in training. The largest decides.

Training may use a bounded sample: about `DOCS_PER_LANG` documents of each language,
picked by a hash of doc_id; every language is learned. Prediction reads every text as a
whole: long ones in blocks that overlap by the longest n-gram less one sign, so that each
n-gram is counted once.

Defined cases: null texts and texts without a letter get `und` and score 0. Texts in
no learned language get the learned language with the largest count, or the first by
name when no n-gram is known. Without any training text that holds a letter all
predictions are `und`.
Ties go to the language first by name. Null doc_ids are never held out and never
trained on. Rows that repeat are predicted alike. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_blocks

#: Bounds of the training sample and the model.
DOCS_PER_LANG, TOP, SIZES, K = 2000, 4000, (2, 3, 4), 3
#: Share of an n-gram's highest rate in any language that makes it a language's own.
BORROWED = 0.3
_BLOCK = 500_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(lowered: str) -> np.ndarray:
    """Letters of a text in lower case as code points, anything else as blanks."""
    code = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[code], code, 0)


def _blocks_of(texts: list[str]):
    """(first place, codes, last start) of blocks of all texts, a blank on both sides of each; an n-gram starts in one block only."""
    lowered = " " + " ".join(t.lower() for t in texts) + " "
    for at in range(0, len(lowered), _BLOCK):
        yield at, _codes(lowered[at : at + _BLOCK + max(SIZES) - 1]), _BLOCK


def ngram_hashes(code: np.ndarray, sizes=SIZES):
    """For each size: (start positions of n-grams that hold no inner blank, their hashes)."""
    wide = code.astype(np.uint64) + np.uint64(1)
    blank = code == 0
    for n in sizes:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ wide[k : k + m]) * _MUL
            h ^= h >> np.uint64(29)
        good = ~(blank[:m] & blank[n - 1 :]) if n == 2 else np.ones(m, bool)
        for k in range(1, n - 1):
            good &= ~blank[k : k + m]
        at = np.flatnonzero(good)
        yield at, h[at]


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Filters:
    """The bit-sliced Bloom filter: slots x languages, packed in 64-bit words."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], rates: list[float], slots_per_gram: int = 8):
        self.langs = langs
        total = max([1, *map(len, grams)])
        self.bits = max(10, int(np.ceil(np.log2(slots_per_gram * total))))
        self.slots = np.zeros((1 << self.bits, (len(langs) + 63) // 64 or 1), np.uint64)
        for i, g in enumerate(grams):
            for at in self._places(g):
                self.slots[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        fill = np.array([((self.slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
        self.false_rate = fill**K
        self.hit_rate = np.maximum(np.array(rates), 1e-3)

    def _places(self, h: np.ndarray):
        for k in range(K):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            yield (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of all languages that contain it."""
        out = None
        for at in self._places(h):
            out = self.slots[at] if out is None else out & self.slots[at]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and how many of them each language contains as measured."""
        n = np.zeros(len(texts), np.int64)
        hits = np.zeros((len(texts), len(self.langs)), np.int64)
        ends = np.cumsum([len(t.lower()) + 1 for t in texts])
        for first, code, stop in _blocks_of(texts):
            for at, h in ngram_hashes(code):
                at, h = at[at < stop], h[at < stop]
                owner = np.minimum(np.searchsorted(ends, at + first, side="right"), len(texts) - 1)
                n += np.bincount(owner, minlength=len(texts))
                mask = self.masks(h)
                for i in range(len(self.langs)):
                    got = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                    hits[:, i] += np.bincount(owner, weights=got, minlength=len(texts)).astype(np.int64)
        return n, hits

    def predict(self, n: np.ndarray, hits: np.ndarray) -> tuple[list[str], list[float]]:
        true = np.maximum(0, (hits - n[:, None] * self.false_rate) / (1 - self.false_rate)) / self.hit_rate
        best = true.argmax(1)
        total = true.sum(1)
        score = np.where(total > 0, true[np.arange(len(best)), best] / np.where(total > 0, total, 1), 0.0)
        return [self.langs[i] for i in best], score.tolist()


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, top: int = TOP) -> Filters | None:
    """Fit the filters on (doc_id, text, lang) rows; bounded by docs_per_lang and top for each language."""
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    share = F.lit(float(docs_per_lang)) / F.col("n_docs")
    # written, so that Spark knows how small it is and no text is dealt out by language
    per_lang = materialize(rows.groupBy(F.col("lang").alias("lang_")).agg(F.count("*").alias("n_docs")), "languages")
    unit = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.join(per_lang, F.col("lang") == F.col("lang_")).filter(unit < share).select("lang", "text")

    def count(batches):
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                texts = list(texts)
                for a, b in text_blocks(texts, _BLOCK):
                    for _, code, stop in _blocks_of(texts[a:b]):
                        found = [h[at < stop] for at, h in ngram_hashes(code)]
                        if found:
                            grams, n = np.unique(np.concatenate(found), return_counts=True)
                            yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n})

    counted = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    # an n-gram that a language only borrows (mixed texts) does not count as its own
    counted = counted.withColumn("rate", F.col("n") / F.col("all"))
    counted = counted.withColumn("own", F.col("rate") >= BORROWED * F.max("rate").over(Window.partitionBy("gram")))
    ranked = counted.filter("own").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= top)
    pdf = ranked.select("lang", "gram", "n", "all").toPandas()  # at most top rows for each language
    if not len(pdf):
        return None
    langs = sorted(pdf["lang"].unique())
    parts = [pdf[pdf["lang"] == x] for x in langs]
    return Filters(langs, [p["gram"].to_numpy(np.int64).view(np.uint64) for p in parts], [p["n"].sum() / p["all"].iloc[0] for p in parts])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def predict_column(spark, model: Filters | None, text) -> F.Column:
    """struct<lang_pred, score> of a text column."""
    shared = spark.sparkContext.broadcast(model)  # fixed size: slots for `top` n-grams

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        own = shared.value
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if own is None:
            return pd.DataFrame({"lang_pred": langs, "score": scores})
        known = [i for i, t in enumerate(texts) if t and _has_letter(t)]
        values = [texts.iloc[i] for i in known]
        for a, b in text_blocks(values, _BLOCK):
            for i, lang, score in zip(known[a:b], *own.predict(*own.counts(values[a:b])), strict=True):
                langs[i], scores[i] = lang, score
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return guess(text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from those not held out."""
    d = docs.select("doc_id", "text", "lang")
    model = train(d.filter(~held_out(F.col("doc_id"))))
    out = predict_column(docs.sparkSession, model, F.col("text"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), out.alias("p")).select("doc_id", "held_out", "p.*")
