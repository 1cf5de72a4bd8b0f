"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. Its documents get an expected number of
copies each, in proportion to a weight (by default one more for each doubling of the
length), at most `most`, so that the expected words are the target. The whole copies are
certain. The fraction p that is left is the probability of one copy more, and documents
are ranked by Pareto order sampling: random odds u/(1-u) over inclusion odds p/(1-p). The
sample has a fixed size in words: ranks are taken as long as they fit what the certain
copies leave of the target. The room that the first document that does not fit leaves is
filled, `FILL` times, by the longest document not taken that fits.

All of it is built-in columns. No source is sorted: the place where a source's room runs
out is found digit by digit (`BITS` bits of the ranking key each time), from sums with
map-side combine; each pass reads only the few columns that ranking needs. Rows that
repeat a document are told apart by a number of their own, so that any share of a table
may be copies. What is broadcast is one row for each source, and only while its table is
small enough for Spark's own threshold; targets sort one row for each source.

Defined cases: a null source is a source of its own, last in order; null or empty
texts have size 0 and are never taken; sources of size 0 have target 0; an empty
table gives an empty one. Rows that repeat a doc_id are documents of their own; rows
equal in every used column are interchangeable. Only doc_id, text, source (and the
weight) are read; other columns, whatever their names, do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Bits of the ranking key that a pass looks at, bits of the key, documents that fill the room a source has left.
BITS, KEY_BITS, FILL = 13, 52, 3
_MOST_KEY, _TINY = (1 << 62), 1e-9


def source_targets(sizes: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size) -> the same with target.

    Weights go to the sources by code point, null last, over and over. All sizes are
    shared by weight; a share stops at `most` times its source's size, and the excess
    is shared among the others by weight until none is above. That is water filling:
    with sources ordered by size over weight, the first k are full, and the level of
    the others is what is left over their weights. One row a source is all it sorts.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("k", F.row_number().over(order) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    here_on = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(here_on))
    s = s.withColumn("full", F.col("level") * F.col("w") > F.col("cap"))
    s = s.withColumn("open_level", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("k"), F.col("level")))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("open_level") * F.col("w"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"))


def class_copies(classes: DataFrame, most: float) -> DataFrame:
    """(source, weight, words, source_size, target) -> the same with the expected copies of a document of that weight.

    Copies are in proportion to the weight, at most `most`, and a source's words times
    copies are its target: water filling over the source's weights, the largest first.
    """
    by_weight = Window.partitionBy("source").orderBy(F.desc("weight"))
    before = by_weight.rowsBetween(Window.unboundedPreceding, -1)
    here_on = by_weight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("words").over(before), F.lit(0))
    shared = F.sum(F.col("words") * F.col("weight")).over(here_on)
    c = classes.withColumn("level", F.when(shared > 0, left / shared).otherwise(F.lit(0.0)))
    is_open = F.col("level") * F.col("weight") <= F.lit(float(most))
    first = F.max(F.when(is_open, F.struct("weight", "level"))).over(Window.partitionBy("source"))["level"]
    expected = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.coalesce(first * F.col("weight"), F.lit(float(most)))))
    return c.withColumn("expected", expected).drop("level")


def _same(left: str, right: str) -> F.Column:
    return F.col(left).eqNullSafe(F.col(right))


def _ranked(docs: DataFrame, weights, most: float, seed: int) -> DataFrame:
    """(uid, doc_id, source, size, weight) -> the same, written, with source_size, target, certain, key (null: no copy more)."""
    classes = docs.groupBy("source", "weight").agg(F.sum("size").alias("words"))
    classes = materialize(classes, "classes")  # a few rows for each source
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "source_")
    plan = class_copies(classes.join(targets, _same("source", "source_")).drop("source_"), most)
    plan = materialize(plan.select(F.col("source").alias("source_"), F.col("weight").alias("weight_"), "source_size", "target", "expected"), "plan")
    d = docs.join(plan, _same("source", "source_") & _same("weight", "weight_")).drop("source_", "weight_")
    certain = F.floor(F.col("expected") + F.lit(_TINY))
    p = F.col("expected") - certain
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.col("size").cast("string"), F.coalesce("source", F.lit("~")))
    u = (F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << KEY_BITS))
    odds = (u / (1 - u)) / (p / (1 - p))
    key = F.least(F.floor(odds / (1 + odds) * F.lit(float(1 << KEY_BITS))), F.lit((1 << KEY_BITS) - 1))
    key = F.when((F.col("size") > 0) & (p > F.lit(_TINY)), key)
    return materialize(d.select("uid", "doc_id", "source", "size", "source_size", "target", certain.alias("certain"), key.alias("key")), "ranked")


def _cuts(d: DataFrame) -> DataFrame:
    """source_, room, key_cut, uid_cut: documents before the cut get one copy more; room words are left beside them."""
    rest = d.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("certain") * F.col("size")).alias("sure"))
    state = rest.select(F.col("source").alias("source_"), (F.col("target") - F.col("sure")).alias("room"), F.lit(0).cast("long").alias("key_cut"), F.lit(0).cast("long").alias("uid_cut"), F.lit(True).alias("open"))
    state = materialize(state, "cuts")
    rows = d.filter("key is not null").select("source", "size", "key", "uid")
    steps = [("key", at) for at in range(KEY_BITS - BITS, -1, -BITS)] + [("uid", at) for at in range(52, -1, -BITS)]
    for k, (name, at) in enumerate(steps):
        # documents that agree with the cut in all digits looked at so far
        inside = F.lit(True) if k == 0 else F.shiftright("key", steps[k - 1][1]) == F.shiftright("key_cut", steps[k - 1][1]) if name == "key" else F.col("key") == F.col("key_cut")
        if name == "uid" and steps[k - 1][0] == "uid":
            inside &= F.shiftright("uid", steps[k - 1][1]) == F.shiftright("uid_cut", steps[k - 1][1])
        near = rows.join(state.filter("open"), _same("source", "source_")).filter(inside)
        cells = near.groupBy("source", F.shiftright(name, at).alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("room").alias("room"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cells = cells.withColumn("upto", upto)
        over = F.col("upto") > F.col("room") + F.lit(1e-6)
        found = cells.groupBy("source").agg(F.min(F.when(over, F.struct("digit", (F.col("upto") - F.col("words")).alias("before"), "n"))).alias("x"), F.max("upto").alias("all"))
        found = found.select(F.col("source").alias("s_"), "x.digit", "x.before", "x.n", "all")
        crossed, asked = F.col("digit").isNotNull(), F.col("open")
        cut = F.when(asked & crossed, F.shiftleft(F.col("digit"), at)).when(asked & (F.lit(k == 0)), F.lit(_MOST_KEY)).otherwise(F.col(f"{name}_cut"))
        left = F.when(asked, F.col("room") - F.coalesce(F.when(crossed, F.col("before")).otherwise(F.col("all")), F.lit(0))).otherwise(F.col("room"))
        other = "uid_cut" if name == "key" else "key_cut"
        state = state.join(found, _same("source_", "s_"), "left").select("source_", left.alias("room"), cut.alias(f"{name}_cut"), other, (asked & crossed & (F.col("n") > 1)).alias("open"))
        state = materialize(state.select("source_", "room", "key_cut", "uid_cut", "open"), "cuts")
        if state.filter("open").isEmpty():
            break
    return state.drop("open")


def _taken(d: DataFrame) -> DataFrame:
    """d with one_more, 0 or 1."""
    cuts = _cuts(d)
    before = F.col("key").isNotNull() & ((F.col("key") < F.col("key_cut")) | (F.col("key") == F.col("key_cut")) & (F.col("uid") < F.col("uid_cut")))
    left = d.filter("key is not null").select("source", "size", "key", "uid").join(cuts, _same("source", "source_")).filter(~before).select("source", "size", "key", "uid")
    rooms = cuts.select("source_", "room")
    picked = None
    for _ in range(FILL):
        fits = left.join(rooms, _same("source", "source_")).filter(F.col("size") <= F.col("room") + F.lit(1e-6))
        if picked is not None:
            fits = fits.join(picked, F.col("uid") == F.col("uid_"), "left_anti")
        best = fits.groupBy("source").agg(F.max(F.struct("size", (-F.col("key")).alias("k"), "uid")).alias("x"))
        best = materialize(best.select(F.col("source").alias("s_"), F.col("x.size").alias("size"), F.col("x.uid").alias("uid_")), "fill")
        rooms = rooms.join(best, _same("source_", "s_"), "left").select("source_", (F.col("room") - F.coalesce("size", F.lit(0))).alias("room"))
        picked = best.select("uid_") if picked is None else picked.union(best.select("uid_"))
    marked = d.join(cuts, _same("source", "source_")).join(picked, F.col("uid") == F.col("uid_"), "left")
    return marked.withColumn("one_more", (before | F.col("uid_").isNotNull()).cast("long")).drop("source_", "room", "key_cut", "uid_cut", "uid_")


def length_weight(size) -> F.Column:
    """One more for each doubling of the number of words."""
    return F.length(F.bin(size)).cast("double")


def _weight(column) -> F.Column:
    """A given weight in steps of an eighth of a doubling, so that a source has few different ones; null is 1, none below 0."""
    w = F.greatest(F.coalesce(column.cast("double"), F.lit(1.0)), F.lit(0.0))
    return F.when(w > 0, F.pow(F.lit(2.0), F.round(F.log2(w) * 8) / 8)).otherwise(F.lit(0.0))


def _copies(rows: DataFrame, weights, most: float, seed: int) -> DataFrame:
    """(uid, doc_id, source, size, weight) -> uid, doc_id, source, size, source_size, target, copies."""
    d = _taken(_ranked(rows, weights, most, seed))
    copies = F.when(F.col("size") > 0, F.least(F.col("certain") + F.col("one_more"), F.lit(int(most)))).otherwise(F.lit(0)).cast("long")
    return d.select("uid", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def pareto_mix(docs: DataFrame, weights=(1, 2, 3), most: float = 3.0, seed: int = 17, weight_col: str | None = None) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, copies.

    `most` bounds both a source's target and the copies of a document. With weight_col a
    document's copies are in proportion to that column in place of the length's weight;
    documents of weight 0 are not taken.
    """
    size = word_count(F.col("text"))
    weight = _weight(F.col(weight_col)) if weight_col else length_weight(size)
    # words are counted once; all later passes read these few columns
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", size.alias("size"), weight.alias("weight")), "sizes")
    d = _copies(rows, weights, most, seed)
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, weights=(1, 2, 3), most: float = 3.0, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    uid = "uid"
    while uid in docs.columns:
        uid += "_"
    rows = materialize(docs.select(F.monotonically_increasing_id().alias(uid), *docs.columns), "numbered")
    size = word_count(F.col("text"))
    few = rows.select(F.col(uid).alias("uid"), "doc_id", "source", size.alias("size"), length_weight(size).alias("weight"))
    taken = _copies(materialize(few, "sizes"), weights, most, seed).filter("copies > 0")
    taken = taken.select(F.col("uid").alias(f"{uid}_of_copies"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(f"{uid}_copy"))
    return rows.join(taken, F.col(uid) == F.col(f"{uid}_of_copies")).select(*docs.columns)
