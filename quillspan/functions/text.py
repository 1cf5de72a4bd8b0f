"""Scalar text functions as columns: normalisation, canonical form, segments, q-grams, hashes.

Unicode NFKC, BLAKE2b and free-form JSON are Arrow-batched functions, since Spark has no
equivalent; so are white space, canonical forms and segments, which took patterns over wide
classes some twenty times as long. All else is built from Spark's own expressions.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed value: the characters that the canonical form keeps (digits, ASCII letters, CJK, Kana, Hangul).
#: Signs below U+0300, where no combining marks are, that NFKC does not change.
_PLAIN = r"\x{0}-\x{9f}\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{180}-\x{1c3}\x{1cd}-\x{1f0}\x{1f4}-\x{2af}"
#: Letters as lower case, and the bytes below 256 that are not kept then.
_LOWER = bytes(range(256)).lower()
_DROPPED = bytes(b for b in range(256) if not (b < 128 and chr(b).isalnum()))
_NOT_KEPT = re.compile("[^0-9A-Za-z\u3400-\u9fff\u3040-\u30ff\uac00-\ud7af]+")
_BLANK_LINE = re.compile(r"\n\s*\n")
_KEPT_IN_METADATA = r"0-9a-z\x{3400}-\x{9fff}"


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _each(c, function) -> Column:
    """function over a string column in Arrow batches; null stays null."""

    @F.arrow_udf("string")
    def apply(values: pa.Array) -> pa.Array:
        return mapped(values, lambda v: None if v is None else function(v), pa.string())

    return apply(_column(c))


def mapped(values: pa.Array, function, kind: pa.DataType) -> pa.Array:
    """function of each value; the texts of a piece of some million signs are Python objects at once, not those of a batch."""
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    parts = [pa.array([function(v) for v in values.slice(low, high - low).to_pylist()], kind) for low, high in pieces(sizes)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def is_plain(c) -> Column:
    """Whether a text holds only signs that NFKC leaves as they are, wherever they stand; a text of one byte a sign is told by its length."""
    c = _column(c)
    return (F.octet_length(c) == F.char_length(c)) | ~c.rlike(f"[^{_PLAIN}]")


def nfkc(c) -> Column:
    """Unicode NFKC. Plain texts stay in the JVM; only the others are sent to Python."""
    c = _column(c)
    other = F.when(~is_plain(c), c)
    return F.coalesce(_each(other, lambda t: unicodedata.normalize("NFKC", t)), c)


def collapse_plain(text: str) -> str:
    """Runs of white space as one blank, none at the ends; str.split has white space as Unicode has it.

    A printable text has no white space but blanks, so most texts are told to be collapsed already without a look at their words.
    """
    if text.isprintable() and "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text
    return " ".join(text.split())


def normalize_plain(text: str) -> str:
    return collapse_plain(text if text.isascii() else unicodedata.normalize("NFKC", text))


def canonical_of_normalized_plain(text: str) -> str:
    """Lower case without what is not kept; texts of one byte a sign go by a table, the others by a pattern."""
    if text.isascii():
        return text.encode().translate(_LOWER, _DROPPED).decode("ascii")
    text = text.lower()
    try:
        return text.encode("latin-1").translate(None, _DROPPED).decode("ascii")
    except UnicodeEncodeError:
        return _NOT_KEPT.sub("", text)


def segments_plain(text: str) -> list[str]:
    """Normalised paragraphs of one text, see segments_of."""
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    for parts in (_BLANK_LINE.split(text), text.splitlines()):
        if len(parts) > 1:  # else there is nothing to tell apart, and the lines are tried before words are read
            found = [x for p in parts if (x := collapse_plain(p))]
            if len(found) > 1:
                return found
    return [collapse_plain(text)]


def first_segment_plain(text: str) -> str:
    """The first of segments_plain; the words of the others are not read."""
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    for parts in (_BLANK_LINE.split(text), text.splitlines()):
        some = (p for p in parts if p.strip())
        first = next(some, None)
        if next(some, None) is not None:
            return collapse_plain(first)
    return collapse_plain(text)


def hash_plain(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: What exploded_segments makes of a segment's text.
_OF_SEGMENT = {"text": str, "canonical": canonical_of_normalized_plain, "segment_hash": hash_plain}


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return _each(c, collapse_plain)


def fenced(df: DataFrame) -> DataFrame:
    """The same rows and columns, made by a generator: what follows reads columns, and no expression is computed again in each of its uses."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("x_")).select("x_.*")


def sha256_text(c) -> Column:
    return F.sha2(_column(c), 256)


def normalize_text(c) -> Column:
    """NFKC, runs of white space as one blank, no blanks at the ends."""
    return _each(c, normalize_plain)


def canonical_of_normalized(c) -> Column:
    """Lower case without what is not kept."""
    return _each(c, canonical_of_normalized_plain)


def canonical_text(c) -> Column:
    """Search form: normalised, lower case, without anything but the kept characters."""
    return canonical_of_normalized(normalize_text(c))


def metadata_form(c) -> Column:
    """Comparison form of a metadata value: null and '' alike, only 0-9, a-z and CJK kept."""
    return F.regexp_replace(F.lower(F.trim(nfkc(F.coalesce(_column(c), F.lit(""))))), f"[^{_KEPT_IN_METADATA}]+", "")


def segments_of(c) -> Column:
    """Normalised paragraphs: split at blank lines, or at line ends if that gives at most one; never empty."""

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return mapped(texts, lambda t: None if t is None else segments_plain(t), pa.list_(pa.string()))

    return split(_column(c))


def exploded_segments(docs: DataFrame, key: str, text: str, columns: tuple = ("text", "canonical"), first: bool = False) -> DataFrame:
    """key, ordinal and text, canonical or segment_hash (SHA-256) of the segments of each text (null: empty), made in one pass.

    Name only the columns that are used: Spark cannot leave out what a Python function makes. first: the first segments alone.
    A batch is worked on in pieces of some million signs, so a worker's memory is that of a piece.
    """
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("t_"))
    schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, ordinal int, " + ", ".join(f"{c} string" for c in columns)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    made = [_OF_SEGMENT[c] for c in columns]
    parted = (lambda t: [first_segment_plain(t)]) if first else segments_plain

    def split(batches):
        for batch in batches:
            for low, high in pieces(pc.binary_length(batch.column(1)).to_pylist()):
                parts = [parted(t) for t in batch.column(1).slice(low, high - low).to_pylist()]
                owner = [low + i for i, p in enumerate(parts) for _ in p]
                texts = [x for p in parts for x in p]
                out = [batch.column(0).take(pa.array(owner, pa.int64())), [i for p in parts for i in range(len(p))], *([f(x) for x in texts] for f in made)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(split, schema)


def pieces(sizes: list[int], most: int = 1 << 21):
    """(first, last) ranges of consecutive rows whose sizes sum up to about `most`, at least one row each."""
    low = size = 0
    for i, n in enumerate(sizes):
        if i > low and size + n > most:
            yield low, i
            low, size = i, 0
        size += n
    if low < len(sizes):
        yield low, len(sizes)


def substrings(c, k: int) -> Column:
    """All substrings of length k in order; the whole string if it is shorter; [] if empty. One regular-expression pass."""
    c = _column(c)
    whole = F.when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))
    return F.when(F.char_length(c) <= k, whole).otherwise(F.regexp_extract_all(c, F.lit(f"(?=(.{{{k}}}))"), F.lit(1)))


def qgrams(canonical, q: int = 3) -> Column:
    """Distinct q-grams of a canonical text."""
    return F.array_distinct(substrings(canonical, q))


def blake2b64(c) -> Column:
    """BLAKE2b with 8 bytes, as hex: the exported id of a gram."""
    return _each(c, lambda t: hashlib.blake2b(t.encode("utf-8"), digest_size=8).hexdigest())


def stable_json(c) -> Column:
    """Canonical form of a JSON text: keys sorted at every level, no blanks, non-ASCII kept."""
    return _each(c, lambda t: json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def fixed_json(*cols: str) -> Column:
    """Canonical JSON of string columns without control characters; keys in order, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def merkle_root(leaves) -> Column:
    """Root over an array of hex hashes: pairs hashed level by level, an odd last one paired with itself."""
    leaves = _column(leaves)
    levels = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.size(leaves), F.lit(1)))).cast("int"))

    def level(a: Column, _: Column) -> Column:
        pair = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / 2).cast("int") - 1), lambda i: F.sha2(F.concat(F.get(a, 2 * i), F.coalesce(F.get(a, 2 * i + 1), F.get(a, 2 * i))), 256))
        return F.when(F.size(a) > 1, pair).otherwise(a)

    root = F.get(F.aggregate(F.sequence(F.lit(1), levels), leaves, level), F.lit(0))
    return F.when(F.size(leaves) == 0, F.sha2(F.lit(""), 256)).otherwise(root)


def jaccard(a, b) -> Column:
    """Ratio of two arrays as sets, 0 if both are empty."""
    a, b = _column(a), _column(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def canonical_plain(value: str) -> str:
    """The canonical form of a driver-side value, for dictionaries and single queries."""
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value)).strip().lower()
    return re.sub("[^0-9A-Za-z㐀-鿿぀-ヿ가-힯]+", "", text)
