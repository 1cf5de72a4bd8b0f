import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, rank long, key string, a long, b long, s string, ranges string, place long, size long, target double, h long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'abcdefgh'[rng.randrange(8)]}" for _ in range(n))


def rows_of(texts):
    """Rows of the documents table with further columns whose names clash with the operators' own."""
    return [(i, t, lang, src, None if t is None else len(t), 7, None, "k", 1, 2, "s", "r", 3, 5, 0.5, 9) for i, t, lang, src in texts]


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls, empty texts, copies, near copies, shared passages, a very long text, repeated rows."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(40, 160)) for _ in range(12)]
    passage = words(rng, 70)
    out = []
    for i, t in enumerate(base):
        out.append((i, t, "en" if i % 2 else "de", f"src{i % 3}"))
    near = base[0].split()
    near[-1] = "changed"
    out += [(20, base[0], "en", "src0"), (21, " ".join(near), "en", None), (22, base[3].upper(), None, "src1")]
    out += [(30, f"{words(rng, 30)}\n{passage}\n{words(rng, 20)}", "en", "src1"), (31, f"{words(rng, 10)}\n{passage}\n{words(rng, 25)}", "en", "src2")]
    out += [(40, None, "en", "src0"), (41, "", "en", "src0"), (42, "  \n \t ", None, None), (43, "one", "en", "src2"), (44, "ONE", "en", "src2"), (45, "two words", "de", "src2"), (46, "two  WORDS", "de", "src2")]
    out += [(50, words(rng, 30_000, 5000), "en", "src1"), (51, "same line here again\n" * 300, "en", "src2"), (None, base[5], "en", "src0"), (None, None, None, None)]
    out += [(60, base[7], "en", "src1"), (60, base[7], "en", "src1")]
    return rows_of(out)


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
