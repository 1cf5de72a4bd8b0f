"""Operators on documents against brute force, on a table with every awkward row."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("quillspan.llm")

from quillspan.llm import compression_rules, language_id, line_dedup, mixing, ngram_join, packing, suffix_dedup
from quillspan.llm.queries import default_tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_rules(messy, messy_rows, empty):
    got = {(r["doc_id"], r["n_bytes"]): r for r in compression_rules.quality_table(messy).collect()}
    assert compression_rules.quality_table(messy).count() == len(messy_rows)
    for doc_id, text, *_ in messy_rows:
        text = text or ""
        r = got[doc_id, len(text.encode())]
        ws = WORD.findall(text)
        windows = Counter(zip(ws, ws[1:], ws[2:]))
        repeated = {i + k for i, w in enumerate(zip(ws, ws[1:], ws[2:])) if windows[w] > 1 for k in range(3)}
        lines, dup = set(), 0
        for line in text.split("\n"):
            dup += bool(WORD.search(line)) and line in lines
            lines.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated))
        assert r["base_failed"] == (len(ws) < 50 or 100 * len(repeated) > 50 * len(ws))
        assert not (r["base_failed"] and r["kept"])
    kept = compression_rules.keep_compressible(messy)
    assert kept.columns == messy.columns
    assert compression_rules.quality_table(empty).count() == 0


def test_bands_reject_noise_and_repetition():
    import random

    import zstandard

    rng = random.Random(1)
    z = zstandard.ZstdCompressor(level=3)
    bands = compression_rules.Bands()
    noise = " ".join("".join(chr(rng.randrange(33, 1000)) for _ in range(8)) for _ in range(800))
    assert not compression_rules.judge(noise, bands, z)[6]
    half = " ".join(f"word{rng.randrange(900)}" for _ in range(400))
    assert not compression_rules.judge(f"{half} tail {half[: len(half) // 2]} {half[: len(half) // 3]}" * 3, bands, z)[6]
    prose = "The committee met on Tuesday to talk about the bridge that the storm had damaged. Most members wanted a quick repair before winter, while others asked for a new plan. An engineer from the county showed three drawings and named the cost of each. After an hour of questions the chair closed the session and promised a vote within ten days, provided the bank agreed to the loan."
    assert compression_rules.judge(prose, bands, z)[6]


def test_bands_look_at_the_last_partial_chunk():
    import base64
    import random

    import zstandard

    rng = random.Random(6)
    z, bands = zstandard.ZstdCompressor(level=3), compression_rules.Bands()
    syllables = "an be co di el fo ga hi in ju ka lo mi ne or pa qui re su ti un ve wa yo".split()
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    prose = " ".join(vocabulary[int(3000 * rng.random() ** 2)] for _ in range(3000))
    noise = " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(700))
    assert compression_rules.judge(prose[:8176], bands, z)[6] and compression_rules.judge(prose[:4196], bands, z)[6]
    for tail in (4080, 1800):
        text = prose[:4096] + noise[:tail]
        low, high = bands.limits(len(text))
        got = compression_rules.judge(text, bands, z)
        assert low <= got[8] <= high and got[9:] == (2, 1) and not got[6]
    assert bands.chunks(0) == [] and bands.chunks(4100) == [(0, 4100)] and bands.chunks(8192 + 64) == [(0, 4096), (4096, 8192), (8192, 8256)]


def test_verdicts_of_bands_against_plain_compression(spark):
    """kept, told again from the limits: the whole text, then its chunks one by one."""
    import random

    import zstandard

    rng = random.Random(21)
    z, bands = zstandard.ZstdCompressor(level=3), compression_rules.Bands()
    words = ["".join(rng.choice("aeioubcdfglmnprstv") for _ in range(rng.randrange(2, 9))) for _ in range(2500)]
    prose = lambda n: " ".join(words[int(2500 * rng.random() ** 2)] for _ in range(n))
    noise = lambda n: " ".join("".join(chr(rng.randrange(33, 126)) for _ in range(10)) for _ in range(n))
    texts = [f(n) for n in (60, 300, 700, 2000) for f in (prose, noise)] + [prose(400) + " " + noise(k) for k in (20, 80, 200, 700)] + [" ".join([prose(30)] * k) for k in (2, 4, 40)] + [prose(700) + " " + "same words again " * 300, "", None]
    got = {r["doc_id"]: r for r in compression_rules.quality_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def limit(table, n):
        size = min(max(n.bit_length() - 1, table[0][0]), table[-1][0])
        return next(v for k, v in table if k == size)

    for k, text in enumerate(texts):
        raw = (text or "").encode()
        cuts = list(range(0, len(raw), 4096)) + [len(raw)]
        if len(cuts) > 2 and cuts[-1] - cuts[-2] < 64:
            del cuts[-2]
        bad = 0
        for a, b in zip(cuts, cuts[1:]):
            low, high = (1.4, 2.6) if b - a >= 4096 else (limit(bands.lowest, b - a), limit(bands.highest, b - a))
            bad += 0 if low <= (b - a) / len(z.compress(raw[a:b])) <= high else b - a
        good = bool(raw) and limit(bands.lowest, len(raw)) <= len(raw) / len(z.compress(raw)) <= limit(bands.highest, len(raw)) and bad <= 0.25 * len(raw)
        assert got[k]["kept"] == (good and not got[k]["base_failed"])
    assert {r["kept"] for r in got.values()} == {True, False}


def test_mixing(messy, empty):
    out = mixing.pareto_mix(messy).toPandas()
    assert len(out) == messy.count()
    assert (out.taken <= 3 * out["size"]).all() and (out.taken[out["size"] == 0] == 0).all()
    again = mixing.pareto_mix(messy).toPandas()
    order = ["doc_id", "source", "size", "taken"]
    assert out.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))
    total = out["size"].sum()
    per = out.assign(source=out.source.fillna("~")).groupby("source").agg(t=("target", "first"), s=("source_size", "first"), k=("taken", "sum"), most=("size", "max"))
    assert (per.t <= 3 * per.s + 1e-6).all() and abs(per.t.sum() - total) < 1e-6 * total
    assert ((per.k - per.t).abs() <= per.most).all() and (per.k <= per.t + 1e-6).all()
    # brute-force water filling
    sizes = dict(per.s)
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes))}
    full, left = {}, dict(weights)
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            full[s] = left.pop(s)
    for s in sizes:
        assert per.t[s] == pytest.approx(3 * sizes[s] if s in full else share[s])
    copies = mixing.mix_documents(messy)
    assert copies.columns == messy.columns
    assert mixing.pareto_mix(empty).count() == 0


def mix_brute(rows, targets, most=3.0, seed=17, fill=3):
    """Taken words of (doc_id, source, size) rows, straight from the definition: one sorted list for each source."""
    out = []
    for source in {s for _, s, _ in rows}:
        own = [(d, n) for d, s, n in rows if s == source]
        target, weight = targets[source], {n: len(f"{n:b}") for _, n in own}
        words = Counter()
        for _, n in own:
            words[weight[n]] += n
        full, level = 0, None
        for w in sorted(words, reverse=True):
            shared = sum(words[v] * v for v in words if v <= w)
            level = (target - most * full) / shared if shared else 0.0
            if level * w <= most:
                break
            full, level = full + words[w], None
        ranked, sure = [], 0
        for d, n in own:
            expected = max(0.0, min(most, level * weight[n] if level is not None else most))
            certain = int(expected + 1e-9)
            p = expected - certain
            sure += certain * n
            if n and p > 1e-9:
                u = (int(hashlib.md5(f"{seed}|{'~' if d is None else d}|{n}|{'~' if source is None else source}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                odds = (u / (1 - u)) / (p / (1 - p))
                ranked.append((min(int(odds / (1 + odds) * 2**52), 2**52 - 1), d, n, certain))
            else:
                out.append((d, source, certain * n))
        ranked.sort(key=lambda r: (r[0], r[2]))
        room, takes, k = target - sure, Counter(), 0
        while k < len(ranked) and ranked[k][2] <= room + 1e-6:
            room -= ranked[k][2]
            takes[k] = 1
            k += 1
        for _ in range(fill):
            fits = [i for i in range(len(ranked)) if not takes[i] and ranked[i][2] <= room + 1e-6]
            if fits:
                i = max(fits, key=lambda i: (ranked[i][2], -ranked[i][0]))
                takes[i] = 1
                room -= ranked[i][2]
        out += [(d, source, (certain + takes[i]) * n) for i, (_, d, n, certain) in enumerate(ranked)]
    return Counter(out)


def test_mixing_against_one_sorted_list(spark, messy, messy_rows):
    for df, rows in ((messy, messy_rows), (None, None)):
        if df is None:
            import random

            rng = random.Random(9)
            rows = [(k, "w " * (7 if k % 3 == 0 else rng.randrange(0, 300)), None, rng.choice(["a", "b", "b", "b", None])) for k in range(400)]
            rows += [(7, "same row " * 20, None, "b")] * 200 + [(8, "short", None, "tiny")]
            df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        out = mixing.pareto_mix(df).collect()
        got = Counter((r["doc_id"], r["source"], r["taken"]) for r in out)
        assert got == mix_brute([(d, s, len(WORD.findall(t or ""))) for d, t, _, s, *_ in rows], {r["source"]: r["target"] for r in out})
        copies = Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"]))) for r in mixing.mix_documents(df).collect())
        want = Counter()
        for r in out:
            want[r["doc_id"], r["source"], r["size"]] += r["copies"]
        assert copies == +want


def test_mixing_of_one_source_and_of_equal_rows(spark):
    docs = spark.createDataFrame([(k, "word " * (1 + k % 7), "one") for k in range(2000)], "doc_id long, text string, source string")
    out = mixing.pareto_mix(docs).toPandas()
    assert len(out) == 2000 and abs(out.taken.sum() - out["size"].sum()) <= 1 and out[out["size"] == 7].taken.mean() / 7 > out[out["size"] == 1].taken.mean()
    same = spark.createDataFrame([(1, "a b c", "x")] * 500 + [(2, "d", "y")] * 300, "doc_id long, text string, source string")
    out = mixing.pareto_mix(same).toPandas()
    for _, g in out.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() and g.copies.max() - g.copies.min() <= 1
    weighed = spark.createDataFrame([(k, "a b", "x", float(k % 3)) for k in range(300)], "doc_id long, text string, source string, w double")
    out = mixing.pareto_mix(weighed, weight_col="w").toPandas()
    assert (out[out.doc_id % 3 == 0].taken == 0).all() and out[out.doc_id % 3 == 2].taken.sum() > 1.7 * out[out.doc_id % 3 == 1].taken.sum()


def test_packing(messy, messy_rows, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(default_tokenizer())
    out = packing.pack(messy, default_tokenizer()).toPandas()
    per_sequence = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, g in per_sequence:
        assert g.length.sum() <= 2048 and (g.offset == g.length.cumsum() - g.length).all()
    assert sorted(out.sequence_id.unique()) == list(range(out.sequence_id.nunique()))
    want = Counter()
    for doc_id, text, *_ in messy_rows:
        import numpy as np

        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 2048):
            piece = ids[at : at + 2048]
            want[(-1 if doc_id is None else doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    got = Counter((-1 if r.doc_id != r.doc_id or r.doc_id is None else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out.itertuples())
    assert got == want
    assert packing.pack(empty, default_tokenizer()).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    import random

    from tokenizers import Tokenizer

    model, own, rng = Tokenizer.from_file(default_tokenizer()), packing.TextEncoder(default_tokenizer()), random.Random(3)
    signs = "abcABCÉéßĳİıΣσς .,..,'s 't!? \n\t\r12²٣́ 　한字<|>|_-Ǆ…"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["Don't <|endoftext|> x", ""]
    for t in texts:
        assert own.ids(t).tolist() == model.encode(t, add_special_tokens=False).ids


def test_patterns_cover_the_histogram():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 7, 300):
        sizes, counts = np.unique(rng.integers(1, 257, n), return_counts=True)
        used = packing.solve_patterns(sizes, counts, 256)
        assert (sum(t * p for t, p in used) == counts).all() and all(p @ sizes <= 256 for _, p in used)
        assert sum(t for t, _ in used) <= 1.25 * (sizes @ counts) / 256 + 2


def line_brute(rows, least=50):
    seen, out = {}, {}
    docs = sorted({(-1 if d is None else d, t) for d, t, *_ in rows if t is not None})
    for d, t in docs:
        lines = t.split("\n")
        at = [(i, tuple(x.encode().split()), x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(lines)]
        at = [x for x in at if x[1]]
        gone = set()
        for i in range(len(at)):
            n, first = 0, False
            for j in range(i, min(len(at), i + 60)):
                n += len(at[j][1])
                if n >= least:
                    key = tuple(x[2] for x in at[i : j + 1])
                    if seen.setdefault(key, (d, i)) != (d, i):
                        gone.update(range(at[i][0], at[j][0] + 1))
        out[d, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(messy, messy_rows, empty):
    out = line_dedup.remove_repeated_lines(messy)
    assert out.columns == [*messy.columns, "dedup_"] and out.count() == len(messy_rows)
    want = line_brute(messy_rows)
    before = Counter((r[0], want.get((-1 if r[0] is None else r[0], r[1]))) for r in messy_rows)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == before
    assert line_dedup.line_report(empty).count() == 0
    assert {r["doc_id"] for r in line_dedup.line_report(messy).filter("n_removed > 0").collect()} >= {20, 31, 60}


def test_only_selected_fingerprints_are_joined(spark, messy, monkeypatch):
    """Windows select few positions, shared runs select the same ones, and without them nothing is found."""
    import random

    rng = random.Random(4)
    run = [" ".join(f"s{rng.randrange(90)}" for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = ["\n".join([*(f"x{k} y{rng.randrange(99)}" for _ in range(30)), *run, *(f"z{k} {rng.randrange(99)}" for _ in range(30))]) for k in range(2)]
    picks = []
    for t in texts:
        hashes, words, _ = line_dedup.line_hashes(t)
        found, picked = line_dedup.select(hashes, words, 20, 50)
        assert len(picked) < len(words) / 3 and all(i <= k < j for i, j, k in found)
        picks.append(set(picked.values()))
    assert len(picks[0] & picks[1]) >= 4
    assert line_dedup.repeated_ranges(messy.select("doc_id", "text")).count() > 0
    monkeypatch.setattr(line_dedup, "_signed", lambda x: rng.randrange(1 << 62))
    assert line_dedup.repeated_ranges(messy.select("doc_id", "text")).count() == 0


def shingles(text, width=5):
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return frozenset(zip(*(ws[k:] for k in range(width)))) if len(ws) >= width else frozenset([tuple(ws)] if ws else [])


def jaccard_brute(rows, percent=80, width=5):
    sets = defaultdict(set)
    for d, t, *_ in rows:
        if d is not None and shingles(t, width):
            sets[d].add(shingles(t, width))
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, xs), (b, ys) in itertools.combinations(sets.items(), 2):
        if any(100 * len(x & y) >= percent * len(x | y) for x in xs for y in ys):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("percent,width", [(80, 5), (85, 4)])
def test_ngram_join(messy, messy_rows, empty, percent, width):
    want = jaccard_brute(messy_rows, percent, width)
    out = ngram_join.jaccard_components(messy, percent, width).collect()
    assert len(out) == len(messy_rows)
    for r in out:
        assert r["component_id"] == want.get(r["doc_id"], r["doc_id"])
    assert Counter((r["doc_id"], r["n_shingles"]) for r in out) == Counter((d, len(shingles(t, width))) for d, t, *_ in messy_rows)
    kept = ngram_join.keep_first(messy, percent, width)
    assert kept.columns == messy.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted(d for d in {r[0] for r in messy_rows if r[0] is not None} if want.get(d, d) == d)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_ngram_join_chains_and_large_columns(spark, monkeypatch):
    """A chain of near copies whose ends do not link, beside a column of many unlinked rows cut into parts."""
    import random

    monkeypatch.setattr(ngram_join, "ROWS", 7)
    rng = random.Random(8)
    text = [f"x{i}" for i in range(120)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(text)))
        text[10 * k % 120] = f"y{k}"
    shared = " ".join(f"p{i}" for i in range(30))
    rows += [(100 + k, f"{shared} {' '.join(f'q{rng.randrange(10**6)}' for _ in range(rng.randrange(4, 12)))}") for k in range(60)]
    out = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), ordered=1).collect()}
    assert out == jaccard_brute(rows)


@pytest.mark.parametrize("slice_size", [4, 64])
def test_products_of_slices_add_up(spark, slice_size):
    """Counts summed over the slices of both rows decide, whatever the slices."""
    import random

    rng = random.Random(12)
    rows = []
    for k in range(40):
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(4, 200))]
        rows.append((10 * k, " ".join(text)))
        for j in range(1, 4):
            for _ in range(j):
                text[rng.randrange(len(text))] = "new"
            rows.append((10 * k + j, " ".join(text)))
    rows.append((10, rows[0][1]))  # a doc_id with two texts links through either
    for percent, width in ((80, 5), (40, 2)):
        out = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent, width, slice_size=slice_size).collect()}
        assert out == jaccard_brute(rows, percent, width)


def test_sketch_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (3, 60, 1500, 1501, 5000):
        x = rng.integers(0, 1 << 62, n).astype(np.uint64)
        y = np.concatenate([x[: n - n // 10], rng.integers(0, 1 << 62, n // 7).astype(np.uint64)])
        owner = np.repeat([0, 1], [len(x), len(y)])
        a, b = ngram_join.sketches(owner, np.concatenate([x, y]), np.array([len(x), len(y)]))
        assert ngram_join.apart(a, b) <= len(set(x.tolist()) ^ set(y.tolist()))


def suffix_brute(rows, length):
    seen, out = set(), {}
    docs = sorted({(-1 if d is None else d, (t or "")) for d, t, *_ in rows})
    for d, t in docs:
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            k = raw[i : i + length]
            if k in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(k)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[d, t] = (len(raw), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2, 1])
def test_suffix_dedup(messy, messy_rows, empty, hot):
    from pyspark.sql import functions as F

    out = suffix_dedup.remove_repeats(messy, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text_bytes", 256).alias("h")).collect()
    want = suffix_brute(messy_rows, 100)
    assert Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["h"])) for r in out) == Counter((d, want[-1 if d is None else d, t or ""]) for d, t, *_ in messy_rows)
    assert suffix_dedup.repeat_report(empty).count() == 0


def test_suffix_dedup_works_on_bounded_pieces(monkeypatch):
    """A task's Python objects do not grow with the batch it is given, null lists and empty texts included."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    texts = [chr(97 + i % 26) * (i % 5 * 150) for i in range(60)]
    spans = [None if i % 4 == 3 or i % 5 == 0 else [{"low": 0, "high": i % 5 * 10}] for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(60), pa.int64()), "text": pa.array(texts), "ranges": pa.array(spans, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))})
    out = list(suffix_dedup._cut(iter([batch, batch.slice(0, 0)]), 100))
    assert len(out) > 10 and all(sum(b.column("n_bytes").to_pylist()) <= 1000 + 600 for b in out)
    got = [row for b in out for row in b.to_pylist()]
    assert [r["doc_id"] for r in got] == list(range(60))
    for r, text, span in zip(got, texts, spans, strict=True):
        gone = 0 if span is None else span[0]["high"] + 100
        assert (r["text_bytes"], r["n_removed"], r["n_spans"]) == (text.encode()[gone:], gone, int(gone > 0))
    runs = [None if s is None else [{"g": 7, "salts": 3 if i % 2 else 1, **s[0]}] for i, s in enumerate(spans)]
    kind = pa.list_(pa.struct([("g", pa.int64()), ("salts", pa.int64()), ("low", pa.int32()), ("high", pa.int32())]))
    ids = pa.array(range(60), pa.int64())
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "th": ids, "text": pa.array(texts), "open": pa.array(runs, kind)})
    out = list(suffix_dedup._contexts(iter([batch]), 100))
    assert len(out) > 10 and all(sum(map(len, b.column("context").to_pylist())) <= 1000 + 5000 for b in out)
    want = sorted((i, at, t[at : at + (100 if i % 2 else s[0]["high"] + 100)].encode()) for i, (t, s) in enumerate(zip(texts, spans, strict=True)) if s for at in (range(s[0]["high"] + 1) if i % 2 else [0]))
    assert sorted((r["doc_id"], r["low"], r["context"]) for b in out for r in b.to_pylist()) == want


def test_suffix_dedup_small_alphabet(spark):
    """Few letters make many overlapping repeats and shared anchors."""
    import random

    rng = random.Random(11)
    rows = [(k, "".join(rng.choice("ab" if k % 3 else "é ") for _ in range(rng.randrange(0, 400)))) for k in range(40)]
    rows += [(50, "ab" * 300), (51, "a" * 99), (52, "a" * 100), (53, "a" * 101)]
    for length, gram in ((12, 5), (100, 24)):
        out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, gram=gram) if length == 100 else None
        if out is not None:
            want = suffix_brute(rows, length)
            for r in out.collect():
                assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == want[r["doc_id"], dict(rows)[r["doc_id"]]][:3]


def test_windows_seen_are_told_by_two_hashes():
    """Equal first hashes with different second ones are different windows."""
    import numpy as np

    rng = np.random.default_rng(11)
    one, two = rng.integers(0, 20, 300).astype(np.uint64), rng.integers(0, 20, 300).astype(np.uint64)
    seen, pairs = suffix_dedup.Seen(), set()
    for at in range(0, 300, 50):
        a, b = one[at : at + 50], two[at : at + 50]
        assert seen.has(a, b).tolist() == [(x, y) in pairs for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        seen.add(a, b)
        pairs |= set(zip(a.tolist(), b.tolist(), strict=True))
    assert list(zip(seen.one.tolist(), seen.two.tolist(), strict=True)) == sorted(pairs)


def test_refined_buckets_are_equal_strings():
    import random

    import numpy as np

    rng = random.Random(5)
    for length, q in ((100, 25), (12, 5), (7, 7), (9, 20), (30, 4)):
        raw = bytes(rng.choice(b"ab") for _ in range(900)) * 2
        starts = np.array(sorted(rng.sample(range(len(raw) - length + 1), 600)))
        group = np.array([rng.randrange(3) for _ in starts])
        got = suffix_dedup.refine(np.frombuffer(raw, np.uint8), group, starts, length, q)
        want = {}
        for g, at, n in zip(group.tolist(), starts.tolist(), got.tolist()):
            assert want.setdefault((g, raw[at : at + length]), n) == n
        assert len(set(want.values())) == len(want)


def test_language_id(spark, messy, messy_rows, empty):
    import random

    rng = random.Random(2)
    own = {"aa": "ka lo mi ru ta".split(), "bb": "str gel pfo nak wim".split()}
    rows = [(k, " ".join("".join(rng.choice(own[x]) for _ in range(rng.randrange(1, 4))) for _ in range(60)), x) for k in range(120) for x in [rng.choice("ab") * 2]]
    rows += [(500, None, "aa"), (501, "123 ...", "bb"), (502, "", None), (503, rows[0][1] * 300, None)]
    out = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for k, t, x in rows:
        r = out[k]
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == (x if k < 500 else "und" if k < 503 else rows[0][2])
    assert language_id.identify(messy).count() == len(messy_rows)
    assert language_id.identify(empty).count() == 0


def test_language_filters_against_plain_sets(monkeypatch):
    """Counts of the bit-sliced filters are those of plain sets and more only by false positives; long texts count as uncut ones."""
    import random

    import numpy as np

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) + " x1y'\u0130\u03a3 \u03a3a" for _ in range(4)]

    def grams(text):
        out = Counter()
        low = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        for n in (2, 3, 4):
            out.update(low[i : i + n] for i in range(len(low) - n + 1) if " " not in low[i + 1 : i + n - 1] and low[i : i + n] != "  ")
        return out

    def hashed(text):
        return np.unique(np.concatenate([h[at < stop] for _, code, stop in language_id._blocks_of([text]) for at, h in language_id.ngram_hashes(code)]))

    known = [hashed(" ".join(rng.sample(words, 40))) for _ in range(300)]
    model = language_id.Filters([f"l{k:03}" for k in range(300)], known, [0.5] * 300)
    n, hits = model.counts(texts)
    assert n.tolist() == [sum(grams(t).values()) for t in texts]
    for t, row in zip(texts, hits):
        h = np.concatenate([h[at < stop] for _, code, stop in language_id._blocks_of([t]) for at, h in language_id.ngram_hashes(code)])
        exact = np.array([np.isin(h, k).sum() for k in known])
        assert (row >= exact).all() and (row - exact <= 10 + 3 * len(h) * model.false_rate).all()
    monkeypatch.setattr(language_id, "_BLOCK", 97)
    cut_n, cut_hits = model.counts(texts)
    assert (cut_n == n).all() and (cut_hits == hits).all()


def test_language_id_without_letters_to_learn_from_and_with_many_languages(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 0)
    rows = [(held, "letters stand here", "aa"), (held + 1000, None, None)] + [(k, "12 34", "aa") for k in range(200, 210)]
    out = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows) and {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}
    many = [(k, " ".join([f"{chr(0x4E00 + 7 * (k % 300))}{chr(0x4E00 + 7 * (k % 300) + 1)}"] * 30), f"x{k % 300:03}") for k in range(1200)]
    out = language_id.identify(spark.createDataFrame(many, "doc_id long, text string, lang string")).collect()
    learned = {r["doc_id"] % 300 for r in out if not r["held_out"]}
    assert len(learned) > 290 and all(r["lang_pred"] == f"x{r['doc_id'] % 300:03}" for r in out if r["doc_id"] % 300 in learned)
