"""Vectors, pages, licences, components, the pipeline and the registry."""

import importlib

import numpy as np
import pytest

pytest.importorskip("quillspan.llm")

from quillspan.llm import embedding_join, html_template, license_scan
from quillspan.llm.components import components


def brute_links(rows, least=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = sorted({i for i, _ in rows if i is not None})
    links, up = dict.fromkeys(range(len(ok)), 0), {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ok)):
        for b in range(len(ok)):
            if a != b and len(ok[a][1]) == len(ok[b][1]):
                x, y = ok[a][1] / np.abs(ok[a][1]).max(), ok[b][1] / np.abs(ok[b][1]).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a] += 1
                    p, q = find(ok[a][0]), find(ok[b][0])
                    up[max(p, q)] = min(p, q)
    return {ok[a][0]: n for a, n in links.items()}, {i: find(i) for i in ids}


@pytest.mark.parametrize("per_pivot,block,spread", [(4096, 8 << 20, 3), (4096, 8 * 8 * 30, 3), (9, 8 * 8 * 30, 100)])
def test_embedding_join(spark, per_pivot, block, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(k, (centres[k % 12] + rng.normal(scale=0.16, size=8)).tolist()) for k in range(150)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, []), (204, [0.0] * 8), (205, [float("nan")] * 8), (206, [1.0, None] + [0.0] * 6), (207, [float("inf")] + [1.0] * 7), (208, [1e300, -1e300] + [0.0] * 6), (209, [1.0, 0.0]), (210, [2.0, 0.0])]
    rows.append((None, rows[1][1]))
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id string")
    out = embedding_join.near_duplicates(df, per_pivot=per_pivot, block_bytes=block, most_spread=spread).collect()
    links, comp = brute_links(rows)
    assert len(out) == len(rows)
    for r in out:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (links.get(r["vec_id"], 0), comp[r["vec_id"]], comp[r["vec_id"]] == r["vec_id"])
    assert embedding_join.near_duplicates(df.limit(0)).count() == 0


def test_pivots_are_chosen_by_what_they_prune():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    clustered = embedding_join._unit((centres[rng.integers(0, 40, 2000)] + rng.normal(scale=0.05, size=(2000, 16))).tolist())
    alike = embedding_join._unit(rng.normal(size=(2000, 64)).tolist())
    assert len(embedding_join.choose_pivots(clustered, 200_000, 0.3, 4096)) > 8
    assert len(embedding_join.choose_pivots(alike, 200_000, 0.3, 4096)) == 1


def test_repeated_vector_ids(spark):
    rows = [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (3, [1.0, 0.01]), (9, [0.01, 1.0]), (5, [0.0, 1.0]), (7, None)]
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert out == [(3, 1, 3), (5, 2, 3), (7, 0, 3), (7, 1, 3), (7, 2, 3), (9, 2, 3)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (100, 95), (7, 7), (95, 96), (1, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 90 for k in (90, 95, 96, 100)}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu {0}</a><li><a href=/b>B</a></ul></nav><header>Site header</header><div class="ad">Buy {0}</div>
<article><h1>Title {0} &amp; more</h1><p>First  block
of <b>text<br>here</b>&nbsp;end<p>Second &lt;b&gt; {0}</p><div class="comments"><p>Reader says no</p></div><form><input>Send</form></article>
<aside>Side</aside><footer>&copy; site</footer></body>"""


def test_html_extraction(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.replace("{0}", str(k)), "x") for k in range(6)]
    plain = "<body><div class=nav><a href=/>Home</a></div><div class=story><p>Story number {0} is told here at some length, with more than a few words.</p><p>It goes on {0}.</p></div><div class=legal>All pages say this line</div></body>"
    rows += [(20 + k, f"https://Plain.example:80/{k}?q", plain.replace("{0}", str(k)), "x") for k in range(6)]
    rows += [(40, None, None, "x"), (41, "http://one.example/", "", "x"), (42, "nonsense", "just text &eacute; <b>bold</b> <unclosed", "x"), (43, "http://cut.example", "<p>cut off <a href=", "x")]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = html_template.extract(df).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    for k in range(6):
        assert by[k]["text"] == f"Title {k} & more\n\nFirst block of text here end\n\nSecond <b> {k}"
        assert by[20 + k]["text"] == f"Story number {k} is told here at some length, with more than a few words.\n\nIt goes on {k}."
    assert by[40]["text"] == by[41]["text"] == "" and by[42]["text"] == "just text é bold" and by[43]["text"] == "cut off"
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_template.extract(df.limit(0)).count() == 0


def test_html_template_decides_inside_the_article(spark):
    page = "<html><body><article><h1>Title {0}</h1><div class=x1><p>Body {0} of the page.</p></div><div class=x2>Tell your friends about us</div><div class=x3>Own {0}</div></article></body></html>"
    rows = [(k, f"http://t.example/{k}", page.replace("{0}", str(k))) for k in range(5)]
    copied = "<html><body><article><div class=x1><p>{0} same words</p></div></article></body></html>"
    rows += [(20 + k, f"http://copies.example/{k}", copied.replace("{0}", "B" if k == 4 else "A")) for k in range(5)]
    by = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(5):
        assert by[k] == f"Title {k}\n\nBody {k} of the page.\n\nOwn {k}"
        assert by[20 + k] == ("B same words" if k == 4 else "A same words")


def test_html_fixed_text_is_told_by_the_whole_block(spark):
    opening = "The following report was sent by our correspondents and is printed without any change of their words. " * 3
    page = "<html><body><div class=story><p>{1}It tells of place {0}.</p><p>More of {0}.</p></div><div class=legal>{1}</div></body></html>"
    rows = [(k, f"http://wire.example/{k}", page.replace("{0}", str(k)).replace("{1}", opening)) for k in range(5)]
    by = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert by == {k: f"{opening}It tells of place {k}.\n\nMore of {k}." for k in range(5)}


def test_html_vectors_alone_split_pages_of_plain_divs(spark):
    """No tag, class or name tells the boilerplate from the article: only what stands in most pages does."""
    page = "<html><body><div>Welcome to our page</div><div><div>Title {0}</div><div>The body of {0} tells of <math><mi>x{0}</mi></math> and more.</div><div>Write to us</div></div><div>Made in the north</div></body></html>"
    rows = [(k, f"http://div.example/{k}", page.replace("{0}", str(k))) for k in range(6)]
    by = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, _, html in rows:
        assert by[k] == f"Title {k}\n\nThe body of {k} tells of x{k} and more."
        assert "Welcome to our page" in html_template.main_text(html, None)


def test_html_classes_against_occurrence_vectors(spark):
    """The tokens of a template are those of valid classes, as counted page by page; one class number for one vector."""
    import random
    from collections import Counter, defaultdict

    rng = random.Random(13)
    pages = []
    for k in range(9):
        parts = [f"<div class=c{rng.randrange(3)}>{rng.choice(['same', 'other', f'own {k}'])}</div>" for _ in range(rng.randrange(2, 7))]
        pages.append(f"<body><table><tr><td>{k}</td></tr></table>{''.join(parts)}<div class=foot-line>fixed words</div></body>")
    rows = [(k, f"http://v.example/{k}", p) for k, p in enumerate(pages)]
    template = [t for r in html_template.host_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect() for t in r["template"]]
    got = {t["token"]: t["class_id"] for t in template}
    vectors, texts = defaultdict(lambda: [0] * 9), defaultdict(set)
    for k, p in enumerate(pages):
        paths, blocks = html_template.parse(p)
        for token, n in Counter(paths).items():
            vectors[token][k] = n
        content = "\n".join(b.text for b in blocks if not b.chrome)
        for b in blocks:
            if b.path not in paths:
                vectors.setdefault(b.path, [0] * 9)
            if not b.chrome:
                vectors["=" + html_template._fixed_key(b)][k] += 1
                texts["=" + html_template._fixed_key(b)].add(content)
    valid = {t for t, v in vectors.items() if sum(map(bool, v)) * 2 >= 9 and (not t.startswith("=") or len(texts[t]) >= 3)}
    assert set(got) == valid
    for a in valid:
        for b in valid:
            assert (vectors[a] == vectors[b]) == (got[a] == got[b])
    # a class is nested in the class of the nearest container around its first token that is of another one
    first = {}
    for t in template:
        first.setdefault(t["class_id"], t)
    for n, t in first.items():
        if not t["token"].startswith("="):
            steps = t["token"].split("/")
            around = [got["/".join(steps[:k])] for k in range(len(steps) - 1, 1, -1)]
            assert t["parent_id"] == next((c for c in around if c != n), -1)


def test_html_classes_nest_by_the_containers_around_them(spark):
    """A passage fills a slot, though it meets another optional part of the template on the same pages."""
    page = "<html><body>{2}<article><h1>Title {0}</h1><div class=x1>{1}</div><div class=x2>Printed by us</div></article></body></html>"
    extra = "<section class=box><b>{0} box</b></section>"
    passage = "Shared passage of several documents"
    rows = [(k, f"http://n.example/{k}", page.replace("{1}", passage if k < 5 else f"Own {k}").replace("{2}", extra if k < 5 else "").replace("{0}", str(k))) for k in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    template = {t["token"]: t for t in html_template.host_templates(df).first()["template"]}
    key = lambda text, path: "=" + html_template._fixed_key(html_template.Block(text, path, True, False, 0, 0))
    root, box = template["/html"]["class_id"], template["/html/body/section.box"]
    shared, printed = template[key(passage, "/html/body/article/div.x1")], template[key("Printed by us", "/html/body/article/div.x2")]
    assert template["/html"]["parent_id"] == -1 and box["parent_id"] == root
    assert shared["class_id"] == box["class_id"] != root and not shared["fixed"]
    assert printed["class_id"] == root and printed["fixed"]
    by = {r["page_id"]: r["text"] for r in html_template.extract(df).collect()}
    for k in range(8):
        kept = f"Title {k}\n\n{passage if k < 5 else f'Own {k}'}"
        assert by[k] == kept, by[k]


def test_html_ancestors():
    assert html_template.ancestors("/a/b/c", "/a/b/c") == ["/a/b/c", "/a/b", "/a"]
    assert html_template.ancestors("/a/b", "/a/bc/d") == ["/a"] and html_template.ancestors("/a/b", "/a/b/c") == ["/a/b", "/a"]
    assert html_template.ancestors("", "") == html_template.ancestors("/a", "/b") == []


def test_html_slots_of_any_size_stay(spark):
    long = "The story of {0} is told here at great length and with many words. " * 20
    page = f"<html><body><div class=lead>Lead {{0}}</div><div class=story><p>{long}</p></div><div class=more><p><a href=/r>The whole report {{0}} as a file</a></p></div><div class=links><a href=/1>A {{0}}</a> | <a href=/2>B {{0}}</a> | <a href=/3>C</a></div></body></html>"
    rows = [(k, f"http://{'lone' if k == 9 else 'many'}.example/{k}", page.replace("{0}", str(k))) for k in (0, 1, 2, 3, 9)]
    by = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert by == {k: f"Lead {k}\n\n{long.replace('{0}', str(k)).strip()}\n\nThe whole report {k} as a file" for k in (0, 1, 2, 3, 9)}


def test_license_scan(spark):
    texts = {
        1: "Some words here.\nLicensed under the Apache License, Version 2.0.\nMore.",
        2: "Released under the MIT License.",
        3: "mit der und das ist mit",
        4: "She passed her driving test and got her license last week.",
        5: None,
        6: "",
        7: "All rights reserved.\nAll rights reserved.",
        8: "x " * 50_000 + "\nThis work is licensed under the GNU General Public License, version 3.",
        9: "Licensed under CC BY-NC 4.0.",
    }
    df = spark.createDataFrame([(k, t, "g", 1.0) for k, t in texts.items()] + [(2, texts[2], "g", 1.0), (None, texts[9], "g", 1.0)], "doc_id long, text string, family string, p double")
    out = license_scan.scan_documents(df).collect()
    assert len(out) == 11
    got = {r["doc_id"]: r["family"] for r in out}
    assert got == {1: "apache-2.0", 2: "mit", 3: "none", 4: "none", 5: "none", 6: "none", 7: "proprietary", 8: "gpl", 9: "cc-by-nc", None: "cc-by-nc"}
    assert {r["n_confirmed"] for r in out if r["doc_id"] == 7} == {2}
    assert license_scan.scan_documents(df.limit(0)).count() == 0


def test_license_scan_of_everyday_words(spark):
    texts = {
        1: "Released under MIT",
        2: "Some words.\nObtaining a copy of this software and associated documentation files\n\nMore of the words.",
        3: "It is one of the best.\nmit\nof the\nTo the public it was free of charge.",
    }
    got = {r["doc_id"]: (r["family"], r["n_scanned"]) for r in license_scan.scan_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: ("mit", 1), 2: ("mit", 1), 3: ("none", 0)}


def license_brute(text, model):
    """(family, p, licence, share, evident) of each paragraph, by plain sums over n-grams."""
    import re

    out = []
    for part in re.split(license_scan.PARAGRAPH, text.lower()):
        grams = license_scan._grams(part)
        z = np.array(model.bias)
        for g in grams:
            z = z + np.array(model.weights.get(g, [0.0] * len(z)))
        z = z / model.temperature
        e = np.exp(z - z.max())
        k = int(z.argmax())
        own, share = {g for g in grams if " " in g}, 0.0
        for t in license_scan.notices(model.classes[k]) if model.classes[k] in license_scan.TEMPLATES else ():
            theirs = {g for g in license_scan._grams(t) if " " in g}
            shorter = min(len(own), len(theirs))
            common = len(own & theirs) / max(1, shorter)
            share = max(share, common if shorter >= license_scan.SHORT or (common == 1 and e[k] / e.sum() >= license_scan.LEAST_LICENCE) else 0.0)
        out.append((model.classes[k], e[k] / e.sum(), 1 - e[model.classes.index("none")] / e.sum(), share, bool(grams & evident_grams(model))))
    return out


def evident_grams(model):
    none = model.classes.index("none")
    return {g for g, v in model.weights.items() if max(v) > v[none]}


def license_verdict(text, model):
    """Family of a text of one paragraph."""
    ((family, p, licence, share, _),) = license_brute(text, model)
    if family not in ("unknown", "none") and p >= license_scan.LEAST_P and share >= license_scan.LEAST_SHARE:
        return family
    return "unknown" if licence >= license_scan.LEAST_LICENCE else "none"


LICENSE_PROBES = {
    "SPDX-License-Identifier: MIT": "mit",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd",
    "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "// SPDX-License-Identifier: Apache-2.0 */": "apache-2.0",
    "This code is MIT.": "mit",
    "thing | other |\nAll rights reserved.": "proprietary",
    "Veröffentlicht unter der MIT-Lizenz.": "mit",
    "Licensed under the EUPL 1.2.": "unknown",
    "This program is under the Microsoft Public License.": "unknown",
    "Licensed under WTFPL.": "unknown",
    "Released under the Academic Free License.": "unknown",
    "This font is licensed under the SIL Open Font License 1.1.": "unknown",
    "Use of this software is governed by the Business Source License 1.1.": "unknown",
    "Licensed under the Foobar Community License 3.1": "unknown",
    "SPDX-License-Identifier: Foo-1.0": "unknown",
    "The judge said that all rights reserved to the tribe by treaty remain in force.": "none",
    "mit der und das ist mit": "none",
    "He used the source of the river as a public place and the work was published under his own name.": "none",
    "To the public it was free of charge.": "none",
}


def test_license_paragraphs_against_plain_sums(spark):
    model = license_scan.train()
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction, including"
    texts = [wrapped, "Licensed under the Eclipse Public License 2.0", "Use of this is under the GNU Affero General Public License v3.\nNext.", "Prose first.\n\nReleased under the MIT License.\nAll rights reserved.", "The committee reserved all copyright and License rights under the MIT License", *license_scan.NEGATIVES[:8]]
    texts += [own[-1] for own in license_scan.TEMPLATES.values()] + list(LICENSE_PROBES)
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:4] * 2, "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): (r["family"], round(r["p"], 9), round(r["licence"], 9), round(r["share"], 9)) for r in license_scan.scan_paragraphs(df).collect()}
    for k, t in rows:
        for i, (family, p, licence, share, evident) in enumerate(license_brute(t, model)):
            if (k, i) in got:
                assert got.pop((k, i)) == (family, round(p, 9), round(licence, 9), round(share, 9))
            else:  # the regular expression loses none
                assert not evident and family == "none"
    assert not got
    family = {r["doc_id"]: r["family"] for r in license_scan.scan_documents(df).collect()}
    assert [family[k] for k in range(3)] == ["mit", "epl", "agpl"] and family[3] in ("mit", "proprietary")
    for k, t in rows[-len(LICENSE_PROBES) :]:
        assert family[k] == LICENSE_PROBES[t] == license_verdict(t, model), t


def test_license_paragraphs_without_evidence_are_none():
    """Nothing but the bias speaks for them at best, and the bias is for `none`."""
    model = license_scan.train()
    bias = np.array(model.bias) / model.temperature
    none = model.classes.index("none")
    assert bias.argmax() == none or bias.max() == bias[none]
    e = np.exp(bias - bias.max())
    assert 1 - e[none] / e.sum() < license_scan.LEAST_LICENCE
    assert all(g in model.evidence or set(g.split()) & set(model.evidence) for g in evident_grams(model))
    shown = [g for t, _, out in license_scan.examples() if not out for g in license_scan._grams(t)]
    assert set(model.evidence) <= set(shown) | {g for t in license_scan._BESIDE for g in license_scan._grams(t)} | set(model.weights)


def test_license_model_on_held_out_notices():
    """Notices and other licences that were not trained on, by the verdict on each."""
    model = license_scan.train()
    held = [(license_verdict(t, model), c) for t, c, out in license_scan.examples() if out]
    fit = {t for t, _, out in license_scan.examples() if not out}
    assert not fit & {t for t, _, out in license_scan.examples() if out}
    families = [found == c for found, c in held if c not in ("unknown", "none")]
    assert sum(families) >= 0.85 * len(families)
    assert sum(found == c for found, c in held) >= 0.9 * len(held)
    assert not [c for found, c in held if c == "none" and found not in ("unknown", "none")]


def test_pipeline_runs_stage_by_stage(spark, messy, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    from quillspan.llm.common import materialize

    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    step = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        step = materialize(stage(spark, step, path), "test")
        if k < 4:
            assert step.columns == docs.columns, name
    whole = pipeline.run(spark, path)
    assert sorted(map(tuple, whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").fillna(-1).collect())) == sorted(map(tuple, step.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").fillna(-1).collect()))
    assert 20 not in {r["doc_id"] for r in whole.select("doc_id").distinct().collect()}  # an exact copy is gone


def test_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


LAYOUTS = [
    '<article><div class="elementor-widget-container"><p>{0}</p></div></article>',
    '<div id="page" class="site has-sidebar"><p>{0}</p></div>',
    '<div class="layout right-sidebar"><article><p>{0}</p></article></div>',
    '<form action=/ method=post><div><p>{0}</p></div><input name=state></form>',
    '<form action=/><article><p>{0}</p></article></form>',
    '<article><div class="navy-history"><p>{0}</p></div></article>',
    '<article><section id="promontory"><p>{0}</p></section></article>',
    '<article><p>First.</p><section id="recommendations"><p>{0}</p></section></article>',
    '<main><section id="related-work"><p>{0}</p></section></main>',
    '<div class="widget"><p>{0}</p></div><div class="share-bar">Tell all</div>',
]


@pytest.mark.parametrize("layout", range(len(LAYOUTS)))
def test_names_do_not_hide_an_article(layout):
    body = "The ship left the harbour before dawn and did not come back that year."
    page = f"<html><body><nav>Home</nav>{LAYOUTS[layout].format(body)}<div class='cookie-notice'>We use cookies.</div><form>Sign up</form><div class='ad'>Buy now</div></body></html>"
    text = html_template.main_text(page, None)
    assert body in text
    assert not any(x in text for x in ("Home", "cookies", "Sign up", "Buy now", "Tell all"))


def test_templates_are_repeated_for_hot_hosts_only(spark, monkeypatch):
    rows = [(k, f"http://{'hot' if k % 3 else f'h{k}'}.org/{k}", f"<body><div class=top>Same line</div><div class=s><p>Story {k} of many words.</p></div></body>") for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = {r["page_id"]: r["text"] for r in html_template.extract(df).collect()}
    monkeypatch.setattr(html_template, "SALTED", 2)  # only the host of two thirds is hot
    assert {r["page_id"]: r["text"] for r in html_template.extract(df).collect()} == plain
    assert plain[1] == "Story 1 of many words."


def test_random_letters_are_noise_and_prose_is_not():
    import random

    import zstandard

    from quillspan.llm import compression_rules

    rng = random.Random(6)
    zstd = zstandard.ZstdCompressor(level=3)
    verdict = lambda t: compression_rules.judge(t, compression_rules.Bands(), zstd)[6]
    for n in (600, 1500, 6000):
        assert not verdict(" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 11))) for _ in range(n)))
    # the lower limits take no document of the test table
    import pandas as pd

    low = compression_rules.Bands(lowest=((6, 0.0),), chunk_lowest=0.0)
    for text in pd.read_parquet("/root/testdata/sf0.001/documents.parquet")["text"]:
        assert compression_rules.judge(text, compression_rules.Bands(), zstd)[6] == compression_rules.judge(text, low, zstd)[6]


def test_columns_with_the_operators_own_names(spark):
    from quillspan.llm import line_dedup, ngram_join

    line = " ".join(f"word{k}" for k in range(60))
    rows = [(1, line, 5, "x", 7, 8, 9, 1.5), (2, f"{line}\nown words", 5, "x", 7, 8, 9, 1.5), (3, "quite another text of some words", 5, "x", 7, 8, 9, 1.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc_id__ long, ranges__ string, cut__ long, dedup_ long, text_hash__ long, `a.b` double")
    out = line_dedup.remove_repeated_lines(df)
    assert out.columns[:-1] == df.columns and out.columns[-1] == "dedup__"
    assert {r["doc_id"]: (r["text"], r["dedup__"]["n_removed"], r["dedup_"]) for r in out.collect()} == {1: (line, 0, 8), 2: ("own words", 1, 8), 3: (rows[2][1], 0, 8)}
    kept = ngram_join.keep_first(df.union(df.filter("doc_id = 3").selectExpr("cast(9 as long)", "text", "doc_id__", "ranges__", "cut__", "dedup_", "text_hash__", "`a.b`")))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
