"""HTML extraction: equivalence-class template deduction.

Tokens of a page are its element paths (tags with their first class) and its text
blocks. Over all pages of a host, tokens with the same occurrence vector (how often in
which page) form an equivalence class; a class is valid if it stands in at least half
of the host's pages and in two or more. Valid classes, numbered in the order of their
positions, are the host's template; a class is nested in the class of the nearest container
around its first token that is not of the class itself (-1: in none). What the template
leaves open are slots: text that lies directly in a container. Inside an article or main element, or on
pages without one everywhere, slots of any size are kept; fixed text, named boilerplate
and, outside these elements, link lists are not. A container is a link list if it has two
links or more and links hold `LIST_SHARE` of its letters, in the mean over the pages of a
template, or on the page itself where its host has none.

Inside an article or main element a text is fixed if it lies in a container nested in
that element and is of one class with a container around it: it stands exactly as often as
that part of the template, on every page. A text whose class is nested in those of all the
containers around it is what fills a slot, whichever other parts of the template it meets
by chance. Where pages hold a text at several places, the containers around all of them
count. Text directly in the article element itself always stays.

The vectors are never gathered: a vector is the sum of hash(page, count) over pages, so
hosts of any size are summed with map-side combine. Whether the pages of a text differ
is told by sums too: with a and b the least and the largest number of their open texts,
the sum of (c - a)(c - b) is 0 unless there is a third. A template is bounded by the tokens
of a page, since each of its tokens stands in half of the pages.

Defined cases: null and empty html give an empty text, null url the host ''. A host with
one page has no template: its page is judged by its own elements. Rows that repeat are
extracted alike (copies of one page do not make its article a template: for a text to be
fixed, three pages that differ in their open text must agree). Unclosed
tags, a page cut off inside a tag and very long pages are read as far as they go. An
empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# HTML element names by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg title select canvas object video audio".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article aside body center div fieldset figure footer form header html main menu nav ol section table td ul".split())
_CHROME = frozenset("head nav footer aside button menu dialog".split())
_MAIN = frozenset(("article", "main"))
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article section div main body html td th".split())
_NAMED = re.compile(
    r"(?:(?:site|page|global|main|primary|top|bottom|left|right|user|reader|social|post|article|cookie|email|mobile)[-_]?)?"
    r"(?:ads?|advert(?:s|isement|isements|ising)?|banner|sponsor(?:s|ed)?|promos?|cookies?|consent|gdpr|notice|newsletter|subscribe|signup|sidebar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|comments?|disqus|reply|replies|social|share|sharing|related|recommended|popup|modal|widget|toolbar|pagination|pager|skip)"
    r"(?:[-_]?(?:bar|box|block|slot|unit|list|section|thread|area|wrap|wrapper|container|form|links?|buttons?|icons?|menu|nav|notice|banner|message|popup|posts|articles|stories|items?|top|bottom|left|right|\d+))?",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
#: Tasks that the pages of one host are dealt to if it has more than one in SALTED of all pages; there are fewer such hosts than SALTED.
SALTS, SALTED = 64, 1024
#: Numbers that the open texts of pages are hashed to; sums of their squares are decimals.
CONTENTS = 1 << 40
#: Share of a page's letters beyond which a container is the page, whatever its name.
MOST = 0.5
#: Letters in links, of a link list's letters.
LIST_SHARE = 0.8
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


class Block:
    __slots__ = ("chrome", "letters", "link", "links", "main", "path", "suspects", "text")

    def __init__(self, text: str, path: str, main: bool, chrome: bool, link: int, links: int, suspects: tuple = ()):
        self.text, self.path, self.main, self.chrome, self.link, self.links, self.suspects = text, path, main, chrome, link, links, suspects
        self.letters = _letters(text) if links else len(text)


def _letters(text: str) -> int:
    return sum(map(str.isalnum, text))


def _chrome(tag: str, attrs: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is none of the article by what it is, and whether it is so by its name, or as a form, unless it holds the article."""
    if tag in _CHROME or tag == "header" and not in_main:
        return True, False
    if tag == "form":
        return False, True
    if not attrs.strip():
        return False, False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden", "") == "true" or found.get("role", "") in _ROLES:
        return True, False
    if tag in ("html", "body", "article", "main"):
        return False, False
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    return False, any(_NAMED.fullmatch(x) for x in names)


def _judge(blocks: list[Block], holds_main: set[int]) -> None:
    """Blocks below a named container or a form are none of the article, unless that holds an article, or most of the page's letters."""
    sums: dict[int, int] = {}
    total = 0
    for b in blocks:
        if not b.chrome:
            total += b.letters
            for k in b.suspects:
                sums[k] = sums.get(k, 0) + b.letters
    for b in blocks:
        b.chrome = b.chrome or any(k not in holds_main and sums[k] <= MOST * total for k in b.suspects)


def _label(tag: str, attrs: str) -> str:
    named = re.search(r"\bclass\s*=\s*[\"']?\s*([\w-]+)", attrs) if attrs else None
    return f"{tag}.{named[1]}" if named else tag


def parse(page: str | None) -> tuple[list[str], list[Block]]:
    """Paths of the containers in page order, and the text blocks in page order."""
    paths: list[str] = []
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool, bool, int, tuple]] = []  # tag, path of the container, in main, in chrome, end of the tag of a link or 0, named containers
    holds_main: set[int] = set()  # named containers around an article
    parts: list[str] = []
    linked = 0
    links: set[int] = set()
    at, end = 0, len(page or "")
    page = page or ""

    def top():
        return stack[-1] if stack else ("", "", False, False, 0, ())

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, path, main, chrome, _, suspects = top()
                blocks.append(Block(text, path, main, chrome, linked, len(links), suspects))
            parts.clear()
        linked = 0
        links.clear()

    def text(value: str) -> None:
        nonlocal linked
        if value:
            parts.append(value)
            if top()[4] and value.strip():
                linked += _letters(html.unescape(value))
                links.add(top()[4])

    while at < end:
        m = _TAG.search(page, at)
        if not m:
            rest = page[at:]
            cut = rest.rfind("<")
            text(rest[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z]|<!", rest[cut:]) else rest)
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:
            if tag in _BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in _BLOCK or not any(s[0] in _SCOPE for s in stack[k:]):
                        del stack[k:]
                    break
            continue
        attrs = m[3]
        if tag in _RAW:
            if not attrs.endswith("/"):
                closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = closing.end() if closing else end
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in _BLOCK:
            flush()
            shut = _CLOSES.get(tag, frozenset()) | {"p"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in shut:
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPE:
                    break
        if tag in _VOID or attrs.endswith("/"):
            continue
        _, path, main, chrome, link, suspects = top()
        if tag in _CONTAINER:
            path = f"{path}/{_label(tag, attrs)}"
            paths.append(path)
        sure, named = _chrome(tag, attrs, main)
        if tag in _MAIN:
            holds_main.update(suspects)
        if named:
            suspects = (*suspects, at)
        stack.append((tag, path, main or tag in _MAIN, chrome or sure, link or (at if tag == "a" else 0), suspects))
    flush()
    _judge(blocks, holds_main)
    return paths, blocks


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _fixed_key(b: Block) -> str | None:
    """The token of a text that may be fixed; None for text directly in an article element."""
    if not b.main:
        return "o" + _hash(b.text)
    return "m" + _hash(b.text) if b.path.rsplit("/", 1)[-1].split(".")[0] not in _MAIN else None


def _tokens(host: str, page_id, page: str | None) -> Iterator[tuple]:
    paths, blocks = parse(page)
    content = int(_hash("\n".join(b.text for b in blocks if not b.chrome)), 16) % CONTENTS
    seen: dict[str, list] = {}
    places: dict[str, list[str]] = {}
    for at, p in enumerate(paths):
        seen.setdefault(p, [0, at, 0, 0, 0])[0] += 1
    for b in blocks:
        own = seen.setdefault(b.path, [0, len(paths), 0, 0, 0])
        own[2] += b.letters
        own[3] += b.link
        own[4] += b.links
        key = None if b.chrome else _fixed_key(b)
        if key:
            seen.setdefault("=" + key, [0, len(paths), 0, 0, 0])[0] += 1
            places.setdefault("=" + key, []).append(b.path)
    for token, (n, at, letters, link, links) in seen.items():
        own = places.get(token, [token])
        yield host, page_id, token, n, at, letters, link, links, content, min(own), max(own)


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def host_templates(pages: DataFrame) -> DataFrame:
    """host, template: array of (token, class_id, parent_id, fixed, letters, link, links), class after class in page order."""

    def scan(batches):
        names = ["host", "page", "token", "n", "at", "letters", "link", "links", "content", "low", "high"]
        for pdf in batches:
            yield pd.DataFrame([t for row in zip(pdf["host"], pdf["page"], pdf["html"], strict=True) for t in _tokens(*row)], columns=names)

    own = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "html").alias("page"), "html")
    rows = own.mapInPandas(scan, "host string, page long, token string, n int, at int, letters long, link long, links long, content long, low string, high string")
    tokens = rows.groupBy("host", "token").agg(
        F.expr("sum(cast(xxhash64(page, n) as decimal(20,0)))").alias("vector"),
        F.count("*").alias("support"),
        F.min("content").cast("decimal(13,0)").alias("a"),
        F.max("content").cast("decimal(13,0)").alias("b"),
        F.sum(F.col("content").cast("decimal(13,0)")).alias("sum_1"),
        F.sum(F.col("content").cast("decimal(13,0)") * F.col("content").cast("decimal(13,0)")).alias("sum_2"),
        F.avg("at").alias("at"),
        F.avg("letters").alias("letters"),
        F.avg("link").alias("link"),
        F.avg("links").alias("links"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    n = own.groupBy("host").agg(F.count("*").alias("pages"))
    valid = tokens.filter(F.col("support") >= 2).join(n, "host").filter(2 * F.col("support") >= F.col("pages"))
    text = F.col("token").startswith("=")
    # whether any page's number is neither the least nor the greatest: sum (x - a)(x - b) is not 0
    third = F.col("sum_2") + F.col("a") * F.col("b") * F.col("support").cast("decimal(11,0)") != (F.col("a") + F.col("b")) * F.col("sum_1")
    valid = valid.filter(~text | third)
    # tokens with one vector are one class; classes are numbered by where they begin
    classes = valid.withColumn("class_at", F.min("at").over(Window.partitionBy("host", "vector")))
    made = F.sort_array(F.collect_list(F.struct("class_at", "vector", "at", "token", "letters", "link", "links", "low", "high")))
    found = classes.groupBy("host").agg(made.alias("tokens"), F.first("pages").alias("pages"))

    @F.pandas_udf("array<struct<token:string,class_id:int,parent_id:int,fixed:boolean,letters:double,link:double,links:double>>")
    def nest(tokens: pd.Series) -> pd.Series:
        return pd.Series([nested(t) for t in tokens], dtype=object)

    return found.select("host", "pages", nest("tokens").alias("template"))


def ancestors(low: str, high: str) -> list[str]:
    """The containers around every path from low to high (in code point order), innermost first; a path is one of its own."""
    common = os.path.commonprefix([low + "/", high + "/"])
    parts = common[: common.rfind("/") + 1].split("/")[1:-1]
    return ["/" + "/".join(parts[:k]) for k in range(len(parts), 0, -1)]


def nested(tokens) -> list[dict]:
    """The template of one host, from its tokens in the order of their classes: each with its class, the class around it and whether it is fixed."""
    numbers: dict = {}
    own = {t["token"]: numbers.setdefault(t["vector"], len(numbers)) for t in tokens}
    parents: dict[int, int] = {}
    out = []
    for t in tokens:
        token, mine = t["token"], own[t["token"]]
        around = [own.get(p, -1) for p in ancestors(t["low"], t["high"]) if p != token]
        parents.setdefault(mine, next((c for c in around if c not in (mine, -1)), -1))
        fixed = token.startswith("=") and (not token.startswith("=m") or mine in around)
        out.append({"token": token, "class_id": mine, "parent_id": parents[mine], "fixed": fixed, **{k: t[k] for k in ("letters", "link", "links")}})
    return out


def _is_list(letters: float, link: float, links: float) -> bool:
    return links >= 2 and link >= LIST_SHARE * letters


def content_slots(template) -> tuple[dict[str, bool], set[str]]:
    """Of a host's template: its containers, with whether their slots are open, and the fixed texts."""
    slots = {t["token"]: not _is_list(t["letters"], t["link"], t["links"]) for t in template if not t["token"].startswith("=")}
    return slots, {t["token"][1:] for t in template if t["fixed"]}


def own_slots(blocks: list[Block]) -> dict[str, bool]:
    """The containers of one page's blocks, with whether their slots are open."""
    sums: dict[str, list[int]] = {}
    for b in blocks:
        own = sums.setdefault(b.path, [0, 0, 0])
        own[0] += b.letters
        own[1] += b.link
        own[2] += b.links
    return {p: not _is_list(*x) for p, x in sums.items()}


def main_text(page: str | None, template) -> str:
    """The article of one page, its blocks joined by a blank line."""
    _, blocks = parse(page)
    open_blocks = [b for b in blocks if not b.chrome]
    slots, fixed = content_slots(template) if template is not None else ({}, set())
    free = [b for b in open_blocks if _fixed_key(b) not in fixed]
    if any(b.main for b in open_blocks):
        chosen = [b for b in free if b.main]
    else:
        slots = own_slots(open_blocks) | slots  # the template's word counts where it has the container
        chosen = [b for b in free if slots[b.path]]
    return "\n\n".join(b.text for b in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    # pages of a host that has more than one in SALTED of all are dealt out by a salt; its template, one small row, is repeated for each
    templates = materialize(host_templates(pages), "templates")
    hot = templates.filter(SALTED * F.col("pages") > pages.count()).select(F.col("host").alias("hot_"))  # below SALTED rows
    made = templates.withColumnRenamed("host", "host_").join(F.broadcast(hot), F.col("host_") == F.col("hot_"), "left")
    made = made.select("host_", "template", F.explode(F.sequence(F.lit(0), F.when(F.col("hot_").isNotNull(), SALTS - 1).otherwise(0))).alias("salt_"))
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(F.broadcast(hot), F.col("host") == F.col("hot_"), "left")
    salt = F.when(F.col("hot_").isNotNull(), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).otherwise(0).cast("int")
    joined = own.withColumn("salt", salt).join(made, (F.col("host") == F.col("host_")) & (F.col("salt") == F.col("salt_")), "left")

    @F.pandas_udf("string")
    def article(pages: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, t) for p, t in zip(pages, found, strict=True)], dtype=object)

    out = joined.select("page_id", "url", article("html", "template").alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
