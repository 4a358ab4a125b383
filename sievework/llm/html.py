"""Main text of web pages by boosted trees over DOM nodes and a decoding that respects the tree."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.boosting import Boosted, fit
from sievework.llm.sampling import bounded_sample

#: Pages whose paragraphs fill the labelled pages, and how many of these are made.
SAMPLE_PAGES, LABELLED_PAGES = 300, 600
#: What a node gains, in log-odds, by being what the container around it is.
AGREE = 1.5

# Fixed names of HTML: elements without content, elements whose content is no text, elements inside a line.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OPAQUE = {
    "script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea", "select",
    "option", "datalist", "button", "title", "map",
}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
#: A start tag of these ends an open one of those named.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"},
}
TAGS = (
    "html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "tr", "td", "blockquote",
    "pre", "nav", "header", "footer", "aside", "form", "figure", "dl", "dd", "address", "fieldset", "details",
)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_STOP = re.compile(r"[.!?]")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[str] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)  # place in the page and text
    link_chars: int = 0


def _tags(page: str):
    """(start, end, match, tag, whether it ends an element) of every tag; the content of raw elements belongs to their start tag."""
    pos = 0
    while (m := _TOKEN.search(page, pos)) is not None:
        pos = m.end()
        tag, end = (m.group(2) or "").lower(), bool(m.group(1))
        if tag in RAW and not end and not m.group(3).endswith("/"):
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, pos)
            pos = len(page) if stop is None else page.find(">", stop.start()) + 1 or len(page)
        yield m.start(), pos, m, tag, end


def _closed(tags) -> dict[int, int]:
    """Where each opaque element ends that has an end tag of its own, by its start.

    It has none if an element around it ends first or the page does, or if a further button or option starts in it.
    """
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}

    def pop_to(tag: str) -> int:
        while True:
            top, start = stack.pop()
            count[top] -= 1
            if top == tag:
                return start

    for start, stop, m, tag, end in tags:
        if not tag or tag in VOID or tag in RAW or tag in INLINE:
            continue
        if end:
            if count.get(tag):
                begun = pop_to(tag)
                if tag in OPAQUE:
                    out[begun] = stop
        elif not m.group(3).endswith("/") or tag not in OPAQUE:
            if tag in ("button", "option") and count.get(tag):
                pop_to(tag)
            stack.append((tag, start))
            count[tag] = count.get(tag, 0) + 1
    return out


def parse(page: str) -> list[Node]:
    """The block elements of a page, parents first, with the text that stands directly in each.

    Inline elements are part of the text around them; a line break is white space; scripts, styles and other
    elements without readable text are left out.  Tags that are missing or out of place are
    repaired as far as the text needs it: a new paragraph ends the last, an end tag closes what is open inside,
    and of a button or the like without its end tag the text up to the next block is left out.
    """
    nodes = [Node("html", -1, 0)]
    open_, order, links, label = [0], 0, 0, False
    text: list[str] = []

    def flush():
        nonlocal order
        if text:
            run = "".join(text)
            text.clear()
            run = " ".join((html.unescape(run) if "&" in run else run).split())
            if run:
                nodes[open_[-1]].runs.append((order, run))
                order += 1

    def say(part: str):
        if part and not label:
            text.append(part)
            if links:
                nodes[open_[-1]].link_chars += len(part)

    tags = list(_tags(page))
    closed = _closed(tags) if any(t[3] in OPAQUE and t[3] not in RAW for t in tags) else {}
    pos = 0
    for start, stop, m, tag, end in tags:
        if start < pos:
            continue
        say(page[pos:start])
        pos = stop
        if not tag:
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in OPAQUE:
            if start in closed:
                pos = closed[start]
            elif end:
                label = False
            elif tag not in RAW and not m.group(3).endswith("/"):
                say(" ")
                label = True
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
                label = False
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if end else 1
            continue
        flush()
        label = False
        if end:
            for k in range(len(open_) - 1, 0, -1):
                if nodes[open_[k]].tag == tag:
                    del open_[k:]
                    break
            links = 0
            continue
        if tag == "html":
            continue
        if nodes[open_[-1]].tag == "p":
            open_.pop()
        shut = ENDS.get(tag)
        while shut and len(open_) > 1 and nodes[open_[-1]].tag in shut:
            open_.pop()
        node = Node(tag, open_[-1], len(open_))
        if m.group(3):
            for a in _ATTR.finditer(m.group(3)):
                node.tokens += _NAME.findall((a.group(2) or a.group(3) or a.group(4) or "").lower())
        nodes.append(node)
        open_.append(len(nodes) - 1)
    say(page[pos:])
    flush()
    return nodes


_TAG_AT = {t: i for i, t in enumerate(TAGS)}


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node: tag, attribute tokens, those of its ancestors, depth, subtree and siblings."""
    n = len(nodes)
    x = np.zeros((n, WIDTH), np.float32)
    chars, links, blocks, stops, words, kids = (np.zeros(n) for _ in range(6))
    for i, node in enumerate(nodes):
        for _, run in node.runs:
            chars[i] += len(run)
            stops[i] += len(_STOP.findall(run))
            words[i] += run.count(" ") + 1
        links[i], blocks[i] = min(node.link_chars, chars[i]), 1 if node.runs else 0
    own = chars.copy()
    size = np.ones(n)
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        kids[p] += 1
        for total in (chars, links, blocks, stops, words, size):
            total[p] += total[i]
    base = len(TAGS) + 1
    same: dict[tuple[int, str], int] = {}
    place, longest = np.zeros(n), np.zeros(n)
    seen = np.zeros(n)
    for i, node in enumerate(nodes):
        x[i, _TAG_AT.get(node.tag, len(TAGS))] = 1
        for t in node.tokens:
            if t in _NAME_AT:
                x[i, base + _NAME_AT[t]] = 1
        p = node.parent
        if p >= 0:
            x[i, base + NAMES : base + 2 * NAMES] = np.maximum(x[p, base : base + NAMES], x[p, base + NAMES : base + 2 * NAMES])
            same[p, node.tag] = same.get((p, node.tag), 0) + 1
            place[i] = seen[p]
            seen[p] += 1
            longest[p] = max(longest[p], chars[i])
    page = max(chars[0], 1)
    for i, node in enumerate(nodes):
        p = max(node.parent, 0)
        x[i, base + 2 * NAMES :] = (
            node.depth, np.log1p(chars[i]), np.log1p(own[i]), links[i] / max(chars[i], 1), stops[i] / max(words[i], 1),
            chars[i] / size[i], words[i] / max(blocks[i], 1), chars[i] / page, np.log1p(size[i]), kids[i], kids[p],
            place[i] / max(kids[p], 1), same.get((node.parent, node.tag), 1) / max(kids[p], 1), chars[i] / max(longest[p], 1),
            chars[i] / max(chars[p], 1), float(nodes[p].tag in ("body", "html")), float(nodes[p].tag in ("article", "main")),
            float(node.tag in ("ul", "ol", "li") or nodes[p].tag in ("ul", "ol")),
        )
    return x


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes are main text: the best choice in which nothing inside a dropped node is kept.

    A kept node counts its log-odds (a container's twice) and its children's best; a child without attributes that name
    it counts AGREE more for being kept inside a kept container.  A dropped node counts nothing, nor does what is in it.  So a container goes
    with all its paragraphs if they do not outweigh it, and a paragraph is never kept inside a dropped one.
    """
    total = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, 0, -1):
        total[i] += float(odds[i]) * (1 if nodes[i].runs else 2)
        p = nodes[i].parent
        if nodes[p].tag not in ("html", "body") and not nodes[i].tokens:
            total[i] += AGREE
        total[p] += min(max(0.0, total[i]), 3.0)
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and (total[i] > 0 or nodes[i].tag == "body")
    return keep


def main_text(nodes: list[Node], keep: np.ndarray) -> str:
    runs = [run for i, node in enumerate(nodes) if keep[i] for run in node.runs]
    runs.sort()
    return " ".join(text for _, text in runs)


# ---- the labelled pages ----------------------------------------------------------------------

# Fixed vocabulary of the labelled pages: names that sites give to the parts of a page.
CONTENT = ("content", "post", "entry", "article-body", "story", "text", "main-content", "post-content", "article", "body-text", "page-content")
PARTS = {
    "nav": ("menu", "navbar", "navigation", "breadcrumbs", "pagination", "nav", "main-menu", "toc-links", "links"),
    "header": ("header", "masthead", "topbar", "site-header", "banner-top", "logo", "branding"),
    "footer": ("footer", "copyright", "site-footer", "bottom", "colophon", "legal"),
    "aside": ("sidebar", "related", "widget", "recommended", "trending", "popular", "more-stories", "aside", "read-next"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "sponsor"),
    "notice": ("cookie", "notice", "alert", "consent", "newsletter", "subscribe", "popup", "modal", "cookie-banner", "gdpr", "message", "warning"),
    "form": ("search", "login", "contact", "signup", "form", "search-box"),
    "comments": ("comments", "comment", "replies", "discussion", "disqus", "responses", "comment-list", "reader-comments"),
    "share": ("share", "social", "tags", "meta", "byline", "author-box", "tools", "share-buttons"),
}
WRAPPERS = ("wrapper", "container", "content")
#: A column for each word of these names, of the node and of those around it; a word that the labelled pages lack says nothing.
_NAME_AT = {t: i for i, t in enumerate(sorted({t for name in (*CONTENT, *WRAPPERS, "item", *(n for kind in PARTS.values() for n in kind)) for t in _NAME.findall(name)}))}
NAMES = len(_NAME_AT)
WIDTH = len(TAGS) + 1 + 2 * NAMES + 18
FILLER = (
    "the house stood near a quiet river and people came to see it in summer while others stayed at home and read about the old town "
    "its market its school and its long history of trade with the north and the south"
).split()


class _Writer:
    """Writes one labelled page; a node is main text if ``good`` was set when it was opened."""

    def __init__(self, rng: Random, texts: list[str]):
        self.rng, self.texts, self.out = rng, texts, []

    def prose(self, low: int, high: int) -> str:
        words = self.rng.choice(self.texts).split() if self.texts and self.rng.random() < 0.8 else FILLER
        n = self.rng.randint(low, high)
        start = self.rng.randrange(max(1, len(words) - n))
        part = words[start : start + n] or FILLER[:n]
        return html.escape(" ".join(part)) + self.rng.choice((".", ".", "", "!"))

    def element(self, tag: str, inner: str, good: bool, name: str = "") -> str:
        attr = f' {self.rng.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f'<{tag}{attr} data-good="{int(good)}">{inner}</{tag}>'

    def links(self, good: bool) -> str:
        items = "".join(
            self.element("li", f'<a href="/x">{self.prose(1, 3)}</a>', good) for _ in range(self.rng.randint(2, 8))
        )
        return self.element("ul", items, good)

    def part(self, kind: str) -> str:
        rng = self.rng
        name = rng.choice(PARTS[kind])
        tag = rng.choice((kind, "div", "div", "section")) if kind in ("nav", "header", "footer", "aside", "form") else rng.choice(("div", "div", "section", "aside"))
        if tag == kind and rng.random() < 0.6:
            name = ""
        style = rng.random()
        if kind in ("nav", "share") or style < 0.25:
            inner = self.links(False)
        elif style < 0.6:
            inner = "".join(self.element("p", self.prose(4, 60), False) for _ in range(rng.randint(1, 5)))
        elif style < 0.8:
            inner = self.prose(3, 40)
        else:
            inner = self.element("h3", self.prose(1, 4), False) + "".join(
                self.element("div", self.element("p", self.prose(5, 50), False), False, rng.choice(("item", "", name + "-item"))) for _ in range(rng.randint(1, 4))
            )
        if kind == "form":
            inner = f'<input type="text">{inner}'
        return self.element(tag, inner, False, name)

    def article(self) -> str:
        rng = self.rng
        out = [self.element(rng.choice(("h1", "h1", "h2")), self.prose(3, 12), True)]
        for _ in range(rng.randint(1, 12)):
            pick = rng.random()
            if pick < 0.66:
                out.append(self.element("p", self.prose(1, 120), True))
            elif pick < 0.71:
                out.append(self.element("h2", self.prose(2, 8), True))
            elif pick < 0.76:
                out.append(self.element("ul", "".join(self.element("li", self.prose(3, 25), True) for _ in range(rng.randint(2, 5))), True))
            elif pick < 0.79:
                out.append(self.element("blockquote", self.element("p", self.prose(8, 50), True), True))
            elif pick < 0.82:
                row = lambda: self.element("tr", "".join(self.element("td", self.prose(1, 6), True) for _ in range(3)), True)
                out.append(self.element("table", row() + row(), True))
            elif pick < 0.84:
                out.append(self.element("pre", self.prose(5, 30), True))
            elif pick < 0.88:
                out.append(self.element("div", self.prose(10, 90), True))
            else:
                out.append(self.part(rng.choice(("ad", "ad", "aside", "notice", "share", "form", "comments"))))
        inner = "".join(out)
        style = rng.random()
        if style < 0.45:
            inner = self.element("article", inner, True)
        elif style < 0.6:
            inner = self.element("main", inner, True)
        elif style < 0.9:
            inner = self.element("div", inner, True, rng.choice(CONTENT))
        else:
            inner = self.element("section", inner, True, rng.choice((*CONTENT, "")))
        if rng.random() < 0.3:
            inner = self.element(rng.choice(("div", "main")), inner, True, rng.choice(("", *WRAPPERS)))
        return inner

    def page(self) -> str:
        rng = self.rng
        before = [self.part(k) for k in ("nav", "header", "notice", "ad", "form") if rng.random() < 0.5]
        after = [self.part(k) for k in ("comments", "aside", "share", "ad", "form", "footer", "notice") if rng.random() < 0.5]
        rng.shuffle(before)
        return "<html><body>" + "".join(before) + self.article() + "".join(after) + "</body></html>"


_GOOD = re.compile(r'data-good="([01])"')


def labelled(texts: list[str], pages: int = LABELLED_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of written pages whose prose is taken from ``texts``."""
    rng = Random(11)
    rows, labels = [], []
    for _ in range(pages):
        source = _Writer(rng, texts).page()
        marks = [int(m) for m in _GOOD.findall(source)]
        nodes = parse(source)
        at = [i for i, node in enumerate(nodes) if node.tag not in ("html", "body")]
        rows.append(features(nodes)[at])
        labels += marks
    return np.concatenate(rows), np.array(labels)


def trained(pages: DataFrame, html_col: str = "html") -> Boosted:
    """Trees fitted to labelled pages whose prose comes from a bounded sample of ``pages``."""
    sample = pages.select(F.col(html_col).alias("html")).where(F.length("html").between(200, 20_000))
    rows = bounded_sample(sample, "html", SAMPLE_PAGES, pages.count()).collect()
    texts = [" ".join(run for node in parse(r.html) for _, run in node.runs) for r in rows]
    return fit(*labelled([t for t in texts if t.count(" ") > 20]))


def _extracted(model):
    def run(batches):
        trees = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                parsed = [parse(h or "") for h in part.column("html").to_pylist()]
                odds = trees(np.concatenate([features(nodes) for nodes in parsed]))
                ends = np.cumsum([len(nodes) for nodes in parsed])
                texts = [main_text(nodes, decode(nodes, odds[e - len(nodes) : e])) for nodes, e in zip(parsed, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return run


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row of ``pages``: page_id, url, text (the main text, empty if none) and n_chars, its code points.

    Whole pages are read, in one pass without a shuffle.  Character references are decoded, white space
    inside a block becomes one blank, blocks are joined by one blank in page order.  A null or empty page has the
    empty text; null and repeated ids and urls stay as they are; an empty table gives no rows;
    other columns are not read.
    """
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    model = pages.sparkSession.sparkContext.broadcast(trained(narrow))
    return narrow.mapInArrow(_extracted(model), "page_id long, url string, text string, n_chars long")
