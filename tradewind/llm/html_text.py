"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded down the tree."""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm import gbt
from tradewind.llm.shared import map_batches, texts

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Their content is never text of the page.
HIDDEN = frozenset(("head", "script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button", "title"))
INLINE = frozenset(("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr"))
#: Opening one of these ends a paragraph that is open.
CLOSES_P = frozenset(("address", "article", "aside", "blockquote", "center", "details", "dialog", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"))
#: What may stand in a head; anything else ends it, as its end tag and the body's start tag may be left out.
OF_HEAD = frozenset(("base", "link", "meta", "noscript", "script", "style", "template", "title"))
#: Elements of other languages, in which "/>" ends an element.
FOREIGN = frozenset(("svg", "math"))
#: What a button can't hold: one that is open when one of these begins was left unclosed.
NOT_IN_BUTTON = frozenset(("address", "article", "aside", "body", "button", "details", "dialog", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"))
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset(("article", "aside", "body", "div", "footer", "form", "header", "html", "main", "nav", "section", "table", "ul", "ol", "dl", "td", "th"))
MARK = "x-main"  # set by the page writer on the elements whose own text is main text


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...]
    place: int  # among its siblings
    children: list[int] = field(default_factory=list)
    chars: int = 0  # of text in blocks of its own
    links: int = 0  # of these, within links
    stops: int = 0
    blocks: int = 0
    main: bool = False


class Page(HTMLParser):
    """Block-level elements as nodes, and the text blocks in page order with the node that each lies in.

    A block ends wherever a block-level element begins or ends. A head ends where something begins that can't stand in
    it, a button where a block does that can't, and within svg and math "/>" ends an element. Unclosed and misplaced
    tags are tolerated: an end tag that nothing opened is dropped, and one for an outer element closes all within.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#", -1, 0, (), 0)]
        self.open: list[tuple[str, int]] = [("#", 0)]  # inline and hidden elements stand on the stack with their block's node
        self.hidden = self.in_link = 0
        self.count: dict[str, int] = {}  # of open elements, by tag
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[int, str]] = []
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            at = self.open[-1][1]
            node = self.nodes[at]
            node.chars += len(text)
            node.links += min(self.linked, len(text))
            node.stops += len(re.findall(r"[.!?](?:\s|$)", text))
            node.blocks += 1
            self.blocks.append((at, text))
        self.parts, self.linked = [], 0

    def pop(self) -> None:
        tag, _ = self.open[-1]
        if tag not in INLINE and tag not in HIDDEN:
            self.flush()
        self.open.pop()
        self.count[tag] -= 1
        self.hidden -= tag in HIDDEN
        self.in_link -= tag == "a"

    def end_open(self, tags: set[str] | frozenset[str]) -> None:
        """Ends the innermost of these elements, if no element of a scope stands between."""
        if not any(map(self.count.get, tags)):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                while len(self.open) > k:
                    self.pop()
                return
            if self.open[k][0] in SCOPES:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden:
            if self.open[-1][0] == "head" and tag not in OF_HEAD:
                self.pop()
            if self.count.get("button") and tag in NOT_IN_BUTTON:
                self.leave("button")
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in CLOSES_P:
            self.end_open({"p"})
        if tag in SAME_ENDS:
            self.end_open(SAME_ENDS[tag])
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        at = self.open[-1][1]
        if tag not in INLINE and tag not in HIDDEN:
            self.flush()
            said = dict(attrs)
            words = " ".join(said.get(k) or "" for k in ("class", "id", "role", "itemprop", "aria-label"))
            parent = self.nodes[at]
            self.nodes.append(Node(tag, at, parent.depth + 1, tuple(re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", words).lower())), len(parent.children), main=MARK in said))
            parent.children.append(len(self.nodes) - 1)
            at = len(self.nodes) - 1
        self.open.append((tag, at))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.hidden += tag in HIDDEN
        self.in_link += tag == "a"

    def foreign(self) -> bool:
        return any(map(self.count.get, FOREIGN))

    def leave(self, tag: str) -> None:
        """Ends the innermost element of this tag and all within."""
        while True:
            last = self.open[-1][0]
            self.pop()
            if last == tag:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in FOREIGN or self.foreign():
            return  # an element of its own, without content
        self.handle_starttag(tag, attrs)  # "<div/>" opens a div, as browsers have it

    def handle_endtag(self, tag: str) -> None:
        if self.count.get(tag):
            self.leave(tag)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())


GROUPS = {
    "main": "article content post entry main story body text copy prose".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toc pagination pager skip links".split(),
    "head": "header masthead head top logo brand banner hero".split(),
    "foot": "footer foot bottom copyright legal colophon contentinfo".split(),
    "side": "sidebar side aside widget widgets rail complementary related recommended more popular trending promo teaser".split(),
    "ad": "ad ads advert advertisement adsense sponsor sponsored dfp adslot promoted".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay privacy disclaimer".split(),
    "form": "form login signup subscribe newsletter search input contact".split(),
    "comment": "comment comments commentlist disqus reply replies respond discussion thread reader".split(),
    "share": "share social follow tags meta byline author bio print".split(),
}
_group = {w: k for k, words in enumerate(GROUPS.values()) for w in words}
TAGS = ("article", "main", "section", "div", "p", "h", "li", "list", "nav", "header", "footer", "aside", "form", "table", "quote", "pre", "body")
_tag = {t: k for k, t in enumerate(TAGS)} | {f"h{i}": 5 for i in range(1, 7)} | {"ul": 7, "ol": 7, "dl": 7, "menu": 8, "td": 13, "tr": 13, "th": 13, "tbody": 13, "blockquote": 14, "html": 16, "#": 16, "dd": 6, "dt": 6, "fieldset": 12, "hgroup": 9}
_unlikely = [k for k, g in enumerate(GROUPS) if g != "main"]
FEATURES = 2 * len(TAGS) + 2 * len(GROUPS) + 20


def node_features(page: Page) -> np.ndarray:
    """A row a node: tag and attribute token groups of itself and of all above it, size, link and text density of the subtree, depth, and its place and share among siblings."""
    nodes = page.nodes
    total = np.array([[n.chars, n.links, n.stops, n.blocks, 1] for n in nodes], float)
    for i in range(len(nodes) - 1, 0, -1):
        total[nodes[i].parent] += total[i]
    whole = max(total[0, 0], 1)
    alike = [Counter(nodes[s].tag for s in n.children) for n in nodes]
    x, t, g = np.zeros((len(nodes), FEATURES)), len(TAGS), len(GROUPS)
    for i, n in enumerate(nodes):
        row = x[i]
        if n.parent >= 0:
            above = x[n.parent]
            row[t : 2 * t] = np.maximum(above[t : 2 * t], above[:t])
            row[2 * t + g : 2 * t + 2 * g] = np.maximum(above[2 * t + g : 2 * t + 2 * g], above[2 * t : 2 * t + g])
        if n.tag in _tag:
            row[_tag[n.tag]] = 1
        for w in n.tokens:
            if w in _group:
                row[2 * t + _group[w]] = 1
        chars, links, stops, blocks, size = total[i]
        up = total[n.parent] if n.parent >= 0 else total[i]
        siblings = nodes[n.parent].children if n.parent >= 0 else [0]
        before = total[siblings[n.place - 1], 0] if n.parent >= 0 and n.place else 0
        after = total[siblings[n.place + 1], 0] if n.parent >= 0 and n.place + 1 < len(siblings) else 0
        row[2 * t + 2 * g :] = (
            n.depth, np.log1p(chars), np.log1p(n.chars), links / max(chars, 1), n.links / max(n.chars, 1), stops / max(chars, 1) * 100, chars / max(blocks, 1), chars / size,
            np.log1p(size), chars / whole, chars / max(up[0], 1), n.place, len(siblings), n.place / max(len(siblings) - 1, 1), np.log1p(before), np.log1p(after),
            len(n.children), alike[n.parent][n.tag] if n.parent >= 0 else 1, up[1] / max(up[0], 1), np.log1p(up[0]),
        )
    return x


def decode(page: Page, chance: np.ndarray) -> list[bool]:
    """Which nodes are kept. A dropped node drops all below it, so a choice for a subtree weighs all its nodes at once:

    the kept set of the greatest total log-probability, by one pass up and one down. Nodes weigh by the text below
    them, so that no stray leaf outvotes the menu that it stands in.
    """
    nodes = page.nodes
    p = np.clip(chance, 1e-4, 1 - 1e-4)
    size = np.array([n.chars for n in nodes], float)
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
    weight = 1 + np.log1p(size)
    keep, drop = weight * np.log(p), weight * np.log(1 - p)
    for i in range(len(nodes) - 1, 0, -1):
        keep[nodes[i].parent] += max(keep[i], drop[i])
        drop[nodes[i].parent] += drop[i]
    kept = [True] * len(nodes)
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and bool(keep[i] >= drop[i])
    return kept


def main_texts(trees: gbt.Trees, several: list[str]) -> list[str]:
    """The main text of each page: blocks of kept nodes in page order, one a line; white space within a block is one space."""
    pages = [Page(h) for h in several]
    rows = [node_features(p) for p in pages]
    chance = trees.probability(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page, own in zip(pages, rows):
        kept = decode(page, chance[at : at + len(own)])
        at += len(own)
        out.append("\n".join(text for node, text in page.blocks if kept[node]))
    return out


# ---- training ----


#: Names of parts of an article that no group above holds.
PLAIN = "note lead intro summary info callout tip highlight box dek standfirst caption wide first figure inset".split()


class PageWriter:
    """Invented pages of many layouts, with the elements of main text marked."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int, stops: bool = True) -> str:
        parts = "an er th on re he in ti es or st en at to nt ha nd ou ea ng as la de sch keit ment eau".split()
        out = ["".join(self.r.choice(parts) for _ in range(self.r.randrange(1, 5))) for _ in range(self.r.randrange(low, high))]
        text = " ".join(w + (self.r.choice([".", ",", ""]) if stops and self.r.random() < 0.2 else "") for w in out).capitalize()
        return escape(text + ("." if stops else ""))

    def attrs(self, *groups: str) -> str:
        if not groups or self.r.random() < 0.15:
            return ""
        name = "-".join(self.r.choice(GROUPS[self.r.choice(groups)]) for _ in range(self.r.choice([1, 1, 2])))
        return f' {self.r.choice(["class", "id", "class", "role"])}="{name}"'

    def links(self, n: int) -> str:
        wrap = self.r.choice(["li", "li", "span", "div", ""])
        items = [f'<a href="/{i}">{self.words(1, 4, False)}</a>' for i in range(n)]
        items = [f"<{wrap}>{x}</{wrap}>" for x in items] if wrap else items
        return "<ul>" + "".join(items) + "</ul>" if wrap == "li" else " ".join(items)

    def boiler(self, kind: str) -> str:
        r = self.r
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        tag = tag if r.random() < 0.6 else r.choice(["div", "section", "div"])
        attrs = self.attrs(kind) if tag == "div" or r.random() < 0.6 else ""
        if not attrs and tag in ("div", "section"):
            attrs = f' class="{r.choice(GROUPS[kind])}"'
        body = {
            "menu": lambda: self.links(r.randrange(2, 9)),
            "head": lambda: f"<div>{self.words(1, 5, False)}</div>" + (self.links(r.randrange(1, 5)) if r.random() < 0.6 else f"<p>{self.words(2, 9)}</p>"),
            "foot": lambda: r.choice([f"&copy; {self.words(1, 4, False)} &middot; {self.words(2, 16)}", f"<p>&copy; 2024 {self.words(2, 12)}</p>{self.links(r.randrange(1, 6))}", f"<p>{self.words(4, 30)}</p>"]),
            "side": lambda: f"<h3>{self.words(1, 4, False)}</h3>" + r.choice([self.links(r.randrange(2, 8)), f"<p>{self.words(5, 40)}</p>", f"<p>{self.words(5, 40)}</p><p>{self.words(5, 30)}</p>"]),
            "ad": lambda: r.choice([self.words(3, 30), f"<p>{self.words(3, 25)}</p>", f'<a href="/x">{self.words(3, 14)}</a>']),
            "notice": lambda: r.choice([f"<p>{self.words(5, 40)}</p>", self.words(5, 30)]) + "<button>OK</button>",
            "form": lambda: f"<p>{self.words(2, 14)}</p><label>{self.words(1, 3, False)}</label><input><button>Go</button>",
            "comment": lambda: f"<h3>{self.words(1, 4, False)}</h3>" + "".join(f'<{t}{self.attrs("comment")}><p>{self.words(3, 60)}</p></{t}>' for t in [r.choice(["div", "li", "article"])] for _ in range(r.randrange(1, 6))),
            "share": lambda: r.choice([self.links(r.randrange(2, 6)), f"<span>{self.words(2, 8, False)}</span>"]),
        }[kind]()
        return f"<{tag}{attrs}>{body}</{tag}>"

    def piece(self, brief: bool) -> str:
        """One part of an article's body, its text marked; now and then something that is no part of it."""
        r, m = self.r, f" {MARK}"
        text = self.words(1, r.choice([2, 3, 6] if brief else [3, 12, 40, 90, 150]))
        short = lambda: self.words(1, 6, r.random() < 0.3)

        def paragraph() -> str:
            body = f"<b>{text}<br>" if r.random() < 0.06 else text if r.random() < 0.8 else text + f' <a href="/l">{self.words(1, 4, False)}</a> ' + self.words(2, 20)
            named = f' class="{r.choice(PLAIN)}"' if r.random() < 0.1 else ""
            return f"<p{named}{m}>{body}" + ("</p>" if r.random() < 0.9 else "")

        def table() -> str:
            rows = "".join("<tr>" + "".join(f"<{t}{m}>{short()}</{t}>" for t in [r.choice(["td", "td", "th"])] for _ in range(r.randrange(1, 5))) + "</tr>" for _ in range(r.randrange(1, 6)))
            return f"<table>{f'<caption{m}>{short()}</caption>' if r.random() < 0.3 else ''}{f'<tbody>{rows}</tbody>' if r.random() < 0.5 else rows}</table>"

        kinds = (
            (55, paragraph), (7, lambda: f"<h{(k := r.choice([2, 2, 3, 4]))}{m}>{self.words(1, 8, False)}</h{k}>"),
            (5, lambda: f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li{m}>{self.words(1, 20)}</li>" for _ in range(r.randrange(1, 6))) + f"</{t}>"),
            (6, lambda: "<ul>" + "".join(f'<li{m}><a href="/{k}">{self.words(1, 6, False)}</a>{r.choice(["", " " + self.words(2, 9)])}</li>' for k in range(r.randrange(1, 7))) + "</ul>"),
            (4, lambda: f"<blockquote><p{m}>{text}</p></blockquote>" if r.random() < 0.6 else f"<blockquote{m}>{text}</blockquote>"), (4, lambda: f"<div{m}>{text}</div>"),
            (7, lambda: f'<div class="{r.choice(PLAIN)}"{m}>{text}</div>' if r.random() < 0.5 else f'<div class="{r.choice(PLAIN)}"><p{m}>{text}</p></div>'),
            (3, lambda: f"<pre{m}>{text}</pre>" if r.random() < 0.4 else f"<pre{m}><code>{text}</code></pre>"), (3, table),
            (2, lambda: "<dl>" + "".join(f"<dt{m}>{short()}</dt><dd{m}>{self.words(1, 25)}</dd>" for _ in range(r.randrange(1, 5))) + "</dl>"),
            (6, lambda: f'<figure><img src="x">{f"<figcaption{m}>{self.words(1, 18)}</figcaption>"}</figure>'), (1, lambda: f"<address{m}>{short()}</address>"), (1, lambda: f"<section><h2{m}>{short()}</h2>{paragraph()}{paragraph()}</section>"),
            (4, lambda: self.boiler(r.choice(["ad", "side", "form", "share"]))),
        )
        return r.choices([k for _, k in kinds], [n for n, _ in kinds])[0]()

    def article(self) -> str:
        r, m = self.r, f" {MARK}"
        out, title = [], ""
        where = r.random()
        if where < 0.85:
            h1 = f"<h{(k := r.choice([1, 1, 1, 1, 2]))}{m}>{self.words(2, 12, False)}</h{k}>"
            h1 = f"<header>{h1}</header>" if r.random() < 0.25 else f'<div class="{r.choice(["title", "headline", "heading"])}">{h1}</div>' if r.random() < 0.1 else h1
            if where < 0.6:
                out.append(h1)
            else:
                title = h1  # outside what holds the rest
        if r.random() < 0.25:
            out.append(self.boiler("share"))
        brief = r.random() < 0.2
        out += [self.piece(brief) for _ in range(r.choice([1, 1, 2] if brief else [1, 1, 2, 3, 4, 6, 9, 14, 20]))]
        tag = r.choice(["article", "article", "article", "main", "main", "div", "div", "section", "", ""])
        attrs = self.attrs("main") if tag in ("article", "main") or r.random() < 0.5 else f' class="{r.choice(GROUPS["main"])}"'
        if tag in ("div", "section") and r.random() < 0.3:
            attrs = ""
        if r.random() < 0.15 and tag:
            out.append(self.boiler("comment"))
        inner = "".join(out)
        if r.random() < 0.3 and tag:
            inner = f"<div{self.attrs('main')}>{inner}</div>"
        return title + (f"<{tag}{attrs}>{inner}</{tag}>" if tag else inner)

    def page(self) -> str:
        r = self.r
        before = [self.boiler(k) for k in ("notice", "head", "menu", "ad", "form", "side") if r.random() < 0.45]
        after = [self.boiler(k) for k in ("comment", "side", "ad", "share", "form", "notice", "foot") if r.random() < 0.4]
        article = self.article() if r.random() < 0.95 else ""
        if r.random() < 0.3:
            side = self.boiler("side")
            article = f"<div>{side + article if r.random() < 0.5 else article + side}</div>"
        if r.random() < 0.3:
            article = f'<div class="{r.choice(["page", "wrapper", "container", "layout"])}">{article}</div>'
        body = "".join(before) + article + "".join(after)
        body = f'<div id="page">{body}</div>' if r.random() < 0.25 else body
        html = f"<!DOCTYPE html><html><head><title>{self.words(2, 9, False)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"
        return html[: r.randrange(len(html) // 2, len(html))] if r.random() < 0.08 else html


@lru_cache(maxsize=1)
def trained(pages: int = 2000, seed: int = 5) -> gbt.Trees:
    """Trees for "main text lies in this node", from written pages; no table is read, so a process trains once for any input."""
    writer, x, y = PageWriter(seed), [], []
    for _ in range(pages):
        page = Page(writer.page())
        main = np.array([n.main for n in page.nodes], float)
        for i in range(len(main) - 1, 0, -1):
            main[page.nodes[i].parent] = max(main[page.nodes[i].parent], main[i])
        x.append(node_features(page))
        y.append(main)
    return gbt.fit(np.concatenate(x), np.concatenate(y), trees=90, depth=6, rate=0.3, bins=32, l2=2.0, least=2.0)


def extract(pages: DataFrame, trees: gbt.Trees | None = None) -> DataFrame:
    """page_id, url, text for every row of pages: the article's text, whole, empty if there is none.

    A null html is empty; repeated rows give repeated rows; an empty table gives an empty result; other columns are
    not read. Broken markup never fails: what the parser can't place is text or is dropped, as browsers do.
    """
    sent = pages.sparkSession.sparkContext.broadcast(trees or trained())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        several, out = texts(batch, "html"), []
        for at in range(0, len(several), 64):
            out += main_texts(sent.value, several[at : at + 64])
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), ["page_id", "url", "html"], "page_id long, url string, text string", step)
