"""Main text of web pages: gradient-boosted trees over DOM nodes with hierarchical decoding.

A page becomes a tree of block-level nodes; inline elements belong to the block
they stand in. Each node has features: its own and its subtree's text, density,
link share, tags, punctuation, depth, place among its siblings and in the page,
its siblings' text, and how telling its attribute tokens and tag, and those of
its ancestors, are for main text. The trees give each node the odds of holding
main text. Decoding picks, per page, the most likely choice in which no
node is kept under one that is dropped, by one pass from the leaves to the root.

Scripts, styles, templates, comments and other markup hold no text. Training
pages are HTML with the attribute `data-main` on the blocks of the article;
a node is positive if it or a descendant has the mark. The default ones
are made by rule (templates below) with fixed seed.

Defined cases: null and empty pages, and pages without text, give an empty text;
unclosed, stray and nested tags are read as browsers mostly do; a page cut
short is read as far as it goes; pages of any length are read whole; equal
pages give equal texts; other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm import boosting
from spendscope.llm.common import mapped

# possessive throughout, so that no page takes more than a look at each character; a quote left open ends with the tag
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+[^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
# fixed values of HTML
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style template noscript head title svg math canvas object iframe textarea select option datalist audio video map".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol menu dl table select".split())


@dataclass
class Page:
    """Block-level nodes in page order."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    tokens: list[list[str]] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    own: list[int] = field(default_factory=list)  # characters of text directly in the block
    links: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    inner: list[int] = field(default_factory=list)  # inline tags directly in the block
    mark: list[bool] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)  # (node, text) in page order

    def open(self, tag: str, parent: int, tokens: list[str], mark: bool) -> int:
        for column, value in zip((self.tag, self.parent, self.tokens, self.depth, self.own, self.links, self.stops, self.inner, self.mark),
                                 (tag, parent, tokens, self.depth[parent] + 1 if parent >= 0 else 0, 0, 0, 0, 0, mark)):
            column.append(value)
        return len(self.tag) - 1


@cache
def _attributes(text: str) -> tuple[tuple[str, ...], bool]:
    """Tokens of class, id, role and the like, and whether the block is marked."""
    tokens, mark = [], False
    for name, *values in _ATTRIBUTE.findall(text):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            tokens += [x.lower() for x in _TOKEN.findall(value)]
        elif name == "data-main":
            mark = True
        elif name in ("hidden", "aria-hidden"):
            tokens.append(name)
    return tuple(tokens), mark


def _attributes_of(text: str) -> tuple[tuple[str, ...], bool]:
    if not text or text.isspace():
        return (), False
    return _attributes(text) if len(text) < 100 else _attributes.__wrapped__(text)


def parse(source: str) -> Page:
    """The block tree of a page; node 0 is the page itself."""
    page = Page()
    page.open("", -1, [], False)
    stack, blocks, anchors, silent, buffer = [("", 0)], [0], 0, 0, []
    at, size = 0, len(source)
    tags_end = source.rfind(">") + 1  # beyond it no tag is whole

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            page.runs.append((blocks[-1], text))

    def say(piece: str) -> None:
        if silent or not piece:
            return
        piece = html.unescape(piece) if "&" in piece else piece
        node, n = blocks[-1], len(piece) - piece.count(" ")
        page.own[node] += n
        if anchors:
            page.links[node] += n
        page.stops[node] += piece.count(".") + piece.count("!") + piece.count("?") + piece.count(",")
        buffer.append(piece)

    def close(depth: int) -> None:
        nonlocal anchors, silent
        while len(stack) > depth:
            tag, node = stack.pop()
            if tag == "a":
                anchors -= 1
            if tag in NO_TEXT:
                silent -= 1
            if node >= 0:
                flush()
                blocks.pop()

    def last(tags: tuple[str, ...], scope: frozenset[str]) -> int:
        """Place in the stack of the nearest open tag of these, not looking past the scope."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in scope:
                break
        return 0

    while at < size:
        found = _TAG.search(source, at, tags_end)
        if not found:
            # a tag cut off by the end of the page is no text
            cut = re.search(r"<[/A-Za-z!?]", source[max(at, tags_end) :])
            say(source[at : max(at, tags_end) + cut.start() if cut else size])
            break
        say(source[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            if name in ("p", "br"):
                place = last(("p",), CLOSES_P - {"p"}) if name == "p" else 0
            else:
                place = last((name,), frozenset())
            if place:
                close(place)
            elif name in CLOSES_P:
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
            stop = end.start() if end else size
            at = source.find(">", stop) + 1 if end else size
            at = at or size
            continue
        if name in CLOSES_P:
            place = last(("p",), CLOSES_P - {"p"})
            if place:
                close(place)
        if name in CLOSED_BY_SAME:
            place = last(CLOSED_BY_SAME[name], SCOPE if name in ("li", "dt", "dd", "option") else frozenset({"table"}))
            if place:
                close(place)
        if name == "body" and not page.tokens[0]:
            page.tokens[0] = list(_attributes_of(found[3])[0])
        if name in VOID:
            if name in ("br", "wbr"):
                buffer.append(" " if name == "br" else "")
            elif name in ("hr", "input"):
                flush()
            continue
        if found[3].endswith("/") and name not in CLOSES_P and name not in INLINE:
            continue
        if name in INLINE:
            page.inner[blocks[-1]] += 1
            tokens, mark = _attributes_of(found[3]) if name in ("ins", "span") and found[3] else ((), False)
            if name == "ins" and tokens:
                flush()
                stack.append((name, page.open(name, blocks[-1], list(tokens), mark)))
                blocks.append(stack[-1][1])
            else:
                stack.append((name, -1))
            anchors += name == "a"
            continue
        flush()
        tokens, mark = _attributes_of(found[3])
        if name in ("html", "body", "tbody", "thead"):
            stack.append((name, -1))
        elif name in NO_TEXT:
            stack.append((name, -1))
            silent += 1
        else:
            stack.append((name, page.open(name, blocks[-1], list(tokens), mark)))
            blocks.append(stack[-1][1])
    close(1)
    flush()
    return page


def ends(parent: list[int]) -> np.ndarray:
    """One past the last descendant of each node."""
    out = np.arange(1, len(parent) + 1)
    for i in range(len(parent) - 1, 0, -1):
        if out[i] > out[parent[i]]:
            out[parent[i]] = out[i]
    return out


@dataclass
class Telling:
    """Log odds of main text by attribute token and by tag."""

    token: dict[str, float]
    tag: dict[str, float]

    def of(self, page: Page) -> np.ndarray:
        """(nodes, 6): lowest and sum of the own tokens, own tag, lowest and highest token, lowest tag on the way from the root."""
        get, tag = self.token.get, self.tag.get
        out = np.zeros((len(page.tag), 6))
        rows: list[tuple] = []
        for name, parent, tokens in zip(page.tag, page.parent, page.tokens):
            own = [get(t, 0.0) for t in tokens]
            low, high, t = min(own, default=0.0), max(own, default=0.0), tag(name, 0.0)
            up = rows[parent] if parent >= 0 else (0.0,) * 6
            rows.append((low, sum(own), t, min(up[3], low), max(up[4], high), min(up[5], t)))
        out[:] = rows
        return out


def features(page: Page, telling: Telling) -> np.ndarray:
    """(nodes, features)."""
    n = len(page.tag)
    parent, depth = np.array(page.parent), np.array(page.depth)
    own, links, stops, inner = (np.array(x, float) for x in (page.own, page.links, page.stops, page.inner))
    end, start = ends(page.parent), np.arange(n)

    def below(x: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(x)]
        return total[end] - total[start]

    text, link, stop, tags, full = below(own), below(links), below(stops), below(inner + 1), below((own > 0).astype(float))
    whole = max(text[0], 1.0)
    up = np.maximum(parent, 0)
    order = np.argsort(up[1:], kind="stable") + 1
    group = up[order]
    first = np.searchsorted(group, group)
    place, count = np.zeros(n), np.ones(n)
    place[order] = np.arange(len(order)) - first
    count[order] = np.searchsorted(group, group, side="right") - first
    before, after = np.zeros(n), np.zeros(n)
    same = np.flatnonzero(group[1:] == group[:-1])
    before[order[same + 1]], after[order[same]] = text[order[same]], text[order[same + 1]]
    begin = np.r_[0, np.cumsum(own)][:-1]
    log = np.log1p
    columns = [
        depth, log(own), log(text), text / whole, link / np.maximum(text, 1), log(tags), text / (tags + 1), stop / np.maximum(text, 1), log(stop),
        place, count, (place + 1) / (count + 1), text / np.maximum(text[up], 1), text / np.maximum(full, 1), log(full), begin / whole, log(before), log(after),
        log(text[up]), link[up] / np.maximum(text[up], 1),
    ]
    return np.c_[np.stack(columns, 1), telling.of(page)]


def decode(logit: np.ndarray, parent: list[int]) -> np.ndarray:
    """The most likely choice of kept nodes in which every kept node's parent is kept."""
    n = len(parent)
    drop, keep = (-logit).tolist(), logit.tolist()  # of whole subtrees, twice the log likelihood less a constant
    for i in range(n - 1, 0, -1):
        p = parent[i]
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i])
    out = np.zeros(n, bool)
    out[0] = keep[0] > drop[0]
    for i in range(1, n):
        out[i] = out[parent[i]] and keep[i] > drop[i]
    return out


@dataclass
class Model:
    trees: boosting.Trees
    telling: Telling

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [parse(s) if s else None for s in sources]
        full = [p for p in pages if p and p.runs]
        if not full:
            return [""] * len(sources)
        logit = self.trees.logits(np.concatenate([features(p, self.telling) for p in full]))
        at, out = 0, []
        for p in pages:
            if not p or not p.runs:
                out.append("")
                continue
            kept = decode(logit[at : at + len(p.tag)], p.parent)
            at += len(p.tag)
            out.append("\n\n".join(text for node, text in p.runs if kept[node]))
        return out


def truth(page: Page) -> np.ndarray:
    """1 for nodes that are marked, lie in a marked node, or have one below."""
    mark = np.array(page.mark)
    for i, p in enumerate(page.parent):
        if p > 0 and page.mark[p] and not page.tokens[i]:
            page.mark[i] = True
    mark = np.array(page.mark)
    total = np.r_[0, np.cumsum(mark)]
    return (total[ends(page.parent)] > total[:-1]).astype(int)


def fit(sources: list[str]) -> Model:
    """A model of marked pages."""
    pages = [parse(s) for s in sources]
    labels = [truth(p) for p in pages]
    seen: dict[str, list[float]] = {}
    for p, y in zip(pages, labels):
        for tag, tokens, good in zip(p.tag, p.tokens, y.tolist()):
            for key in {f"<{tag}", *tokens}:
                seen.setdefault(key, [0.0, 0.0])[good] += 1
    odds = {k: float(np.log((a + 0.5) / (b + 0.5))) for k, (b, a) in seen.items()}
    telling = Telling({k: v for k, v in odds.items() if k[0] != "<"}, {k[1:]: v for k, v in odds.items() if k[0] == "<"})
    x, y = np.concatenate([features(p, telling) for p in pages]), np.concatenate(labels)
    return Model(boosting.fit(x, y, trees=80, depth=5), telling)


# Training pages by rule. Words for attributes, by what they tend to mark.
NAMES = {
    "main": "article content post entry main story body text page single blog news detail richtext prose document markdown".split(),
    "neutral": "wrapper container row col inner outer grid section block box site layout wrap center left primary group".split(),
    "nav": "nav menu navbar navigation links breadcrumb breadcrumbs topbar pagination pager tabs toc skip".split(),
    "header": "header masthead banner logo branding top hero site-title head".split(),
    "footer": "footer foot colophon copyright bottom legal imprint credits disclaimer".split(),
    "sidebar": "sidebar aside widget related secondary rail recommended trending popular tags categories archive".split(),
    "notice": "cookie consent notice alert gdpr popup modal overlay message warning paywall banner toast announcement".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo adsbygoogle banner-ad dfp outbrain taboola".split(),
    "form": "form search newsletter subscribe signup login contact register".split(),
    "comment": "comment comments comment-list reply replies discussion disqus responses respond thread".split(),
    "share": "share social sharing follow toolbar buttons author-bio meta byline".split(),
}


class _Maker:
    """One training page after the other."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = [a + b for a in "b c d f g h l m n p r s t v w th ch st".split() for b in "a e i o u en er in or ing an al".split()]

    def words(self, low: int, high: int) -> str:
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            w = "".join(r.choice(self.syllables) for _ in range(r.randint(1, 3)))
            out.append(w + r.choice(["", "", "", "", "", ",", "."]))
        text = " ".join(out).capitalize()
        return text + r.choice([".", ".", ".", "", "!", "?"])

    def attrs(self, kind: str, chance: float = 0.75) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        names = r.sample(NAMES[kind], min(len(NAMES[kind]), r.randint(1, 2)))
        if r.random() < 0.3:
            names.append(r.choice(NAMES["neutral"]))
        return f' {r.choice(["class", "class", "id"])}="{r.choice([" ", "-", "_"]).join(names)}"'

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 99999)}">{self.words(low, high)}</a>'

    def items(self, tag: str = "ul") -> str:
        inside = (lambda: self.link()) if self.r.random() < 0.9 else (lambda: self.words(1, 4))
        return f"<{tag}>" + "".join(f"<li>{inside()}</li>" for _ in range(self.r.randint(2, 12))) + f"</{tag}>"

    def inline(self, low: int, high: int) -> str:
        r, text = self.r, self.words(low, high)
        if r.random() < 0.25:
            text = f"<{(t := r.choice(['b', 'i', 'em', 'strong', 'span']))}>{text}" + ("" if r.random() < 0.4 else f"</{t}>")
        if r.random() < 0.15:
            text += f" {self.link()} " + self.words(2, 20)
        if r.random() < 0.15:
            text += "<br>" + (self.words(1, 20) if r.random() < 0.5 else "")
        return text

    def block(self) -> str:
        r, m = self.r, " data-main"
        kind = r.random()
        if kind < 0.62:
            return f"<p{m}>{self.inline(*r.choice([(1, 3), (4, 15), (15, 60), (40, 140)]))}" + ("" if r.random() < 0.3 else "</p>")
        if kind < 0.72:
            return f"<h{(k := r.choice('234'))}{m}>{self.words(1, 8)}</h{k}>"
        if kind < 0.80:
            return (t := r.choice(["ul", "ol"])) and f"<{t}{m}>" + "".join(f"<li{m}>{self.inline(1, 25)}</li>" for _ in range(r.randint(2, 8))) + f"</{t}>"
        if kind < 0.85:
            return f"<blockquote{m}><p{m}>{self.words(5, 50)}</p></blockquote>" if r.random() < 0.5 else f"<blockquote{m}>{self.words(5, 50)}</blockquote>"
        if kind < 0.89:
            return f"<table{m}>" + "".join(f"<tr{m}>" + "".join(f"<td{m}>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 6))) + "</table>"
        if kind < 0.93:
            return f"<figure{m}><img src=x><figcaption{m}>{self.words(3, 15)}</figcaption></figure>"
        if kind < 0.96:
            return f"<pre{m}>{self.words(5, 40)}</pre>"
        return f"<div{m}>{self.inline(5, 80)}</div>"

    def around(self, kind: str) -> str:
        r = self.r
        tag = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div", "footer"], "sidebar": ["aside", "div"],
               "notice": ["div", "div", "section", "aside", "p", "dialog"], "ad": ["div", "aside", "ins", "section"], "form": ["form"], "comment": ["section", "div", "ol"], "share": ["div", "ul", "p"]}[kind]
        tag = r.choice(tag)
        bare = 0.25 if tag in ("nav", "header", "footer", "aside", "form") else 1.0 if kind in ("notice", "ad", "comment") else 0.85
        head = f"<{tag}{self.attrs(kind, bare)}>"
        title = f"<h{(k := r.choice('234'))}>{self.words(1, 4)}</h{k}>" if r.random() < 0.4 and tag not in ("ul", "ol", "p", "ins") else ""
        if kind == "nav":
            body = self.items().removeprefix("<ul>").removesuffix("</ul>") if tag == "ul" else self.items()
        elif kind == "header":
            body = f"<h1>{self.words(1, 4)}</h1>" + (f"<p>{self.words(2, 8)}</p>" if r.random() < 0.5 else "") + (self.items() if r.random() < 0.5 else "")
        elif kind == "footer":
            body = r.choice([f"&copy; {self.words(2, 16)}", f"<p>&copy; {self.words(2, 25)}</p>" + self.items(), self.items() + f"<p>{self.words(3, 20)}</p>"])
        elif kind == "sidebar":
            body = title + "".join(r.choice([self.items(), f"<p>{self.words(5, 40)}</p>", f"<div{self.attrs('sidebar')}><h3>{self.words(1, 3)}</h3>{self.items()}</div>"]) for _ in range(r.randint(1, 4)))
        elif kind in ("notice", "ad"):
            text = self.words(*r.choice([(1, 5), (5, 30), (20, 60)]))
            body = title + (text if tag in ("p", "ins") or r.random() < 0.6 else f"<p>{text}</p>") + (f"<button>{self.words(1, 2)}</button>" if kind == "notice" and r.random() < 0.5 else self.link() if r.random() < 0.4 else "")
        elif kind == "form":
            body = title + f"<label>{self.words(1, 4)}</label><input><p>{self.words(2, 20)}</p><button>{self.words(1, 2)}</button>"
        elif kind == "comment":
            one = lambda: f"<p>{self.words(3, 80)}</p>"
            item = "li" if tag == "ol" else r.choice(["div", "article", "li"])
            body = title + "".join(f"<{item}{self.attrs('comment', 0.7)}><span>{self.words(1, 2)}</span>{one()}{one() if r.random() < 0.3 else ''}</{item}>" for _ in range(r.randint(1, 8)))
        else:
            body = "".join(f"<li>{self.link()}</li>" for _ in range(4)) if tag == "ul" else self.link() + self.words(1, 6) + self.link()
        return head + body + f"</{tag}>"

    def page(self) -> str:
        r = self.r
        some = lambda kind, chance: self.around(kind) if r.random() < chance else ""
        blocks = [self.block() for _ in range(r.choice([1, 2, 4, 8, 15, 30]))]
        for kind, chance in (("ad", 0.25), ("share", 0.2), ("form", 0.1), ("sidebar", 0.1), ("notice", 0.08)):
            if r.random() < chance:
                blocks.insert(r.randint(0, len(blocks)), self.around(kind))
        title = f"<h1 data-main>{self.words(1, 12)}</h1>" if r.random() < 0.8 else ""
        if title and r.random() < 0.2:
            title = f"<header>{title}</header>"
        inside = title + "".join(blocks)
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        core = f"<{tag}{self.attrs('main', 0.4 if tag in ('article', 'main') else 0.85)}>{inside}</{tag}>"
        if r.random() < 0.25:
            core = f"<{tag}{self.attrs('main', 0.8)}>{core}{some('comment', 0.5)}</{tag}>"
        for _ in range(r.choice([0, 0, 1, 2])):
            core = f"<div{self.attrs(r.choice(['neutral', 'main']), 0.8)}>{some('nav', 0.1)}{core}{some('sidebar', 0.3)}</div>"
        before = [some("notice", 0.25), some("header", 0.4), some("nav", 0.6), some("ad", 0.35), some("form", 0.15)]
        if r.random() < 0.3:
            r.shuffle(before)
        after = [some("share", 0.15), some("comment", 0.35), some("sidebar", 0.35), some("form", 0.15), some("ad", 0.15), some("notice", 0.1), some("footer", 0.8)]
        end = "" if r.random() < 0.1 else "</body></html>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{''.join(before)}{core}{''.join(after)}{end}"


def training_pages(n: int = 900, seed: int = 7) -> list[str]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]


@cache
def default_model() -> Model:
    return fit(training_pages())


def extracted(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def work(batch: pa.RecordBatch) -> dict:
        texts = shared.value.texts(batch.column("text").to_pylist())
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "out": pa.array(texts, pa.string())}

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("text"))
    found = mapped(rows, work, "page_id long, url string, out string")
    return found.select("page_id", "url", F.col("out").alias("text"), F.length("out").cast("long").alias("n_chars"))
