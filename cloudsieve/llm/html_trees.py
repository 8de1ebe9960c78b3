"""Main-text extraction: gradient-boosted trees over DOM nodes and a hierarchical decoding.

A page is parsed into a tree of elements. Boosted trees give every element a probability of belonging to the article,
from tags, attribute tokens, depth, densities of its subtree and how it compares with its siblings. The decoding chooses the most
probable labelling in which the article is a connected part of a branch: outside, then article, then excluded inside
it, never back; so an advert in an article drops with all it holds, and nothing inside a menu can be article.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, text_of, without

#: Elements scored together.
NODES = 20_000
PAGES, TREES, DEPTH, RATE, BINS = 260, 70, 4, 0.25, 32

# ---- fixed values ---------------------------------------------------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split())
#: What an opening tag ends: the same kind of item, up to its list or table.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "option": ({"option"}, {"select"})}
GROUPS = {
    "main": "article articlebody content entry main post story text body page single hentry",
    "nav": "nav navigation navbar menu menubar breadcrumb breadcrumbs toc pager pagination tabs links",
    "head": "header head masthead banner logo top topbar brand toolbar",
    "foot": "footer foot bottom copyright legal imprint colophon",
    "side": "sidebar aside side widget widgets rail related recommended trending popular teaser more tags author bio",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted banner dfp adsense adslot",
    "notice": "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe gdpr privacy paywall warning message",
    "comment": "comment comments discussion disqus reply replies respond reader readers feedback reviews",
    "form": "form search login signup register contact input button",
    "share": "share sharing social follow like likes buttons icons",
}
LONG_WORDS = ("comment", "cookie", "sidebar", "footer", "header", "advert", "sponsor", "newsletter", "related", "navigation",
              "discussion", "breadcrumb", "article", "content", "share", "social", "search", "promo")
TAG_GROUPS = {"article": "main", "main": "main", "nav": "nav", "menu": "nav", "header": "head", "footer": "foot", "aside": "side",
              "form": "form", "input": "form", "button": "form", "select": "form", "textarea": "form", "label": "form",
              "fieldset": "form", "option": "form", "dialog": "notice"}
HIDDEN = frozenset("head title script style noscript template svg iframe object canvas select textarea button".split())

# ---- parsing --------------------------------------------------------------------------------------------------------

_NAMES = list(GROUPS)
_BIT = {w: 1 << i for i, g in enumerate(_NAMES) for w in GROUPS[g].split()}
_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)|[!?][^>]*(?:>|\Z))", re.S)
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_TAG_KINDS = {t: i for i, t in enumerate(
    "html body div section article main p h1 h2 h3 ul ol li a b span table tr td blockquote pre figure nav header footer aside form".split(), 1)}
FEATURES = 20 + 2 * len(_NAMES)


@lru_cache(maxsize=1 << 14)
def _words(value: str) -> int:
    mask = 0
    for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
        mask |= _BIT.get(w, 0)
        if not _BIT.get(w):
            for long in LONG_WORDS:
                if w.startswith(long):
                    mask |= _BIT[long]
    return mask


class Page:
    """Elements in page order, and blocks: lists of (element, decoded text)."""

    def __init__(self, source: str):
        self.parent, self.tags, self.masks, self.marked = [-1], ["#page"], [0], [False]
        self.blocks: list[list[tuple[int, str]]] = []
        self._block: list[tuple[int, str]] = []
        self._stack = [0]
        # places in the stack of the open elements of each name, and of all that end a block
        self._places: dict[str, list[int]] = {}
        self._breaking: list[int] = []
        self._parse(source)
        self._flush()

    def _flush(self) -> None:
        if self._block:
            self.blocks.append(self._block)
            self._block = []

    def _text(self, text: str) -> None:
        if text:
            self._block.append((self._stack[-1], html.unescape(text) if "&" in text else text))

    def _close(self, names, stop=frozenset()) -> None:
        """Close the innermost open element of these names, unless one of ``stop`` is nearer."""
        k = max((self._places[n][-1] for n in names if self._places.get(n)), default=0)
        if not k or any(self._places[n][-1] > k for n in stop if self._places.get(n)):
            return
        if self._breaking and self._breaking[-1] >= k:
            self._flush()
        for element in self._stack[k:]:
            self._places[self.tags[element]].pop()
        while self._breaking and self._breaking[-1] >= k:
            self._breaking.pop()
        del self._stack[k:]

    def _open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._flush()
        if tag in CLOSES_P:
            self._close({"p"}, {"button", "table", "td", "th", "object"})
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        mask, marked = 0, False
        if attributes:
            for m in _NAMED.finditer(attributes):
                mask |= _words(m[1] or m[2] or m[3] or "")
            marked = "data-article" in attributes
        if tag == "br":
            self._block.append((self._stack[-1], " "))
            return
        group = TAG_GROUPS.get(tag)
        if group:
            mask |= 1 << (len(_NAMES) + _NAMES.index(group))
        self.parent.append(self._stack[-1])
        self.tags.append(tag)
        self.masks.append(mask)
        self.marked.append(marked)
        if tag not in VOID:
            self._places.setdefault(tag, []).append(len(self._stack))
            if tag not in INLINE:
                self._breaking.append(len(self._stack))
            self._stack.append(len(self.tags) - 1)

    def _parse(self, source: str) -> None:
        at = 0
        while m := _TOKEN.search(source, at):
            self._text(source[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            rest = _ATTRIBUTES.match(source, at)
            end = rest.end() if rest else (source.find(">", at) + 1 or len(source))
            tag, attributes = m[2].lower(), source[at:end - 1]
            at = end
            if m[1]:
                if tag == "p" and not self._places.get("p"):
                    self._flush()
                self._close({tag}, frozenset() if tag not in INLINE else CLOSES_P - {"p"})
            else:
                self._open(tag, attributes)
                if tag in RAW:
                    close = re.compile(f"</{tag}", re.I).search(source, at)
                    at = close.start() if close else len(source)
        self._text(source[at:])

    def features(self) -> np.ndarray:
        n = len(self.tags)
        own, marks, pieces = [0] * n, [0] * n, [0] * n
        for block in self.blocks:
            for node, text in block:
                size = len(text) - text.count(" ") - text.count("\n")
                own[node] += size
                pieces[node] += size > 0
                marks[node] += text.count(".") + text.count(",")
        depth, masks, linked = [0] * n, list(self.masks), [False] * n
        order, seen = [0] * n, [0] * n
        for i in range(1, n):
            p = self.parent[i]
            depth[i] = depth[p] + 1
            linked[i] = linked[p] or self.tags[i] == "a"
            masks[i] |= masks[p]
            order[i] = seen[p]
            seen[p] += 1
        total, links, stops, count, paragraphs, listed, fields = (
            list(own), [o if l else 0 for o, l in zip(own, linked)], list(marks), [1] * n,
            [int(t == "p") for t in self.tags], [int(t in ("li", "a")) for t in self.tags],
            [int(TAG_GROUPS.get(t) == "form") for t in self.tags])
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            for x in (total, links, stops, count, paragraphs, listed, fields):
                x[p] += x[i]
        parent = np.maximum(np.array(self.parent), 0)
        total, links, stops, count, paragraphs, listed, fields, own_, depth, order, seen = (
            np.array(x, np.float32) for x in (total, links, stops, count, paragraphs, listed, fields, own, depth, order, seen))
        whole, brothers = max(float(total[0]), 1.0), np.maximum(seen[parent], 1)
        kinds = np.array([_TAG_KINDS.get(t, 0) for t in self.tags], np.float32)
        hidden = np.array([t in HIDDEN for t in self.tags], np.float32)
        inline = np.array([t in INLINE for t in self.tags], np.float32)
        columns = [
            kinds, hidden, inline, depth, total, own_, total / whole, links / (total + 1), stops / (total + 1) * 50, count,
            total / count, paragraphs, paragraphs / count, listed / count, fields, order, brothers, order / brothers,
            total / (total[parent] + 1), total - total[parent] / brothers]
        bits = np.array(masks, np.int64)
        mine = np.array(self.masks, np.int64)
        columns += [(((mine >> i) | (mine >> (i + len(_NAMES)))) & 1).astype(np.float32) for i in range(len(_NAMES))]
        columns += [(((bits >> i) | (bits >> (i + len(_NAMES)))) & 1).astype(np.float32) for i in range(len(_NAMES))]
        return np.stack(columns, 1)

    def article(self, chance: np.ndarray) -> list[bool]:
        """Elements that are article in the best labelling (outside, article, excluded) given their chances."""
        chance = np.clip(chance, 1e-6, 1 - 1e-6)
        yes, no = np.log(chance).tolist(), np.log1p(-chance).tolist()
        outside, inside, excluded = list(no), list(yes), list(no)
        for i in range(len(self.tags) - 1, 0, -1):
            p = self.parent[i]
            outside[p] += max(outside[i], inside[i])
            inside[p] += max(inside[i], excluded[i])
            excluded[p] += excluded[i]
        state = [0] * len(self.tags)
        state[0] = int(inside[0] > outside[0]) if len(self.tags) > 1 else 1
        for i in range(1, len(self.tags)):
            up = state[self.parent[i]]
            state[i] = 2 if up == 2 else (1 if inside[i] >= excluded[i] else 2) if up else int(inside[i] > outside[i])
        return [s == 1 for s in state]

    def text(self, chosen: list[bool]) -> str:
        lines = (_SPACE.sub(" ", "".join(t for i, t in block if chosen[i])).strip(" ") for block in self.blocks)
        return "\n".join(x for x in lines if x)


# ---- labelled pages -------------------------------------------------------------------------------------------------

SYLLABLES = "the and of ti on er ha en re st ou le que de ei un ch ie ga lo mi ño".split()


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[str]:
    """Pages by rule in many layouts; article elements carry ``data-article``, which no feature reads."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(3, 18).capitalize() + r.choice("....!?")
    prose = lambda a, b: " ".join(sentence() for _ in range(r.randint(a, b)))
    mark = " data-article"

    def name(group: str, chance: float = 0.8) -> str:
        if r.random() > chance:
            return ""
        token = r.choice(GROUPS[group].split())
        token = r.choice((token, f"site-{token}", f"{token}-{word()}", f"{token} {word()}"))
        return f' {r.choice(("class", "class", "id"))}="{token}"'

    def box(group: str, tags: str, inner: str) -> str:
        tag = r.choice(tags.split())
        return f"<{tag}{name(group, 0.9 if tag in ('div', 'section', 'ul') else 0.3)}>{inner}</{tag}>"

    links = lambda a, b: "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(r.randint(a, b))) + "</ul>"

    def advert() -> str:
        return r.choice(("", f"<!-- ad {r.randint(0, 99)} -->")) + f'<{(t := r.choice(("div", "div", "aside", "section")))}{name("advert", 1)}>' + \
            r.choice((sentence(), f"<p>{sentence()}</p>", f'<a href="/x">{words(2, 6)}</a>')) + f"</{t}>"

    def comments() -> str:
        one = lambda: f'<{(t := r.choice(("div", "li", "article")))}{name("comment", 0.7)}><b>{word()}</b><p>{prose(1, 4)}</p></{t}>'
        return f'<{(t := r.choice(("section", "div")))}{name("comment", 1)}>' + f"<h3>{words(1, 2)}</h3>" * r.randint(0, 1) + \
            "".join(one() for _ in range(r.randint(1, 6))) + f"</{t}>"

    def form() -> str:
        return f'<form{name("form", 0.5)}><label>{words(1, 3)}</label><input type="text"><button>{word()}</button></form>'

    def paragraph() -> str:
        inner = prose(1, 7)
        kind = r.random()
        if kind < 0.15:
            return f"<p{mark}><b{mark}>{inner}<br>"
        if kind < 0.3:
            return f'<p{mark}>{inner} <a{mark} href="/{word()}">{words(1, 3)}</a> {sentence()}</p>'
        if kind < 0.4:
            return f"<p{mark}>{inner} <em{mark}>{words(1, 4)}</em>.</p>"
        return f"<p{mark}>{inner}</p>" if kind < 0.9 else f"<p{mark}>{inner}"

    def body() -> str:
        parts = [f"<h1{mark}>{words(1, 9)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.06:
                parts.append(f"<ul{mark}>" + "".join(f"<li{mark}>{sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.1:
                parts.append(f"<blockquote{mark}><p{mark}>{prose(1, 2)}</p></blockquote>")
            elif kind < 0.13:
                parts.append(f"<pre{mark}>{words(3, 12)}</pre>")
            elif kind < 0.16:
                parts.append(f"<table{mark}><tr{mark}><td{mark}>{words(1, 3)}</td><td{mark}>{word()}</td></tr></table>")
            elif kind < 0.22:
                parts.append(f"<h2{mark}>{words(1, 6)}</h2>")
            elif kind < 0.27:
                parts.append(advert())
            elif kind < 0.3:
                parts.append(box("share", "div ul", links(2, 4)))
            elif kind < 0.33:
                parts.append(box("side", "aside div", f"<h3>{words(1, 2)}</h3>" + links(2, 5)))
            parts.append(paragraph())
        if r.random() < 0.15:
            parts.append(comments())
        if r.random() < 0.1:
            parts.append(form())
        return "".join(parts)

    def main() -> str:
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        return f"<{tag}{mark}{name('main', 1 if tag in ('div', 'section') else 0.3)}>{body()}</{tag}>"

    out = []
    for _ in range(n):
        parts = []
        if r.random() < 0.4:
            parts.append(box("head", "header header div", r.choice((f"<h2>{words(1, 3)}</h2>", f"<a href='/'>{word()}</a>", f"<p>{sentence()}</p>", f"<h1>{words(1, 3)}</h1>"))))
        if r.random() < 0.8:
            parts.append(box("nav", "nav nav div ul", links(3, 9)))
        if r.random() < 0.3:
            parts.append(box("notice", "div div section dialog", f"<p>{prose(1, 3)}</p>" + r.choice(("", f"<button>{word()}</button>"))))
        if r.random() < 0.5:
            parts.append(advert())
        middle = main()
        if r.random() < 0.35:
            side = box("side", "aside div", f"<h3>{words(1, 3)}</h3>" + r.choice((links(3, 8), f"<p>{prose(1, 3)}</p>")))
            middle = r.choice((middle + side, side + middle))
        if r.random() < 0.3:
            middle = f'<div{r.choice(("", " class=wrapper", " id=container"))}>{middle}</div>'
        parts.append(middle)
        if r.random() < 0.3:
            parts.append(comments())
        if r.random() < 0.2:
            parts.append(form())
        if r.random() < 0.85:
            parts.append(box("foot", "footer footer div", r.choice(("", "<p>")) + f"&copy; {word()}.example &middot; {prose(1, 2)}"))
        out.append(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{words(1, 6)}</title><style>p{{margin:0}}</style>'
                   f'<script>var t="</p>";</script></head><body>{"".join(parts)}' + r.choice(("</body></html>", "")))
    return out


# ---- boosted trees --------------------------------------------------------------------------------------------------

def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> dict:
    """Newton-boosted complete trees on binned features; arrays (feature, threshold, leaf) and the base score."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    score = np.full(len(y), base)
    inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, 1 << depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            wide, first = 1 << level, (1 << level) - 1
            best = np.full(wide, 1e-3)
            pick_f, pick_b = np.zeros(wide, np.int64), np.full(wide, BINS)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                at = (node - first) * (BINS + 1) + binned[:, f]
                gs, hs = (np.bincount(at, v, wide * (BINS + 1)).reshape(wide, -1).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs ** 2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt ** 2 / (ht + 1)
                gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                b = gain[:, :len(e)].argmax(1)
                top = gain[np.arange(wide), b]
                better = top > best
                best[better], pick_f[better], pick_b[better] = top[better], f, b[better]
            for k in range(wide):
                if pick_b[k] < BINS:
                    feature[t, first + k], threshold[t, first + k] = pick_f[k], edges[pick_f[k]][pick_b[k]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), pick_f[node - first]] > pick_b[node - first])
        at = node - inner
        leaf[t] = -RATE * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + 1)
        score += leaf[t][at]
    return {"feature": feature, "threshold": threshold, "leaf": leaf, "base": base}


def chances(model: dict, x: np.ndarray) -> np.ndarray:
    score, rows = np.full(len(x), model["base"]), np.arange(len(x))
    inner = model["feature"].shape[1]
    for feature, threshold, leaf in zip(model["feature"], model["threshold"], model["leaf"]):
        node = np.zeros(len(x), np.int64)
        while node.size and node[0] < inner:
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        score += leaf[node - inner]
    return 1 / (1 + np.exp(-score))


@lru_cache(maxsize=1)
def trained() -> dict:
    pages = [Page(p) for p in labelled_pages()]
    return boost(np.concatenate([p.features() for p in pages]), np.concatenate([np.array(p.marked, float) for p in pages]))


def main_texts(sources: list[str], model: dict) -> list[str]:
    """The main text of each page; elements of many pages are scored together."""
    out: list[str] = []
    pages: list[Page] = []
    size = 0

    def flush():
        nonlocal pages, size
        if pages:
            parts = [p.features() for p in pages]
            got = np.split(chances(model, np.concatenate(parts)), np.cumsum([len(p) for p in parts])[:-1])
            out.extend(p.text(p.article(c)) for p, c in zip(pages, got))
        pages, size = [], 0
    for s in sources:
        pages.append(Page(s))
        size += len(pages[-1].tags)
        if size >= NODES:
            flush()
    flush()
    return out


def _text_batches(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            texts = main_texts(batch.column(batch.num_columns - 1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())],
                                             names=[*batch.schema.names[:-1], "text"])
    return run


def extract(pages: DataFrame, html_col: str = "html", model: dict | None = None) -> DataFrame:
    """``pages`` with ``text``: the article's blocks in page order, one per line.

    Character references are decoded; runs of ASCII white space in a block and line-break elements become one space; inline elements
    stay in their block. Null or empty pages, and pages without article, have empty text; a source without any element is one
    block of text. Malformed markup is closed as browsers do. No shuffle. Repeated rows get equal texts; an empty table gives no
    rows. An input column ``text`` is replaced, all others pass through.
    """
    kept = without(pages, ["text"])
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    source, = fresh(pages, "_whole_page")
    rows = pages.withColumn(source, text_of(html_col)).select(*[F.col(quoted(c)) for c in kept.columns], F.col(source))
    schema = ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in kept.schema), "text string"])
    return rows.mapInArrow(_text_batches(shared), schema)
