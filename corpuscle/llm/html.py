"""Main-text extraction: a linear-chain CRF over the leaf blocks of a page's DOM.

A page is cut into leaf blocks, the runs of text between block-level tags. Each block has features of its ancestors'
tags and of the names in their attributes, and of its text, its links and its neighbours. The model is trained on
labelled pages, which ``labelled_pages`` writes in many layouts, and decoded by Viterbi, page by page.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import chain
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .crf import Chains, Crf, Ragged
from .textops import chunks, string_column

BITS = 14
TRAIN_PAGES = 400
SCALE = 1 << 32
GROUP_CHARS = 4 << 20

_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript iframe svg object audio video canvas noembed noframes".split())
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_KEEP_P = ("button", "td", "th", "table", "article", "section", "div", "aside")
_CLOSE_P = _BLOCK - frozenset("body button head html title td th tr tbody thead tfoot caption option optgroup legend li dd dt".split())
#: A tag without < or > in its attributes: by far the most, and one that fails to match costs no look beyond the next of these signs.
_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/<>]*+)([^<>\"']*+(?:\"[^\"<>]*+\"[^<>\"']*+|'[^'<>]*+'[^<>\"']*+)*+)>")
_START = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_VALUE = re.compile(r"=\s*+")
_UNQUOTED = re.compile(r"[^\s>]*+")
_ATTR = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_NAME = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CUES = frozenset(
    "cookie cookies copyright rights reserved privacy terms subscribe newsletter login signup register comment comments reply replies advertisement sponsored share follow related search menu datenschutz impressum kommentar kommentare anzeige anmelden abonnieren derechos privacidad comentario comentarios publicidad suscribirse droits confidentialit commentaire commentaires publicit abonner".split()
)
_SIGNS = re.compile(r"[.!?:;,]")


class Block(NamedTuple):
    """A leaf block: decoded text with single spaces, nearest block tag, characters inside links, and what the elements open where it begins give: their feature numbers, or, in a weighed reading, the exact sum of those features' weights."""

    text: str
    tag: str
    linked: int
    outer: tuple[int, ...] | int


_memo: dict[str, int] = {}


def _slot(name: str) -> int:
    i = _memo.get(name)
    if i is None:
        if len(_memo) > 200_000:
            _memo.clear()
        i = _memo[name] = zlib.crc32(name.encode("utf-8", "replace")) & ((1 << BITS) - 1)
    return i


_attrs_memo: dict[tuple[str, str], tuple[int, ...]] = {}


def _element_features(tag: str, attrs: str) -> tuple[int, ...]:
    """Distinct feature numbers of an element: its tag, if a block's, and the names in its attributes."""
    known = _attrs_memo.get((tag, attrs))
    if known is not None:
        return known
    found = [f"a={tag}"] if tag in _BLOCK and tag not in ("html", "body") else []
    if attrs:
        for _, v in _ATTR.findall(attrs):
            found.extend(f"n={x.lower()}" for x in _NAME.findall(_CAMEL.sub(" ", v.strip("\"'"))))
        if _HIDDEN.search(attrs):
            found.append("n=*hidden")
    out = tuple(dict.fromkeys(_slot(x) for x in found))
    if len(attrs) < 200:
        if len(_attrs_memo) > 20_000:
            _attrs_memo.clear()
        _attrs_memo[tag, attrs] = out
    return out


class _Open:
    """The open elements of a page. Every operation costs what it adds or removes, never the depth: each feature is counted, and the weights of those present are summed in whole numbers, so taking one away undoes adding it exactly."""

    def __init__(self, weights: list[int] | None):
        self.weights = weights
        self.tags: list[str] = []
        self.features: list[tuple[int, ...]] = []
        self.where: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.count: dict[int, int] = {}
        self.total = 0

    def last(self, tags: frozenset[str] | tuple[str, ...]) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def push(self, tag: str, features: tuple[int, ...]) -> None:
        self.where[tag].append(len(self.tags))
        if tag in _BLOCK:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.features.append(features)
        for f in features:
            n = self.count.get(f, 0)
            self.count[f] = n + 1
            if not n and self.weights is not None:
                self.total += self.weights[f]

    def _forget(self, i: int) -> None:
        for f in self.features[i]:
            n = self.count[f] - 1
            if n:
                self.count[f] = n
            else:
                del self.count[f]
                if self.weights is not None:
                    self.total -= self.weights[f]
        self.features[i] = ()

    def cut(self, i: int) -> None:
        """Close everything from place ``i`` inwards."""
        while len(self.tags) > i:
            tag = self.tags.pop()
            if tag:
                self.where[tag].pop()
                if tag in _BLOCK:
                    self.blocks.pop()
            self._forget(len(self.tags))
            self.features.pop()

    def close(self, tag: str) -> None:
        """Close the innermost element of this tag: a block with all inside it, another alone."""
        at = self.where.get(tag)
        if not at:
            return
        if tag in _BLOCK:
            self.cut(at[-1])
        elif at[-1] == len(self.tags) - 1:
            self.cut(at[-1])
        else:
            i = at.pop()
            self._forget(i)
            self.tags[i] = ""

    def outer(self) -> tuple[int, ...] | int:
        return tuple(self.count) if self.weights is None else self.total

    def block(self) -> str:
        return self.tags[self.blocks[-1]] if self.blocks else "none"


def _tag_end(page: str, at: int, absent: set[str]) -> int:
    """Where the tag whose attributes begin at ``at`` ends: the > outside of quoted values; -1 if there is none. A quote that never closes (``absent`` remembers which) quotes nothing."""
    while True:
        end, eq = page.find(">", at), page.find("=", at)
        if end < 0:
            return -1
        if eq < 0 or eq > end:
            return end
        at = _VALUE.match(page, eq).end()
        q = page[at : at + 1]
        if q and q in "\"'" and q not in absent:
            close = page.find(q, at + 1)
            if close >= 0:
                at = close + 1
                continue
            absent.add(q)
        at = _UNQUOTED.match(page, at).end()


def leaf_blocks(page: str, weights: list[int] | None = None) -> list[Block]:
    """The non-empty leaf blocks of a page, in order, in one pass that never goes back: time and memory follow the page's length, however broken or deep it is.

    A tag that never ends takes the rest of the page with it, as in browsers. Inline elements left open end with the block they stand in."""
    out: list[Block] = []
    open_ = _Open(weights)
    parts: list[str] = []
    linked: list[str] = []
    outer: list[Any] = []
    absent: set[str] = set()
    at, n = 0, len(page)
    links = open_.where["a"]

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, open_.block(), len(" ".join(unescape("".join(linked)).split())) if linked else 0, outer[0]))
            parts.clear()
            outer.clear()
            linked.clear()

    def add(piece: str) -> None:
        if piece:
            parts.append(piece)
            if links:
                linked.append(piece)
            if not outer and not piece.isspace():
                outer.append(open_.outer())

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        m = _PLAIN.match(page, lt)
        if m:
            closing, tag, attrs = m.groups()
            at = m.end()
        else:
            m = _START.match(page, lt)
            if not m:
                if page.startswith("<!--", lt):
                    at = _COMMENT.match(page, lt).end()
                elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                    end = page.find(">", lt)
                    at = end + 1 if end >= 0 else n
                else:
                    add("<")
                    at = lt + 1
                continue
            end = _tag_end(page, m.end(), absent)
            if end < 0:
                break
            closing, tag = m.groups()
            attrs = page[m.end() : end]
            at = end + 1
        tag = tag.lower()
        if closing:
            if tag in _BLOCK:
                flush()
            open_.close(tag)
            continue
        if tag in _RAW and not attrs.endswith("/"):
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            at = found.end() if found else n
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            if tag in _CLOSE_P:
                p = open_.last(("p",))
                if p >= 0 and p > open_.last(_KEEP_P):
                    open_.cut(p)
            if tag in _CLOSES:
                ends, stop = _CLOSES[tag]
                bound = open_.last(stop)
                first = [w[i] for w in (open_.where[t] for t in ends if open_.where.get(t)) if (i := bisect_right(w, bound)) < len(w)]
                if first:
                    open_.cut(min(first))
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            continue
        open_.push(tag, _element_features(tag, attrs))
    flush()
    return out


def _bin(x: float, edges: tuple[float, ...]) -> int:
    i = 0
    for e in edges:
        if x < e:
            break
        i += 1
    return i


@lru_cache(1 << 16)
def _own(tag: str, length: int, links: int) -> list[int]:
    return [_slot(x) for x in ("bias", f"t={tag}", f"l={length}", f"k={links}", f"lk={length},{links}", f"tl={tag},{length}", f"tk={tag},{links}")]


@lru_cache(1 << 16)
def _beside(side: str, tag: str, length: int, links: int) -> list[int]:
    return [_slot(f"{side}t={tag}"), _slot(f"{side}l={length},{links}")]


def _numbers(blocks: list[Block]) -> list[list[int]]:
    """The feature numbers of each block but those of its open elements."""
    out = []
    n = len(blocks)
    own = [(b.tag, _bin(len(b.text), (20, 40, 80, 160, 320)), _bin(b.linked / len(b.text), (0.01, 0.3, 0.7))) for b in blocks]
    for i, b in enumerate(blocks):
        f = list(_own(*own[i]))
        f.append(_slot(f"s={_bin(len(_SIGNS.findall(b.text)), (1, 2, 4))}"))
        f.append(_slot(f"e={b.text[-1] in '.!?…。！？'}"))
        f.append(_slot(f"p={_bin(i / n, (0.1, 0.3, 0.7, 0.9))}"))
        if b.text[0] in "©|»›•" or "©" in b.text:
            f.append(_slot("copy"))
        if not _CUES.isdisjoint(_NAME.findall(b.text.lower())):
            f.append(_slot(f"cue={own[i][1]}"))
        f += _beside("b", *(own[i - 1] if i else ("start", 9, 9)))
        f += _beside("a", *(own[i + 1] if i + 1 < n else ("end", 9, 9)))
        out.append(f)
    return out


def _ragged(rows: list[list[int]]) -> Ragged:
    return Ragged(np.fromiter(chain.from_iterable(rows), np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))


def features(blocks: list[Block]) -> Ragged:
    """All feature numbers of blocks read without weights: their own and, however many, those of the elements around them."""
    return _ragged(_all_numbers(blocks))


def _all_numbers(blocks: list[Block]) -> list[list[int]]:
    return [x + list(b.outer) for x, b in zip(_numbers(blocks), blocks, strict=True)]


def labelled_pages(n: int, seed: int = 11) -> Iterator[tuple[list[Block], list[int]]]:
    """Pages in random layouts whose blocks are known to be article (1) or not (0): the labels are marks in the text, removed before use."""
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda: "".join(pick(("ba", "ko", "ri", "ne", "tu", "la", "so", "me", "di", "ver", "an", "th")) for _ in range(rng.randrange(1, 4)))

    cue_words = sorted(_CUES)

    def text(lo: int, hi: int, stop: str = ".", cues: float = 0.08) -> str:
        w = [word() for _ in range(rng.randrange(lo, hi))]
        for i in range(len(w)):
            if rng.random() < 0.12:
                w[i] += pick((",", ".", ".", ";"))
        if rng.random() < cues:
            w[rng.randrange(len(w))] = pick(cue_words)
        return (" ".join(w)).capitalize() + stop

    good = lambda s: "\ue001" + s
    bad = lambda s: "\ue000" + s
    wrap = lambda tag, attr, inner: f"<{tag}{' ' + attr if attr else ''}>{inner}</{tag}>"
    attr = lambda *xs: pick(("class", "id", "class", "class")) + f'="{pick(xs)}"'
    links = lambda lo, hi: "".join(wrap("li", "", wrap("a", f'href="/{word()}"', bad(text(1, 4, "")))) for _ in range(rng.randrange(lo, hi)))
    prose = lambda: bad(text(*pick(((3, 9), (8, 30), (20, 60), (1, 4, ""))), cues=0.3))

    def noise(kind: str) -> str:
        if kind == "nav":
            return wrap(pick(("nav", "nav", "div", "menu")), pick(("", attr("nav", "navbar", "menu", "main-menu", "breadcrumb", "breadcrumbs", "navigation", "topnav"), 'role="navigation"')), wrap("ul", attr("menu", "nav-list") if rng.random() < 0.3 else "", links(2, 9))) if rng.random() < 0.8 else wrap("nav", "", " ".join(wrap("a", 'href="/x"', bad(text(1, 3, ""))) for _ in range(4)))
        if kind == "header":
            return wrap("header", pick(("", attr("site-header", "header", "masthead", "top"), 'role="banner"')), wrap(pick(("div", "p", "h2", "h1")), "", prose()) + (wrap("p", "", prose()) if rng.random() < 0.5 else ""))
        if kind == "footer":
            inner = wrap("p", "", prose()) + (wrap("ul", "", links(1, 5)) if rng.random() < 0.4 else "")
            return wrap(pick(("footer", "footer", "div")), attr("footer", "site-footer", "bottom", "colophon", "copyright"), pick((inner, bad("&copy; 2020 " + text(2, 12)), bad("© " + text(5, 20))))) if rng.random() < 0.5 else wrap("footer", "", pick((inner, bad("&copy; " + text(2, 25)))))
        if kind == "side":
            return wrap(pick(("aside", "aside", "div", "section")), attr("sidebar", "side", "widget", "related", "recommended", "popular", "most-read", "rail", "secondary"), wrap(pick(("h2", "h3", "h4")), "", bad(text(1, 4, ""))) + wrap("ul", "", links(2, 6)) + (wrap("p", "", prose()) if rng.random() < 0.6 else "")) if rng.random() < 0.7 else wrap("aside", "", wrap("p", "", prose()) * 1 + (wrap("p", "", prose()) if rng.random() < 0.4 else ""))
        if kind == "ad":
            return wrap(pick(("div", "div", "section", "aside", "p", "span")), attr("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "adbox", "sponsor"), pick((prose(), wrap("p", "", prose()), wrap("a", 'href="/b"', prose()))))
        if kind == "notice":
            return wrap(pick(("div", "div", "section", "dialog")), pick((attr("cookie", "cookie-banner", "cookie-notice", "consent", "notice", "gdpr", "alert", "popup", "modal", "paywall", "newsletter", "subscribe", "disclaimer"), 'role="alert"', 'role="dialog"')), wrap("p", "", prose()) + (wrap("button", "", bad(text(1, 3, ""))) if rng.random() < 0.5 else ""))
        if kind == "form":
            return wrap("form", pick(("", attr("search", "login", "signup", "newsletter-form", "contact"))), wrap("label", "", bad(text(1, 4, ""))) + "<input type=text>" + (wrap("p", "", prose()) if rng.random() < 0.4 else "") + wrap("select", "", "".join(wrap("option", "", bad(text(1, 3, ""))) for _ in range(3))) * rng.randrange(0, 2) + wrap("button", "", bad(text(1, 3, ""))))
        if kind == "comments":
            each = lambda: wrap(pick(("div", "li", "article", "section")), attr("comment", "reply", "comment-body"), pick((prose(), wrap("p", "", prose()), wrap("span", 'class="author"', bad(text(1, 3, ""))) + wrap("p", "", bad(text(5, 40))))))
            return wrap(pick(("section", "div", "ol")), attr("comments", "comment-list", "disqus", "replies", "discussion", "respond", "reader-comments"), (wrap(pick(("h2", "h3")), "", bad(text(1, 4, ""))) if rng.random() < 0.6 else "") + "".join(each() for _ in range(rng.randrange(1, 5))))
        return wrap(pick(("div", "ul", "p")), attr("share", "social", "sharing", "tags", "meta", "byline", "author-info", "pagination", "toolbar"), bad(text(2, 8, "")))

    kinds = ("nav", "header", "footer", "side", "ad", "notice", "form", "comments", "misc")

    def article() -> str:
        body = []
        if rng.random() < 0.8:
            h = wrap("h1", "", good(text(2, 12, pick(("", "", ".")))))
            body.append(wrap("header", "", h) if rng.random() < 0.1 else h)
        for _ in range(1 if rng.random() < 0.1 else rng.randrange(1, 14)):
            r = rng.random()
            para = text(*pick(((2, 8), (8, 25), (20, 80), (60, 160))), pick((".", ".", ".", ".", "!", "?", "")))
            if r < 0.66:
                if rng.random() < 0.15:
                    para = para.replace(" ", pick((" <b>x</b> ", ' <a href="/y">link</a> ')), 1)
                body.append(f"<p>{'<b>' if rng.random() < 0.15 else ''}{good(para)}{pick(('</p>', '</p>', '</p>', '<br>'))}")
            elif r < 0.76:
                body.append(wrap(pick(("h2", "h3", "h4")), "", good(text(1, 8, ""))))
            elif r < 0.82:
                body.append(wrap(pick(("ul", "ol")), "", "".join(wrap("li", "", good(text(3, 20, pick((".", ""))))) for _ in range(rng.randrange(2, 6)))))
            elif r < 0.86:
                body.append(wrap("blockquote", "", wrap("p", "", good(text(8, 40)))))
            elif r < 0.88:
                body.append(wrap("table", "", "".join(wrap("tr", "", "".join(wrap("td", "", good(text(1, 5, ""))) for _ in range(3))) for _ in range(2))))
            elif r < 0.90:
                body.append(wrap("figure", "", "<img src=a>" + wrap("figcaption", "", good(text(4, 15)))))
            elif r < 0.91:
                body.append(wrap("pre", "", good(text(4, 30))))
            else:
                body.append(noise(pick(("ad", "side", "misc", "notice", "form"))))
        if rng.random() < 0.1:
            body.append(noise("comments"))
        inner = "".join(body)
        layout = rng.random()
        if layout < 0.5:
            return wrap("article", pick(("", "", attr("post", "article", "story", "entry"))), inner)
        if layout < 0.65:
            return wrap("main", pick(("", attr("content", "main"))), inner if rng.random() < 0.5 else wrap("article", "", inner))
        return wrap("div", pick((attr("content", "post", "entry-content", "article-body", "story", "post-body", "main-content", "text", "article"), 'role="main"', 'itemprop="articleBody"')), inner)

    for _ in range(n):
        before = [noise(pick(kinds if rng.random() < 0.4 else ("nav", "header", "ad", "notice"))) for _ in range(0 if rng.random() < 0.2 else rng.randrange(0, 5))]
        after = [noise(pick(kinds if rng.random() < 0.6 else ("footer", "comments", "side", "form"))) for _ in range(0 if rng.random() < 0.2 else rng.randrange(0, 5))]
        title = f"<title>{bad(text(2, 12, ''))}</title>" if rng.random() < 0.8 else ""
        page = f"<!DOCTYPE html><html><head>{title}<style>p{{}}</style></head><body>" + "".join(before) + article() + "".join(after) + "</body></html>"
        if rng.random() < 0.1:
            page = page[: int(len(page) * (0.5 + rng.random() / 2))]
        blocks, labels = [], []
        for b in leaf_blocks(page):
            marks = [c for c in b.text if c in "\ue000\ue001"]
            clean = " ".join(b.text.replace("\ue000", "").replace("\ue001", "").split())
            if clean:
                blocks.append(b._replace(text=clean, linked=min(b.linked, len(clean))))
                labels.append(int(marks[0] == "\ue001") if marks else (labels[-1] if labels else 0))
        if blocks:
            yield blocks, labels


def train(pages: Iterator[tuple[list[Block], list[int]]] | None = None) -> Crf:
    """Fit the model on labelled pages, by default TRAIN_PAGES written ones, and then only once in a process."""
    return _fit(pages) if pages is not None else _default()


@lru_cache(1)
def _default() -> Crf:
    return _fit(labelled_pages(TRAIN_PAGES))


def _fit(pages: Iterator[tuple[list[Block], list[int]]]) -> Crf:
    xs, ys, per = [], [], []
    for blocks, labels in pages:
        xs.extend(_all_numbers(blocks))
        ys.extend(labels)
        per.append(len(blocks))
    model = Crf(1 << BITS)
    model.fit(_ragged(xs), Chains(np.array(per)), np.array(ys), steps=70, rate=0.2, l2=1e-4)
    return model


def extract(model: Crf, page: str | None) -> str:
    """The article's text: its blocks in page order, joined by two newlines."""
    return _extract_all(model, _whole(model), [page])[0]


def _whole(model: Crf) -> list[int]:
    """The model's weights as whole numbers of 1 / SCALE."""
    return np.rint(model.w * SCALE).astype(np.int64).tolist()


def _extract_all(model: Crf, weights: list[int], pages: list[str | None]) -> list[str]:
    blocks = [leaf_blocks(p, weights) if p else [] for p in pages]
    per = np.array([len(b) for b in blocks], np.int64)
    if not per.sum():
        return [""] * len(pages)
    u = model.unary(_ragged([f for b in blocks for f in _numbers(b)])) + np.array([b.outer for p in blocks for b in p]) / SCALE
    y = model.viterbi(u, Chains(per))
    out, at = [], 0
    for b in blocks:
        out.append("\n\n".join(t.text for t, k in zip(b, y[at : at + len(b)], strict=True) if k))
        at += len(b)
    return out


def extract_pages(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """The main text of every page: ``page_id, url, text, n_chars``, one row for each input row.

    The whole html is read, however long, in time proportional to its length; a null or empty page, or one without an
    article, gives '' and 0, an empty table no rows. ``n_chars`` counts code
    points. White space (any, after character references are decoded) becomes one space inside a block. Broken markup
    doesn't fail: an unclosed tag or comment runs to the end, an unfinished reference stays as it is. Null ids and urls
    pass through, repeated rows repeat, other columns are ignored. One scan, no shuffle; the model is 130 kB.
    """
    held: Any = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _whole(held.value)
        for batch in batches:
            _, offs = string_column(batch.column("html"))
            for a, b in chunks(offs, GROUP_CHARS):
                cut = batch.slice(a, b - a)
                text = _extract_all(held.value, weights, cut.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([cut.column("page_id"), cut.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
