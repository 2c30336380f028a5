"""A small wikitext parser: markup in, plain text with links out. Pure Python, no Spark.

It knows templates, tables, comments, internal and external links, tags, headings and character references, nested as
they come. Broken markup never fails: what can't be read as markup is text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Callable
from typing import NamedTuple

from .titles import category_pattern, media_pattern

_INVISIBLE = frozenset("categorytree ce chem gallery graph hiero imagemap inputbox math maplink mapframe score section syntaxhighlight source templatedata timeline ref references table script style".split())
_RAW = frozenset("nowiki pre math syntaxhighlight source score timeline gallery chem ce hiero graph imagemap inputbox templatedata".split())
_SINGLE = frozenset("br hr wbr img".split())
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?)(/?)>")
_HEADING = re.compile(r"^(={1,6})(.+?)\1[ \t]*$", re.M)
_URL = re.compile(r"\[((?:https?:|ftp:|mailto:|//)[^\s\]]+)(?:[ \t]+([^\]\n]*))?\]")
_QUOTES = re.compile(r"''+")
_SWITCH = re.compile(r"__[A-Z]{3,}__")


class Link(NamedTuple):
    title: str
    text: str
    start: int
    end: int


class Paragraph(NamedTuple):
    text: str
    links: list[Link]
    abstract: bool


def _clean_title(raw: str) -> str:
    title = _plain(raw).strip(" ")
    title = title.removeprefix(":")
    rest = title[1:].replace("_", " ")
    return title[:1].replace("_", " ").upper() + rest


class _Pairs:
    """Where balanced pairs that open in a text end, each kind found in one pass with a stack when first asked for.

    In a run of one sign the pairs of signs are counted from its inner end: from its right end for openings, from its left
    one for closings."""

    def __init__(self, text: str):
        self.text = text
        self.ends: dict[str, dict[int, int]] = {}
        self.run = (0, 0)
        self.tags: dict[str, tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]] = {}

    def end(self, at: int, opening: str, closing: str) -> int:
        """The end of the pair that opens at ``at``, -1 if it isn't closed."""
        if opening not in self.ends:
            self.ends[opening] = self._scan(opening, closing)
        if opening[0] == opening[1]:  # a place off by one in a run stands for the opening as far from the run's end
            if not self.run[0] <= at < self.run[1]:
                stop = at
                while self.text.startswith(opening[0], stop):
                    stop += 1
                self.run = (at, stop)
            stop = self.run[1]
            at = stop - 2 * ((stop - at) // 2)
        return self.ends[opening].get(at, -1)

    def _scan(self, opening: str, closing: str) -> dict[int, int]:
        found: dict[int, int] = {}
        stack: list[int] = []
        same = opening[0] == opening[1]
        more = "+" if same else ""
        for m in re.finditer(f"{re.escape(opening)}{'(?:' + re.escape(opening[0]) + ')*' if same else ''}|{re.escape(closing)}{more and '(?:' + re.escape(closing[0]) + ')*'}", self.text):
            a, b = m.span()
            if m.group().startswith(opening):
                stack.extend(range(b - 2 * ((b - a) // 2), b, 2) if same else [a])
            else:
                for end in range(a + 2, b + 1, 2):
                    if stack:
                        found[stack.pop()] = end
        return found


    def element(self, name: str, at: int, nests: bool) -> tuple[int, int] | None:
        """Where the closing tag begins and ends of the element whose opening tag ends at ``at``; None if it isn't closed. In one that doesn't nest, the next closing tag counts."""
        closings, partner = self._elements(name)
        if nests:
            return partner.get(at)
        i = bisect_left(closings, (at, at))
        return closings[i] if i < len(closings) else None

    def closes_after(self, name: str, at: int) -> bool:
        closings, _ = self._elements(name)
        return bool(closings) and closings[-1][0] >= at

    def _elements(self, name: str) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
        if name not in self.tags:
            closings: list[tuple[int, int]] = []
            partner: dict[int, tuple[int, int]] = {}
            stack: list[int] = []
            for m in re.finditer(rf"<(/?){re.escape(name)}\b(?:[^<>]*?)(/?)>", self.text, re.I):
                if m.group(1):
                    closings.append(m.span())
                    if stack:
                        partner[stack.pop()] = m.span()
                elif not m.group(2):
                    stack.append(m.end())
            self.tags[name] = closings, partner
        return self.tags[name]


def _split_top(body: str) -> list[str]:
    """Cut at bars outside nested links and templates."""
    parts, depth, last, i = [], 0, 0, 0
    while i < len(body):
        two = body[i : i + 2]
        if two in ("[[", "{{"):
            depth += 1
            i += 2
        elif two in ("]]", "}}"):
            depth -= 1
            i += 2
        else:
            if body[i] == "|" and depth == 0:
                parts.append(body[last:i])
                last = i + 1
            i += 1
    return [*parts, body[last:]]


def _plain(text: str) -> str:
    """The text of some markup, links replaced by what they show."""
    return "".join(p if isinstance(p, str) else p[1] for p in _pieces(text, None, None, None))


def _pieces(text: str, media: re.Pattern | None, category: re.Pattern | None, hook: Callable[[str], str] | None) -> list[str | tuple[str, str]]:
    """Text and (title, text) links, in order."""
    out: list[str | tuple[str, str]] = []
    plain: list[str] = []

    def flush() -> None:
        if plain:
            s = html.unescape("".join(plain))
            s = re.sub(r"\n{3,}", "\n\n", s)
            out.append(hook(s) if hook else s)
            plain.clear()

    i, n = 0, len(text)
    pairs = _Pairs(text)
    close = line = -1  # the next ] and line end, looked up again once passed
    while i < n:
        c = text[i]
        if c == "<":
            if text.startswith("<!--", i):
                end = text.find("-->", i)
                i = n if end < 0 else end + 3
                continue
            m = _TAG.match(text, i)
            if m:
                closing, name = m.group(1), m.group(2).lower()
                single = m.group(4) or m.group(3).endswith("/")
                i = m.end()
                if closing or single or name in _SINGLE:
                    if name == "br":
                        plain.append("\n")
                    continue
                if name in _RAW or name in _INVISIBLE:
                    stop = pairs.element(name, i, name not in _RAW)
                    if name in ("nowiki", "pre"):
                        plain.append(text[i : stop[0]] if stop else "")
                    if stop:
                        i = stop[1]
                    elif name == "ref" and not pairs.closes_after(name, i):
                        i = n
                continue
        elif c == "{":
            if text.startswith("{{", i):
                end = pairs.end(i, "{{", "}}")
                if end > 0:
                    i = end
                    continue
            elif text.startswith("{|", i):
                end = pairs.end(i, "{|", "|}")
                if end > 0:
                    i = end
                    continue
        elif c == "[":
            if text.startswith("[[", i):
                end = pairs.end(i, "[[", "]]")
                if end > 0:
                    parts = _split_top(text[i + 2 : end - 2])
                    target = parts[0]
                    i = end
                    if media is not None and media.match(target.strip()):
                        continue
                    shown = _plain(parts[-1]) if len(parts) > 1 else _plain(target)
                    if category is not None and category.match(target.strip()):
                        shown = category.sub("", shown.strip())
                    if hook:
                        shown = hook(shown)
                    title = _clean_title(target)
                    flush()
                    out.append((title, shown) if title else shown)
                    continue
            else:
                if close < i:
                    close = text.find("]", i) % (n + 1)  # n where there is none
                if line < i:
                    line = text.find("\n", i) % (n + 1)
                m = _URL.match(text, i) if close < line else None
                if m:
                    plain.append(_plain(m.group(2)) if m.group(2) else "")
                    i = m.end()
                    continue
        plain.append(c)
        i += 1
    flush()
    return out


def _sections(text: str) -> list[str]:
    """The lead and every section with its heading's text, flat."""
    out, last = [], 0
    for m in _HEADING.finditer(text):
        out.append(text[last : m.start()])
        last = m.start()
    out.append(text[last:])
    return [_HEADING.sub(lambda m: m.group(2).strip(), s) for s in out]


def parse_page(wiki_text: str, language: str = "en", preprocess: Callable[[str], str] | None = None, aliases: tuple[dict, dict] | None = None) -> list[Paragraph]:
    """The non-empty sections of a page as paragraphs; a link's span is its place in the paragraph's text, the first kept one is the abstract.

    Media links vanish, category links lose their prefix in the text, references, tables, templates and comments leave nothing."""
    cat, med = aliases or (None, None)
    category, media = re.compile(category_pattern(language, cat)), re.compile(media_pattern(language, med))
    out: list[Paragraph] = []
    for section in _sections(_SWITCH.sub("", _QUOTES.sub("", wiki_text))):
        text, links = "", []
        for p in _pieces(section, media, category, preprocess):
            if isinstance(p, tuple):
                links.append(Link(p[0], p[1], len(text), len(text) + len(p[1])))
                text += p[1]
            else:
                text += p
        if text:
            out.append(Paragraph(text, links, not out))
    return out
