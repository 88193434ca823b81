"""Text blocks of a web page: runs of text between block-level tags, each with its path of open elements."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

# Element names of HTML by their role in parsing.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby s samp small span strike strong sub sup time tt u var wbr rb rp rt".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset("script style noscript template head title textarea select option optgroup datalist button iframe object canvas svg math audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: An element that a start tag of the same group closes, up to the nearest of the elements that hold the group.
GROUPS = [({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"td", "th"}, {"tr", "table"}), ({"tr"}, {"table"}), ({"thead", "tbody", "tfoot"}, {"table"})]

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_BLANK, _WORD, _EQUALS, _BARE = (re.compile(p) for p in (r"[\s/]*", r"=?[^\s/>=]+|=", r"\s*=\s*", r"[^\s>]*"))
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Open elements of a page at most; what is nested deeper cuts blocks, but is not part of their paths.
DEPTH = 512

Attributes = list[tuple[str, str]]


def attributes(html: str, at: int) -> tuple[Attributes, int, bool] | None:
    """(names and values, the place behind the tag, whether it closes itself) from behind a tag's name; None if it has no end.

    One walk with a cursor that never goes back.
    """
    found, start, size = [], at, len(html)
    while True:
        at = _BLANK.match(html, at).end()
        if at >= size:
            return None
        if html[at] == ">":
            return found, at + 1, html[start:at].rstrip().endswith("/")
        word = _WORD.match(html, at)
        at, value = word.end(), ""
        equals = _EQUALS.match(html, at)
        if equals:
            at = equals.end()
            if html[at : at + 1] in ('"', "'"):
                close = html.find(html[at], at + 1)
                if close < 0:
                    return None
                value, at = html[at + 1 : close], close + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare[0], bare.end()
        found.append((word[0].lower(), value))


def start_tag(html: str, at: int) -> tuple[Attributes, int, bool]:
    """attributes of a tag behind which a > is known to stand: a quote that nothing closes counts for nothing."""
    found = attributes(html, at)
    if found is None:
        end = html.index(">", at)
        names, _, closed = attributes(re.sub("[\"']", " ", html[at:end]) + ">", 0)
        found = names, end + 1, closed
    return found


def hidden(found: Attributes) -> bool:
    """By the names hidden and aria-hidden, and by the style: no other value says so."""
    return any(name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NO_DISPLAY.search(value) for name, value in found)


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[tuple[str, ...], ...]
    linked: int = 0  # characters inside links


@dataclass
class _Page:
    stack: list[tuple[str, tuple[str, ...], bool]] = field(default_factory=list)  # element, its names, shown
    out: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    linked: int = 0
    known: dict[tuple, tuple] = field(default_factory=dict)  # blocks of one path share it
    open: Counter[str] = field(default_factory=Counter)  # open elements by name

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = tuple(names for tag, names, _ in self.stack if tag not in INLINE)
            self.out.append(Block(text, self.known.setdefault(path, path), min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def shown(self) -> bool:
        return not self.stack or self.stack[-1][2]

    def inline(self) -> bool:
        """Whether the innermost open element is a hidden inline one or stands in one."""
        return bool(self.stack) and self.stack[-1][0] in INLINE

    def push(self, tag: str, names: tuple[str, ...], shown: bool) -> None:
        if len(self.stack) < DEPTH:
            self.stack.append((tag, names, shown))
            self.open[tag] += 1

    def cut(self, k: int) -> None:
        """Closes the element at k and all in it."""
        for tag, _, _ in self.stack[k:]:
            self.open[tag] -= 1
        del self.stack[k:]

    def close_inline(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] not in INLINE:
                return
            if self.stack[k][0] == name:
                self.cut(k)
                return

    def close_paragraph(self) -> None:
        """Closes an open p with the hidden inline elements that are open in it."""
        k = len(self.stack) - 1
        while k >= 0 and self.stack[k][0] in INLINE:
            k -= 1
        if k >= 0 and self.stack[k][0] == "p":
            self.cut(k)

    def close(self, name: str, barrier: set[str] | frozenset[str] = frozenset()) -> None:
        if not self.open[name]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                self.cut(k)
                return
            if self.stack[k][0] in barrier:
                return


def _names(tag: str, found: Attributes) -> tuple[str, ...]:
    """The element, and the words of its class, id and role."""
    return (tag, *(f".{w.lower()}" for name, value in found if name in ("class", "id", "role") for w in _NAME.findall(value)))


def blocks(html: str) -> list[Block]:
    page, at, size, last = _Page(), 0, len(html), html.rfind(">")
    while at < size:
        m = _OPEN.match(html, at) if at < last else None
        if m is None:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = size if end < 0 else end + 3
                continue
            if html.startswith(("<!", "<?"), at):
                at = html.find(">", at) + 1 if at < last else size
                continue
            end = html.find("<", at + 1)  # what opens no tag is text
            end = size if end < 0 else end
            if page.shown():
                text = unescape(html[at:end])
                page.parts.append(text)
                if page.links:
                    page.linked += len(text)
            at = end
            continue
        end, tag = m[1], m[2].lower()
        found, at, closed = start_tag(html, m.end())
        if tag == "br":
            page.parts.append(" ")
        elif tag == "a":
            page.links = 0 if end else 1
        elif tag in INLINE:  # those that are shown leave no trace; a hidden one, with what stands in it, is kept open without cutting the block
            if end:
                page.close_inline(tag)
            elif tag not in VOID and not closed and (page.inline() or hidden(found)):
                page.push(tag, (), False)
        elif end:
            page.flush()
            if tag == "body" or tag == "html":
                continue
            page.close(tag, {"td", "th", "table"} if tag == "p" else frozenset())
        else:
            page.flush()
            page.close_paragraph()
            if tag == "body":
                page.close("head")
            for members, holders in GROUPS:
                if tag in members:
                    for other in members:
                        page.close(other, holders)
            if tag in VOID or closed and tag not in RAW:
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = close.end() if close else size
                continue
            page.push(tag, _names(tag, found), page.shown() and tag not in UNSHOWN and not hidden(found))
    page.flush()
    return page.out
