"""Leaf blocks of an HTML page: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field

# Element names by how they shape text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe xmp noembed noframes".split())
UNSEEN = frozenset("head svg math canvas object audio video select button datalist map".split())
#: A start tag ends these open elements, up to the nearest of their containers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Any other start tag ends an open head.
OF_HEAD = frozenset("title meta link base script style noscript template head".split())
#: Elements nested deeper are taken as children of this level, as browsers do.
DEPTH = 512

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
#: What is no text where no ``>`` follows.
TAIL = re.compile(r"<!--.*|<[!?].*", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Words of marks: two letters or more, digits only after them; what mixes both is a made-up name.
WORDS = re.compile(r"(?<![a-z0-9])([a-z]{2,})\d*(?![a-z0-9])")
CASES = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    path: int
    text: str
    linked: int  # characters inside links


@dataclass
class Paths:
    """Ancestor chains by number: 0 is the page; each chain is its parent's number, a tag and its marks (words of class, id and role)."""

    number: dict[tuple[int, str, str], int] = field(default_factory=dict)
    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    marks: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    depth: list[int] = field(default_factory=lambda: [0])

    def child(self, path: int, tag: str, attributes: str) -> int:
        if self.depth[path] >= DEPTH:
            path = self.parent[path]
        key = (path, tag, attributes)
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.parent)
            self.parent.append(path)
            self.tag.append(tag)
            self.marks.append(marks_of(attributes))
            self.depth.append(self.depth[path] + 1)
        return at

    def chain(self, path: int) -> list[int]:
        """The path's elements, innermost first."""
        out = []
        while path:
            out.append(path)
            path = self.parent[path]
        return out


def marks_of(attributes: str) -> tuple[str, ...]:
    if not attributes.strip(" \t\n\r/"):
        return ()
    found: list[str] = []
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            found += WORDS.findall(CASES.sub(" ", value).lower())
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            found.append("hidden")
    return tuple(dict.fromkeys(found))


class Open:
    """The open elements in their order, each name's places known, so that no tag is looked for among all of them."""

    def __init__(self):
        self.names: list[str] = []
        self.paths: list[int] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, path: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.paths.append(path)

    def last(self, names: Iterable[str]) -> int:
        """The innermost open element of one of these names; -1: none."""
        return max((at[-1] for n in names if (at := self.places.get(n))), default=-1)

    def first_after(self, place: int, names: Iterable[str]) -> int:
        """The outermost open element of one of these names inside ``place``; -1: none."""
        found = [at[i] for n in names if (at := self.places.get(n)) and (i := bisect_right(at, place)) < len(at)]
        return min(found, default=-1)

    def cut(self, place: int) -> tuple[list[str], int]:
        """Ends the element at ``place`` and all in it: their names, and the path around them."""
        gone, path = self.names[place:], self.paths[place]
        del self.names[place:], self.paths[place:]
        for name in gone:
            self.places[name].pop()
        return gone, path


def leaf_blocks(page: str, paths: Paths) -> list[Block]:
    """The page's blocks in order, in time linear in the page; scripts, styles, markup, controls and comments of the markup are left out."""
    blocks: list[Block] = []
    pieces: list[str] = []
    stack = Open()
    path, links, unseen, linked, at, size, last_end = 0, 0, 0, 0, 0, len(page), page.rfind(">")

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(path, text, linked))
            pieces.clear()
        linked = 0

    def close(place: int) -> None:
        nonlocal path, links, unseen
        gone, path = stack.cut(place)
        for tag in gone:
            links -= tag == "a"
            unseen -= tag in UNSEEN

    while at < size:
        m = (TOKEN if at <= last_end else TAIL).search(page, at)
        end = m.start() if m else size
        if end > at and not unseen:
            text = page[at:end]
            if "&" in text:
                text = html.unescape(text)
            pieces.append(text)
            if links:
                linked += len(text)
        if m is None:
            break
        at = m.end()
        name = m[2] or m[5] if m.re is TOKEN else None
        if name is None:
            continue
        tag, ends = name.lower(), (m[1] or m[4]) == "/"
        if tag == "br":
            if not unseen:
                pieces.append(" ")
            continue
        if not ends and tag not in OF_HEAD and stack.places.get("head"):
            close(stack.places["head"][0])
        inline = tag in INLINE
        if not inline:
            flush()
        if ends:
            if stack.places.get(tag):
                close(stack.places[tag][-1])
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        if tag in VOID:
            continue
        if not inline:
            ended, within = CLOSES.get(tag, ({"p"}, {"table", "article", "section", "div", "li", "td", "blockquote"}))
            place = stack.first_after(stack.last(within), ended) if tag == "tr" else stack.last(ended)
            if place > stack.last(within):
                close(place)
        stack.push(tag, path)
        if not inline:
            path = paths.child(path, tag, m[3] or m[6] or "")
        links += tag == "a"
        unseen += tag in UNSEEN
    flush()
    return blocks
