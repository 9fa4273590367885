"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes its sequence of leaf blocks (text between block-level tags).
Each block has features from its ancestors (tags; words of class, id and role;
the nearest container with such marks; what lies between it and an ``article``)
and from texts (length, share of links, punctuation, telling words, and how
much of the page's text its container holds). The field labels blocks as
article or other, and Viterbi decoding gives the best sequence for the whole
page. Blocks of the article are joined in page order.

It is trained on composed pages whose labels are known, because the composer
knows what it writes: with semantic elements, with marked containers, with
marks that mean nothing, hardly any marks, or no container at all. The fit is
kept beside this module; with labelled pages of one's own it is made anew.

Elements that hold the page's main region and more say nothing about a block;
where it lies to that region does, so an article in containers without telling
names is kept.

Pages are read, parsed and decoded where they are: no shuffle.

Defined results: a null or empty page, and one whose blocks are all rejected,
has empty text; broken mark-up is read as far as it goes; repeated rows are
treated alike; an empty table gives an empty result. Columns besides page_id,
url and html are not looked at.
"""

from __future__ import annotations

import functools
import json
import random
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .crf import Chain, train
from .dom import Block, Paths, leaf_blocks

#: Weights fitted on the composed pages, written by this module when it is run.
FITTED = Path(__file__).with_name("extractor.json")
COMPOSED = 2400
#: Features in fewer pages are not learned: made-up marks would be learned by heart.
LEAST = 15
#: Longer pages are fitted on in pieces of so many blocks.
FIT_BLOCKS = 60

# Words of marks (class, id, role) and of texts that tell what a block is; elements that shape text inside a container.
OTHER_MARKS = frozenset("ad ads advert advertisement sponsored sponsor promo promotion offer partner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer bottom sidebar aside widget rail related recommended share social cookie consent notice banner alert popup modal newsletter subscribe signup login form search comments comment reply replies respond response responses feedback discussion disqus pager pagination copyright legal tags meta toolbar skip hidden".split())
CONTENT_MARKS = frozenset("article content main post entry story body text".split())
CUES = re.compile(r"©|\b(?:cookies?|copyright|rights reserved|subscribe|newsletter|sign ?up|sign ?in|log ?in|advertisement|sponsored|share this|follow us|read more|related|leave a reply|comments?|privacy|terms of|posted by|menu|search|buy now|shop now|order now|get yours|special offer|save up|only today|you may also like|more on this|latest news)\b", re.I)
ZONES = frozenset("article main nav footer header aside form section".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tbody thead tr td th blockquote figure figcaption pre".split())


def kind_of_marks(marks: Sequence[str]) -> str:
    if not marks:
        return "none"
    other, content = bool(OTHER_MARKS & set(marks)), bool(CONTENT_MARKS & set(marks))
    return "both" if other and content else "other" if other else "content" if content else "unknown"


def anchor(paths: Paths, path: int) -> int:
    """The container of a block: its nearest ancestor, or itself, that is more than an element of the text."""
    leaf = True
    while path:
        tag, marks = paths.tag[path], paths.marks[path]
        if not (tag in TEXT_TAGS and (not marks or tag not in ("li", "ul", "ol", "dl", "table", "figure", "blockquote")) or leaf and tag == "div" and not marks):
            return path
        leaf, path = False, paths.parent[path]
    return path


def path_features(paths: Paths, path: int, main: int) -> list[str]:
    """Features of the elements around a block, but for those that hold the whole main region too, and for a form as that region: a page in a form is not a form."""
    around = set(paths.chain(main)[0 if paths.tag[main] == "form" else 1 :])
    chain = [p for p in paths.chain(path) if p not in around]
    marks = [m for p in chain for m in paths.marks[p]]
    out = {f"tag:{paths.tag[p]}" for p in chain} | {f"mark:{m}" for m in marks} | {f"piece:{m[:4]}" for m in marks}
    if chain:
        out.add(f"in:{paths.tag[chain[0]]}")
    out.add(f"zone:{next((paths.tag[p] for p in chain if paths.tag[p] in ZONES), 'none')}")
    marked = next((p for p in chain if paths.marks[p]), None)
    near = kind_of_marks(paths.marks[marked]) if marked is not None else "none"
    out |= {f"near:{near}", f"any:{'other' if OTHER_MARKS & set(marks) else 'content' if CONTENT_MARKS & set(marks) else 'none'}"}
    if marked is not None:
        out |= {f"near:{m}" for m in paths.marks[marked]} | {f"near:{near}:{paths.tag[marked]}"}
    at = next((i for i, p in enumerate(chain) if paths.tag[p] in ("article", "main")), None)
    if at is not None:
        between = [p for p in chain[:at] if paths.tag[p] not in TEXT_TAGS or paths.marks[p] and paths.tag[p] != "p"]
        kinds = {kind_of_marks(paths.marks[p]) for p in between}
        out |= {f"inside:{min(2, len(between))}", *(f"between:{k}" for k in kinds), *(f"between:{paths.tag[p]}" for p in between)}
    else:
        out.add("outside")
    return sorted(out)


def sums_upward(paths: Paths, blocks: Sequence[Block], weights: Sequence[int]) -> dict[int, int]:
    """The weights of the blocks in each element."""
    held: dict[int, int] = {}
    for b, w in zip(blocks, weights, strict=True):
        held[b.path] = held.get(b.path, 0) + w
    for path in sorted({p for q in held for p in paths.chain(q)}, reverse=True):  # children have larger numbers
        held[paths.parent[path]] = held.get(paths.parent[path], 0) + held.setdefault(path, 0)
    return held


def said_other(paths: Paths, path: int) -> bool:
    return paths.tag[path] in ("nav", "footer", "aside") or paths.tag[path] not in ("html", "body", "form") and kind_of_marks(paths.marks[path]) == "other"


def regions(paths: Paths, blocks: Sequence[Block], sizes: Sequence[int], memory: dict[int, tuple[int, ...]]) -> tuple[int, list[tuple]]:
    """The page's main region, and of each block: where it lies to that, the region's share of the prose, whether a top heading is in it, and where it comes to all prose.

    The main region is the lowest element reached from the top by going where
    more than half of the prose is: blocks of eight words or more with few
    links (a top heading counts ten words), but for elements that are said to be
    something else and hold less than nine tenths of it.
    """
    weight = []
    for b, words in zip(blocks, sizes, strict=True):
        if b.path not in memory:
            memory[b.path] = tuple(p for p in paths.chain(b.path) if said_other(paths, p))
        weight.append(0 if 4 * b.linked >= len(b.text) else 10 if paths.tag[b.path] in ("h1", "h2") else words if words >= 8 else 0)
    held = sums_upward(paths, blocks, weight)
    weight = [0 if any(10 * held[p] < 9 * held[0] for p in memory[b.path]) else w for b, w in zip(blocks, weight, strict=True)]
    held = sums_upward(paths, blocks, weight)
    headed = sums_upward(paths, blocks, [int(paths.tag[b.path] == "h1") for b in blocks])
    children: dict[int, list[int]] = {}
    for path in held:
        if path:
            children.setdefault(paths.parent[path], []).append(path)
    main, total = 0, max(1, held.get(0, 0))
    inside = {0: 0}
    while (best := max(children.get(main, ()), key=lambda c: (held[c], -c), default=None)) is not None and 2 * held[best] > total and paths.tag[best] not in TEXT_TAGS - {"table", "tbody", "tr", "td"}:
        main = best
    order = [i for i, w in enumerate(weight) if w >= 8]
    first, last = (order[0], order[-1]) if order else (0, len(blocks))
    share = min(3, 4 * held.get(main, 0) // max(1, held.get(0, 0)))
    out = []
    for i, b in enumerate(blocks):
        if b.path not in inside:
            chain = paths.chain(b.path)
            at = chain.index(main) if main in chain else len(chain) if main == 0 else -1
            between = [] if at < 0 else [p for p in chain[:at] if paths.tag[p] not in TEXT_TAGS or paths.marks[p] and paths.tag[p] != "p"]
            odd = any(paths.tag[p] in ("nav", "footer", "aside", "header", "form") or kind_of_marks(paths.marks[p]) in ("other", "both") for p in between)
            inside[b.path] = 0 if at < 0 else 3 if odd else 1 if not between else 2
        out.append((inside[b.path], share, headed.get(main, 0) > 0, 0 if i < first else 2 if i > last else 1))
    return main, out


def text_kinds(paths: Paths, blocks: Sequence[Block], anchors: dict[int, int], never: dict[int, tuple[int, ...]]) -> tuple[int, list[tuple]]:
    """The main region, and what a block's own text, its container's share of the page and its place to the main region tell, in few steps."""
    held: dict[int, int] = {}
    prose: dict[int, int] = {}
    sizes = []
    for b in blocks:
        if b.path not in anchors:
            anchors[b.path] = anchor(paths, b.path)
        words = b.text.count(" ") + 1
        sizes.append(words)
        own = 4 * b.linked < len(b.text)
        held[anchors[b.path]] = held.get(anchors[b.path], 0) + words * own
        prose[anchors[b.path]] = prose.get(anchors[b.path], 0) + (own and words >= 8)
    most = max(held.values(), default=0)
    main, places = regions(paths, blocks, sizes, never)
    out = []
    for b, words, region in zip(blocks, sizes, places, strict=True):
        text, own = b.text, held[anchors[b.path]]
        share = 3 if own == most else 2 if 2 * own >= most else 1 if 10 * own >= most else 0
        out.append((min(7, words.bit_length()), min(3, 4 * b.linked // len(text)), text[-1] in ".!?…\"'”»:;", text[0].isupper(), words < 40 and CUES.search(text) is not None, share, min(3, prose[anchors[b.path]].bit_length()), *region))
    return main, out


def text_features(kind: tuple) -> list[str]:
    words, links, ends, upper, cue, share, prose, region, main, headed, place = kind
    own = [f"words:{words}", f"links:{links}", f"ends:{ends}", f"upper:{upper}", f"cue:{cue}", f"share:{share}", f"words:{words}:ends:{ends}", f"words:{words}:links:{links}", f"share:{share}:words:{words}", f"share:{share}:links:{links}", "always"]
    where = f"region:{region}"
    return own + [where, f"{where}:words:{words}:ends:{ends}", f"{where}:links:{links}", f"{where}:cue:{cue}", f"{where}:main:{main}", f"{where}:headed:{headed}", f"{where}:place:{place}", f"{where}:share:{share}", f"prose:{prose}", f"prose:{prose}:{where}", f"place:{place}:links:{links}", f"place:{place}:words:{words}"]


STYLES = ("semantic", "marked", "wild", "bare", "open", "plain")
#: How the article of a page in style "plain" is held; "wrapped": every paragraph in an element of its own.
PLAIN = ("one", "one", "bare", "nested", "deep", "wrapped", "numbered", "form", "table", "none", "spans")


def compose_page(rng: random.Random, style: str | None = None) -> tuple[str, list[int]]:
    """A page in some layout, and the labels of its leaf blocks."""
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "ti", "es", "ou", "ing", "ly", "be", "da", "mo", "ü", "é", "ch", "s", "a")) for _ in range(rng.randrange(1, 4)))

    def sentence(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randrange(low, high))).capitalize() + rng.choice((".", ".", ".", "!", "?", ""))

    style = style or rng.choice(("semantic", *STYLES, "plain", "plain"))
    held_in = rng.choice(PLAIN) if style == "plain" else ""
    plain_prose = rng.choice(((8, 30), (8, 30), (5, 60)))
    labels: list[int] = []
    wrapper = rng.choice((f"{word()}-{rng.randrange(1000)}", f"css-{rng.randrange(1 << 24):x}", f"sc-{word()}", "row", f"x{rng.randrange(100)}"))
    own_mark = f' class="{rng.choice((wrapper, "css-" + word(), "text", word() + word()))}"' if held_in in ("wrapped", "spans") and rng.random() < 0.5 else ""

    def plain(inner: str) -> str:
        """A container whose tag and marks, if any, say nothing."""
        names = (f"c{rng.randrange(1, 40)}", f"css-{rng.randrange(1 << 24):x}", f"col-{rng.randrange(1, 12)}", rng.choice(("row", "wrap", "inner", "outer", "container", "page", "grid", "box", "block", "root", "app", "layout", "view", "center", "left", "right")), f"sc-{word()}{rng.randrange(100)}", f"{word()}_{word()}")
        mark = f' {rng.choice(("class", "class", "class", "id"))}="{rng.choice(names)}{rng.choice(("", "", " " + rng.choice(names)))}"'
        tag = rng.choice(("div", "div", "div", "section"))
        return f"<{tag}{mark if rng.random() < 0.75 else ''}>{inner}</{tag}>"

    def box(tag: str, marks: Sequence[str], inner: str) -> str:
        if (style == "semantic" or style == "open" and rng.random() < 0.5) and tag != "div" and rng.random() < 0.8:
            mark = f' class="{rng.choice(marks)}"' if tag == "section" or rng.random() < 0.3 else ""
            return f"<{tag}{mark}>{inner}</{tag}>"
        if style == "bare" and rng.random() < 0.7:
            return f"<div>{inner}</div>"
        if style == "plain":
            if held_in == "table" and rng.random() < 0.5:
                return f"<table><tr><td>{inner}</td></tr></table>"
            if rng.random() < 0.5:
                return plain(inner)
            if tag != "div" and rng.random() < 0.5:
                return f"<{tag}>{inner}</{tag}>"
        name = word() + word() if style == "wild" else rng.choice(marks)
        name = rng.choice((name, f"site-{name}", f"{name}-box", f"{name} {word()}"))
        outer = rng.choice(("div", "div", "section"))
        return f'<{outer} {rng.choice(("class", "class", "id"))}="{name}">{inner}</{outer}>'

    def said(low: int, high: int, start: Sequence[str] = ("",)) -> str:
        """Text without an element of its own."""
        labels.append(0)
        return rng.choice(start) + " ".join(sentence(low, high) for _ in range(rng.randrange(1, 4)))

    def links(n: int) -> str:
        labels.extend([0] * n)
        items = "".join(f'<li><a href="/{i}">{sentence(1, 4).rstrip(".!?")}</a></li>' for i in range(n))
        return f"<ul>{items}</ul>"

    def lines(n: int, low: int, high: int, label: int, tags: Sequence[str] = ("p",), linked: float = 0.0) -> str:
        out = ""
        for _ in range(n):
            tag, text = rng.choice(tags), sentence(low, high)
            text = f'<a href="#">{text}</a>' if rng.random() < linked else f"<span>{text}</span>" if held_in == "spans" and label else text
            labels.append(label)
            piece = f"<{tag}{own_mark if label else ''}>{text}" + (f"</{tag}>" if rng.random() < 0.9 or tag != "p" else "")
            out += f'<div class="{wrapper}">{piece}</div>' if label and tag in ("p", "div", "h2", "h3") and held_in == "wrapped" else f'<div id="{wrapper[0]}{len(labels)}">{piece}</div>' if label and held_in == "numbered" and tag != "li" else piece
        return out

    def other(kind: str) -> str:
        if kind == "nav":
            return box("nav", ("nav", "menu", "navigation", "breadcrumb"), links(rng.randrange(2, 9)))
        if kind == "header":
            return box("header", ("header", "masthead", "topbar", "banner"), lines(rng.randrange(1, 3), 1, 8, 0, ("h2", "p", "div")))
        if kind == "ad":
            if rng.random() < 0.3:
                labels.append(0)
                text = f"{rng.choice(('Buy now at', 'Buy now:', 'Shop now at', 'Get yours at', 'Save up to', 'Special offer:', 'Only today:', 'Order now from'))} {sentence(1, 5)}"
                return f"<table><tr><td>{text}</td></tr></table>" if rng.random() < 0.4 else box("div", ("ad", "promo", "partner"), f"<p>{text}</p>")
            if rng.random() < 0.3:
                return box("div", ("ad", "advert", "promo"), said(3, 20))
            return box("div", ("ad", "ads", "advert", "sponsored", "promo", "advertisement", "partner-offer"), lines(rng.randrange(1, 3), 3, 25, 0, ("p", "div"), 0.3))
        if kind == "links":  # a heading and a list, without a container of their own
            labels.append(0)
            return f"<{(h := rng.choice(('h2', 'h3', 'h4', 'p')))}>{rng.choice(('Related articles', 'Read more', 'More on this', 'Latest news', 'You may also like', sentence(1, 4)))}</{h}>" + links(rng.randrange(2, 7))
        if kind == "aside" and rng.random() < 0.3:
            labels.append(0)
            return box("aside", ("related", "more", "recommended"), f"<{(h := rng.choice(('h2', 'h3', 'h4', 'p', 'div')))}>{rng.choice(('Related articles', 'Read more', 'More on this', 'Latest', 'You may also like', sentence(1, 4)))}</{h}>" + links(rng.randrange(2, 7)))
        if kind == "aside" and rng.random() < 0.3:
            return box("aside", ("sidebar", "aside", "related", "rail"), said(1, 12))
        if kind == "aside":
            return box("aside", ("sidebar", "aside", "widget", "related", "recommended", "rail"), lines(1, 1, 4, 0, ("h3", "h4")) + (links(rng.randrange(2, 7)) if rng.random() < 0.6 else lines(rng.randrange(1, 3), 4, 25, 0)))
        if kind == "notice":
            labels.append(0)
            text = rng.choice(("We use cookies to improve this site.", "This site uses cookies. By going on you agree to our privacy terms.", "Sign up for our newsletter!", "Please log in to continue.", sentence(5, 20)))
            return box("div", ("cookie", "consent", "notice", "banner", "alert", "popup", "modal", "newsletter"), f"<p>{text}</p>")
        if kind == "form":
            labels.append(0)
            inner = f'<form action="/s"><label>{sentence(1, 6)}</label><input name="q"><button>{word()}</button></form>'
            return box("div", ("form", "search", "login", "subscribe"), inner) if rng.random() < 0.5 else inner
        if kind == "comments":
            item = lambda: lines(1, 1, 4, 0, ("div", "h4")) + lines(rng.randrange(1, 3), 4, 40, 0)
            marks = ("comments", "comment", "replies", "discussion", "responses", "respond", "feedback")
            if rng.random() < 0.4:  # a list of comments with a mark of its own
                inner = "".join(f"<li>{lines(rng.randrange(1, 3), 3, 40, 0) if rng.random() < 0.7 else item()}</li>" for _ in range(rng.randrange(1, 5)))
                name = word() + word() if style == "wild" or rng.random() < 0.3 else rng.choice(marks)
                return f'<{rng.choice(("ol", "ul"))} {rng.choice(("class", "id"))}="{name}">{inner}</ol></ul>'
            inner = lines(rng.randrange(2), 1, 4, 0, ("h2", "h3"))
            for _ in range(rng.randrange(1, 5)):
                inner += f'<div class="{rng.choice(("comment", "reply", "item", word()))}">{item()}</div>' if rng.random() < 0.6 else lines(rng.randrange(1, 3), 4, 40, 0)
            return box("section", marks, inner)
        if kind == "unknown":  # a box in the text whose mark says nothing
            return f'<div {rng.choice(("class", "id"))}="{word()}{word()}">{lines(rng.randrange(1, 3), 3, 25, 0, ("p", "div"), 0.3)}</div>'
        if rng.random() < 0.4:
            return box("footer", ("footer", "bottom", "copyright", "legal"), said(1, 14, ("", "&copy; ", "Site &middot; ")))
        return box("footer", ("footer", "bottom", "copyright", "legal"), lines(1, 3, 18, 0, ("p", "div")) if rng.random() < 0.5 else links(rng.randrange(2, 6)))

    def items(n: int) -> str:
        tag = rng.choice(("ul", "ol"))
        return f"<{tag}>{lines(n, 2, 16, 1, ('li',))}</{tag}>"

    def article() -> str:
        prose = rng.choice((("p",), ("p",), ("div",)))
        if style == "plain":
            inner = lines(rng.random() < 0.8, 1, 12, 1, ("h1", "h1", "h2")) + lines(rng.randrange(2, 9), *plain_prose, 1, prose)
        else:
            inner = lines(rng.randrange(2), 1, 12, 1, ("h1", "h1", "h2")) + lines(1, 1, rng.choice((6, 60, 60, 60)), 1, prose)
        for _ in range(rng.randrange(rng.choice((1, 3, 14, 14)))):
            if style == "plain" and rng.random() < 0.8:
                inner += lines(rng.randrange(1, 4), *plain_prose, 1, prose)
                continue
            inner += rng.choice((lambda: lines(rng.randrange(1, 5), 4, 90, 1, prose), lambda: lines(1, 2, 8, 1, ("h2", "h3")), lambda: items(rng.randrange(2, 5)), lambda: lines(1, 5, 40, 1, ("blockquote", "figcaption", "pre", "td"))))()
            if rng.random() < 0.1:
                inner += other(rng.choice(("ad", "ad", "notice", "aside", "form", "unknown", "links", "links")))
            if rng.random() < 0.05:
                labels.append(1)
                inner += f"<p>{rng.choice(('All rights reserved.', 'Licensed under the terms below.', 'Read more about it here.', word()))}"
        if style != "open" and rng.random() < 0.3:
            inner = f'<div class="{rng.choice(("entry-content", "post-body", "text", word() + word()))}">{inner}</div>'
        if rng.random() < 0.25:
            inner += other("comments")
        if rng.random() < 0.2:
            inner += other(rng.choice(("nav", "footer", "form")))
        if rng.random() < 0.15:
            inner += other(rng.choice(("aside", "links", "ad")))
        if style == "open" or held_in == "none":
            return inner
        if held_in == "table":
            return f"<table><tr><td>{inner}</td></tr></table>"
        if style == "plain":
            if held_in == "bare":
                return f"<div>{inner}</div>"
            for _ in range(1 if held_in in ("one", "spans", "form", "numbered") else rng.randrange(12, 45) if held_in == "deep" else rng.randrange(1, 5)):
                inner = f"<div>{inner}</div>" if held_in == "deep" and rng.random() < 0.7 else plain(inner)
            return inner
        return box(rng.choice(("article", "article", "main")), ("article", "content", "post", "entry", "story", "main-content", "post-body", "entry-content", "article-body"), inner)

    before = [k for k in ("notice", "header", "nav", "ad", "form", "aside") if rng.random() < 0.5]
    after = [k for k in ("aside", "comments", "ad", "form", "nav", "footer", "notice") if rng.random() < 0.5]
    if style == "plain" and rng.random() < 0.3:
        before, after = [], []
    body = "".join(map(other, before)) + article() + "".join(map(other, after))
    if held_in == "form":
        body = f'<form id="f{word()}" action="/">{body}</form>'
    elif held_in in ("wrapped", "nested") and rng.random() < 0.6:
        body = plain(plain(body))
    return f"<!DOCTYPE html><html><head><title>{sentence(2, 8)}</title><script>var a='<p>';</script></head><body>{body}</body></html>", labels


def composed_chains(n: int, seed: int = 11, style: str | None = None) -> list[tuple[list[list[str]], list[int]]]:
    rng, out = random.Random(seed), []
    while len(out) < n:
        page, labels = compose_page(rng, style)
        paths = Paths()
        blocks = leaf_blocks(page, paths)
        if len(blocks) == len(labels):
            out.append((features(paths, blocks), labels))
    return out


def features(paths: Paths, blocks: Sequence[Block]) -> list[list[str]]:
    main, kinds = text_kinds(paths, blocks, {}, {})
    return [path_features(paths, b.path, main) + text_features(kind) for b, kind in zip(blocks, kinds, strict=True)]


@functools.lru_cache(maxsize=1)
def fitted_extractor() -> Chain:
    """What ``fit_extractor()`` gives, read from the file that ``python -m facetmill.llm.extraction`` writes."""
    said = json.loads(FITTED.read_text(encoding="utf-8"))
    return Chain(said["weights"], np.array(said["steps"]), said["first"])


@functools.lru_cache(maxsize=2)
def fit_extractor(composed: int = COMPOSED, labelled: tuple[tuple[str, tuple[int, ...]], ...] = ()) -> Chain:
    """Trains on composed pages, and on given (html, label of each of its leaf blocks) pairs."""
    chains = composed_chains(composed)
    for page, labels in labelled:
        paths = Paths()
        chains.append((features(paths, leaf_blocks(page, paths)), list(labels)))
    return train([(f[i : i + FIT_BLOCKS], y[i : i + FIT_BLOCKS]) for f, y in chains for i in range(0, len(y), FIT_BLOCKS)], least=LEAST)


class Memory:
    """What is known of ancestor chains and kinds of text, kept between pages."""

    def __init__(self):
        self.paths, self.of_path, self.anchors, self.never, self.of_kind = Paths(), {}, {}, {}, {}


def main_text(page: str | None, chain: Chain, memory: Memory) -> str:
    """The article's text."""
    if len(memory.paths.parent) > 50_000:
        memory.__init__()
    blocks = leaf_blocks(page or "", memory.paths)
    get = chain.weights.get
    scores = []
    main, kinds = text_kinds(memory.paths, blocks, memory.anchors, memory.never)
    for b, kind in zip(blocks, kinds, strict=True):
        if (b.path, main) not in memory.of_path:
            memory.of_path[b.path, main] = sum(get(f, 0.0) for f in path_features(memory.paths, b.path, main))
        if kind not in memory.of_kind:
            memory.of_kind[kind] = sum(get(f, 0.0) for f in text_features(kind))
        scores.append(memory.of_path[b.path, main] + memory.of_kind[kind])
    return " ".join(b.text for b, label in zip(blocks, chain.decode(scores), strict=True) if label)


def extract_pages(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(chain or fitted_extractor())  # some hundred weights

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = sent.value, Memory()
        for batch in batches:
            texts = [main_text(page.as_py(), own, memory) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {n: pages.schema[n].dataType.simpleString() for n in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


if __name__ == "__main__":
    own = fit_extractor()
    said = {"first": round(own.first, 4), "steps": own.steps.round(4).tolist(), "weights": {k: round(v, 4) for k, v in sorted(own.weights.items())}}
    FITTED.write_text(json.dumps(said, ensure_ascii=False, indent=0) + "\n", encoding="utf-8")
