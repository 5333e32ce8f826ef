"""Leaf blocks of an HTML page: runs of text between block-level boundaries, with their ancestors."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

# Element names of the HTML standard by their role in rendering.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input picture source button math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mstyle munder mover munderover semantics annotation".split())
#: Their content is not text of the page.
RAW = frozenset("script style noscript template iframe svg object canvas audio video title textarea".split())
#: An opening tag of these closes an open one of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("ul ol dl table div section article main body html aside nav header footer form td th".split())

#: A tag without a < or a quoted > in it: it ends, or fails, before the next <.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_OPENS = re.compile(r"<(?=[a-zA-Z/!?])")
_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ENDS = re.compile(r"""["'>]""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:\s|^)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Elements that divide pages.
MAJOR = frozenset(("article", "main", "section", "aside", "nav", "header", "footer", "form"))
_WORD = re.compile(r"[a-z]+|\d+")


class Place:
    """An element as the last of its chain of ancestors. A page has one object for each different chain, so chains
    are equal if they are the same object, and blocks share them however deep they are."""

    __slots__ = ("parent", "tag", "names", "inner", "major", "known")

    def __init__(self, parent: Place | None, tag: str, names: tuple[str, ...]):
        self.parent, self.tag, self.names = parent, tag, names
        # The innermost two, and of the elements that divide pages: they tell an article's own header from the site's.
        inner, major = (parent.inner, parent.major) if parent else ((), ())
        self.inner = inner if tag == "a" else (*inner, tag)[-2:]
        self.major = (*major, tag)[-2:] if tag in MAJOR else major
        self.known: tuple[object, frozenset[str]] | None = None  # what ``extraction`` found, and for which names


@dataclass
class Block:
    """Text with white space as single spaces, and where it is (None outside any element)."""

    text: str
    place: Place | None
    linked: int  # code points inside links

    @property
    def ancestors(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """From the outermost, each with the words of its class, id and role."""
        out, at = [], self.place
        while at:
            out.append((at.tag, at.names))
            at = at.parent
        return tuple(reversed(out))


class _TagEnds:
    """For tags that hold a < or a quoted >: where each ends, found for all places in one pass from the page's end."""

    def __init__(self, html: str):
        found = [(m.start(), m[0]) for m in _ENDS.finditer(html)]
        self.at = [i for i, _ in found]
        self.ends, self.plain = [-1] * (len(found) + 1), [-1] * (len(found) + 1)
        last = {'"': len(found), "'": len(found)}
        for k in range(len(found) - 1, -1, -1):
            i, c = found[k]
            self.plain[k] = i if c == ">" else self.plain[k + 1]
            # Behind a quote the tag goes on after its partner, if it has one.
            self.ends[k] = i if c == ">" else self.ends[last[c] + 1] if last[c] < len(found) else -1
            if c != ">":
                last[c] = k

    def of(self, start: int) -> int:
        """The first > outside quotes; with an unclosed quote the first > at all; -1 for none."""
        k = bisect_left(self.at, start)
        return self.ends[k] if self.ends[k] >= 0 else self.plain[k]


def _pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """The page as ("text", text, "") and ("open" or "close", name, attributes) in order; each character is looked at a few times at most."""
    at, end = 0, len(html)
    ends: _TagEnds | None = None
    without: set[str] = set()  # marks that do not occur any more

    def find(mark: str, start: int) -> int:
        i = -1 if mark in without else html.find(mark, start)
        if i < 0:
            without.add(mark)
        return i

    from_ = 0  # where text begins that has not been handed out
    while True:
        m = _OPENS.search(html, at)
        if not m:
            break
        at = m.start()
        tag = _TAG.match(html, at)
        if tag:
            stop, closing, name, attributes = tag.end(), tag[1], tag[2], tag[3]
        elif html.startswith("<!--", at):
            i = html.find("-->", at + 4)
            stop, name = (i + 3 if i >= 0 else end), ""
        elif html.startswith("<![CDATA[", at) and (i := find("]]>", at)) >= 0:
            stop, name = i + 3, ""
        elif html[at + 1] in "!?":
            if (i := find(">", at)) < 0:
                break
            stop, name = i + 1, ""
        else:
            start = _START.match(html, at)
            if not start:
                at += 1
                continue
            ends = ends or _TagEnds(html)
            i = ends.of(start.end())
            if i < 0:
                break
            stop, closing, name, attributes = i + 1, start[1], start[2], html[start.end() : i]
        if at > from_:
            yield "text", html[from_:at], ""
        at = from_ = stop
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                close = _raw_end(name).search(html, at) if name not in without else None
                if not close:
                    without.add(name)
                at = from_ = close.end() if close else end
            continue
        yield "close" if closing else "open", name, attributes
    if end > from_:
        yield "text", html[from_:], ""


@lru_cache(maxsize=32)
def _raw_end(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(name)}\s*+>", re.I)


class _Stack:
    """Open elements, with the places of each name, of barriers and of all that are not inline, so that no look-up walks."""

    def __init__(self) -> None:
        self.items: list[tuple[str, Place | None]] = []
        self.of_name: dict[str, list[int]] = {}
        self.barriers: list[int] = []
        self.outer: list[int] = []
        self.places: dict[tuple[Place | None, str, tuple[str, ...]], Place] = {}

    def place(self) -> Place | None:
        return self.items[-1][1] if self.items else None

    def push(self, name: str, names: tuple[str, ...]) -> None:
        at, place = len(self.items), self.place()
        if name not in INLINE or name == "a" or names:
            key = (place, name, names)
            if key not in self.places:
                self.places[key] = Place(place, name, names)
            place = self.places[key]
        self.items.append((name, place))
        self.of_name.setdefault(name, []).append(at)
        if name in BARRIER:
            self.barriers.append(at)
        if name not in INLINE:
            self.outer.append(at)

    def last(self, name: str) -> int:
        where = self.of_name.get(name)
        return where[-1] if where else -1

    def pop_to(self, depth: int) -> None:
        while len(self.items) > depth:
            name, _ = self.items.pop()
            self.of_name[name].pop()
            if name in BARRIER:
                self.barriers.pop()
            if name not in INLINE:
                self.outer.pop()

    def close(self, name: str) -> None:
        """An end tag: ends what is inside its element too, but nothing beyond what holds its kind of element in."""
        at = self.last(name)
        wall = self.outer if name in INLINE else [] if name in BARRIER else self.barriers
        if at >= 0 and not (wall and wall[-1] > at):
            self.pop_to(at)

    def make_room(self, name: str) -> None:
        """A start tag that ends an open element of its group, unless that is outside an enclosing box."""
        at = max(map(self.last, CLOSES[name]))
        if at >= 0 and not (self.barriers and self.barriers[-1] > at):
            self.pop_to(at)


def leaf_blocks(html: str | None) -> list[Block]:
    """Blocks in page order. Null and empty pages have none; text outside any element is a block of its own.

    Broken markup is read leniently: unclosed elements end with an enclosing one or the page, stray end
    tags are ignored, and a < that opens no tag is text. Time and memory are in proportion to the page's
    length, whatever is in it.
    """
    blocks: list[Block] = []
    stack = _Stack()
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(p for p, _ in parts)).split())
            if text:
                inside = sum(len(" ".join(unescape(p).split())) for p, linked in parts if linked)
                blocks.append(Block(text, stack.place(), inside))
            parts.clear()

    for kind, name, attributes in _pieces(html or ""):
        if kind == "text":
            parts.append((name, stack.last("a") >= 0))
            continue
        if name not in INLINE:
            flush()
        if kind == "close":
            stack.close(name)
            continue
        if name in VOID:
            continue
        if name in CLOSES:
            stack.make_room(name)
        names = tuple(w for g in _NAMES.findall(attributes) for v in g if v for w in _WORD.findall(v.lower())) if attributes else ()
        if attributes and _HIDDEN.search(attributes):
            names += ("hidden",)
        stack.push(name, names)
    flush()
    return blocks
