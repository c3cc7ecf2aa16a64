"""Main text of web pages by wrappers: union-free expressions inferred from the pages of each host.

A page is a tree of elements and texts; inline elements that say nothing of themselves are part of the text. A host's
expression is a sequence of units at each level: an element or text that stands once, may be missing (optional), or a
group that repeats; texts that differ are slots. It has no alternatives. The first page is the expression; each further
page is aligned with it, level by level, by the best common subsequence of elements (those built alike count more), and
what doesn't fit is resolved: a text that differs becomes a slot; units that recur beside their likes become a repeated
group; all others become optional. This goes on until nothing more can be folded. Pages are aligned where they lie, and
the partial expressions of a host with each other, by the same step, so a host may have any number of pages and every
page takes part.

Text is read through the match: a page is aligned with its host's expression, and each text is what its place there is.
Places are labelled once for the host. Slots tell the data from the template; elements that are named article, main or
content and hold slots come before the whole body. Menus, headers and footers outside an article, sidebars, notices,
adverts, forms, comments and code are cut. Without a named region, texts that stand on all of several different pages
unchanged are template, as are items and cells that are links alone in lists that mostly are.

Defined results
    null and empty html: empty text. Pages without a host (null or odd urls) share one wrapper. A page that lacks its
    host's data region, or whose host has no other page, is labelled by itself. White space inside a block, also a line
    break, becomes one space; blocks are joined by a line end; empty blocks give nothing. Unclosed elements end where
    HTML ends them; elements deeper than ``DEPTH`` count as that deep. Repeated rows give a row each; other columns are
    not looked at. Pages are read whole, in time linear in their length. An expression is bounded: a level of over
    ``LONG`` units is folded by name, and levels that make it larger than ``NODES`` are left to their parents.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut
from palimpsest.llm.urls import host

#: Hosts whose partial wrappers a task holds before it hands them on; bytes of wrappers that are broadcast at most.
HELD, SMALL, SALTS = 500, 16_000_000, 64
#: Different texts that show a host's pages to be different articles, if they are at least one part in ``PART`` of what is the same.
SEVERAL, PART = 3, 4
#: Bounds of an expression; siblings that are a repeated group on one page; units folded at once; cells of an alignment.
DEPTH, LONG, NODES, RUN, GROUP, CELLS = 100, 48, 4000, 4, 4, 20_000
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*>?|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"\b(?:class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend optgroup option tbody td tfoot th thead title tr".split()) | {"dd", "dt"}
#: Opening the key ends the values, up to a container.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
FENCE = frozenset("ul ol dl table select article section div body html".split())
BAD_TAGS = frozenset("nav aside footer form script style noscript template iframe svg canvas object button select textarea dialog head title menu audio video".split())
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies dialog disqus discussion footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related reply replies respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe toolbar topbar topnav widget".split())
#: Of these, the words that cut an element even from within an article.
CUTTING = frozenset("ad ads advert adverts advertisement advertising comment commentlist comments consent cookie cookies disqus gdpr hidden newsletter promo promoted promotion related respond share sharing sidebar signup sponsor sponsored subscribe".split())
GOOD_WORDS = frozenset("article articlebody content entry main post story text".split())
#: Elements that hold other blocks, and so may be a part of a page.
HOLDERS = frozenset("aside center dl details dir div dialog fieldset figure footer form header menu nav ol section table tbody td tr ul".split())
#: Beside another word, these tell a state of the page and not what an element is.
STATE_FIRST, STATE_LAST = frozenset("has no not with without is".split()), frozenset("free open opened closed enabled disabled active".split())
ROOT, TEXT = "", "#"


def _key(name: str, token: str) -> str:
    """An element in a wrapper: its name and its words of class, id and role, without numbers."""
    if "=" not in token and "hidden" not in token:
        return name
    words: set[str] = set()
    for m in MARK.finditer(token, len(name) + 1):
        value = next((g for g in m.groups() if g is not None), None)
        if m[0][:6].lower() == "hidden" or m[0][:11].lower() == "aria-hidden" and (value or "").lower() == "true":
            words.add("hidden")
        elif value is not None and m[0][:4].lower() != "aria":
            words.update(w for w in re.split(r"\s+", value.lower()) if w)
    words = {re.sub(r"[\d\s>.]+", "", w) for w in words} - {""}
    return f"{name}.{'.'.join(sorted(words))}" if words else name


class Element:
    """Of a page: an element with what it holds, or a text (then ``parts`` are its pieces and ``links`` counts those in links)."""

    __slots__ = ("block", "key", "kids", "links", "parts")

    def __init__(self, key: str, block: int = 0):
        self.key, self.block, self.kids, self.parts, self.links = key, block, [], [], 0

    def kinds(self) -> frozenset:
        return frozenset(k.key for k in self.kids if k.key)

    def add(self, text: str, block: int, linked: bool) -> None:
        if self.kids and self.kids[-1].parts and self.kids[-1].block == block:
            last = self.kids[-1]
        elif text.isspace():
            last = Element(ROOT, block)  # stands at no place of its own
            self.kids.append(last)
        else:
            last = Element(TEXT, block)
            self.kids.append(last)
        if not text.isspace():
            last.key = TEXT
            last.links += len(text.strip()) if linked else 0
        last.parts.append(text)


def parse(html: str) -> Element:
    root = Element(ROOT)
    names, at, open_ = [""], [root], Counter()
    block, pos, size = 0, 0, len(html)

    def close(down: int) -> None:
        for n in names[down:]:
            open_[n] -= 1
        del names[down:], at[down:]

    while pos < size:
        m = TOKEN.match(html, pos)
        token, pos = m[0], m.end()
        if token[0] != "<" or token == "<":
            at[-1].add(token, block, open_["a"] > 0)
            continue
        if token[1] in "!?":
            continue
        if token[-1] != ">":  # a quote that isn't closed, or the end of the page
            end = html.find(">", pos)
            pos = size if end < 0 else end + 1
        name = NAME.match(token)[1].lower()
        if token[1] == "/":
            if open_[name] > 0:
                down = len(names) - 1
                while names[down] != name:
                    down -= 1
                close(down)
            if name in BLOCK:
                block += 1
            continue
        if name in BLOCK:
            block += 1
        ends = IMPLIED.get(name, ())
        para = name in ENDS_P and open_["p"] > 0
        if para or any(open_[e] > 0 for e in ends):
            depth = len(names) - 1
            while depth and names[depth] not in FENCE and (para and open_["p"] > 0 or any(open_[e] > 0 for e in ends)):
                if names[depth] in ends or para and names[depth] == "p":
                    close(depth)
                depth -= 1
        if name == "br":
            at[-1].add(" ", block, False)
        if name in VOID:
            continue
        key = _key(name, token)
        if key == name and name not in BLOCK and name not in RAW and name not in BAD_TAGS or len(at) > DEPTH:
            element = at[-1]
        else:
            element = Element(key)
            at[-1].kids.append(element)
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(html, pos)
            pos = end.start() if end else size
            shut = html.find(">", pos)
            pos = size if shut < 0 else shut + 1
            if name in BLOCK:
                block += 1
            continue
        if token[-2:] == "/>" and name in ("svg", "path"):
            continue
        names.append(name), at.append(element)
        open_[name] += 1
    return root


class Node:
    """A place of an expression: an element with its units, or a text with its characters, those in links, and digests.

    Of the digests there are as many as are needed to tell whether they are ``SEVERAL``. ``bare``: its units go by name.
    """

    __slots__ = ("_kinds", "bare", "chars", "digests", "key", "links", "units")

    def __init__(self, key: str, units: list | None = None, bare: bool = False, chars: int = 0, links: int = 0, digests: tuple = ()):
        self.key, self.units, self.bare, self.chars, self.links, self.digests = key, units or [], bare, chars, links, digests
        self._kinds = None

    def kinds(self) -> frozenset:
        if self._kinds is None:
            self._kinds = frozenset(k for u in self.units for k in u.of)
        return self._kinds

    def packed(self) -> list:
        return [self.key, self.bare, self.chars, self.links, self.digests, [[u.repeated, u.optional, [n.packed() for n in u.of.values()]] for u in self.units]]

    @classmethod
    def unpacked(cls, x: list) -> Node:
        key, bare, chars, links, digests, units = x
        return cls(key, [Unit({n[0]: cls.unpacked(n) for n in of}, r, o) for r, o, of in units], bare, chars, links, tuple(digests))


class Unit:
    """One place, or a group of places that repeats in any number; it may be optional."""

    __slots__ = ("of", "optional", "repeated")

    def __init__(self, of: dict, repeated: bool = False, optional: bool = False):
        self.of, self.repeated, self.optional = of, repeated, optional


#: How two of what units hold become one: nodes of a wrapper, or lists of a page's elements.
Join = Callable


def alike(a: frozenset, b: frozenset) -> bool:
    """Whether two elements hold the same kinds of things, for the greater part."""
    return a == b or 2 * len(a & b) >= len(a | b)


def _kinds_of(x: Node | list[Element]) -> frozenset:
    return x[0].kinds() if isinstance(x, list) else x.kinds()


def fits(a: Unit, b: Unit) -> int:
    """How well two units fit: 0 without a common key, else more if what they have in common is built alike."""
    best = 0
    for k, x in a.of.items():
        if (y := b.of.get(k)) is not None:
            if k == TEXT or alike(_kinds_of(x), _kinds_of(y)):
                return 3
            best = 2
    return best


def paired(a: list[Unit], b: list[Unit]) -> list[tuple[int, int]]:
    """The best common subsequence: pairs in order. A repeated unit may take several."""
    low = 0
    same = lambda x, y: not x.repeated and not y.repeated and x.of.keys() == y.of.keys() and fits(x, y) == 3
    while low < len(a) and low < len(b) and same(a[low], b[low]):
        low += 1
    out = [(i, i) for i in range(low)]
    x, y = a[low:], b[low:]
    if x and y:
        score = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        fit = [[fits(u, v) for v in y] for u in x]
        for i, u in enumerate(x, 1):
            row, up, fit_row = score[i], score[i - 1], fit[i - 1]
            for j, v in enumerate(y, 1):
                best = up[j] if up[j] > row[j - 1] else row[j - 1]
                if f := fit_row[j - 1]:
                    best = max(best, f + up[j - 1], f + row[j - 1] if u.repeated else 0, f + up[j] if v.repeated else 0)
                row[j] = best
        found, i, j = [], len(x), len(y)
        while i and j:
            now, f = score[i][j], fit[i - 1][j - 1]
            if now == score[i - 1][j]:  # the earliest of equal ones
                i -= 1
            elif now == score[i][j - 1]:
                j -= 1
            else:
                found.append((low + i - 1, low + j - 1))
                if now == f + score[i - 1][j - 1]:
                    i, j = i - 1, j - 1
                elif x[i - 1].repeated and now == f + score[i][j - 1]:
                    j -= 1
                else:
                    i -= 1
        out += reversed(found)
    return out


def _union(units: list[Unit], join: Join) -> dict:
    of: dict = {}
    for u in units:
        for k, x in u.of.items():
            of[k] = join(of[k], x) if k in of else x
    return of


def _grouped(units: list[Unit], join: Join) -> Unit:
    return Unit(_union(units, join), True, all(u.optional for u in units))


def _by_key(units: list[Unit], join: Join) -> list[Unit]:
    """Every key in one unit: whatever stands between two occurrences is in a repeated group with them."""
    last, out = {}, []
    for i, u in enumerate(units):
        for k in u.of:
            last[k] = i
    i = 0
    while i < len(units):
        end, j = i, i
        while j <= end:
            end = max(end, *(last[k] for k in units[j].of))
            j += 1
        out.append(units[i] if end == i else _grouped(units[i : end + 1], join))
        i = end + 1
    return out


def _bare(key: str) -> str:
    name = key.split(".", 1)[0]
    return key if key == TEXT else name if name in BLOCK else "inline"


def _bared(units: list[Unit], join: Join) -> list[Unit]:
    def renamed(u: Unit) -> Unit:
        of: dict = {}
        for k, x in u.of.items():
            k = _bare(k)
            if isinstance(x, Node):
                x = Node(k, x.units, x.bare, x.chars, x.links, x.digests)
            of[k] = join(of[k], x) if k in of else x
        return Unit(of, u.repeated or len(of) < len(u.of), u.optional)

    return _by_key([renamed(u) for u in units], join)


def _resolved(units: list[Unit]) -> list[Unit]:
    """Recurrences beside their likes as repeated groups, as long as there are any."""
    again = lambda a, k: all(x.of.keys() == y.of.keys() and fits(x, y) == 3 for x, y in zip(units[a : a + k], units[a + k : a + 2 * k], strict=True))
    i = 0
    while i < len(units):
        at = size = -1
        for k in range(2, GROUP + 1):  # a run of units again
            a = i + 1 - 2 * k
            if at < 0 <= a and any(all(u.optional for u in units[x : x + k]) for x in (a, a + k)) and again(a, k):
                at, size = a, k
        for back in range(i - 1, max(-1, i - 2 - GROUP), -1):  # a unit again, with nothing but optional ones between
            if at >= 0:
                break
            if (units[i].optional or units[back].optional) and fits(units[back], units[i]) == 3:
                at, size = back, i - back
            if not units[back].optional:
                break
        if at < 0:
            i += 1
            continue
        while at >= size and again(at - size, size):
            at -= size
        units[at : i + 1] = [_grouped(units[at : i + 1], across)]
        i = at
    return units


def _merged(a: Node, b: Node, digests: tuple, align: Join) -> Node:
    if a.key == TEXT:
        return Node(TEXT, None, False, a.chars + b.chars, a.links + b.links, digests)
    bare = a.bare or b.bare
    x, y = (_bared(n.units, within) if bare and not n.bare else n.units for n in (a, b))
    units = align(x, y)
    if _places(units) > LONG:
        units = _by_key(units, across)
        if _places(units) > LONG and not bare:
            units, bare = _bared(units, across), True
    return Node(a.key, units, bare)


def _places(units: list[Unit]) -> int:
    return sum(len(u.of) for u in units)


def within(a: Node, b: Node) -> Node:
    """Two occurrences on one page: their texts in turn are what may differ from page to page."""
    one = len(a.digests) == len(b.digests) == 1
    return _merged(a, b, (zlib.crc32(f"{a.digests[0]}.{b.digests[0]}".encode()),) if one else _few(a, b), lambda x, y: aligned(x, y, within))


def across(a: Node, b: Node) -> Node:
    """The same place on different pages."""
    return _merged(a, b, _few(a, b), aligned)


def _few(a: Node, b: Node) -> tuple:
    return a.digests if a.digests == b.digests else tuple(sorted({*a.digests, *b.digests})[:SEVERAL])


def aligned(a: list[Unit], b: list[Unit], join: Join = across) -> list[Unit]:
    """Both sequences in one expression: what fits is merged, mismatches are resolved."""
    if len(a) == len(b) and all(x.of.keys() == y.of.keys() and len(x.of) == 1 and not x.repeated and not y.repeated and fits(x, y) == 3 for x, y in zip(a, b, strict=True)):
        out = [Unit({k: join(n, y.of[k]) for k, n in x.of.items()}, False, x.optional or y.optional) for x, y in zip(a, b, strict=True)]
        return _resolved(out) if any(u.optional for u in out) else out
    if len(a) * len(b) > CELLS:
        a, b = _by_key(a, join), _by_key(b, within)
    pairs, out, i, j, at = paired(a, b), [], 0, 0, 0
    while at < len(pairs):
        x, y = pairs[at]
        out += [Unit(u.of, u.repeated, True) for u in (*a[i:x], *b[j:y])]
        end_x, end_y = x, y
        while at < len(pairs) and (pairs[at][0] == end_x or pairs[at][1] == end_y):
            end_x, end_y = pairs[at]
            at += 1
        mine, theirs = a[x : end_x + 1], b[y : end_y + 1]
        repeated = len(mine) + len(theirs) > 2 or mine[0].repeated or theirs[0].repeated
        of = _union(mine, across)
        for k, n in _union(theirs, within).items():
            of[k] = join(of[k], n) if k in of else n
        out.append(Unit(of, repeated, all(u.optional for u in mine) or all(u.optional for u in theirs)))
        i, j = end_x + 1, end_y + 1
    out += [Unit(u.of, u.repeated, True) for u in (*a[i:], *b[j:])]
    return _resolved(out)


def _runs(kids: list[Element]) -> Iterator[tuple[str, list[Element]]]:
    """Keys in order with their elements: ``RUN`` siblings of a key and more that are built alike are together."""
    for key, run in groupby((k for k in kids if k.key), lambda k: k.key):
        run = list(run)
        if len(run) >= RUN and all(alike(run[0].kinds(), x.kinds()) for x in run[1:]):
            yield key, run
        else:
            yield from ((key, [x]) for x in run)


def _text(elements: list[Element]) -> Node:
    """One place for texts of one page."""
    texts = ["".join(x.parts).strip() for x in elements]
    digest = zlib.crc32("\n".join(texts).encode("utf-8", "replace"))
    return Node(TEXT, None, False, sum(map(len, texts)), sum(x.links for x in elements), (digest,))


def grown(element: Element) -> Node:
    """An expression of one page's element."""
    if element.key == TEXT:
        return _text([element])
    units = []
    for key, run in _runs(element.kids):
        if len(run) > 1 and all(len(x.kids) == 1 and x.kids[0].key == TEXT for x in run):
            node = Node(key, [Unit({TEXT: _text([x.kids[0] for x in run])})])
        else:
            node = grown(run[0])
            for x in run[1:]:
                node = within(node, grown(x))
        units.append(Unit({key: node}, len(run) > 1))
    if _places(units) > LONG:
        units = _by_key(units, within)
        if _places(units) > LONG:
            return Node(element.key, _bared(units, within), True)
    return Node(element.key, units)


def _levels(root: Node) -> list[int]:
    """How many places each level has."""
    out, level = [], [root]
    while level:
        out.append(len(level))
        level = [n for x in level for u in x.units for n in u.of.values()]
    return out


def _lopped(node: Node, depth: int) -> Node:
    units = [Unit({k: _lopped(n, depth - 1) for k, n in u.of.items()}, u.repeated, u.optional) for u in node.units] if depth else []
    return Node(node.key, units, node.bare, node.chars, node.links, node.digests)


class Wrapper:
    """The expression of a host and how many pages it is of."""

    def __init__(self, root: Node, pages: int = 1):
        self.root, self.pages = root, pages

    @classmethod
    def of(cls, page: Element) -> Wrapper:
        return cls(grown(page))._bounded()

    def align(self, other: Wrapper) -> Wrapper:
        return Wrapper(across(self.root, other.root), self.pages + other.pages)._bounded()

    def _bounded(self) -> Wrapper:
        levels = _levels(self.root)
        if sum(levels) > NODES:
            depth = next(d for d in range(len(levels), 0, -1) if d == 1 or sum(levels[: d + 1]) <= NODES)
            self.root = _lopped(self.root, depth)
        return self

    def packed(self) -> str:
        return json.dumps([self.pages, self.root.packed()])

    @classmethod
    def unpacked(cls, text: str) -> Wrapper:
        pages, root = json.loads(text)
        return cls(Node.unpacked(root), pages)

    def expression(self) -> str:
        """As text: ? is optional, + repeated, # a slot, and other texts are left out."""

        def one(n: Node) -> str:
            return ("#" if len(n.digests) > 1 else "") if n.key == TEXT else f"<{n.key}>{show(n)}</>"

        def show(node: Node) -> str:
            out = []
            for u in node.units:
                inner = "".join(one(n) + ("?" if u.repeated and len(u.of) > 1 else "") for n in u.of.values())
                mark = "+" * u.repeated + "?" * u.optional
                out.append(f"({inner}){mark}" if mark and inner else inner)
            return "".join(out)

        return show(self.root)

    def labels(self) -> Labels:
        return Labels(self)


class Labels:
    """What each place of a wrapper is. Places are numbered in order; those below i have the numbers i + 1 to end[i] - 1."""

    def __init__(self, wrapper: Wrapper):
        self.nodes, self.up, self.end, self.always, self.number = [], [], [], [], {}
        self._walk(wrapper.root, -1, True)
        self.parts = [_parts(n.key) for n in self.nodes]
        chars, links = [n.chars for n in self.nodes], [n.links for n in self.nodes]
        self.sum_chars, self.sum_links = self._sums(chars), self._sums(links)
        held = [i for i, n in enumerate(self.nodes) if n.chars]
        self.slots = {i for i in held if len(self.nodes[i].digests) > 1}
        self.inside = self._inside()
        bad = self._bad_parts()
        self.clear = self._clear(bad)
        same = self._same([i for i in held if self.clear[i]], wrapper.pages)
        self.data = [bool(c) and i not in same for i, c in enumerate(chars)]
        self.region = self._region(bad)
        body = not self.region
        if body:
            self.region = [i for i, c in enumerate(self.clear) if c and self.parts[i][0] == "body"][:1] or [0]
        mute = same | self._linked(held) if body else set()
        self.keep = [False] * len(self.nodes)
        for r in self.region:
            for i in range(r, self.end[r]):
                self.keep[i] = self.clear[i] and i not in mute

    def _walk(self, node: Node, up: int, always: bool) -> None:
        i = self.number[id(node)] = len(self.nodes)
        self.nodes.append(node), self.up.append(up), self.end.append(0), self.always.append(always)
        for u in node.units:
            for n in u.of.values():
                self._walk(n, i, always and not u.optional and len(u.of) == 1)
        self.end[i] = len(self.nodes)

    @staticmethod
    def _sums(values: list[int]) -> list[int]:
        out = [0]
        for v in values:
            out.append(out[-1] + v)
        return out

    def _below(self, sums: list[int], i: int) -> int:
        return sums[self.end[i]] - sums[i]

    def _clear(self, bad: set[int]) -> list[bool]:
        out: list[bool] = []
        for i, up in enumerate(self.up):
            out.append(i not in bad and (up < 0 or out[up]))
        return out

    def _inside(self) -> list[str]:
        """For each place, in what kind of region it is: article, content or none."""
        out = [""]
        for i in range(1, len(self.nodes)):
            name, words = self.parts[self.up[i]]
            above = out[self.up[i]]
            out.append("article" if name == "article" or above == "article" else "content" if above or name == "main" or _content(name, words) else "")
        return out

    def _bad(self, i: int) -> bool:
        if self.nodes[i].key in (ROOT, TEXT):
            return False
        # Within an article, what is no text but links, or is on all pages the same, is not the article's.
        odd = 2 * self._below(self.sum_links, i) > self._below(self.sum_chars, i) or bool(self.slots) and self.slots.isdisjoint(range(i, self.end[i]))
        return is_bad(*self.parts[i], self.inside[i], odd)

    def _bad_parts(self) -> set[int]:
        """Elements that are no part of an article by name or words, but not what the article itself stands in.

        While no article or main is clear, one around them with over half of the host's text (of several pages, the text
        that differs) is a layout; so is, where nothing is marked as content, one with over half of the text that differs.
        """
        bad = {i for i in range(len(self.nodes)) if self._bad(i)}
        sizes = self._sums([n.chars if not self.slots or i in self.slots else 0 for i, n in enumerate(self.nodes)])
        strong = [i for i, (name, words) in enumerate(self.parts) if name in ("article", "main") or "main" in words and name in ("div", "section")]
        while bad:
            clear = self._clear(bad)
            marked = any(clear[i] and (i in strong or _content(*p)) for i, p in enumerate(self.parts))
            if any(clear[i] for i in strong) or not strong and (marked or not self.slots):
                break
            around = lambda i: self.parts[i][0] not in BAD_TAGS - {"form"} and (not strong or any(i < s < self.end[i] for s in strong))  # noqa: B023, E731
            tops = [i for i in sorted(bad) if clear[self.up[i]] and around(i) and 2 * self._below(sizes, i) > sizes[-1]]
            if not tops:
                break
            bad.remove(tops[0])
        return bad

    def _same(self, held: list[int], pages: int) -> set[int]:
        """Texts that stand on all pages unchanged, if the pages are different articles."""
        same = {i for i in held if i not in self.slots and self.always[i]} if pages > 1 else set()
        own = lambda i: self.nodes[i].chars - self.nodes[i].links
        # Copies of one article with another menu, date or advert differ, too.
        several = sum(own(i) for i in held if len(self.nodes[i].digests) >= SEVERAL)
        return same if several and PART * several >= sum(map(own, same)) else set()

    def _linked(self, held: list[int]) -> set[int]:
        out = set()
        for i in held:
            item = self.up[i]
            if self.nodes[i].chars == self.nodes[i].links and self.parts[item][0] in ("li", "td"):
                above = self.up[item]
                if self._below(self.sum_chars, item) == self._below(self.sum_links, item) and 2 * self._below(self.sum_links, above) > self._below(self.sum_chars, above):
                    out.add(i)
        return out

    def _region(self, bad: set[int]) -> list[int]:
        """The outermost clear elements of the first kind that hold data; if none does, of the first kind there is."""
        kinds = (lambda n, w: n == "article", lambda n, w: n == "main" or "main" in w and n in ("div", "section"), _content)
        for need in (True, False):
            for kind in kinds:
                tops: list[int] = []
                for i, p in enumerate(self.parts):
                    if self.clear[i] and kind(*p) and not (tops and i < self.end[tops[-1]]):
                        tops.append(i)
                if tops and (not need or any(self.data[j] and self.clear[j] for i in tops for j in range(i, self.end[i]))):
                    return tops
        return []


def _parts(key: str) -> tuple[str, frozenset[str]]:
    name, *words = key.split(".")
    return name, frozenset(words)


def _content(name: str, words: frozenset[str]) -> bool:
    return name in ("div", "section", "td") and bool(words & GOOD_WORDS)


def is_bad(name: str, words: frozenset[str], inside: str, odd: bool) -> bool:
    """Whether an element is no part of an article, by its name and words; headers are, inside of one.

    In an article only a few words cut, or any of the words if the element is ``odd``, too, and holds blocks; in another
    region so do all words, but from elements that hold blocks alone.
    """
    if name in BAD_TAGS:
        return True
    halves = [re.split(r"[-_]+", w) for w in words]
    words = words.union(*(h for h in halves if len(h) < 2 or h[0] not in STATE_FIRST and h[-1] not in STATE_LAST))
    if name == "header" or "header" in words:
        return not words & GOOD_WORDS and inside != "article" and not (inside and name == "header")
    if name in ("html", "body", "article", "main") or BAD_WORDS.isdisjoint(words):
        return False
    if not inside or not CUTTING.isdisjoint(words):
        return True
    return name in HOLDERS and (inside != "article" or odd)


def _match(node: Node, element: Element, labels: Labels, out: list, seen: list) -> None:
    """Texts of an element in order, as (block, text), by what their places in the wrapper are."""
    i = labels.number[id(node)]
    places: dict[int, Node] = {}
    units = [Unit({key: run}, len(run) > 1) for key, run in _runs(element.kids)]
    joined = lambda x, y: x.extend(y) or x
    if node.bare:
        units = _bared(units, joined)
    if len(units) * len(node.units) > CELLS:
        units = _by_key(units, joined)
    for a, b in paired(node.units, units):
        for key, run in units[b].of.items():
            if (place := node.units[a].of.get(key)) is not None:
                places.update((id(x), place) for x in run)
    for kid in element.kids:
        place = places.get(id(kid))
        if place is not None and kid.key != TEXT:
            seen[0] |= labels.number[id(place)] in labels.region
            _match(place, kid, labels, out, seen)
        elif kid.parts:
            if labels.keep[labels.number[id(place)] if place is not None else i]:
                out.append((kid.block, "".join(kid.parts)))
        else:
            _loose(kid, labels.keep[i], _beneath(labels.inside[i], node.key), out)


def _beneath(inside: str, key: str) -> str:
    name, words = _parts(key)
    return "article" if "article" in (inside, name) else "content" if inside or name == "main" or _content(name, words) else ""


def _loose(element: Element, keep: bool, inside: str, out: list) -> None:
    """The same where the wrapper has no place: a page's own parts are what their parent is, unless they are bad."""
    if keep and not is_bad(*_parts(element.key), inside, False):
        for kid in element.kids:
            if kid.parts:
                out.append((kid.block, "".join(kid.parts)))
            else:
                _loose(kid, keep, _beneath(inside, element.key), out)


def _joined(found: list[tuple[int, str]]) -> str:
    blocks = (" ".join(unescape("".join(t for _, t in b)).split()) for _, b in groupby(found, lambda x: x[0]))
    return "\n".join(b for b in blocks if b)


def text_of(page: Element, wrapper: Wrapper, labels: Labels) -> tuple[str, bool]:
    """Main text, and whether the page has any part of the data region."""
    out: list[tuple[int, str]] = []
    seen = [labels.region == [0]]
    _match(wrapper.root, page, labels, out, seen)
    return _joined(out), seen[0]


def extract(html: str | None, wrapper: Wrapper | None = None, labels: Labels | None = None) -> str:
    if not html:
        return ""
    page = parse(html)
    if wrapper is not None:
        text, seen = text_of(page, wrapper, labels or wrapper.labels())
        if seen:
            return text
    own = Wrapper.of(page)
    return text_of(page, own, own.labels())[0]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, wrapper) of the pages that lie here."""
    held: dict[str, Wrapper] = {}
    give = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([w.packed() for w in held.values()], pa.string())], ["host", "wrapper"])
    for batch in batches:
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if html := page.as_py():
                new = Wrapper.of(parse(html))
                held[name] = held[name].align(new) if name in held else new
                if len(held) >= HELD:
                    yield give()
                    held.clear()
    yield give()


def _unite(pdf: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for text in sorted(pdf["wrapper"]):
        part = Wrapper.unpacked(text)
        whole = whole.align(part) if whole else part
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [whole.packed()], "expression": [whole.expression()]})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, expression) of each host.

    Every task that met a host gives partial wrappers of it; these are united in ``SALTS`` groups, then these.
    """
    named = pages.select(F.coalesce(host(F.col("url")), F.lit("")).alias("host"), "html")
    schema = "host string, wrapper string, expression string"
    parts = named.mapInArrow(_fold, "host string, wrapper string").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return parts.groupBy("host", "salt").applyInPandas(_unite, schema).groupBy("host").applyInPandas(_unite, schema)


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    found = cut(wrappers(pages).select("host", "wrapper"))
    size = found.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    named = pages.select("page_id", "url", "html", F.coalesce(host(F.col("url")), F.lit("")).alias("host"))
    # Few bytes of wrappers go to every task; many are joined by shuffle, where Spark splits a host with many pages.
    joined = named.join(F.broadcast(found) if size <= SMALL else found, "host", "left").select("page_id", "url", "html", "wrapper")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Wrapper, Labels]] = {}
        for batch in batches:
            texts = []
            for html, text in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if text is not None and text not in known:
                    if len(known) >= HELD:
                        known.clear()
                    wrapper = Wrapper.unpacked(text)
                    known[text] = (wrapper, wrapper.labels())
                texts.append(extract(html.as_py(), *(known[text] if text is not None else ())))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(of, f"page_id {kind}, url string, text string, n_chars long")
