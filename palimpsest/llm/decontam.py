"""Benchmark passages in documents, up to an error budget, by pigeonhole pieces and Myers' bit-parallel distance.

Texts and items are compared as lower-case words (letters and digits) joined by one space. An item of n characters may
be met with ``n * RATE`` edits, k. It is cut into k + 1 pieces, one of which must stand unharmed in any such passage.
One automaton finds all pieces of all items in one pass over a text. A hit is verified up a tree of the item's pieces:
of two halves that share the budget one keeps within its own, so a hit climbs only while the part above it is met
with fewer edits than it has pieces; the last step is the whole item. That loses nothing and ends most hits early.

Defined results
    null and empty texts contain nothing; items without a word are never met. Items of under ``EXACT`` characters are
    met exactly, at word bounds. Equal items are each reported. Repeated documents each give their rows. A document
    and an item give one row, for the place with the fewest edits, then the leftmost. Texts are searched whole; other
    columns are not looked at. Items are read in blocks of ``BLOCK`` characters, each block broadcast and searched in
    turn, so what a task holds doesn't grow with the benchmark; the documents are read once for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, EXACT, BLOCK = 0.1, 30, 8_000_000
WORD = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(w.lower() for w in WORD.findall(text or ""))


def budget(n: int) -> int:
    return int(n * RATE) if n >= EXACT else 0


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Fewest edits between the pattern and a part of ``text`` (from its start if anchored), and where it first ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    carry = 1 if anchored else 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1 | carry) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class Node:
    """Pieces lo to hi of an item: their text from ``start``, met with at most ``most`` edits."""

    start: int
    text: str
    most: int
    up: Node | None = None
    peq: dict[str, int] = field(default_factory=dict)
    #: If this is half of a node of two pieces: the other half, and whether it stands to the right.
    other: str = ""
    right: bool = False

    def window(self, text: str, at: int) -> tuple[int, str]:
        """Where this part may stand if the item starts at about ``at``, with the whole item's slack."""
        lo = max(0, at + self.start - self.most)
        return lo, text[lo : at + self.start + len(self.text) + self.most]


def _tree(item: str, cuts: list[int]) -> list[Node]:
    """The leaves."""
    leaves: list[Node] = []

    def grow(lo: int, hi: int, up: Node | None) -> Node:
        node = Node(cuts[lo], item[cuts[lo] : cuts[hi]], hi - lo - 1, up)
        if hi - lo == 1:
            leaves.append(node)
            return node
        node.peq = masks(node.text)
        mid = (lo + hi) // 2
        a, b = grow(lo, mid, node), grow(mid, hi, node)
        if hi - lo == 2:
            a.other, a.right, b.other = b.text, True, a.text
        return node

    grow(0, len(cuts) - 1, None)
    return leaves


def _beside(leaf: Node, text: str, p: int) -> bool:
    """False if the piece beside an exact one can't be met with one edit: a half of it would have to stand unharmed."""
    other, half = leaf.other, len(leaf.other) // 2
    if leaf.right:
        q = p + len(leaf.text)
        if text.startswith(other[:half], q):
            return True
        rest, q = other[half:], q + half
    else:
        q = p - len(other) + half
        if q >= 0 and text.startswith(other[half:], q):
            return True
        rest, q = other[:half], q - half
    return any(x >= 0 and text.startswith(rest, x) for x in (q - 1, q, q + 1))


class Finder:
    def __init__(self, items: list[tuple[object, str]]):
        """items: (id, text)."""
        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.auto, pieces = ahocorasick.Automaton(), {}
        for n, (_, t) in enumerate(self.items):
            k = budget(len(t))
            for leaf in _tree(t, [len(t) * i // (k + 1) for i in range(k + 2)]):
                pieces.setdefault(leaf.text, []).append((n, leaf))
        for text, leaves in pieces.items():
            self.auto.add_word(text, leaves)
        self.auto.make_automaton()

    def _climb(self, leaf: Node, text: str, p: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the item around its piece at ``p``."""
        if leaf.other and not _beside(leaf, text, p):
            return None
        node, at = leaf, p - leaf.start
        if not leaf.up:
            end = p + len(leaf.text)
            return (0, p, end) if (p == 0 or text[p - 1] == " ") and text[end : end + 1] in ("", " ") else None
        while node.up:
            node = node.up
            lo, window = node.window(text, at)
            edits, end = myers(node.peq, len(node.text), window)
            if edits > node.most:
                return None
        back = window[:end][::-1]
        _, length = myers(masks(node.text[::-1]), len(node.text), back, anchored=True)
        return edits, lo + end - length, lo + end

    def find(self, text: str | None, first: bool = False) -> list[tuple[object, int, int, int]]:
        """(id, edits, start, end) in the normal text: the best place of each item; any one if ``first``."""
        if not len(self.auto) or not text:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        seen: dict[int, set[int]] = {}
        for last, leaves in self.auto.iter(text):
            for n, leaf in leaves:
                p = last + 1 - len(leaf.text)
                # The item was verified there through another of its pieces, or was met without an edit.
                if p - leaf.start in seen.get(n, ()) or n in best and not best[n][0]:
                    continue
                found = self._climb(leaf, text, p)
                if found:
                    if first:
                        return [(self.items[n][0], *found)]
                    seen.setdefault(n, set()).add(p - leaf.start)
                    best[n] = min(best.get(n, found), found)
        return [(self.items[n][0], *x) for n, x in sorted(best.items())]


def _offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normal text as spans of the text, widened to whole words."""
    words, at, starts = list(WORD.finditer(text)), 0, []
    for w in words:
        starts.append(at)
        at += len(w[0].lower()) + 1
    index = pd.Index(starts)
    inside = lambda x: words[max(0, index.searchsorted(x, "right") - 1)]
    return [(inside(a).start(), inside(b - 1).end()) for a, b in spans]


def _blocks(bench: DataFrame) -> list:
    """Broadcasts of the items, each of about ``BLOCK`` characters at most."""
    items = bench.select("item_id", "text").where("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    n = max(1, -(-int(chars) // BLOCK))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    context = bench.sparkSession.sparkContext
    return [context.broadcast([tuple(r) for r in items.where(part == i).orderBy("item_id", "text").collect()]) for i in range(n)]


def matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, end): passages met; start and end are code points of the document's text."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {bench.schema['item_id'].dataType.simpleString()}, edits int, start long, end long"

    def search(items):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(items.value)
            for batch in batches:
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    text = text.as_py()
                    if found := finder.find(normal(text)):
                        spans = _offsets(text, [x[2:] for x in found])
                        rows += [(doc, i, d, *s) for (i, d, *_), s in zip(found, spans, strict=True)]
                if rows:
                    names = ["doc_id", "item_id", "edits", "start", "end"]
                    types = [batch.schema.field(0).type, None, pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        return of

    out = None
    for items in _blocks(bench):
        part = docs.select("doc_id", "text").mapInArrow(search(items), schema)
        out = part if out is None else out.union(part)
    return out


def _clean(items):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(items.value)
        for texts in batches:
            yield pd.Series([not finder.find(normal(t), first=True) for t in texts], dtype=bool)

    return clean


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without those that contain a benchmark item; rows and columns are otherwise as they were."""
    for items in _blocks(bench):
        docs = docs.where(_clean(items)(F.col("text")))
    return docs
