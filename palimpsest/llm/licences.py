"""Licence notices in texts: exact phrases, and short notices with a few errors.

A text becomes its lower-case words (ASCII letters and digits, and all that isn't ASCII) joined by one space. A notice
of n characters may be met with ``n // ERROR_EVERY`` errors, k: insertions, deletions or substitutions. It is cut into
k + 1 seeds, one of which any such passage holds unharmed. One automaton finds all seeds; in the window of each hit, as
long as the notice and k more on either side, the regex library's bounded-error matching, with the best match asked for,
verifies the notice, at word bounds, and gives its span. Of matches that overlap the one with the fewest errors (then of
the longest notice, then the leftmost) stays. Time is linear in the text.

Defined results
    null and empty texts have no words, no labels and score 0. Rows that repeat give a row each; other columns are not
    looked at. Texts are searched whole. Places of a phrase may overlap; all count.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_EVERY = 12
#: Windows whose match a task remembers; they only save time.
REMEMBERED = 20_000
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# The opening words of public licences and usual notices.
NOTICES = (
    ("agpl-3", "gnu affero general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
_APART = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def budget(notice: str) -> int:
    return len(notice) // ERROR_EVERY


class Scanner:
    def __init__(self, notices=NOTICES):
        self.notices, self.auto, seeds = notices, ahocorasick.Automaton(), {}
        # What stands beyond a window (shown by a null, if it goes on there) is no error and no bound.
        self.match = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n)}){{e<={budget(n)}:[^\x00]}}(?![^ ])") for _, n in notices]
        self.known: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        for i, (_, n) in enumerate(notices):
            k = budget(n)
            cuts = [len(n) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(n[a:b], []).append((i, a))
        for seed, at in seeds.items():
            self.auto.add_word(seed, (len(seed), at))
        self.auto.make_automaton()

    def _best(self, i: int, text: str, lo: int, hi: int) -> tuple[int, int, int] | None:
        """(errors, start, end) of the best match of a notice within a window; windows that read alike are matched once."""
        piece = ("\0" if lo and text[lo - 1] != " " else " ") + text[lo:hi] + ("\0" if hi < len(text) and text[hi] != " " else "")
        if (i, piece) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            m = self.match[i].search(piece)
            self.known[i, piece] = (sum(m.fuzzy_counts), m.start(), m.end()) if m else None
        found = self.known[i, piece]
        return found and (found[0], found[1] + lo - 1, found[2] + lo - 1)

    def find(self, text: str) -> list[tuple[int, int, int, str, int]]:
        """(start, end, errors, label, length of the notice) in joined words; none overlap.

        Every hit's own window gives its best match. Of all these the one with the fewest errors, then of the longest
        notice, then the leftmost is taken, then the next that overlaps none taken, and so on.
        """
        windows = {(i, last + 1 - size - a) for last, (size, at) in self.auto.iter(text) for i, a in at}
        taken, kept, heap = bytearray(len(text)), [], []

        def seek(i: int, lo: int, hi: int) -> None:
            if best := self._best(i, text, lo, hi):
                heapq.heappush(heap, (best[0], -len(self.notices[i][1]), *best[1:], i, lo, hi))

        for i, start in windows:
            n, k = len(self.notices[i][1]), budget(self.notices[i][1])
            seek(i, max(0, start - k), min(len(text), start + n + k))
        while heap:
            errors, n, start, end, i, lo, hi = heapq.heappop(heap)
            if taken.find(1, start, end) < 0:
                taken[start:end] = b"\1" * (end - start)
                kept.append((start, end, errors, self.notices[i][0], -n))
                continue
            while lo < hi:  # what is still free of the window
                free = taken.find(1, lo, hi)
                free = hi if free < 0 else free
                if free - lo >= -n - budget(self.notices[i][1]):
                    seek(i, lo, free)
                lo = taken.find(0, free, hi)
                if lo < 0:
                    break
        return sorted(kept)


def scan(scanner: Scanner, raw: bytes | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    words = (raw or b"").translate(_APART).split()
    joined = b" ".join(words)
    padded, places, base = b" " + joined + b" ", [], set()
    for phrase, label in PHRASES:
        needle, at, seen, word = f" {phrase} ".encode(), -1, 0, 0
        while (at := padded.find(needle, at + 1)) >= 0:
            word, seen = word + padded.count(b" ", seen, at), at
            places.append(word)
            base.add(label)
    found = scanner.find(joined.decode("utf-8", "replace"))
    spans = ""
    if found:
        text = raw.decode("utf-8", "replace")
        at, bounds = 0, []
        for m in _WORD.finditer(text):
            bounds.append((at, *m.span()))
            at += m.end() - m.start() + 1
        starts = {a: s for a, s, _ in bounds}
        ends = {a + e - s: e for a, s, e in bounds}
        spans = ",".join(f"{label}:{starts[s]}:{ends[e]}:{errors}" for s, e, errors, label, _ in found)
    score = max([1.0 if base else 0.0, *(1 - errors / n for _, _, errors, _, n in found)])
    labels = base | {f[3] for f in found}
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def report(docs: DataFrame) -> DataFrame:
    """A row for each document; spans are label:start:end:errors, in code points of the text, ends exclusive."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scan(scanner, x.as_py()) for x in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(of, schema)
