"""Quality of documents: histogram gradient-boosted trees over statistics of the text.

Statistics are computed per document in the tasks. The trees are fitted on the driver from the statistics of at most
``SAMPLE`` labelled rows, those with the smallest hash of their id, so the fit costs the same at any size and doesn't
depend on how rows are dealt. Held-out rows never enter it. The fitted trees are flattened into arrays, level by level,
and all documents of a batch walk them together.

Defined results
    null and empty texts have the statistics of an empty text and are scored like any other. Labels that are null are
    not learnt from; a document labelled more than once counts as often. Without labels of both classes every score is
    the (smoothed) share of label 1. A null doc_id is held out. Rows that repeat give a row each; only ``doc_id`` and
    ``text`` are looked at. Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, FOLDS, ACCEPT = 20_000, 5, 0.3
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 80, 4, 64, 0.15, 5.0, 1.0

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "white": (9, 11, 12, 13, 32), "line": (10,), "high": range(128, 256), "stop": b".,;:", "loud": b"!?", "bar": b"|/\\", "quote": b"\"'()[]{}<>", "sign": b"#$%&*@^~=+_-"}
_TABLE = np.zeros((256, len(_CLASSES)), np.float64)
for _n, _bytes in enumerate(_CLASSES.values()):
    _TABLE[list(_bytes), _n] = 1
STATISTICS = [*_CLASSES, "bytes", "words", "word_length", "long_word", "shouted", "marked", "distinct", "commonest", "lines", "repeated_lines", "worst_line", "odd_lines", "line_length", "ends"]


def statistics(raw: bytes | None) -> list[float]:
    """Of UTF-8 text, in the order of ``STATISTICS``."""
    raw = raw or b""
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    odd = [1 - len(x.translate(None, _ODD)) / len(x) for x in lines]
    sizes = [len(x) for x in lines]
    return [
        *share.tolist(), np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n, np.log1p(max(map(len, words), default=0)),
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n, sum(c for w, c in counts.items() if w[-1] in _ODD) / n,
        len(counts) / n, max(counts.values(), default=0) / n, np.log1p(len(lines)), 1 - len(set(lines)) / m if lines else 0.0,
        max(odd, default=0.0), sum(s for s, o in zip(sizes, odd, strict=True) if o > 0.08) / max(1, sum(sizes)), np.log1p(sum(sizes) / m),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / m,
    ]


_ODD = b"#$%&*@^~=+_|\\!<>{}[]"


@dataclass
class Trees:
    """Flattened: node i of a tree has the children 2i + 1 and 2i + 2; a leaf is numbered from the last level on."""

    base: float
    feature: np.ndarray  # (trees, 2 ** DEPTH - 1)
    above: np.ndarray  # the value that goes to the right child, if exceeded
    leaf: np.ndarray  # (trees, 2 ** DEPTH)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, above, leaf in zip(self.feature, self.above, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > above[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss; each level picks, for every node, the cut of a histogram with the largest gain."""
    inner, p = 2**DEPTH - 1, (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    if not 0 < y.sum() < len(y):
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin b: at most cuts[b]
    flat = binned + np.arange(width) * BINS
    total, out = np.full(len(y), base), Trees(base, np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1)))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            hist = [np.bincount(at, np.repeat(w, width), many * width * BINS).reshape(many, width, BINS).cumsum(2) for w in (g, h)]
            (gl, hl), (ga, ha) = hist, [w[:, :1, -1:] for w in hist]
            gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(hl < LEAST) | (ha - hl < LEAST)] = 0
            best = gain.reshape(many, -1).argmax(1)
            go = np.full(inner + inner + 1, BINS)
            for i, b in enumerate(best):
                f, cut = divmod(int(b), BINS)
                if gain[i, f, cut] > 1e-9 and cut < len(cuts[f]):
                    out.feature[t, first + i], out.above[t, first + i], go[first + i] = f, cuts[f][cut], cut
            node = 2 * node + 1 + (binned[np.arange(len(y)), out.feature[t][node]] > go[node])
        node -= inner
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        out.leaf[t] = -RATE * gs / (hs + RIDGE)
        total += out.leaf[t][node]
    return out


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
    # Most rows fall away by their hash alone, so that few are sorted however many labels there are.
    share = min(1.0, 1.2 * SAMPLE / max(1, known.count()))
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    order = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)), "doc_id", "quality")
    chosen = F.broadcast(few.orderBy(*order).limit(SAMPLE))  # bounded by the limit
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).join(chosen, "doc_id")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = pa.array([statistics(x.as_py()) for x in b["raw"]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["quality"].cast("int32"), values], ["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(of, f"doc_id {kind}, quality int, x array<double>")
    # A doc_id may have many documents; of their rows, too, those of the smallest hashes are taken.
    rows = found.orderBy(F.xxhash64("doc_id", "quality", "x"), "doc_id", "quality").limit(SAMPLE).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id), r.quality, r.x))
    x = np.array([r.x for r in rows], np.float64).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r.quality == 1 for r in rows], np.float64))


def _scorer(trees: Trees):
    model = trees

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raws in batches:
            x = np.array([statistics(r) for r in raws], np.float64).reshape(len(raws), len(STATISTICS))
            yield pd.Series(model.score(x))

    return score


def scored(docs: DataFrame, labels: DataFrame, into: str = "score") -> DataFrame:
    """``docs`` with their score, 0 to 1: higher if label 1 is likelier."""
    return docs.withColumn(into, _scorer(train(docs, labels))(F.col("text").cast("binary")))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that score at least ``ACCEPT``; rows and columns are otherwise as they were."""
    return docs.where(_scorer(train(docs, labels))(F.col("text").cast("binary")) >= ACCEPT)
