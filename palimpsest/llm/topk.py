"""Exact k best inner products of integer vectors, by a k-d tree in each shard.

Rows are dealt to shards by the cells of a small k-d tree over a bounded sample, which only decides where rows lie: a
shard has at most about ``SHARD`` rows, and a cell with more of them (equal rows can't be split by value) is dealt out
over several. Each shard builds a tree: cells are split at the median of their widest side and keep the tight box of
their rows. A query visits cells best-first by the greatest product that a box allows, until no box can reach its k-th
score. Its k-th score in the shard where it lives goes along to all other shards: those whose whole box can't reach it
are not asked at all, and the others start with it and give back only what reaches it.

Trees stay in one piece; only queries go to them, one row for each shard that has to be asked. A task holds one tree
and ``ASKED`` queries at a time.

Defined results
    Rows whose id is null, or whose vector is null or has a null or non-finite component, take no part. A query's own
    row is every row with its id. All other rows are candidates, each one of repeated rows and ids, too; rows that ask
    under one id are answered together, by the best pairs of one of them with a candidate. Equal scores go to the
    smaller id. A shorter vector is taken to go on with zeros. Other columns are not looked at. Components are
    floor(256 * x); products are exact: in doubles where they fit 53 bits, else in Python's integers (a score beyond a
    long raises an error).
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut

K, LEAF, SCALE = 5, 128, 256
#: Rows of a shard, and from how many on there are several; rows that cells are learnt from; queries searched at once.
SHARD, SMALL, SAMPLE, ASKED = 65_536, 1024, 20_000, 512
#: Bytes of the shards' boxes that are broadcast at most; beyond, all shards are asked.
BOXES = 64_000_000


def matrix(vectors: list) -> np.ndarray:
    """floor(256 * x) of each component, as doubles."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return np.floor(out * SCALE)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(c) for c in row] for row in x], object).reshape(x.shape)


def reach(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest product of each query with a point of each box."""
    return np.maximum(queries, queries * 0) @ high.T + np.minimum(queries, queries * 0) @ low.T


class Tree:
    """Nodes in arrays: a box each, and children (or, for leaves, -1) and the range of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.low, self.high, self.child, self.part, places = [], [], [], [], []
        self._grow(rows, order, places)
        order = np.concatenate(places) if places else order
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high = np.array(self.low).reshape(-1, rows.shape[1]), np.array(self.high).reshape(-1, rows.shape[1])

    def _grow(self, rows: np.ndarray, order: np.ndarray, places: list) -> int:
        if not len(order):
            return -1
        node, here = len(self.child), rows[order]
        low, high = here.min(0), here.max(0)
        self.low.append(low)
        self.high.append(high)
        self.child.append((-1, -1))
        at = sum(map(len, places))
        if len(order) <= LEAF or not here.shape[1] or (low == high).all():
            places.append(order)
            self.part.append((at, at + len(order)))
            return node
        self.part.append((0, 0))
        side = int((high - low).argmax())
        ranked = order[np.argsort(here[:, side].astype(float), kind="stable")]
        half = len(order) // 2
        self.child[node] = (self._grow(rows, ranked[:half], places), self._grow(rows, ranked[half:], places))
        return node

    def search(self, queries: np.ndarray, own: np.ndarray, least: list, k: int = K) -> list[list[tuple]]:
        """For each query its best (score, id), down to ``least`` (None: no bound yet), without its own id."""
        width = self.rows.shape[1]
        fit = np.zeros((len(queries), width))
        fit[:, : queries.shape[1]] = queries[:, :width]
        rows, low, high = self.rows, self.low, self.high
        if np.abs(fit).max(initial=0) * np.abs(rows).max(initial=0) * width >= 2**53:
            fit, rows, low, high = map(_whole, (fit, rows, low, high))
        bound, out = reach(fit, low, high), []
        for q, me, floor, limit in zip(fit, own, least, bound, strict=True):
            best: list[tuple] = []  # a heap: the worst first, as (score, -id)
            heap = [(-limit[0], 0)] if len(limit) else []
            while heap:
                top, node = heapq.heappop(heap)
                worst = best[0][0] if len(best) == k else floor
                if worst is not None and -top < worst:
                    break
                left, right = self.child[node]
                if left >= 0:
                    heapq.heappush(heap, (-limit[left], left))
                    heapq.heappush(heap, (-limit[right], right))
                    continue
                a, b = self.part[node]
                scores = rows[a:b] @ q
                keep = self.ids[a:b] != me
                if worst is not None:
                    keep &= scores >= worst
                for s, i in zip(scores[keep].tolist(), self.ids[a:b][keep].tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    else:
                        heapq.heappushpop(best, (s, -i))
            out.append(sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1])))
        return out


def _cells(rows: np.ndarray, n: int):
    """A tree over a sample with ``n`` leaves, as (side, at, left, right) or the number of a cell."""
    count = iter(range(n))

    def grow(part: np.ndarray, n: int):
        if n == 1 or not part.size or (part.max(0) == part.min(0)).all():
            return next(count)
        side = int((part.max(0) - part.min(0)).argmax())
        at = np.sort(part[:, side])[len(part) * (n // 2) // n - 1 if len(part) * (n // 2) >= n else 0]
        if at == part[:, side].max():  # so that neither half is empty
            at = part[:, side][part[:, side] < at].max()
        left = part[:, side] <= at
        return side, at, grow(part[left], n // 2), grow(part[~left], n - n // 2)

    return grow(rows, n)


def _cell_of(cells, rows: np.ndarray) -> np.ndarray:
    out, todo = np.zeros(len(rows), np.int64), [(cells, np.arange(len(rows)))]
    while todo:
        node, at = todo.pop()
        if not isinstance(node, tuple):
            out[at] = node
            continue
        side, value, left, right = node
        below = rows[at, side] <= value if side < rows.shape[1] else np.full(len(at), value >= 0)
        todo += [(left, at[below]), (right, at[~below])]
    return out


def _dealt(valid: DataFrame, cells, times: dict[int, int]) -> DataFrame:
    """With the shard of each row: its cell and, if that is dealt over several, which one."""

    @F.pandas_udf("long")
    def shard(vectors: pd.Series, row: pd.Series) -> pd.Series:
        cell = _cell_of(cells, matrix(list(vectors)))
        return pd.Series((cell << 20) + row.to_numpy() % np.array([times.get(int(c), 1) for c in cell], np.int64))

    row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40))
    return valid.withColumn("shard", shard("embedding", row))


#: kind 0: a tree and, as vec, its box; 1: a query with its k-th score, if it has any; 2: what a query found.
ROW = "shard long, kind int, tree binary, id long, vec array<double>, least double, hit long, score long"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def _rows(shard: int, kind: int, **columns) -> pd.DataFrame:
    n = len(next(iter(columns.values())))
    return pd.DataFrame({c: columns.get(c, [None] * n) for c in NAMES} | {"shard": [shard] * n, "kind": [kind] * n})


def _hits(shard: int, ids, found: list[list[tuple]]) -> pd.DataFrame:
    each = [(q, i, int(s)) for q, f in zip(ids, found, strict=True) for s, i in f]
    return _rows(shard, 2, id=[e[0] for e in each], hit=[e[1] for e in each], score=[e[2] for e in each])


def _below(score) -> float:
    """As a double, which is not above it."""
    return float(score) if abs(score) < 2**53 else float(np.nextafter(float(score), -np.inf))


def _home(every: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        """A shard's tree, its own queries with the k-th scores that they have here, and what they found."""
        shard, ids, rows = int(pdf["shard"].iloc[0]), pdf["vec_id"].to_numpy(), matrix(list(pdf["embedding"]))
        tree = Tree(ids, rows)
        asks = np.flatnonzero(ids % every == 0)
        found = []
        for at in range(0, len(asks), ASKED):
            part = asks[at : at + ASKED]
            found += tree.search(rows[part], ids[part], [None] * len(part))
        least = [_below(f[-1][0]) if len(f) == K else None for f in found]
        box = np.concatenate((tree.low[0], tree.high[0])).astype(float)
        parts = [_rows(shard, 0, tree=[pickle.dumps(tree)], vec=[box]), _rows(shard, 1, id=ids[asks], vec=list(rows[asks].astype(float)), least=least), _hits(shard, ids[asks], found)]
        return pd.concat([p for p in parts if len(p)])

    return build


def _asking(boxes: list[tuple[int, list | None]]):
    """Each query once for every other shard that may hold a score which reaches its k-th."""
    shards = np.array([s for s, _ in boxes], np.int64)
    width = max((len(b) // 2 for _, b in boxes if b is not None), default=0)
    known = all(b is not None for _, b in boxes)
    low, high = np.zeros((len(boxes), width)), np.zeros((len(boxes), width))
    for i, (_, b) in enumerate(boxes):
        if b is not None:
            low[i, : len(b) // 2], high[i, : len(b) // 2] = b[: len(b) // 2], b[len(b) // 2 :]
    far = max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ASKED):
                part = pdf.iloc[at : at + ASKED]
                vectors = list(part["vec"])
                wanted = part["shard"].to_numpy()[:, None] != shards
                least = part["least"].to_numpy(dtype=float, na_value=np.nan)
                fit = np.zeros((len(part), width))
                for row, v in zip(fit, vectors, strict=True):
                    row[: len(v)] = v[:width]
                if known and np.abs(fit).max(initial=0) * far * width < 2**53:
                    wanted &= ~(reach(fit, low, high) < least[:, None])
                for s, column in zip(shards, wanted.T, strict=True):
                    if column.any():
                        yield _rows(int(s), 1, id=part["id"].to_numpy()[column], vec=[v for v, w in zip(vectors, column, strict=True) if w], least=least[column])

    return ask


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by shard and kind: a tree, then its queries."""
    tree = None
    for pdf in batches:
        at = 0
        while at < len(pdf):
            if pdf["kind"].iloc[at] == 0:
                tree, at = pickle.loads(pdf["tree"].iloc[at]), at + 1
                continue
            rest = pdf["kind"].to_numpy()[at : at + ASKED]
            part = pdf.iloc[at : at + (int(rest.argmin()) if not rest.all() else len(rest))]
            least = [None if pd.isna(x) else x for x in part["least"]]
            vectors = list(part["vec"])
            rows = np.zeros((len(part), max(map(len, vectors), default=0)))
            for row, v in zip(rows, vectors, strict=True):
                row[: len(v)] = v
            ids = part["id"].to_numpy(dtype=np.int64)
            yield _hits(int(part["shard"].iloc[0]), ids, tree.search(rows, ids, least))
            at += len(part)


def top(vectors: DataFrame, every: int, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of each row whose vec_id is divisible by ``every``."""
    if k > K:
        raise ValueError(f"shards give {K} at most")
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    valid = vectors.select(F.col("vec_id").cast("long"), x.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & x.isNotNull() & sound)
    n = valid.count()
    lanes = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // SHARD), min(lanes, -(-n // SMALL)))
    few = valid.where(F.pmod(F.xxhash64("vec_id", x), F.lit(1 << 32)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 32))).limit(2 * SAMPLE)
    cells = _cells(matrix([r[0] for r in few.select(x).collect()]) if shards > 1 else np.zeros((0, 0)), shards)
    sizes = _dealt(valid, cells, {}).groupBy("shard").count().collect() if shards > 1 else []  # a row for each cell
    times = {r["shard"] >> 20: -(-r["count"] // SHARD) for r in sizes if r["count"] > SHARD}
    parts = min(4 * (shards + sum(times.values())), 20_000)
    grown = cut(_dealt(valid, cells, times).repartition(parts, "shard").groupBy("shard").applyInPandas(_home(every), ROW))
    trees, asks, found = (grown.where(F.col("kind") == i) for i in range(3))
    boxes = trees.select("shard", "vec") if shards * 16 * 1024 <= BOXES else trees.select("shard", F.lit(None))
    asks = asks.mapInPandas(_asking([tuple(r) for r in boxes.collect()]), ROW)
    near = trees.union(asks).repartition(parts, "shard").sortWithinPartitions("shard", "kind")
    found = found.union(near.mapInPandas(_meet, ROW)).select(F.col("id").alias("query_id"), F.col("hit").alias("vec_id"), "score")
    # Ranks up to k are kept before the shuffle, too.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
