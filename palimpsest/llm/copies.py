"""Near-copies by Jaccard similarity of five-word shingles, at least ``LEAST``, for the corpus pipeline.

A text's signature is a SimHash of 1,000 bits: a bit is set if it is set in over half of the hashes of the shingles that
vote on it. If all shingles voted on every bit, as they do in ``simhash``, texts at 0.8 would differ in 15 % of the bits
and share one positional byte in four, so that an index of keys selective enough would need some 500 of them for each
text. So the signature has ``BANDS`` parts of ``ROWS`` positional bytes, and ``VOTERS`` shingles vote on a part: the least
under each of as many orders. Two texts have a voter in common with the probability of their similarity, and a part whose
voters are the same is the same, whatever the number of shingles. The inverted index posts the positional bytes of each
part as a key; a pair at 0.8 shares none of them at most once in 20,000. Pairs that meet are filtered by their counts of
shingles and by the tally of positional bytes that they share, of all parts, and those with at least ``SHARED`` are
verified by their exact similarity.

Posting lists up to ``BUCKET`` members give their pairs. Longer ones, whose pairs grow with the square of a group, give
none: their members are dealt to blocks of ``BLOCK`` at most, and a block is compared in its task by one matrix product,
which has the exact similarity of all its members and gives a star of links for each group found there. If a list has
several blocks, groups are closed over all links, and the members outside the list's largest group are compared with
every block in the same way. So each two texts that meet in the index are in one group or were compared, however long
their lists are.

Defined results
    Words as in ``simhash``: ASCII lower case, ASCII white space. Texts of fewer words than a shingle are one shingle. Null,
    empty and white texts have none and are copies of each other. A shingle counts once, however often a text has it.
    Rows that repeat, null ids and extra columns: as in ``simhash``. Texts are equal if their 64-bit hashes and lengths
    are; shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, looked_up
from palimpsest.llm.components import components

#: Words of a shingle, and the least similarity of near-copies as a fraction.
WORDS, LEAST = 5, (4, 5)
BANDS, ROWS, VOTERS, BUCKET, BLOCK, SEED = 25, 5, 5, 8, 2048, 42
#: Of 125 positional bytes a pair at 0.8 that meets shares 53 on average; none of 60,000 simulated ones shared fewer than 16.
SHARED = 14
#: Shingles of all members of a block together, at most; shingles that a product takes at once; tasks that read a list.
HELD, WIDE, SALTS = 4_000_000, 1024, 8
#: Shingles whose orders are computed at once; rows of texts that are looked up by broadcast at most; pairs of a text in one task.
PIECE, SMALL, SPREAD = 1 << 13, 1_000_000, 10_000
_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 31, BANDS * VOTERS, np.int64).astype(np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
#: An order multiplies by an odd number; multiplied by its inverse, what is least gives its shingle back.
_BACK = np.array([pow(int(x), -1, 1 << 32) for x in _ORDERS[:, 0]], np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes | None, words: int = WORDS) -> np.ndarray:
    """Of UTF-8 text: the distinct hashes of its shingles, in order."""
    tokens = (raw or b"").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in tokens), np.uint64, len(tokens))
    n = max(1, len(tokens) - words + 1)
    out = np.full(n, len(tokens) if len(tokens) < words else words, np.uint64)
    for i in range(min(words, len(tokens))):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n])
    return np.unique(out)


def signature(found: np.ndarray) -> bytes:
    """The positional bytes of a text by its shingles: the votes of each part's voters, bit by bit."""
    least = np.full(BANDS * VOTERS, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), PIECE):
        np.minimum(least, (_ORDERS * short[at : at + PIECE]).min(axis=1), out=least)
    hashes = _mixed((least * _BACK).astype(np.uint64)).view(np.uint8).reshape(BANDS, VOTERS, 8)[:, :, :ROWS]
    votes = np.unpackbits(hashes, axis=2).sum(1, np.uint8)
    return np.packbits(2 * votes > VOTERS, axis=1).tobytes()


def _named(docs: DataFrame) -> DataFrame:
    """With a number of each text, fp: equal texts have the same."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.withColumn("raw", raw).withColumn("fp", F.xxhash64("raw", F.octet_length("raw")))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, size, sign): a number for each text, 0 without words; how many shingles it has; its signature."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py()) for x in batch.column(1)]
            fp = [f if len(s) else 0 for f, s in zip(batch.column(2).to_pylist(), sets, strict=True)]
            signs = [signature(s) if len(s) else None for s in sets]
            columns = [batch.column(0), pa.array(fp, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "size", "sign"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _named(docs.select("doc_id", "text")).select("doc_id", "raw", "fp").mapInArrow(of, f"doc_id {kind}, fp long, size long, sign binary")


def _posted(distinct: DataFrame) -> DataFrame:
    """(key, fp): each text under the positional bytes of every part."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sign", ROWS * i + 1, ROWS)) for i in range(BANDS)])
    return distinct.where("sign is not null").select(F.explode(keys).alias("key"), "fp")


def _first(posted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs (a, b) of short lists, and the members (key, fp) of long ones."""
    lists = posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    # Each list stands ``SALTS`` times, so that a long one is read by as many tasks.
    lists = cut(lists).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = cut(posted.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(lists, ["key", "salt"]).drop("salt"))
    short = met.where(F.col("size") <= BUCKET).groupBy("key").agg(F.collect_list("fp").alias("all"))
    short = short.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a < b")
    return short.distinct(), met.where(F.col("size") > BUCKET).select("key", "fp")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, has): the shingles of the wanted texts, each once."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(x.as_py()).view(np.int64) for x in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["fp", "has"])

    texts = _named(docs.select("text")).select("fp", "raw")
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= SMALL else wanted, "fp", "left_semi")
    return cut(texts.groupBy("fp").agg(F.first("raw").alias("raw")).mapInArrow(of, "fp long, has array<long>"))


def _verified(docs: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs that are near-copies: by counts, by the tally of shared bytes, then exactly."""
    signed = distinct.select("fp", "size", "sign")
    side = lambda end: signed.select(F.col("fp").alias(end), F.col("size").alias(f"size_{end}"), F.col("sign").alias(f"sign_{end}"))
    few, many = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    pairs = cut(pairs)
    # An end with many pairs is repeated, once for ``SPREAD`` of them; there is at most one such for every SPREAD / 2 pairs.
    often = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").count().where(F.col("count") > SPREAD)
    often = cut(often.select("fp", F.ceil(F.col("count") / SPREAD).alias("times")))
    met = _spread(_spread(pairs, side("a"), "a", often), side("b"), "b", often).where(few * LEAST[1] >= many * LEAST[0])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= SHARED))

    near = cut(met.select("a", "b", "sign_a", "sign_b").mapInArrow(tally, "a long, b long"))
    texts = _sets(docs, cut(near.select(F.explode(F.array("a", "b")).alias("fp")).distinct()))
    side = lambda end: texts.select(F.col("fp").alias(end), F.col("has").alias(f"has_{end}"))
    both = _spread(_spread(near, side("a"), "a", often), side("b"), "b", often).withColumn("same", F.size(F.array_intersect("has_a", "has_b")))
    return cut(both.where(F.col("same") * LEAST[1] >= (F.size("has_a") + F.size("has_b") - F.col("same")) * LEAST[0]).select("a", "b"))


def _spread(pairs: DataFrame, facts: DataFrame, end: str, often: DataFrame) -> DataFrame:
    """``pairs`` with what ``facts`` knows of one end, of which some (``often``: fp, times) have too many pairs for a task."""
    if often.isEmpty():
        return pairs.join(facts, end)
    often, times = F.broadcast(often.withColumnRenamed("fp", end)), F.coalesce("times", F.lit(1).cast("long"))
    left = pairs.join(often, end, "left").withColumn("salt", F.pmod(F.xxhash64("b" if end == "a" else "a"), times)).drop("times")
    right = facts.join(often, end, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).drop("times")
    return left.join(right, [end, "salt"]).drop("salt")


def _similar(sets: list[np.ndarray], among: list[np.ndarray] | None = None) -> np.ndarray:
    """Which of ``sets`` are similar to which of ``among`` (or to each other), exactly."""
    both = sets if among is None else [*sets, *among]
    mine, theirs = slice(len(sets)), slice(0 if among is None else len(sets), len(both))
    rows, items = np.repeat(np.arange(len(both)), [len(x) for x in both]), np.concatenate(both)
    _, place, times = np.unique(items, return_inverse=True, return_counts=True)
    shared = times > 1  # what one text has alone counts in no intersection
    number = np.cumsum(shared) - 1
    rows, place = rows[shared[place]], number[place[shared[place]]]
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    sizes = np.array([len(x) for x in both], np.float64)
    same = np.zeros((len(sets), theirs.stop - theirs.start), np.float32)
    for low in range(0, int(shared.sum()), WIDE):
        a, b = np.searchsorted(place, (low, low + WIDE))
        has = np.zeros((len(both), WIDE), np.float32)
        has[rows[a:b], place[a:b] - low] = 1
        same += has[mine] @ has[theirs].T
    near = np.empty(same.shape, bool)
    for at in range(0, len(sets), 256):
        part = same[at : at + 256]
        near[at : at + 256] = part * LEAST[1] >= (sizes[mine][at : at + 256, None] + sizes[theirs] - part) * LEAST[0]
    return near


def _stars(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links from the least member of each group of a block to its others."""
    pdf = pdf.sort_values("fp")
    fp, sets = pdf["fp"].to_numpy(), list(pdf["has"])
    near, out, free = _similar(sets), [], np.ones(len(fp), bool)
    for root in range(len(fp)):
        reached = np.zeros(len(fp), bool)
        reached[root] = free[root]
        now = np.flatnonzero(reached)
        while len(now):
            new = near[now].any(0) & free & ~reached
            reached |= new
            now = np.flatnonzero(new)
        free &= ~reached
        out += [(fp[root], x) for x in fp[reached] if x != fp[root]]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _between(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links from members outside a list's largest group to those of a block that are in other groups."""
    outside, block = pdf[pdf["part"] >= 0], pdf[pdf["part"] < 0]
    if not len(outside) or not len(block):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    near = _similar(list(outside["has"]), list(block["has"])) & (outside["group"].to_numpy()[:, None] != block["group"].to_numpy())
    x, y = np.nonzero(near)
    return pd.DataFrame({"a": outside["fp"].to_numpy()[x], "b": block["fp"].to_numpy()[y]})


def _dense(docs: DataFrame, long: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) among the members of long lists."""
    lanes = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = _sets(docs, cut(long.select("fp").distinct()))
    sized = cut(long.join(sets.select("fp", F.size("has").alias("size")), "fp"))
    lists = sized.groupBy("key").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / HELD)).cast("int").alias("blocks"))
    lists = cut(lists.where("n > 1"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block")
    placed = cut(looked_up(sized, lists.withColumn("all", F.col("n")), "key", sized.count()).select("key", "fp", "all", "blocks", block))
    stars = placed.join(sets, "fp").groupBy("key", "block").applyInPandas(_stars, "a long, b long")
    found = cut(found.union(stars.distinct()).coalesce(lanes))
    several = placed.where("blocks > 1")
    if several.isEmpty():
        return found
    grouped = cut(several.join(components(found).toDF("fp", "group"), "fp", "left").withColumn("group", F.coalesce("group", "fp")))
    per = grouped.groupBy("key", "group").agg(F.count("*").alias("n"))
    tops = per.groupBy("key").agg(F.max(F.struct("n", "group")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("groups")).where("groups > 1")
    tops = tops.select("key", "n", F.col("top.group").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("parts"))
    mixed = cut(looked_up(grouped, cut(tops), "key", grouped.count()))
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = mixed.where("group != top").select("key", "fp", "group", part.alias("part"), each("blocks").alias("block"))
    outside = outside.withColumn("of", F.col("part"))
    inside = mixed.select("key", "fp", "group", F.lit(-1).alias("part"), "block", each("parts").alias("of"))
    met = outside.select(*inside.columns).union(inside).join(sets, "fp").groupBy("key", "block", "of").applyInPandas(_between, "a long, b long")
    return cut(found.union(met.distinct()).coalesce(lanes))


def links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): links between texts (fp, size, sign) of ``docs``, enough to connect all that are near-copies."""
    pairs, long = _first(_posted(distinct))
    found = _verified(docs, distinct, pairs)
    return found if long.isEmpty() else _dense(docs, long, found)
