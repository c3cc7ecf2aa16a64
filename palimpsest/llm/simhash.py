"""SimHash near-duplicates through an inverted index on positional bytes, with count filtering.

Two 64-bit fingerprints at most two bits apart differ in at most two bytes, so of their eight positional bytes at
least six are shared. The index takes four positional bytes to a posting key (a single byte's posting list would hold
a 256th of the corpus, and its pairs grow with the square of that): the eight positions are cut into four pairs, of
which two stay untouched, so a pair that qualifies meets under at least one of the six keys. Pairs from a posting
list tally the positional bytes they share, those with six or more are kept and then verified bit by bit.

Posting lists over ``BUCKET`` members emit no pairs. Their members are linked through stars instead, which is exact
and linear: fingerprints at most two bits apart have a common word at most one bit from each, so every member is
listed under its 65 such words, and each word links its members to the least of them. (Members of one word are never
more than two bits apart.)

Defined results
    null, empty and white texts: no words, fingerprint zero, linked like any other. Texts of fewer words than a shingle
    are one shingle. Rows that repeat give a row each. Null ids take part but never name a component, which is null if
    its documents have no other. Extra columns are not looked at. An empty table gives an empty result. Long texts are
    hashed whole, in pieces of ``PIECE`` shingles, so memory stays at a small multiple of one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import copies
from palimpsest.llm.common import cut, looked_up
from palimpsest.llm.components import components

WORDS, SEED, BITS = 3, 42, 2
#: Longest posting list that is turned into pairs; longer ones are linked through stars.
BUCKET = 16
PIECE = 1 << 16
SHARED = 8 - BITS
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_OFFSETS = np.arange(8, dtype=np.int64) * 256


def fingerprint(raw: bytes | None, words: int = WORDS) -> int:
    """Of UTF-8 text, as an unsigned number: a bit is set if it is in over half of the shingles' hashes."""
    tokens = (raw or b"").lower().split()  # both take ASCII alone: A-Z, and space with \t to \r
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - words + 1]
    ends = ends[words - 1 :]
    tally = np.zeros(2048, np.int64)
    for at in range(0, len(starts), PIECE):
        spans = zip(starts[at : at + PIECE].tolist(), ends[at : at + PIECE].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        tally += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048)
    counts = (tally.reshape(8, 256) @ _BITS_OF).ravel()
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs, one row per document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(of, f"doc_id {kind}, fp long")


def _byte(fp: Column | str, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(255)


def _keys() -> Column:
    """The six posting keys of a fingerprint: a number for the choice of positions, and their four bytes."""
    choices = []
    for n, units in enumerate(combinations(range(4), 2)):
        mask = sum(0xFFFF << (16 * u) for u in units)
        choices.append(F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask - (mask >> 63 << 64))).alias("bytes")))
    return F.array(*choices)


def _pairs(small: DataFrame) -> DataFrame:
    left, right = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    tally = sum((F.when(_byte("a", i) == _byte("b", i), 1).otherwise(0) for i in range(1, 8)), F.when(_byte("a", 0) == _byte("b", 0), 1).otherwise(0))
    met = left.join(right, "key").where("a < b").select("a", "b").where(tally >= SHARED)
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)


def _stars(members: DataFrame) -> DataFrame:
    """Links among fingerprints at most two bits apart, without pairs: two such have a one-bit neighbour in common."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    listed = members.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("word"))
    hubs = listed.groupBy("word").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    return listed.join(hubs, "word").where("fp != hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between fingerprints (fp), enough to connect all that are at most two bits apart."""
    posted = distinct.select("fp", F.explode(_keys()).alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(posted.join(lists, "key"))
    return _pairs(met.where(F.col("n") <= BUCKET)).union(_stars(met.where(F.col("n") > BUCKET).select("fp").distinct()))


def groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id) of each document; component_id is the least doc_id reachable over links."""
    prints = cut(fingerprints(docs, words))
    return grouped(prints, links(prints.select("fp").distinct()))


def grouped(prints: DataFrame, linked: DataFrame) -> DataFrame:
    """(doc_id, fp, root, component_id) of ``prints`` (doc_id, fp), by links (a, b) between values of fp.

    ``root`` tells components apart also where documents of two have the same id.
    """
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    linked = components(linked)
    linked = cut(linked.join(distinct, linked.node == distinct.fp).select("fp", "component", "low"))
    least = linked.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    least = looked_up(linked.select("fp", "component"), least, "component", linked.count())
    named = distinct.join(least, "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("root"), F.coalesce("component_id", "low").alias("component_id"))
    return looked_up(prints, cut(named), "fp", prints.count()).select("doc_id", "fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without near-copies by ``copies``: of each group the row with the least doc_id stays.

    If rows of that doc_id have different texts of the group, one of the text with the least hash stays; if they have
    the same text, the least by the other columns. Rows whose doc_id is null can't be told apart by it; they stay.
    ``docs`` is read three times: give a table, or a frame that is cut.
    """
    prints = cut(copies.signatures(docs))
    distinct = cut(prints.groupBy("fp").agg(F.first("size").alias("size"), F.first("sign").alias("sign")))
    near = grouped(prints.select("doc_id", "fp"), copies.links(docs, distinct)).where("doc_id is not null")
    # Of a group: its texts under the least doc_id, of these one, and whether that has more than one row.
    rows = near.groupBy("root", "doc_id", "fp").agg(F.count("*").alias("n"))
    rows = cut(rows.withColumn("kept", F.struct("doc_id", "fp")))
    keep = rows.groupBy("root").agg(F.min("kept").alias("kept")).select("kept")
    gone = cut(rows.join(keep, "kept", "left_anti").select("doc_id", "fp", F.lit(1).alias("drop")))
    more = cut(rows.where("n > 1").join(keep, "kept", "left_semi").select("doc_id", "fp", F.lit(2).alias("drop")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    words = F.col("text").rlike(r"[^\x09-\x0D ]")
    named = copies._named(docs.select("doc_id", "text", F.struct(*columns).alias("row")))
    named = named.select("doc_id", F.when(words, F.col("fp")).otherwise(0).alias("fp"), "row")
    few = lambda marked: F.broadcast(marked) if marked.count() <= copies.SMALL else marked
    if more.isEmpty():
        return named.join(few(gone.drop("drop")), ["doc_id", "fp"], "left_anti").select("row.*")
    named = named.join(few(gone.union(more)), ["doc_id", "fp"], "left")
    alone = named.where("drop is null").select("row.*")
    twice = named.where("drop = 2").groupBy("doc_id", "fp").agg(F.min("row").alias("row")).select("row.*")
    return alone.union(twice)
