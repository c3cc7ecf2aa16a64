"""SentencePiece encoding and decoding by a Viterbi pass that words with a common prefix share.

A text is cut into marked words (leading spaces and what follows them); no piece of the vocabulary reaches from one
into the next. The distinct words of a batch are sorted, which is the depth-first order of their trie: for each word
the forward states of the prefix that it shares with the word before are kept, and only the rest is computed.

The state of a prefix is its best score and last piece. For a unigram model that is the plain Viterbi recurrence. The
vocabulary here is a byte-pair model, whose result is not the path of the highest sum, so the lattice only has the
edges that its merges allow: piece t may follow piece p if merging the characters of both gives p and t again. With
these edges exactly one path is left for each prefix, and it is what the reference library returns.

Defined results
    null and empty texts: no ids. A text that has U+2581 itself gets it as bytes, as any character outside the
    vocabulary, so decoding returns every text unchanged (the library would return a space). Ids outside the
    vocabulary can't be decoded and raise an error; ids of control pieces decode to nothing; bytes that aren't UTF-8
    decode to U+FFFD. Rows that repeat give a row each; other columns are kept. Long words cost linear time. What a
    task remembers between batches is bounded by ``REMEMBERED`` words and ``PAIRS`` pairs; they only save time.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBERED, PAIRS, CHARS = 400_000, 1_000_000, 4_000_000
MARK, ONE = "▁", (1,)


def load(path: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kinds: piece, byte, other."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece"
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


class Codec:
    """Encodes and decodes; spaces stand for the vocabulary's mark, so that a mark in a text is a character of its own."""

    def __init__(self, pieces: list[tuple[str, float, str]], merges: bool = True):
        self.merges = merges
        self.text = [p.replace(MARK, " ") for p, _, _ in pieces]
        self.score = [s for _, s, _ in pieces]
        self.ids = {self.text[i]: i for i, (_, _, k) in enumerate(pieces) if k == "piece"}
        self.byte = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.raw = [bytes((self.of_byte[i],)) if k == "byte" else b"" if k == "other" else self.text[i].encode() for i, (_, _, k) in enumerate(pieces)]
        self.table = pa.array(self.raw, pa.binary())
        # How long pieces are that end in these two characters, longest first.
        sizes: dict[str, set[int]] = {}
        for t in self.ids:
            sizes.setdefault(t[-2:] if len(t) > 1 else t, {1}).add(len(t))
        self.sizes = {t: tuple(sorted(x, reverse=True)) for t, x in sizes.items()}
        apart = "".join(c for c in "\n\t\r" if not any(c in t for t in self.ids))
        # Where no piece has a space after another character, words are cut before spaces, and around such characters.
        if any(" " in t.lstrip(" ") for t in self.ids):
            raise ValueError("a piece of this vocabulary reaches across words")
        self.words = re.compile(rf" *[^ {apart}]+| +|[{apart}]" if apart else " *[^ ]+| +").findall
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.fallback = min(self.score[i] for i in self.ids.values()) - 10

    def merged(self, text: str) -> list[str]:
        """Characters of a short text, merged pair by pair: the best score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.score[i], n) for n in range(len(parts) - 1) if (i := self.ids.get(parts[n] + parts[n + 1])) is not None]
            if not found:
                break
            n = min(found)[1]
            parts[n : n + 2] = [parts[n] + parts[n + 1]]
        return parts

    def follows(self, before: int, piece: int) -> bool:
        """Whether ``piece`` may follow ``before``; -1 is a word's start or a character outside the vocabulary."""
        key = (before + 1) << 32 | piece
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            head = [self.text[before]] if before >= 0 else []
            known = self.pairs[key] = self.merged("".join([*head, self.text[piece]])) == [*head, self.text[piece]]
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each word as packed 32-bit numbers, by one depth-first pass over their trie."""
        ids, score, sizes, pairs, follows, merges = self.ids.get, self.score, self.sizes.get, self.pairs, self.follows, self.merges
        out: dict[str, bytes] = {}
        forward, last, start, before = [0.0], [-1], [0], ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            if word.startswith(before):
                shared = most
            else:
                while shared < most and word[shared] == before[shared]:
                    shared += 1
            del forward[shared + 1 :], last[shared + 1 :], start[shared + 1 :]
            piece, at = last[-1], start[-1]
            for end in range(shared + 1, len(word) + 1):
                best = None
                # Mostly the last piece goes on; as only one piece can be right, finding it so ends the search.
                if merges and piece >= 0:
                    t = ids(word[at:end])
                    if t is not None:
                        p = last[at]
                        ok = pairs.get((p + 1) << 32 | t)
                        if follows(p, t) if ok is None else ok:
                            best, piece = forward[at] + score[t], t
                if best is None:
                    piece, at = -1, end - 1
                    for size in sizes(word[end - 2 : end], ONE) if end > 1 else ONE:
                        begin = end - size
                        if begin < 0:
                            continue
                        t = ids(word[begin:end])
                        if t is None:
                            continue
                        if not merges:
                            if best is None or forward[begin] + score[t] > best:
                                best, piece, at = forward[begin] + score[t], t, begin
                            continue
                        p = last[begin]
                        ok = pairs.get((p + 1) << 32 | t)
                        if follows(p, t) if ok is None else ok:
                            best, piece, at = forward[begin] + score[t], t, begin
                            break
                    if best is None:
                        best = forward[end - 1] + self.fallback
                forward.append(best)
                last.append(piece)
                start.append(at)
            found, end = [], len(word)
            while end:
                if last[end] >= 0:
                    found.append(last[end])
                else:
                    found.extend(self.byte[b] for b in reversed(word[end - 1].encode()))
                end = start[end]
            found.reverse()
            out[word] = array("i", found).tobytes()
            before = word
        return out

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, packed."""
        cut = [self.words(" " + t) if t else [] for t in texts]
        known = self.known
        known.update(self.encode_words({w for ws in cut for w in ws if w not in known}))
        if len(known) > REMEMBERED:  # of words seen before, those of this batch are kept, if these are not too many
            used = {w: known[w] for ws in cut for w in ws}
            self.known = used if len(used) <= REMEMBERED else {}
        return [b"".join([known[w] for w in ws]) for ws in cut]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        raw = self.raw
        joined = b"".join([raw[i] for i in ids])
        return joined[1:].decode("utf-8", "replace") if joined[:1] == b" " else joined.decode("utf-8", "replace")


def _lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in packed], dtype=np.int64))) // 4
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _lossless(codec: Codec, ids: pa.ListArray, texts: pa.Array) -> pa.Array:
    """Whether the pieces of each row, joined, are its text after one space; no text has no pieces."""
    joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, codec.table.take(ids.values)), b"")
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    marked = pc.binary_join_element_wise(pa.scalar(b" ", pa.binary()), texts, pa.scalar(b"", pa.binary()))
    return pc.equal(joined, pc.if_else(pc.equal(texts, b""), texts, marked))


_HELD: dict = {}


def _codec(pieces) -> Codec:
    """One codec a worker, for the tasks that it runs one after another."""
    if pieces.value is not _HELD.get("of"):
        _HELD.update({"of": pieces.value, "codec": Codec(pieces.value)})
    return _HELD["codec"]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose last column has about ``CHARS`` bytes of text; one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.columns[-1]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHARS, "right")))
        yield batch.slice(at, end - at)
        at = end


def _broadcast(spark: SparkSession, path: str):
    """The vocabulary goes to every task; it is as large as the model says, tens of thousands of short pieces."""
    return spark.sparkContext.broadcast(load(path))


def encode(docs: DataFrame, text: str = "text", path: str = MODEL) -> DataFrame:
    """``docs`` with ids (array of int), n_tokens and lossless: whether decoding the ids gave the text back."""
    pieces = _broadcast(docs.sparkSession, path)
    keep = [c for c in docs.columns if c not in ("ids", "n_tokens", "lossless")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(pieces)
        for batch in batches:
            for part in _slices(batch):
                texts = part.columns[-1]
                ids = _lists(codec.packed(texts.to_pylist()))
                columns = [*part.columns[:-1], ids, pc.list_value_length(ids).cast(pa.int64()), _lossless(codec, ids, texts)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "n_tokens", "lossless"])

    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("lossless", T.BooleanType())]
    return source.mapInArrow(of, T.StructType(source.schema.fields[:-1] + new))


def decode(df: DataFrame, ids: str = "ids", into: str = "text", path: str = MODEL) -> DataFrame:
    """``df`` with ``into``: the text of the ids; null ids give the empty text."""
    pieces = _broadcast(df.sparkSession, path)
    keep = [c for c in df.columns if c != into]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("__ids"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(pieces)
        for batch in batches:
            texts = pa.array([codec.decode(x.as_py() or ()) for x in batch.columns[-1]], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*keep, into])

    return source.mapInArrow(of, T.StructType([*source.schema.fields[:-1], T.StructField(into, T.StringType())]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, ids, n_tokens, lossless."""
    return encode(docs.select("doc_id", "text")).select("doc_id", "ids", "n_tokens", "lossless")
