import random

import numpy as np
import pytest
from test_simhash import roots

from palimpsest.llm import copies, simhash

SF = "/root/testdata/sf0.01"


def shingled(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def left(spark, rows):
    return {r.doc_id for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = [(r.doc_id, shingled(r.text)) for r in docs.collect()]
    assert {r.doc_id for r in simhash.dedup(docs).collect()} == set(roots(sets, similar))


@pytest.mark.parametrize(("bucket", "block"), [(32, 2048), (4, 2048), (2, 7), (1, 3)])
def test_groups_of_edited_texts(spark, monkeypatch, bucket, block):
    """Also if nearly all lists are long and in several blocks, and with chains in which the ends aren't alike."""
    monkeypatch.setattr(copies, "BUCKET", bucket)
    monkeypatch.setattr(copies, "BLOCK", block)
    monkeypatch.setattr(copies, "WIDE", 10 * block)
    monkeypatch.setattr(copies, "SPREAD", 3 * bucket)
    random.seed(bucket)
    rows = []
    for n, edits in ((1, 0), (2, 2), (6, 3), (40, 3), (30, 6)):
        words = [f"w{random.randrange(10_000)}" for _ in range(200)]
        for _ in range(n):
            own = list(words)
            for _ in range(random.randint(0, edits)):
                own[random.randrange(200)] = f"new{random.randrange(10_000)}"
            rows.append((len(rows), " ".join(own)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(0, 60, 4):
        rows.append((len(rows), " ".join(f"d{j}" if j < i else x for j, x in enumerate(chain))))
    assert left(spark, rows) == set(roots([(d, shingled(x)) for d, x in rows], similar))


def test_repeated_ids(spark):
    rows = [(1, "a b c", "y"), (1, "a b c", "x"), (1, "other text", "z"), (2, "a b c", "w"), (3, "other text", "v"), (None, "a b c", "u"), (None, None, None), (4, " ", None), (5, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, drop string")
    got = sorted(map(tuple, simhash.dedup(docs).collect()), key=str)
    assert got == sorted([(1, "a b c", "x"), (1, "other text", "z"), (None, "a b c", "u"), (None, None, None), (4, " ", None)], key=str)
    assert simhash.dedup(docs).columns == docs.columns and simhash.dedup(docs.limit(0)).collect() == []


def test_threshold(spark):
    words = [f"w{i}" for i in range(13)]  # nine shingles
    rows = [(1, " ".join(words)), (2, " ".join(words[:12])), (3, " ".join(words[:10])), (4, "A b\tc"), (5, "a B c"), (6, "a b d"), (7, ""), (8, None), (9, " \n")]
    assert left(spark, rows) == {1, 3, 4, 6, 7}


def test_shingles():
    for text in (None, "", "a", "a b c d", "a b c d e", "a b c d e f a b c d e f", "x " * 50):
        assert len(copies.shingles(None if text is None else text.encode())) == len(shingled(text))


def test_similarity_matrix():
    random.seed(9)
    sets = [shingled(" ".join(random.choice("ab") for _ in range(random.randint(4, 12)))) for _ in range(60)]
    hashed = [np.array(sorted(hash(x) for x in s)) for s in sets]
    assert copies._similar(hashed[:20], hashed[20:]).tolist() == [[similar(a, b) for b in sets[20:]] for a in sets[:20]]


def test_signature_is_a_majority_of_voters():
    """Each bit by hand: the voters of a part are its orders' least shingles, and over half of their hashes have the bit."""
    random.seed(4)
    orders = [int(x) for x in copies._ORDERS.ravel()]
    for n in (1, 2, 5, 40):
        found = np.array(sorted(random.getrandbits(64) for _ in range(n)), np.uint64)
        want = []
        for part in range(copies.BANDS):
            mine = orders[part * copies.VOTERS : (part + 1) * copies.VOTERS]
            voters = [min((int(x) >> 32 for x in found), key=lambda x: x * m % 2**32) for m in mine]  # noqa: B023
            hashes = [int(copies._mixed(np.array([v], np.uint64))[0]).to_bytes(8, "little")[: copies.ROWS] for v in voters]
            bit = lambda at, k: 2 * sum(h[at] >> k & 1 for h in hashes) > copies.VOTERS  # noqa: E731, B023
            want += [sum(bit(at, k) << k for k in range(8)) for at in range(copies.ROWS)]
        assert list(copies.signature(found)) == want


def test_index_reaches_the_threshold():
    """Pairs at 0.8 with few and many shingles share a part's positional bytes and pass the tally; unlike ones don't pass it."""
    rng = np.random.default_rng(5)
    parts = lambda x: np.frombuffer(copies.signature(np.unique(x)), np.uint8).reshape(copies.BANDS, copies.ROWS)
    for n in (5, 10, 100, 1000):
        for _ in range(100):
            texts = rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64)
            alone, other = texts[n // 10 : n - n // 10], texts[: n - n // 5]  # of two texts, or a part of a text and all of it
            for a, b in ((texts[: n - n // 10], texts[n // 10 :]) if n > 5 else (texts[:4], texts), (other, texts)):
                same = parts(a) == parts(b)
                assert same.all(1).any() and same.sum() >= copies.SHARED
            far = parts(rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64)) == parts(alone)
            assert far.sum() < copies.SHARED
