import random
import re
from itertools import combinations

import pytest
import xxhash

from palimpsest.llm import simhash


def plain(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, linked):
    """Component of each (id, fp): ids joined where ``linked`` says so."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if linked(prints[i][1], prints[j][1]):
            parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(prints))]


near = lambda a, b: (a ^ b).bit_count() <= 2


def test_fingerprint():
    random.seed(1)
    texts = [None, "", " \t", "One", "one TWO", "É a b c\x0bd", "a b c", *(" ".join(random.choices(["x", "Yy", "é", "z q", "K"], k=random.randint(1, 90))) for _ in range(200))]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == plain(t), t
    long = " ".join(str(i % 977) for i in range(150_000))
    assert simhash.fingerprint(long.encode()) == plain(long)


@pytest.mark.parametrize("bucket", [1, 16])
def test_links_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    random.seed(bucket)
    prints = set()
    for _ in range(25):
        f = random.getrandbits(64)
        for _ in range(random.choice([1, 1, 3, 40])):
            prints.add(f)
            for _ in range(random.choice([1, 2, 3])):
                f ^= 1 << random.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    assert all(near(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in got)
    rows = [(i, p & (1 << 64) - 1) for i, p in enumerate(signed)]
    have = {frozenset((a & (1 << 64) - 1, b & (1 << 64) - 1)) for a, b in got}
    assert roots(rows, near) == roots(rows, lambda a, b: frozenset((a, b)) in have)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    want = dict(zip([r[0] for r in rows], roots(rows, near), strict=True))
    got = simhash.report(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in rows}


def test_edges(spark):
    rows = [(7, "", "x"), (5, None, "x"), (5, None, "x"), (None, "a b c d", "x"), (9, "A b C d", None), (None, "only null ids here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.report(docs).collect()), key=str)
    assert got == sorted([(7, 5), (5, 5), (5, 5), (None, 9), (9, 9), (None, None)], key=str)
    assert sorted(r.doc_id for r in simhash.dedup(docs).collect() if r.doc_id is not None) == [5, 9]
    assert simhash.dedup(docs).columns == docs.columns
    assert simhash.report(docs.limit(0)).collect() == []
