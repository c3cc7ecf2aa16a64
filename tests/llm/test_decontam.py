import random
import re

from palimpsest.llm import decontam


def distance(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        prev, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
    return min(row)


def damaged(text, n):
    text = list(text)
    for _ in range(n):
        i = random.randrange(len(text))
        match random.randrange(3):
            case 0:
                text[i] = random.choice("abcde")
            case 1:
                text.insert(i, random.choice("abcde"))
            case 2:
                del text[i]
    return "".join(text)


def words(n, rng=random):
    return " ".join("".join(rng.choices("abcde", k=rng.randint(2, 7))) for _ in range(n))


def test_myers():
    random.seed(2)
    for _ in range(300):
        p, t = words(random.randint(1, 6)), words(random.randint(1, 12))
        assert decontam.myers(decontam.masks(p), len(p), t)[0] == distance(p, t)


def test_finder_equals_brute_force():
    random.seed(3)
    items = [(i, words(random.randint(4, 30))) for i in range(12)]
    finder, met = decontam.Finder(items), 0
    for _ in range(150):
        i, item = random.choice(items)
        edits = random.randint(0, 2 * max(1, len(item) // 10))
        text = f"{words(random.randint(0, 20))} {damaged(item, edits)} {words(random.randint(0, 20))}".strip()
        text = decontam.normal(text)
        got = {x[0]: x[1] for x in finder.find(text)}
        for j, other in items:
            best = distance(other, text)
            if len(other) >= decontam.EXACT:
                assert (j in got) == (best <= len(other) // 10), (other, text)
                met += j in got
                if j in got:
                    assert got[j] == best
    assert met > 40


def test_fewest_edits_where_pieces_recur():
    """Texts of few syllables, in which an item is met at many places that overlap."""
    random.seed(11)
    met = 0
    for _ in range(500):
        some = ["".join(random.choices("abc", k=random.randint(1, 3))) for _ in range(3)]
        make = lambda n: " ".join("".join(random.choices(some, k=random.randint(1, 3))) for _ in range(n))  # noqa: B023, E731
        item = make(random.randint(8, 14))
        text = decontam.normal(f"{make(random.randint(0, 6))} {damaged(item, random.randint(0, 5))} {damaged(item, random.randint(0, 3))} {make(3)}")
        best, got = distance(item, text), decontam.Finder([(1, item)]).find(text)
        if len(item) >= decontam.EXACT:
            assert [g[1] for g in got] == [best] * (best <= decontam.budget(len(item))), (item, text)
            met += bool(got)
        for _, edits, start, end in got:
            assert distance(item, text[start:end]) == edits
    assert met > 200


def test_recall_against_brute_force(spark):
    """Of near passages, too: damaged items put into the test documents."""
    random.seed(12)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text) < 3000][:25]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()][:10]
    finder = decontam.Finder(items)
    for text in docs:
        i, item = random.choice(items)
        text = decontam.normal(f"{text[:1000]} {damaged(decontam.normal(item), random.randint(0, len(item) // 8))} {text[1000:]}")
        want = {j: d for j, other in finder.items if (d := distance(other, text)) <= decontam.budget(len(other)) and (d or len(other) >= decontam.EXACT)}
        assert {x[0]: x[1] for x in finder.find(text)} == want


def test_spans_and_stage(spark):
    item = "The Quick brown fox, jumps over the lazy dog near the river bank at dawn"
    bench = spark.createDataFrame([(1, item), (2, item.upper()), (3, None), (4, "..."), (5, "short one")], "item_id long, text string")
    near = item.replace("brown", "brawn").replace(",", " --")
    rows = [(1, f"Éa {near}! end"), (2, "a clean text, with fox and dog"), (3, None), (4, ""), (4, f"x {item}"), (6, "a short one"), (7, "a short onex"), (8, "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as edits")
    got = sorted(tuple(r) for r in decontam.matches(docs, bench).collect())
    assert got == [(1, 1, 1, 3, 3 + len(near)), (1, 2, 1, 3, 3 + len(near)), (4, 1, 0, 2, 2 + len(item)), (4, 2, 0, 2, 2 + len(item)), (6, 5, 0, 2, 11)]
    kept = decontam.decontaminate(docs, bench)
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text is not None) == sorted(r for r in rows if r[1] is not None and r not in (rows[0], rows[4], rows[5]))
    assert kept.columns == docs.columns and kept.where("text is null").count() == 1
    assert decontam.matches(docs, bench.limit(0)).collect() == [] == decontam.matches(docs.limit(0), bench).collect()
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()}
    items = [(r.item_id, decontam.normal(r.text)) for r in bench.collect()]
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in items if f" {t} " in f" {decontam.normal(r.text)} "}
    assert exact and exact <= got
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in decontam.matches(docs, bench).collect():
        part = decontam.normal(texts[r.doc_id][r.start : r.end])
        assert re.match(r"\w", part) and distance(dict(items)[r.item_id], part) <= len(dict(items)[r.item_id]) // 10


def test_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(tuple(r) for r in decontam.matches(docs, bench).collect())
    left = decontam.decontaminate(docs, bench).count()
    monkeypatch.setattr(decontam, "BLOCK", 3000)
    assert sorted(tuple(r) for r in decontam.matches(docs, bench).collect()) == want
    assert decontam.decontaminate(docs, bench).count() == left == docs.count() - len({w[0] for w in want})
