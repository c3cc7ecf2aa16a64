import random
import re
import time

from palimpsest.llm import licences


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in licences.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
    return row[-1]


def brute(text, notices):
    """Notices that some run of whole words meets within the errors."""
    words, met = text.split(), set()
    for label, n in notices:
        k = licences.budget(n)
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                part = " ".join(words[i:j])
                if abs(len(part) - len(n)) <= k and edits(n, part) <= k:
                    met.add(label)
    return met


def test_fuzzy_equals_brute_force():
    random.seed(6)
    scanners = [((label, n),) for label, n in licences.NOTICES]
    hit = 0
    for _ in range(400):
        notices = random.choice(scanners)
        text = list(notices[0][1])
        for _ in range(random.randint(0, licences.budget(notices[0][1]) + 2)):
            i = random.randrange(len(text))
            text[i : i + random.choice([0, 1])] = random.choice(["x", "", " ", "e"])
        text = " ".join(f"some words {''.join(text)} and more".split())
        got = {f[3] for f in licences.Scanner(notices).find(text)}
        assert got == brute(text, notices), (notices, text)
        hit += bool(got)
    assert 100 < hit < 390


def spans(text, notices):
    """All runs of words that meet a notice, taken one after another by errors, length of the notice and start."""
    at, words = [], []
    for m in re.finditer("[^ ]+", text):
        words.append(m.span())
    for label, n in notices:
        k = licences.budget(n)
        for x, (start, _) in enumerate(words):
            for _, end in words[x:]:
                if abs(end - start - len(n)) <= k and (e := edits(n, text[start:end])) <= k:
                    at.append((e, -len(n), start, end, label))
    kept = []
    for e, _, start, end, label in sorted(at):
        if all(end <= s or start >= t for s, t, *_ in kept):
            kept.append((start, end, e, label))
    return sorted(kept)


def test_all_spans_of_several_notices():
    random.seed(4)
    scanner, some = licences.Scanner(), [n for _, n in licences.NOTICES if len(n) < 50]
    for _ in range(60):
        parts = []
        for _ in range(random.randint(2, 5)):
            text = list(random.choice(some))
            for _ in range(random.choice([0, 0, 1, 2, 3])):
                i = random.randrange(len(text))
                text[i : i + random.choice([0, 1])] = random.choice(["x", "", "e"])
            parts += ["".join(text), *["some other words"] * random.choice([0, 1])]
        text = " ".join(" ".join(parts).split())
        got = [(s, e, errors, label) for s, e, errors, label, _ in scanner.find(text)]
        want = spans(text, licences.NOTICES)
        assert [g[2:] for g in got] == [w[2:] for w in want], (text, got, want)
        assert all(abs(g[0] - w[0]) + abs(g[1] - w[1]) <= 6 for g, w in zip(got, want))
    assert [f[:3] for f in scanner.find("licensed under the mit licence licensed under the mit license")] == [(0, 30, 1), (31, 61, 0)]


def test_long_texts_take_linear_time():
    scanner = licences.Scanner()
    for text in ("under the mit license ", "cc by nc ", "licensed under cc by sa 4 0 ", "permission"):
        raw = (text * (1_000_000 // len(text))).encode()
        began = time.perf_counter()
        n = licences.scan(scanner, raw)[1]
        assert time.perf_counter() - began < 6 and n in (0, len(raw) // len(text))


def test_overlaps_go_to_the_closest():
    find = lambda t: [(label, errors) for _, _, errors, label, _ in licences.Scanner().find(t)]
    assert find("the gnu general public license version 2 or") == [("gpl-2", 0)]
    assert find("the gnu general public license version 3 or") == [("gpl-3", 0)]
    assert find("licensed under cc by nc 4 0") == [("cc-by-nc", 0)]
    assert find("relased under teh mit license and gnu genral public license version 3") == [("gpl-3", 1)]


HARD = [None, "", "...", "Under the MIT License under THE mit-license", "Licensed under the Apache License, Version 2.0.", "CC-BY-NC cc by nc", "É Released undr the MIT Licence!", "x " * 100_000 + "cc by nc", "under the mit licenses", "Ünder the mit license", "under the mit license" * 3]


def test_rows(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(HARD)] + [(3, HARD[3], "again")], "doc_id long, text string, score string")
    got = sorted(licences.report(docs).collect())
    assert len(got) == len(HARD) + 1
    for r in got:
        t = HARD[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    one = [r for r in got if r.doc_id == 6][0]
    assert one.labels == "mit" and one.base_labels == "" and one.spans == f"mit:2:{len(HARD[6]) - 1}:2" and 0.9 < one.score < 1
    assert licences.report(docs.limit(0)).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = licences.report(docs).collect()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
    assert {x for r in rows for x in r.labels.split(",")} >= {"mit", "apache-2", "cc-by-nc", "gpl-3"}
    assert all(not r.labels for r in rows if "licen" not in texts[r.doc_id].lower() and "cc" not in texts[r.doc_id].lower())
