import hashlib
import re
import shutil
from pathlib import Path

from palimpsest.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def keep(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    text = text or ""
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if keep(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


TEXTS = [
    None, "", "no data here", "é.34@mail7.example.com and a@b.c_d@e.f x@y a@b..c @a.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 97.51.17.173",
    "9807915762804490 4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 12 345678901234567890123", "+1 (017) 555-7713 +12 +1((((((((( +4912345678901 +1 2+3 4 5 6 7 8 9 0 1",
    "1" * 30000, "a" * 50000, "a@" * 20000, "1 " * 20000, "1.2." * 20000, "+1(" * 10000, "\U0001f600 x@y.z \U0001f600 1.1.1.1", "a.b" * 30000 + "@c.d" + ".e" * 30000,
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432", "my ssn 123-45-6789 or 123-45-6789 a lot later " + "x " * 40 + "123-45-6789", "card +4111111111111111 mail 1.2.3.4@5.6.7.8",
    "4111 1111 1111 1111@x.yz",
]


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, pii string, spans int")
    return {r.doc_id: r for r in pii.report(docs).collect()}


def test_base_spans_equal_brute_force(spark):
    got = run(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        want = brute(t)
        assert [s for s in got[i].spans.split(",") if s and s.split(":")[0] in BASE] == want, (i, want[:5], got[i].spans[:200])
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        for k in BASE:
            assert got[i][f"n_{k}"] == sum(w.startswith(k) for w in want)


def test_method_adds_iban_and_ssn(spark):
    got = run(spark, TEXTS)
    assert [s for s in got[15].spans.split(",") if s.startswith("iban")] == ["iban:5:32", "iban:37:59"]
    assert len([s for s in got[16].spans.split(",") if s.startswith("ssn")]) == 1
    assert got[15].scores.split(",")[0] == "1.0"


def test_query_equals_sql(spark, agree):
    assert agree(queries.op1_pii(spark, "/root/testdata/sf0.01"), queries.ORACLES["op1_pii"], "/root/testdata/sf0.01") == 1000


def test_sql_on_hard_texts(spark, agree, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t is None or len(t) < 1000]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/x")
    folder = tmp_path / "sf"
    folder.mkdir()
    for table in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if table.name != "documents.parquet":
            (folder / table.name).symlink_to(table)
    shutil.copy(next((tmp_path / "x").glob("*.parquet")), folder / "documents.parquet")
    assert agree(queries.op1_pii(spark, f"{tmp_path}/sf"), queries.ORACLES["op1_pii"], f"{tmp_path}/sf") == len(rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.report(docs).collect():
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in BASE] == brute(texts[r.doc_id])


def test_redact(spark):
    docs = spark.createDataFrame([(1, "a x@y.zz b 1.2.3.4", 7), (2, None, 7), (3, "clean", 7), (4, "+4111111111111111.", 7)], "doc_id long, text string, __x int")
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {1: "a [EMAIL] b [IP]", 2: None, 3: "clean", 4: "+[CARD]."}
    assert pii.redact(docs).columns == docs.columns


def test_empty(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
