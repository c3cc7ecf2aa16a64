from datetime import datetime

import pytest

from palimpsest.llm import queries, urls

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("small", [100_000, 0])
def test_query_equals_sql(spark, agree, monkeypatch, small):
    monkeypatch.setattr(urls, "SMALL", small)
    assert agree(queries.op7_url_lists(spark, SF), queries.ORACLES["op7_url_lists"], SF) == 250


def test_keys(spark):
    of = lambda u: spark.createDataFrame([(u,)], "u string").select(urls.keys(urls.F.col("u"))).first()[0]
    assert of("HTTP://user:pw@A.b.Example.com.:8080/x/y/?q#f") == ["host a.b.example.com", "host b.example.com", "host example.com", "host com", "prefix a.b.example.com/x", "prefix a.b.example.com/x/y"]
    assert of("https://h.org") == of("https://h.org/") == of("https://h.org?x=/a") == ["host h.org", "host org"]
    assert of(None) == of("") == of("nonsense") == of("http://") == []


@pytest.mark.parametrize("small", [100_000, 0])
def test_times_and_odd_rows(spark, monkeypatch, small):
    monkeypatch.setattr(urls, "SMALL", small)
    day = lambda n: datetime(2024, 1, n)
    changes = [("bad", "host", ".Example.com", "add", day(5)), ("bad", "host", "example.com", "remove", day(10)), ("bad", "host", "example.com", "add", day(20)), ("bad", "host", "example.com", "add", day(20)),
               ("allow", "prefix", "a.example.com/ok/", "add", day(7)), ("worse", "host", "example.com", "add", day(20)), ("x", "host", None, "add", day(1)), ("x", "host", "org", "add", None),
               ("gone", "host", "net", "add", day(3)), ("gone", "host", "net", "remove", day(3)), ("bad", "host", "example.com", "remove", day(5))]
    changes = changes[:-1]
    lists = spark.createDataFrame(changes, "list string, kind string, value string, change string, at timestamp_ntz")
    u = "http://a.example.com/"
    rows = [(1, u, day(4)), (2, u, day(5)), (3, u, day(10)), (4, u, day(20)), (5, u + "ok/x", day(8)), (6, u + "okay", day(8)), (7, None, day(8)), (8, u, None), (9, "http://n.net", day(4)), (1, u, day(4)), (None, u, day(6))]
    captures = spark.createDataFrame(rows, "entry_id long, url string, fetched timestamp_ntz")
    got = sorted([(r.entry_id, r.n_active, r.verdict, r.entry) for r in urls.match(captures, lists).collect()], key=str)
    bad = "bad host example.com"
    want = [(1, 0, "none", "")] * 2 + [(2, 1, "block", bad), (3, 0, "none", ""), (4, 2, "block", bad), (5, 2, "allow", "allow prefix a.example.com/ok"), (6, 1, "block", bad), (7, 0, "none", ""), (8, 0, "none", ""), (9, 0, "none", ""), (None, 1, "block", bad)]
    assert got == sorted(want, key=str)
    assert urls.match(captures.limit(0), lists).collect() == []
    assert {r.verdict for r in urls.match(captures, lists.limit(0)).collect()} == {"none"}


@pytest.mark.parametrize("small", [100_000, 0])
def test_long_urls(spark, monkeypatch, small):
    """200,000 characters of parts or of labels; entries of several parts are still met."""
    monkeypatch.setattr(urls, "SMALL", small)
    at = datetime(2024, 1, 1)
    lists = spark.createDataFrame([("bad", "prefix", "h.org/a/b/c", "add", at), ("bad", "host", "x.y.net", "add", at), ("bad", "prefix", "h.org", "add", at)], "list string, kind string, value string, change string, at timestamp_ntz")
    rows = [(1, "http://h.org/a/b/c" + "/a" * 100_000), (2, "http://" + "a." * 100_000 + "x.y.net/"), (3, "http://h.org/" + "a" * 200_000), (4, "http://h.org/a/b"), (5, "http://y.net/")]
    captures = spark.createDataFrame([(*r, at) for r in rows], "id long, url string, fetched timestamp_ntz")
    assert {r.id: r.entry for r in urls.match(captures, lists).collect()} == {1: "bad prefix h.org/a/b/c", 2: "bad host x.y.net", 3: "", 4: "", 5: ""}
