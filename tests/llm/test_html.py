import html as std
import random
import re
import time

import pytest

from palimpsest.llm import html

SF = "/root/testdata/sf0.01"


def plain(page):
    """Main text of the pages of the test tables, which all have one article and simple markup."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", body)
    blocks = [" ".join(std.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("small", [16_000_000, -1])
def test_pages(spark, monkeypatch, small):
    monkeypatch.setattr(html, "SMALL", small)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: (r.url, plain(r.html)) for r in pages.collect()}
    got = html.report(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


RICH = """<!DOCTYPE html><HTML><head><title>T</title><script>if (a<b) x="</p><article>no</article>"</script></head><body class="page ad-free">
<header><h1>Site</h1></header><nav>menu</nav><div class='cookie-notice'>We use cookies</div><aside>side</aside><div class="ad banner">Buy</div>
<article class="post"><header><h2>Title &amp; more</h2></header><p>One &lt;b&gt; <b>bold</b><i>er</i>
 text<br>line &eacute;<p>Two <a href="x>y" title='"'>link</a>.<!-- <p>gone</p> --><ul><li>A<li>B</ul><div class="share">Share</div><form><input>Send</form>
<table><tr><td>c1<td>c2</table><script>var t="</article>"</script><section id="comments"><p>nice</p></section><footer>by me</footer></article>
<section class="comments"><article><p>reader</p></article></section><footer>&copy;</footer></body></html>"""


def test_rich_page():
    want = "Title & more\nOne <b> bolder text line é\nTwo link.\nA\nB\nc1\nc2"
    assert html.extract(RICH) == want
    wrapper = html.Wrapper.of(html.parse(RICH)).align(html.Wrapper.of(html.parse(RICH.replace("Two", "Three"))))
    assert html.extract(RICH, wrapper) == want
    assert html.extract(RICH[:-60], wrapper) == want


def test_words_of_elements():
    page = """<body><div class="site-header">S</div><div id=footer>F</div><div role="navigation">N</div><div class="article-header">no</div><div class=entry>
      <div class="entry-header"><h1>Title</h1></div><p>Text</p><ol class="comment-list"><li>C</ol><div class="newsletter_box">B</div></div><div class="col ad_slot">A</div></body>"""
    assert html.extract(page) == "Title\nText"
    assert html.extract(page.replace("<div class=entry>", "<article>").replace("</div><div class=\"col", "</article><div class=\"col")) == "Title\nText"


def test_alignment():
    a = html.Wrapper.of(html.parse("<body><h1>x</h1><p>1</p><p>2</p></body>"))
    b = html.Wrapper.of(html.parse("<body><h1>y</h1><div>new</div><p>1</p></body>"))
    for w in (a.align(b), b.align(a)):
        e = w.expression()
        assert "<h1>#</>" in e and "(<div></>)?" in e and "(<p>#</>)+" in e
        assert e.index("h1") < e.index("div") < e.index("<p>")
        assert w.pages == 2 and "(<h1>" not in e


def test_pages_without_an_article():
    page = lambda t, more="": f"<body><div class='menu'>M</div><div>Welcome to our site</div><div><p>{t}</p>{more}</div><ul><li><a href=x>Home</a></li></ul></body>"
    whole = united(*map(page, ("first text", "second text", "third")))
    assert html.extract(page("first text", "<p>tail</p>"), whole) == "first text\ntail"
    assert html.extract("<body><main><p>a</p></main><p>b</p></body>") == "a"
    assert html.extract("<body><div id='content'><p>a</p></div><p>b</p></body>") == "a"


def test_odd_rows(spark):
    rows = [(1, "http://h.org/a", "", "x"), (2, "http://h.org/b", None, "x"), (3, None, "<p>alone</p>", "x"), (4, "http://h.org/c", "no markup &amp; <", "x"), (4, "http://h.org/c", "no markup &amp; <", "x"),
            (5, "http://h.org/d", "<article>" + "<p>w</p>" * 50_000 + "</article>", "x"), (6, "http://h.org/e", "<div " * 2000 + "'" * 2001, "x"), (7, "http://h.org/f", "<article>only title=\"", "x"), (8, "http://h.org/g", "<article></article>", "x")]
    got = {r.page_id: r.text for r in html.report(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got == {1: "", 2: "", 3: "alone", 4: "no markup & <", 5: "\n".join(["w"] * 50_000), 6: "", 7: 'only title="', 8: ""}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert html.report(pages).count() == len(rows) and html.report(pages.limit(0)).collect() == []
    assert all("<article>" in r.expression or r.host == "" for r in html.wrappers(pages).collect())


def united(*pages):
    whole = html.Wrapper.of(html.parse(pages[0]))
    for page in pages[1:]:
        whole = whole.align(html.Wrapper.of(html.parse(page)))
    return whole


@pytest.mark.parametrize("words", ["layout has-sidebar", "content no-sidebar", "nav-open", "ad-free", "no-comments", "search-page", "with_banner", "share-enabled"])
def test_layout_around_the_article(words):
    page = lambda t: f"<body><div class='{words}'><nav>menu</nav><article><p>{t}</p></article><div class=comments><article>{t * 9}</article></div></div></body>"
    pages = [page("one text"), page("another"), page("third")]
    assert html.extract(pages[0]) == "one text"
    assert html.extract(pages[0], united(*pages)) == "one text"


def test_layout_around_texts_that_differ():
    page = lambda t: f"<body><div class=search-page><p>{t}</p><div class=search-box>find</div></div><div class=ad>buy</div></body>"
    pages = [page("one text"), page("another"), page("third")]
    assert html.extract(pages[0], united(*pages)) == "one text"
    assert html.extract("<body><div class=content>text</div><aside><article>teaser of more than half</article></aside></body>") == "text"
    assert html.extract("<body><form class=x><article>text</article></form></body>") == "text"


def test_links_among_text():
    assert html.extract("<body><ul><li>See the <a href=x>docs</a> for more<li>and <a href=y>this</a></ul><ul class=m><li><a href=z>Home</a></ul></body>") == "See the docs for more\nand this"
    assert html.extract("<body><ul><li>x</li><li class=y><a href=x>short</a></li><li class=z>a long item of text</li></ul></body>") == "x\nshort\na long item of text"


def test_copies_of_one_article():
    page = lambda date, menu: f"<body><div class=when>{date}</div><ul><li><a href=x>{menu}</a></li></ul><p>The same article in all captures, of one line.</p></body>"
    pages = [page(f"{n} May", f"menu {n}") for n in range(5)]
    assert html.extract(pages[0], united(*pages)) == "0 May\nThe same article in all captures, of one line."
    assert "The same article" in html.extract(pages[1], united(*pages[:2]))


def test_all_content_regions():
    page = "<body><div class=entry><p>much longer text</p></div><div class=content><p>other</p></div><div>rest</div></body>"
    assert html.extract(page) == "much longer text\nother"
    assert html.extract("<body><div class=main>a b c</div><section class=main>d</section></body>") == "a b c\nd"


def best(a, b):
    """The greatest value of any common subsequence of two lists of (key, kinds), by trying all."""
    if not a or not b:
        return 0
    here = 0 if a[0][0] != b[0][0] else 3 if html.alike(a[0][1], b[0][1]) else 2
    return max(best(a[1:], b), best(a, b[1:]), here + best(a[1:], b[1:]) if here else 0)


def test_alignment_equals_brute_force():
    random.seed(8)
    some = ["<p>{}</p>", "<div><p>{}</p></div>", "<div><ul><li>{}</ul></div>", "<h2>{}</h2>", "<div>{}</div>"]
    for _ in range(300):
        pages = ["".join(random.choice(some).format(random.random()) for _ in range(random.randint(0, 7))) for _ in range(2)]
        a, b = (html.grown(html.parse(x)).units for x in pages)
        listed = [[(*u.of, *(n.kinds() for n in u.of.values())) for u in units if not u.repeated] for units in (a, b)]
        pairs = html.paired(a, b)
        assert all(x < y for p, q in zip(pairs, pairs[1:]) for x, y in zip(p, q)) or any(u.repeated for u in a + b)
        if len(listed[0]) == len(a) and len(listed[1]) == len(b):
            assert sum(html.fits(a[i], b[j]) for i, j in pairs) == best(*listed), pages


def test_mismatches_are_resolved():
    of = lambda *bodies: united(*(f"<body>{b}</body>" for b in bodies)).expression()
    assert of("<h1>a</h1><p>b</p>", "<h1>c</h1><p>b</p>") == "<body><h1>#</><p></></>"
    assert of("<h1>a</h1><p>b</p>", "<h1>a</h1><img><div>x</div><p>b</p>") == "<body><h1></>(<div></>)?<p></></>"
    assert of("<p>a</p>", "<p>a</p><p>b</p><p>c</p>") == "<body>(<p>#</>)+</>"
    assert of("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>") == "<body><dl>(<dt>#</>?<dd>#</>?)+</></>"
    assert of("<p>a</p><ul><li>x</ul><p>b</p>", "<p>c</p><p>d</p>") == "<body><p>#</>(<ul><li></></>)?<p>#</></>"
    assert of("<p>a</p><ul><li>x</ul><p>b</p>", "<p>c</p>") == "<body>(<p>#</>?<ul><li></></>?)+</>"
    assert of("<div><p>a</div><div><ul><li>x</ul></div>", "<div><p>b</div><div><ul><li>x</ul></div>") == "<body><div><p>#</></><div><ul><li></></></></>"
    assert of("<table><tr><td>1<tr><td>2</table>", *(f"<table>{'<tr><td>x' * n}</table>" for n in (1, 3, 9))).count("<tr>") == 1


def test_slots_give_the_text():
    """No element or class tells the article: three divisions, of which one differs, and a list that differs in its links."""
    page = lambda t, n: f"""<body><div><ul><li><a href=x>Link {n}</a></li><li><a href=y>About us</a></li></ul></div><div><p>We are a site about things and their names, in {7} languages.</p></div>
      <div><h2>Title {t}</h2><p>{t} text</p>{"<p>more</p>" * n}</div><div><p>All rights reserved</p></div></body>"""  # noqa: E731
    pages = [page(t, n) for n, t in enumerate(("first", "second", "third", "fourth"))]
    wrapper = united(*pages)
    assert html.extract(pages[1], wrapper) == "Title second\nsecond text\nmore"
    assert html.extract(pages[0], wrapper) == "Title first\nfirst text"
    assert html.extract(pages[1]) != html.extract(pages[1], wrapper)
    assert html.extract(pages[1], html.Wrapper.unpacked(wrapper.packed())) == html.extract(pages[1], wrapper)


def test_words_within_an_article():
    pages = [f'<article><p class="language-menu">a{n}</p><p class="search">b{n}</p><div class="social">c{n}</div><span class=menu>d{n}</span><div class="ad">x{n}</div><div class="menu"><a href=x>y{n}</a></div></article>' for n in range(4)]
    for wrapper in (None, united(*pages)):
        assert html.extract(pages[1], wrapper) == "a1\nb1\nc1\nd1"


def test_long_and_deep_pages_take_linear_time():
    began = time.perf_counter()
    assert html.extract("<div>" * 10_000 + "x") == "x"
    assert html.extract("<div>a" * 10_000 + "</div>b" * 10_000) == "\n".join(["a"] * 10_000 + ["b"] * 10_000)
    assert time.perf_counter() - began < 4
    many = "".join(f"<p class=k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}>w{i}</p>" for i in range(5000))
    wrapper = united(*[f"<article>{many}</article>"] * 3)
    assert html.extract(f"<article>{many}</article>", wrapper) == "\n".join(f"w{i}" for i in range(5000))
    assert len(wrapper.packed()) < 10_000
