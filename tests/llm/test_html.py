"""Extraction from whole pages, broken markup, and template counting against a plain count."""

import random
import time

import pytest

from faintline.llm import html

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";track(0);</script></head>
<body><header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy now</div>
<div id="cookie-notice">We use cookies</div><aside>Side</aside>
<article><h1>Title &amp; more</h1><p><b>First
para&nbsp;graph<br><p>Second <i>one</i> &lt;b&gt; &#233; &copy;</p><form><input value="x">Send</form>
<ul><li>item 1<li>item 2</ul><table><tr><td>c1<td>c2</table><p hidden>secret</p>{extra}</article>
<section class="comments"><article class="comment"><p>Reader says</p></article></section><footer>&copy; site</footer></body></html>"""
BLOCKS = ["Title & more", "First para graph", "Second one <b> é ©", "item 1", "item 2", "c1", "c2"]


def test_one_page():
    assert html.main_text(PAGE.format(extra="")).split("\n\n") == BLOCKS
    for none in (None, "", "<html></html>", "<script>x</script>", "<!-- only"):
        assert html.main_text(none) == ""
    assert html.main_text("plain <b>text") == "plain text"
    assert html.main_text("<div>a<div>b</div>c</div>") == "a\n\nb\n\nc"
    assert html.main_text("<div>" * 30000 + "deep") == "deep"
    assert html.main_text("<p>a < b and c > d &amp;amp;</p>") == "a < b and c > d &amp;"
    assert html.main_text("<article><header><h1>H</h1></header><p>t</p><footer>tags</footer></article>") == "H\n\nt"
    assert html.main_text("<p>x</p></p></div>y<p") == "x\n\ny"


def test_named_wrappers_and_states():
    article = "<article%s><p>The story itself.</p></article>"
    story = "The story itself."
    for open_ in ("<div class='layout has-sidebar'>", "<div id='page' class='no-sidebar widget-area'>", "<div class='modal-open'>", "<section id=comments>", "<div class=menu><div class=widget>"):
        assert html.main_text(f"<body>{open_}{article % ''}</div>") == story, open_
        assert html.main_text(f"<body>{open_}<main><p>{story}</p></main></div>") == story, open_
        assert html.subtrees(f"<body>{open_}{article % ''}</div>")[0] == html.subtrees(article % "")[0]
    for attrs in (" data-comments-url='/c'", " class='post comments-open'", " class='post has-comments' id=post-7"):
        assert html.main_text(article % attrs) == story, attrs
    for attrs in (" class=comment", " class='comment-body even'", " id='div-comment-12'", " role=comment"):
        assert html.main_text(article % "" + f"<article{attrs}><p>Reader says</p></article>") == story, attrs
    # what is named so beside the article still goes, articles of its own or not
    for name in ("comments", "related", "site-footer", "cookie-notice", "main-nav", "widget"):
        assert html.main_text(f"{article % ''}<div class='{name}'><article><p>Other</p></article></div>") == story, name
        assert html.main_text(f"<div><p>{story}</p></div><div class='{name}'><p>Other</p></div>") == story, name
    assert html.main_text(f"<div><p>{story}</p></div><div class='comments'><article><p>Other</p></article></div>") == story
    assert html.main_text(f"{article % ''}<aside><article><p>Other</p></article></aside>") == story


def test_templates(spark):
    rnd = random.Random(1)
    words = lambda n: " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(99)) for _ in range(n))
    rows = []
    for i in range(60):
        body = f"<div class=x><p>{words(30)}</p><p>{words(20)}</p></div>"
        rows.append((i, "http://a.example/%d" % i, f"<div><p>Our motto stands here</p></div>{body}<div><p>Call us any time</p></div>", "k"))
    rows += [(100 + i, "http://B.example:80/", f"<article><p>{'same text ' * 30}</p></article>", "k") for i in range(40)]
    rows += [(200 + i, f"http://c.example/{i}", f"<article><p>{words(25)}</p><p>Follow us for more</p></article>", "k") for i in range(30)]
    rows += [(300, None, None, None), (301, "no url", "", None), (302, "http://d.example/", "<p>alone</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, _, source, _ in rows:
        plain = html.main_text(source).split("\n\n")
        want = [b for b in plain if b not in ("Our motto stands here", "Call us any time", "Follow us for more")]
        assert got[i] == "\n\n".join(want), i
    assert got[100].startswith("same text") and got[302] == "alone"
    assert html.extract(df.limit(0)).collect() == []


def test_counts_against_a_plain_count(spark):
    rnd = random.Random(2)
    pieces = ["<p>%s</p>" % w for w in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")]
    rows = [(i, f"http://h{rnd.randint(0, 2)}/", "<article><p>%d main text that is long enough to be the most</p></article>" % rnd.randint(0, 30) + "".join(rnd.sample(pieces, 3))) for i in range(200)]
    read = html.hashed(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("substring(url, 8, 2) AS host", "html"))
    got = {(r.host, r.digest) for r in html.templates(read, few=3, share=0.4).collect()}
    seen, mains = {}, {}
    for _, u, s in rows:
        main, found = html.subtrees(s)
        h = u[7:-1]
        mains.setdefault(h, set()).add(main)
        for d, inner in found:
            seen.setdefault((h, d), [set(), True])[0].add(main)
            seen[h, d][1] &= inner
    want = set()
    for (h, d), (m, inner) in seen.items():
        part = len(m) / len(mains[h])
        if len(m) >= 3 and ((len(m) >= 10 and part >= 0.5) if inner else part >= 0.4):
            want.add((h, d))
    assert got == want and want


def site(rnd, n):
    """(html, main text) of pages of one site whose chrome tells nothing by name: only counting can find it."""
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 9)))
    words = lambda m: " ".join(word() for _ in range(m))
    motto, articles = words(6), rnd.random() < 0.5
    for i in range(n):
        menu = "<div class='x1'><ul>" + "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(rnd.randint(3, 7))) + "</ul></div>"
        offer = f"<div class='x2'><span>{words(5)}</span> {words(3)}</div>" if articles else ""
        blocks = [words(rnd.randint(30, 60)) for _ in range(rnd.randint(2, 6))]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        body = f"<article>{body}</article>" if articles else f"<div class='x3'>{body}</div>"
        yield f"<html><head><title>{word()}</title><style>p{{}}</style></head><body>{menu}{offer}{body}<div id='n{i}'>{motto}</div><script>{word()}()</script></body></html>", "\n\n".join(blocks)


@pytest.mark.parametrize("small", [200_000, 0])
def test_whole_pages_by_counting_alone(spark, small):
    """Pages with known main texts, by either join, with columns of clashing names."""
    rnd, rows, want = random.Random(3), [], {}
    for h in range(6):
        for source, text in site(rnd, 30):
            want[len(rows)] = text
            rows.append((len(rows), f"http://h{h}.example/{len(rows)}", source, 1, "x", "y", "z", "w"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, number int, host string, main string, found string, template string").repartition(4)
    got = html.extract(df, by_names=False, small=small)
    assert got.columns == ["page_id", "url", "number", "host", "main", "found", "template", "text"]
    assert {r.page_id: r.text for r in got.collect()} == want
    assert {r.page_id: r.text for r in html.extract(df, small=small).collect()} == want
    assert {(r.number, r.host, r.main, r.found, r.template) for r in got.collect()} == {(1, "x", "y", "z", "w")}


def test_time_grows_with_length():
    n = 8000
    bad = ["<p>" + "<b>" * n + "x</i>" * n, "<p>" + "<span>" * n + "<div>y</div>" * n, "<ul>" + "<div>" * n + "<li>z</li>" * n, "<table>" + "<b>" * n + "<td>q" * n, "<article>" * n + "deep", "<div class=menu>" * n + "<article>a</article>" * n]
    began = time.process_time()
    for source in bad:
        assert html.main_text(source) and html.subtrees(source)[0]
    assert time.process_time() - began < 15


def test_topics_name_nothing_inside_an_article():
    page = "<article><p>a</p><section class='legal'><p>On legal tender</p></section><div class='search-results-explained'><p>c</p></div><div class='legal sidebar'>d</div></article><div class='legal'>e</div>"
    assert html.main_text(page) == "a\n\nOn legal tender\n\nc"
    assert html.main_text("<body><p>a</p><div class='legal'>e</div></body>") == "a"
