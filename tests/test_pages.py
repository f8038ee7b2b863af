"""Trees, metadata, main texts and text operators, on pages made for them."""

from __future__ import annotations

import datetime
import json
import os
import pathlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressmill.functions import text as X
from pressmill.functions import urls as U
from pressmill.operators import article, body, clean, discover, dom, extract, images, nlp, source
from pressmill.operators.config import Config
from pressmill.sources import memo, pages


def one(spark, column, html="<p>x</p>", url="http://www.site.test/a/b"):
    return dom.parse_dom(spark.createDataFrame([(html, url)], "html string, url string")).select(column.alias("x")).first().x


N = lambda: F.col("nodes")
STORY = "It was the best of times and it was the worst of times, as we all know that it is so here."


# --- trees ---


def test_unclosed_tags():
    root = dom.parse("<p>One<p>Two <b>bold<p>Three<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>")
    assert [n.inner_text() for n in root.elements("p")] == ["One", "Two bold", "Three"]
    assert [n.inner_text() for n in root.elements("li", "td")] == ["a", "b", "c", "d"]


def test_head_and_body_are_there():
    root = dom.parse("<title>T</title>text<!-- no --><?x y?>")
    assert [n.tag for n in root.elements()] == ["head", "title", "body"]
    assert dom.parse(None) is None and dom.parse("  ") is None and dom.rows(None) == []


def test_entities_and_scripts():
    root = dom.parse('<a href="?a=1&amp;b=2">x &lt; y &copy;</a><script>if (a<b) "</p>"</script>')
    a = root.elements("a")[0]
    assert a.attrs["href"] == "?a=1&b=2" and a.inner_text() == "x < y ©"
    assert root.elements("script")[0].text == 'if (a<b) "</p>"'


def test_remove_keeps_the_tail_and_unwrap_the_rest():
    root = dom.parse("<p>a<i>b</i>c<b>d<u>e</u>f</b>g</p>")
    p = root.elements("p")[0]
    root.elements("i")[0].remove()
    root.elements("b")[0].unwrap()
    assert p.inner_text() == "a cd e fg" and [c.tag for c in p.children] == ["u"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "<table>", "<td>", "</table>", "<br>", "text ", "<a href=x>", "</a>", "<!--c-->"]), max_size=30))
def test_intervals_nest_and_texts_stay(parts):
    html = "".join(parts)
    rows = dom.rows(dom.parse(html))
    for node, end, parent, depth, *_ in rows:
        assert node <= end < len(rows)
        if parent >= 0:
            assert rows[parent][0] < node and end <= rows[parent][1] and depth == rows[parent][3] + 1
    assert html.count("text") == "".join(r[7] + r[8] for r in rows).count("text") or "<!--" in html


# --- metadata ---


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<title>A long story of it | The Site</title><h1>A long story of it</h1>", "A long story of it"),
        ("<title>The Site - Something else happened here</title>", "Something else happened here"),
        ("<title>Well-known fact / Site</title>", "Well-known fact / Site"),
        ("<title>News: x</title><meta property='og:title' content='News'>", "News"),
        ("<h1>No title tag here at all</h1>", ""),
        ("<title>First_Second piece</title>", "Second piece"),
        ("<title></title>", ""),
    ],
)
def test_titles(spark, html, want):
    assert one(spark, extract.title(N()), html) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [("By Ann Lee and Bo Yi, staff", ["Ann Lee", "Bo Yi"]), ("From: Jo O'Neil-Smith", ["Jo O'Neil-Smith"]), ("<b>by</b> A. B. Cee 2014", ["A. B. Cee"]), ("single", []), ("", [])],
)
def test_bylines(line, want):
    assert extract.byline(line) == want


def test_authors_are_distinct_and_few(spark):
    html = "<meta name='author' content='ann lee'><a rel='author'>Ann Lee</a><div class='byline'>By Bo Yi</div>" + "".join(f"<i class='byl'>By Person N{chr(65 + i)}</i>" for i in range(12))
    found = one(spark, extract.authors(N()), html)
    assert found[:2] == ["Ann Lee", "Bo Yi"] and len(found) == 10


@pytest.mark.parametrize(
    ("url", "html", "want"),
    [
        ("http://x.test/2013/nov/27/story", "", datetime.datetime(2013, 11, 27)),
        ("http://x.test/a", "<meta property='article:published_time' content='2020-02-03T04:05:06+02:00'>", datetime.datetime(2020, 2, 3, 2, 5, 6)),
        ("http://x.test/a", "<meta name='PublishDate' content='bad'><time itemprop='datePublished' datetime='March 4, 2019'>", datetime.datetime(2019, 3, 4)),
        ("http://x.test/a", "<p>2019-01-01</p>", None),
    ],
)
def test_dates(spark, url, html, want):
    assert one(spark, extract.publish_date(N(), F.col("url")), html + "<p>", url) == want


@pytest.mark.parametrize(("html", "want"), [("<html lang='EN-us'>", "en"), ("<html lang=''><meta name='lang' content='de'>", None), ("<meta http-equiv='Content-Language' content='fr'>", "fr"), ("<p>x", None), ("<html lang='1x'>", None)])
def test_languages(spark, html, want):
    assert one(spark, extract.meta_lang(N()), html + "<p>x") == want


def test_canonical_links(spark):
    c = extract.canonical_link(N(), F.col("url"))
    assert one(spark, c, "<link rel=canonical href='/z?q=1'>") == "http://www.site.test/z"
    assert one(spark, c, "<link rel=canonical href='http://o.test/z'>") == "http://o.test/z"
    assert one(spark, c, "<link rel=canonical href='/x/www.site.test/y'>") == "http://www.site.test/y"
    assert one(spark, c) == ""


def test_nested_meta_data(spark):
    html = "<meta property='og:a' content='x'><meta property='og:a:b' content='12'><meta name='fb' content='s'><meta name='fb:c' content='t'><meta name='e' content=' '><meta name=f value=3>"
    assert json.loads(one(spark, F.to_json(extract.meta_data(N())), html)) == {"og": {"a": {"identifier": "x", "b": 12}}, "fb": {"fb": "s", "c": "t"}, "f": 3}


def test_images_and_tags(spark):
    assert one(spark, extract.meta_image(N()), "<link rel='img_src' href='/i.png'><link rel=icon href='/f.ico'>") == "/i.png"
    assert one(spark, extract.tags(N()), "<a href='/tag/x'>X</a><a href='/o'>O</a><a href='/topic/y'>Y</a>") == ["X", "Y"]
    assert one(spark, extract.meta_favicon(N()), "<link rel='apple-touch-icon'>") is None
    assert one(spark, extract.meta_favicon(N())) == ""


# --- main text ---


def test_body_of_a_page():
    html = f"<body class='comment'><div class='sidebar-tools'><p>{STORY}</p></div><div id='x'><h2>Head</h2><p>{STORY} First.</p><p>{STORY} Second<br>line.</p><ul><li>one</li><li>two</li></ul><p><a href='/a'>just a link</a></p></div></body>"
    b = body.body(html)
    assert b.text.startswith("Head\n\n" + STORY + " First.") and "Second\n\nline." in b.text and "one\n\ntwo" in b.text and b.text.count(STORY) == 2


def test_pages_without_text():
    assert body.body(None).text is None and body.body("<p>Hi").text is None and body.body("").movies == []


def test_paragraphs_from_loose_text():
    root = clean.clean(dom.parse("<div>loose <a href='/x'>link</a> more<p>own</p>after</div><div>only text</div>"))
    assert [p.inner_text() for p in root.elements("p")] == ["loose link more", "own", "after", "only text"]


def test_videos():
    html = f"<div><p>{STORY}</p><p>{STORY}</p><iframe src='http://youtube.com/1'></iframe><iframe src='/x'></iframe><object width=3><param name='movie' value='http://vimeo.com/2'><embed src='http://vimeo.com/2'></object></div>"
    assert [(v.embed_type, v.provider) for v in body.body(html).movies] == [("iframe", "youtube"), ("object", "vimeo")]


def test_article_html_has_no_scripts():
    html = f"<div><p onclick='x()'>{STORY}<script>1</script></p><p>{STORY} <em>so</em> <a href='javascript:x'>l</a></p></div>"
    out = body.body(html, keep_html=True).article_html
    assert "<script" not in out and "onclick" not in out and "javascript" not in out and "<p>" in out


def test_link_density():
    p = lambda h: dom.parse(h).elements("p")[0]
    assert body.is_link_dense(p("<p><a>one two</a></p>")) and not body.is_link_dense(p("<p>one two</p>")) and not body.is_link_dense(p("<p>" + "word " * 9 + "<a>x</a></p>"))


def test_build(spark):
    html = f"<html lang=en><title>The story of it all</title><body><div>{'<p>' + STORY + '</p>'}{'<p>' + STORY * 2 + '</p>'}</div>"
    rows = article.build(spark.createDataFrame([("http://s.test/news/a", html), ("http://s.test/b", None)], "url string, html string")).orderBy("url").collect()
    assert rows[0].title == "" and rows[0].download_state == 0 and not rows[0].is_parsed and rows[0].text == "" and rows[0].summary == ""
    assert rows[1].title == "The story of it all" and STORY in rows[1].text and rows[1].keywords and rows[1].source_url == "http://s.test"


def test_settings():
    assert Config.for_language("de").use_meta_language is False
    with pytest.raises(ValueError, match="language"):
        Config(language="xx")


# --- text ---


def text_of(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_stop_words_by_language(spark):
    s = lambda t, lang: text_of(spark, X.stopword_stats(F.col("t"), lang), t)
    assert s("The cat, and  the dog.", "en").stop_word_count == 3 and s("The cat, and  the dog.", "en").word_count == 6
    assert s("le chat et la souris", "fr").stop_word_count >= 3
    for lang in ("ko", "hi", "ar", "fa", "zh", "ja", "th"):
        assert s("abc", lang).word_count >= 1
        assert body.count_stopwords("abc def", lang) == s("abc def", lang).stop_word_count


def test_keywords_and_words_glued_across_lines(spark):
    row = nlp.with_keywords(spark.createDataFrame([("zeta alpha\nbeta zeta zeta Alpha, the the",), ("",), (None,)], "text string")).collect()
    assert [(k.word, k.n) for k in row[0].keywords] == [("zeta", 3), ("alphabeta", 1), ("alpha", 1)] and row[0].keywords[0].score == pytest.approx(3 / 7 * 1.5 + 1)
    assert row[1].keywords == [] and row[2].keywords == []


def test_keywords_of_a_very_long_text(spark):
    text = " ".join(f"w{i % 30000}" for i in range(200_000))
    row = nlp.with_keywords(spark.createDataFrame([(text,)], "text string")).where(F.size("keywords") > 5).first()
    assert len(row.keywords) == 10


def test_sentences(spark):
    assert text_of(spark, X.sentences(F.col("t")), "Mr. Smith went to town. He came\nback! Was it \"late?\" So it was so. No.") == ["Mr. Smith went to town.", "He cameback!", 'Was it "late?"', "So it was so."]


def test_summary_order_and_limits(spark):
    d = spark.createDataFrame([("Sky colour", " ".join(f"The sky has a colour number {w} today." for w in "abcdefg")), ("", "Some text that is long enough."), ("t", None)], "title string, text string")
    rows = nlp.with_summary(d, most=2).collect()
    assert rows[0].summary.count("\n") == 1 and rows[1].summary == "" and rows[2].summary == ""


def test_trimming_and_chunks(spark):
    assert text_of(spark, X.inner_trim(F.col("t")), " a \n\t b c ") == "a b c" and text_of(spark, X.inner_trim(F.col("t")), None) == ""
    assert text_of(spark, X.chunks(F.split("t", " "), 3), "a b c d e") == [["a"], ["b"], ["c", "d", "e"]]


# --- URLs and sites ---


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, False), ("http://x.t", False), ("ftp://example.test/news/x", False), ("http://example.test/news/story", True), ("http://example.test/a/b.pdf", False), ("http://twitter.com/news/a", False),
        ("http://example.test/one-two-three-four-five-six", True), ("http://example.test/example-two-three-four-five-six", False), ("http://example.test/one", False), ("http://example.test/about/news", False),
        ("http://example.test/2014/02/03/x", True), ("http://example.test/x/index.html", False), ("http://about.example.test/news/x", False), ("http://example.test/x/y", False), ("mailto:a@http://example.test/news/x", False),
    ],
)
def test_article_urls(spark, url, want):
    assert text_of(spark, U.valid_article_url(F.col("t")), url) is want


@pytest.mark.parametrize(
    ("url", "source", "want"),
    [("/a", "http://x.test/b/c", "http://x.test/a"), ("d?e", "http://x.test/b/c", "http://x.test/b/d?e"), ("http://go.test/?url=http%3A%2F%2Fy.test", "http://x.test/", "http://y.test"), ("http://www.x.test/?url=z", "http://x.test", "http://www.x.test/?url=z"), ("a", None, "a"), (None, "http://x.test", None), ("http://[", "http://x.test", "")],
)
def test_prepared_urls(spark, url, source, want):
    assert spark.createDataFrame([(url, source)], "u string, s string").select(U.prepare_url(F.col("u"), F.col("s")).alias("x")).first().x == want


def test_memo_is_a_set_that_overflows(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([("d", f"u{i}") for i in range(n)], "domain string, url string")
    assert memo.read(spark, str(tmp_path)).count() == 0
    memo.update(spark, str(tmp_path), rows(5), 4)
    memo.update(spark, str(tmp_path), rows(3).unionByName(spark.createDataFrame([("e", "v")], "domain string, url string")), 4)
    assert {r.domain for r in memo.read(spark, str(tmp_path)).collect()} == {"e"}  # d held more than four
    memo.clear(spark, str(tmp_path), "e")
    assert memo.read(spark, str(tmp_path)).count() == 0


def test_unique_keeps_first_place_and_last_values(spark):
    d = spark.createDataFrame([("u", 1, "a"), ("v", 2, "b"), ("u", 3, None)], "url string, pos int, title string")
    assert sorted(map(tuple, discover.unique(d).collect())) == [("u", 1, None), ("v", 2, "b")]


def test_sources_and_bytes(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<meta charset='latin-1'>é".encode("latin-1"))
    assert pages.files(spark, str(tmp_path)).first().html.endswith("é")
    assert pages.decode("é".encode("cp1252")) == "é" and pages.decode(b"\xef\xbb\xbfx") == "x" and pages.decode("ж".encode("koi8-r"), "koi8-r") == "ж" and pages.decode(None) is None
    html = "<meta http-equiv='refresh' content='0;URL=http://x.test/y'>"
    assert text_of(spark, pages.meta_refresh(F.col("t")), html) == "http://x.test/y" and text_of(spark, pages.meta_refresh(F.col("t")), "<p>") is None


def test_image_sizes():
    assert images.size_of(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (3).to_bytes(4) + (4).to_bytes(4)) == (3, 4)
    assert images.size_of(b"GIF89a" + bytes([5, 0, 6, 0])) == (5, 6) and images.size_of(b"\xff\xd8\xff\xc0\0\x11\x08\0\x07\0\x08" + bytes(9)) == (8, 7) and images.size_of(b"x") is None


@pytest.mark.parametrize(
    ("selector", "want"),
    [("a", ["x", "y", "z"]), ("#one a", ["x", "y"]), ("div > a", ["x", "z"]), (".b.c", ["z"]), ("a[href^=http]", ["y"]), ("a[title], .b", ["x", "z"]), ("p a, div.d > a[title='t']", ["x", "y"]), ("ul a", [])],
)
def test_css(spark, selector, want):
    html = "<div id=one class=d><a title=t>x</a><p><a href='http://s.test'>y</a></p></div><div><a class='b  c'>z</a></div>"
    assert one(spark, F.transform(extract.css(N(), selector), lambda n: n["text"]), html) == want


def test_navigation(spark):
    html = "<ul><li id=i1 class=ab1>1<li>2<li class=ab22>3</ul>"
    texts = lambda c: F.transform(c, lambda n: n["text"])
    assert one(spark, texts(extract.matching(N(), "class", r"b\d\d$")), html) == ["3"]
    assert one(spark, extract.by_id(N(), "i1")["text"], html) == "1" and one(spark, extract.by_id(N(), "i2"), html) is None
    assert one(spark, texts(extract.siblings(N(), extract.by_id(N(), "i1"))), html) == ["2", "3"] and one(spark, texts(extract.siblings(N(), extract.by_id(N(), "i1"), before=True)), html) == []


def test_deep_pages_neither_fail_nor_grow(spark):
    html = "<div>" * 5000 + f"<p>{STORY}</p>" + "</div>" * 5000
    found = body.body(html, keep_html=True)
    assert STORY in found.text and STORY in found.article_html
    rows = dom.rows(dom.parse(html))
    assert len(rows) > 5000 and sum(len(r[9] or "") for r in rows) == 0
    root = dom.parse(html)
    assert root.height() > 5000 and root.outer_html().count("<div>") == 5000


def test_sites_keep_their_own_limits_and_memos(spark):
    html = lambda k: "<body>" + "".join(f"<a href='/2014/05/01/a{i}'>t</a>" for i in range(k)) + "<a href='http://w.test/2014/05/01/x'>w</a>"
    categories = dom.parse_dom(spark.createDataFrame([(f"http://s{k}.test/c", html(40 * (k + 1))) for k in range(3)], "url string, html string"))
    feeds = spark.createDataFrame([], "url string, rss string")
    found = discover.generate_articles(categories, feeds, most=60).groupBy("domain").count().collect()
    assert {r.domain: r["count"] for r in found} == {"s0.test": 41, "s1.test": 60, "s2.test": 60}
    memo_ = spark.createDataFrame([("s1.test", "http://w.test/2014/05/01/x")], "domain string, url string")
    left = discover.generate_articles(categories, feeds, memo_).where("url = 'http://w.test/2014/05/01/x'").collect()
    assert {r.domain for r in left} == {"s0.test", "s2.test"}


def test_a_broken_memo_raises_and_is_not_forgotten(spark, tmp_path):
    rows = spark.createDataFrame([("d", "u")], "domain string, url string")
    memo.update(spark, str(tmp_path), rows)
    (tmp_path / "v-999999999999-half").mkdir()  # a write that was cut off has no mark of success
    assert memo.read(spark, str(tmp_path)).count() == 1
    (latest,) = [p for p in tmp_path.iterdir() if (p / "_SUCCESS").exists()]
    for p in latest.glob("*.parquet"):
        p.write_bytes(b"broken")
    with pytest.raises(Exception, match="(?i)parquet|malformed|corrupt"):
        memo.update(spark, str(tmp_path), rows)
    assert len([p for p in tmp_path.iterdir() if (p / "_SUCCESS").exists()]) == 1


@pytest.mark.parametrize("language", ["en", "de", "zh", "ja", "ko", "ar", "th", "hi"])
def test_both_counts_of_stop_words_agree(spark, language):
    texts = ["The cat and the hat, of all things.", "der Hund und die Katze", "我 的 书\t是 不 一样 的", "これは本です。私のものだ", "나는 학교에 간다", "من البيت إلى المدرسة", "ที่นี่ และ นั่น", "मैं घर में हूँ और वह", ""]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.stopword_stats(F.col("t"), language)["stop_word_count"].alias("n")).collect()
    assert {r.t: r.n for r in found} == {t: body.count_stopwords(t, language) for t in texts}


def test_articles_without_a_top_image_have_their_largest(spark):
    a = spark.createDataFrame([("u1", "h", "", ["a", "b", "thin"]), ("u2", "h", "set", ["a"]), ("u3", "h", "", []), ("u4", "h", "", ["unknown"])], "url string, link_hash string, top_img string, imgs array<string>")
    sizes = spark.createDataFrame([("a", 100, 100), ("b", 200, 150), ("thin", 2000, 100)], "url string, width int, height int")
    top = lambda c: {r.url: r.top_img for r in article.with_top_images(a, sizes, c).collect()}
    assert top(Config()) == {"u1": "b", "u2": "set", "u3": "", "u4": ""}
    assert top(Config(image_ratio=30)) == {"u1": "thin", "u2": "set", "u3": "", "u4": ""} and top(Config(fetch_images=False))["u1"] == ""


def test_sites_end_to_end(spark):
    web = {
        "http://www.x.test": "<meta name=description content=D><a href=/news>n</a><a href=/lost>l</a>",
        "http://www.x.test/news": "<a href=/2014/05/01/a>A</a><a href=/2014/05/01/b>B</a><a href=/2014/05/01/seen>S</a>",
        "http://www.x.test/feed": "<link type=application/rss+xml href=/all.xml>",
        "http://www.x.test/all.xml": "<rss><title>T</title>http://www.x.test/2014/05/01/b http://www.x.test/2014/05/01/c</rss>",
        "http://www.x.test/2014/05/01/a": f"<title>A long title</title><p>{STORY}</p><p>{STORY}</p>" * 3,
        "http://www.x.test/2014/05/01/b": "<meta http-equiv=refresh content='0;url=http://www.x.test/2014/05/01/a'>",
    }
    fetch = source.stored(spark.createDataFrame(list(web.items()), "url string, html string"))
    memo_ = spark.createDataFrame([("www.x.test", "http://www.x.test/2014/05/01/seen")], "domain string, url string")
    built = source.build(spark.createDataFrame([("http://www.x.test",), ("http://www.x.test",), ("ftp://no.test",), (None,)], "url string"), fetch, memo_, Config(min_word_count=10, min_sentence_count=2, follow_meta_refresh=True))
    assert [tuple(r) for r in built.summary().collect()] == [("www.x.test", "x", "D", 2, 1, 3)]
    assert {(r.url[-1], r.title) for r in built.articles.collect()} == {("a", "A"), ("b", "B"), ("c", "")} and built.feeds.first().title == "T"
    got = built.download_articles(fetch)
    assert {r.url[-1] for r in got.articles.collect()} == {"a", "b"}  # c is missing; b leads to a
    assert {(r.url[-1], r.title) for r in got.parse_articles().articles.collect()} == {("a", "A long title"), ("b", "A long title")}
    assert built.remember(memo_).count() == 4


#: A folder of real pages (html/*.html) and their main texts (text/*.txt), for whoever has one.
GOLDEN = pathlib.Path(os.environ.get("GOLDEN_PAGES", "/nowhere"))


@pytest.mark.skipif(not GOLDEN.is_dir(), reason="GOLDEN_PAGES names no folder")
def test_main_texts_of_real_pages():
    pairs = [(p, q) for p in sorted((GOLDEN / "html").glob("*.html")) if (q := GOLDEN / "text" / f"{p.stem}.txt").exists()]
    same = [(body.body(p.read_text("utf-8", "replace")).text or "").split() == q.read_text("utf-8", "replace").split() for p, q in pairs]
    assert pairs and sum(same) >= 2 * len(same) / 3
