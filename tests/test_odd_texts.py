"""Texts, pages and sites that the small tables don't have, held against SQL or what it says."""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from pressmill.functions import text as X
from pressmill.operators import body, discover, dom
from pressmill.plans import document_queries as D
from pressmill.plans import page_queries as Q
from pressmill.plans import site_queries as S
from pressmill.sources import pages as P


def test_sentences_after_capitals_beyond_ascii_are_those_of_sql(spark):
    texts = ["Die Zeit ist da für.\nFÜR.\nVERÖTE!! Das war es dann.", "Was ist Ä. Ein Wort mehr? ÖB. Noch ein Satz.", "One long\u000bsentence.\u000bAnother one here. Mr.\u000bSmith came to town."]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT unnest(range(3)) AS doc_id, unnest(?) AS text", [texts])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").select("doc_id", F.posexplode(X.sentences(F.col("text"))))
    assert sorted(tuple(r) for r in rows.collect()) == sorted(con.execute(D.DOC_SENTENCES).fetchall())


def test_a_refresh_to_an_address_of_several_pages_gives_one_page(spark):
    to = lambda u: f'<meta http-equiv="refresh" content="0;url={u}">'
    made = spark.createDataFrame([(1, "http://a.test/1", to("http://x.test/")), (2, "http://a.test/2", to("http://x.test/")), (3, "http://a.test/3", to("http://no.test/"))], "page_id int, url string, html string")
    there = spark.createDataFrame([(1, "http://x.test/", "one"), (2, "http://x.test/", "two"), (9, "http://x.test/", None), (8, None, "none")], "page_id int, url string, html string")
    found = {r.page_id: r.html for r in P.follow_refresh(made, there, ("page_id",)).collect()}
    assert found == {1: "one", 2: "two", 3: to("http://no.test/")}
    plain = P.follow_refresh(made, there.unionByName(there))
    assert plain.count() == 3 and plain.columns == made.columns
    assert len({r.html for r in plain.where("page_id < 3").collect()}) == 1 and plain.where("html in ('one', 'two')").count() == 2


def test_page_refresh_with_an_address_twice_is_its_sql(spark, tmp_path):
    spark.createDataFrame([(i, f"http://x.test/{i // 4}", "<p>" + "x" * i) for i in range(12)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(tuple(r) for r in Q.page_refresh(spark, str(tmp_path)).collect()) == sorted(con.execute(Q.PAGE_REFRESH).fetchall())


def test_names_of_entities_without_semicolon_stay_as_written():
    root = dom.parse("<title>a&amp;b &amp c&ampd &copy x&notit; &#38 &lt;&amp</title><a href='?a=1&copy=2&amp;b=3'>R&D</a><!-- &lt --><script>a&amp&&lt;b</script>")
    assert root.elements("title")[0].text == "a&b &amp c&ampd &copy x&notit; & <&amp"
    assert root.elements("a")[0].attrs["href"] == "?a=1&copy=2&b=3" and root.elements("a")[0].text == "R&D"
    assert [n.text for n in root.walk() if n.tag == "#comment"] == [" &lt "] and root.elements("script")[0].text == "a&amp&&lt;b"
    assert dom.parse("<p>\U000f0000 &amp c").elements("p")[0].text == "\U000f0000 &amp c"


def test_a_site_without_a_limit_has_all_its_articles(spark):
    links = "".join(f'<a href="/2014/05/01/story-{i}">S</a>' for i in range(discover.MOST_ARTICLES + 7))
    categories = dom.parse_dom(spark.createDataFrame([("a.test", "http://a.test/c", links)], "domain string, url string, html string"))
    feeds = spark.createDataFrame([], "domain string, url string, rss string")
    assert discover.generate_articles(categories, feeds, None, None).count() == discover.MOST_ARTICLES + 7
    assert discover.generate_articles(categories, feeds).count() == discover.MOST_ARTICLES


def test_source_build_of_more_articles_than_the_limit_is_its_sql(spark, tmp_path):
    spark.range(9, 9 * 6000, 9).selectExpr("id AS page_id", "concat('http://p.test/', id) AS url", "'<p>x' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(tuple(r) for r in S.source_build(spark, str(tmp_path)).collect()) == sorted(con.execute(S.SOURCE_BUILD).fetchall())


def test_trees_and_bodies_are_made_for_a_bounded_part_of_a_batch():
    pages = [None, "", "<p>" + "x" * 1000, "<p>" + "y" * 3 * dom.SLICE_BYTES] + ["<p>It was the best of times and it was the worst of times.</p>" * 20] * 1500
    trees = list(dom._tree.func(iter([pa.array(pages), pa.array([], pa.string()), pa.array(pages[:2])])))
    assert sum(map(len, trees)) == len(pages) + 2 and len(trees) > 5
    assert max(sum(len(p or "") for p in ps) for (ps,) in dom.in_slices([(pa.array(pages[4:]),)])) <= dom.SLICE_BYTES
    assert [t for a in trees for t in a.to_pylist()][2][2]["text"] == "x" * 1000
    texts = list(body.fulltext.func(iter([(pa.array(pages), pa.array(["en"] * len(pages)))])))
    assert len(texts) > 5 and [t for a in texts for t in a.to_pylist()] == [body.body(p).text for p in pages[:5]] + [body.body(pages[4]).text] * 1499
