"""Queries over page operators.  The pages carry few metadata, so that most queries run over pages with tags put in by an expression that Spark and SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.operators import article, body, dom, extract, images
from pressmill.sources import pages as P

RICH = """replace(replace(html, '</head>', concat('<meta property="og:type" content="article"><meta property="og:site_name" content=" Site ', page_id % 7, ' "><meta name="description" content="About page ', page_id, '">',
 '<meta name="keywords" content="alpha, beta ,k', page_id % 5, '">', CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('<link rel="shortcut icon" href="/f', page_id, '.ico">') END,
 CASE page_id % 4 WHEN 0 THEN concat('<link rel="canonical" href="http://c.test/x/', page_id, '">') WHEN 1 THEN concat('<link rel="canonical" href="/rel/', page_id, '?q=1">') WHEN 2 THEN concat('<meta property="og:url" content="http://og.test/', page_id, '">') ELSE '' END,
 CASE WHEN page_id % 2 = 0 THEN concat('<meta property="og:image" content="http://i.test/', page_id, '.png">') ELSE '' END,
 CASE page_id % 3 WHEN 0 THEN '<meta name="author" content="By Ann Lee and bob stone">' WHEN 1 THEN '<meta name="dc.creator" content="Cy Dee, ANN LEE, ann lee">' ELSE '' END,
 CASE page_id % 3 WHEN 0 THEN concat('<meta property="article:published_time" content="2021-03-0', page_id % 9 + 1, 'T05:06:07Z">') WHEN 1 THEN '<meta name="publish_date" content="not a date">' ELSE '' END,
 '<meta property="fb:app:id" content="', page_id, '"></head>')),
 '</footer>', concat('<a rel="tag" href="/t">Tag ', page_id % 6, '</a><img src="/a.png"><img src="http://i.test/b.png"><img src="/a.png"></footer>'))"""


def _pages(spark: SparkSession, sf_dir: str, rich: bool = False) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.withColumn("html", F.expr(RICH)) if rich else pages


def _nodes(spark: SparkSession, sf_dir: str, rich: bool = False) -> DataFrame:
    return dom.parse_dom(P.spread(_pages(spark, sf_dir, rich)))


_CHARS = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_PLAIN = "trim(regexp_replace(" + _CHARS + ", '\\s+', ' ', 'g'))"
_HOST = "regexp_extract(url, '^https?://([^/:?#]*)', 1)"
_SITE = "regexp_extract(url, '^https?://[^/?#]*', 0)"


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by language: how many, and how long their title and main text are."""
    rows = body.with_body(_nodes(spark, sf_dir)).select(extract.meta_lang(F.col("nodes")).alias("lang"), F.length(extract.title(F.col("nodes"))).alias("t"), F.length(F.coalesce("body.text", F.lit(""))).alias("b"))
    return rows.groupBy("lang").agg(F.count("*").alias("pages"), F.sum("t").alias("title_chars"), F.sum("b").alias("text_chars"))


def page_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("page_id", extract.meta_lang(F.col("nodes")).alias("lang"))


PAGE_LANG = "SELECT page_id, lower(regexp_extract(html, '<html[^>]* lang=\"([A-Za-z]{2})', 1)) AS lang FROM pages"


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by page and tag."""
    return _nodes(spark, sf_dir).select("page_id", F.explode(F.transform("nodes", lambda n: n["tag"])).alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


PAGE_ELEMENTS = """WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<script[^>]*>).*?</script>', '\\1', 'gs'), '(<style[^>]*>).*?</style>', '\\1', 'gs') AS h FROM pages)
SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)) AS tag FROM h) GROUP BY page_id, tag"""


def page_article_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs within each article element, by the intervals of node ids."""
    n = F.col("nodes")
    rows = _nodes(spark, sf_dir).select("page_id", n, F.explode(extract.by_tag(n, "article")).alias("a"))
    return rows.select("page_id", F.size(extract.by_tag(extract.descendants(n, F.col("a")), "p")).cast("bigint").alias("paragraphs"))


PAGE_ARTICLE_PARAGRAPHS = "SELECT page_id, len(regexp_extract_all(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>'))::BIGINT AS paragraphs FROM pages"


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("page_id", extract.title(F.col("nodes")).alias("title"))


PAGE_TITLES = f"""WITH a AS (SELECT page_id, {_PLAIN.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS t, {_PLAIN.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS g FROM pages),
b AS (SELECT page_id, t, CASE WHEN len(string_split(g, ' ')) <= 2 THEN '' ELSE g END AS h FROM a),
c AS (SELECT *, CASE WHEN contains(t, '|') THEN string_split(t, '|') WHEN contains(t, '-') THEN string_split(t, ' - ') WHEN contains(t, '_') THEN string_split(t, '_') WHEN contains(t, '/') THEN string_split(t, '/') ELSE [t] END AS pieces,
 lower(regexp_replace(h, '[^a-zA-Z0-9 ]', '', 'g')) AS hint FROM b),
d AS (SELECT *, list_filter(list_transform(pieces, lambda p: trim(p)), lambda p: hint <> '' AND contains(lower(regexp_replace(p, '[^a-zA-Z0-9 ]', '', 'g')), hint)) AS held,
 list_filter(list_transform(pieces, lambda p: trim(p)), lambda p: length(p) = list_max(list_transform(pieces, lambda q: length(trim(q))))) AS most FROM c),
e AS (SELECT page_id, h, CASE WHEN h = t THEN t WHEN len(pieces) = 1 AND NOT (contains(t, '-') OR contains(t, '|')) THEN t WHEN len(held) > 0 THEN held[1] ELSE most[1] END AS chosen FROM d)
SELECT page_id, CASE WHEN lower(regexp_replace(h, '[^一-龥a-zA-Z0-9 ]', '', 'g')) = lower(regexp_replace(chosen, '[^一-龥a-zA-Z0-9 ]', '', 'g')) THEN h ELSE chosen END AS title FROM e"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("page_id", F.posexplode(extract.anchors(F.col("nodes"))).alias("i", "a")).select("page_id", F.col("i").cast("bigint").alias("i"), "a.href", "a.text")


PAGE_LINKS = f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="[^"]+">[^<]*') AS found FROM pages), x AS (SELECT page_id, unnest(range(len(found))) AS i, unnest(found) AS a FROM l)
SELECT page_id, i::BIGINT AS i, {_CHARS.format("regexp_extract(a, 'href=\"([^\"]+)\"', 1)")} AS href, {_CHARS.format("regexp_extract(a, '>(.*)$', 1, 's')")} AS text FROM x"""


def page_text_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """http(s) addresses in texts made of a page's own."""
    text = F.concat(F.lit("<item><link>"), F.col("url"), F.lit("</link> see "), F.col("url"), F.lit("&x </item>"))
    return _pages(spark, sf_dir).select("page_id", F.explode(extract.text_urls(text)).alias("found")).groupBy("page_id", "found").agg(F.count("*").alias("n"))


PAGE_TEXT_URLS = r"""WITH t AS (SELECT page_id, regexp_replace(concat('<item><link>', url, '</link> see ', url, '&x </item>'), '<[^<]+?>', ' ', 'g') AS t FROM pages)
SELECT page_id, found, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(t, 'https?://[!$-_a-z]+')) AS found FROM t) GROUP BY page_id, found"""


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("nodes")
    return _nodes(spark, sf_dir, True).select("page_id", extract.meta_type(n).alias("kind"), extract.meta_site_name(n).alias("site_name"), extract.meta_description(n).alias("description"), F.array_join(extract.meta_keywords(n), "|").alias("keywords"), extract.meta_favicon(n).alias("favicon"), extract.canonical_link(n, F.col("url")).alias("canonical"), extract.meta_image(n).alias("image"))


_ICON = "CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('/f', page_id, '.ico') END"
PAGE_META = f"""SELECT page_id, 'article' AS kind, concat('Site ', page_id % 7) AS site_name, concat('About page ', page_id) AS description, concat('alpha|beta|k', page_id % 5) AS keywords, {_ICON} AS favicon,
 CASE page_id % 4 WHEN 0 THEN concat('http://c.test/x/', page_id) WHEN 1 THEN concat(regexp_extract(url, '^https?', 0), '://', {_HOST}, '/rel/', page_id) WHEN 2 THEN concat('http://og.test/', page_id) ELSE '' END AS canonical,
 CASE WHEN page_id % 2 = 0 THEN concat('http://i.test/', page_id, '.png') ELSE {_ICON} END AS image FROM pages"""


def page_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, True).select("page_id", F.array_join(extract.authors(F.col("nodes")), "|").alias("authors"))


PAGE_AUTHORS = "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Ann Lee|Bob Stone' WHEN 1 THEN 'Cy Dee|Ann Lee' ELSE '' END AS authors FROM pages"


def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr("CASE WHEN page_id % 5 = 0 THEN 'http://x.test/2014/02/03/story' ELSE url END")
    return _nodes(spark, sf_dir, True).select("page_id", F.date_format(extract.publish_date(F.col("nodes"), url), "yyyy-MM-dd HH:mm:ss").alias("published"))


PAGE_DATES = "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '2014-02-03 00:00:00' WHEN page_id % 3 = 0 THEN concat('2021-03-0', page_id % 9 + 1, ' 05:06:07') END AS published FROM pages"


def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, True).select("page_id", F.explode(extract.tags(F.col("nodes"))).alias("tag"))


PAGE_TAGS = "SELECT page_id, concat('Tag ', page_id % 6) AS tag FROM pages WHERE contains(html, '</footer>')"


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, True).select("page_id", F.explode(extract.absolute(extract.image_urls(F.col("nodes")), F.col("url"))).alias("image"))


PAGE_IMAGES = f"SELECT page_id, unnest([concat({_SITE}, '/a.png'), 'http://i.test/b.png']) AS image FROM pages WHERE contains(html, '</footer>')"


def page_meta_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths into the nested metadata, and the flat map."""
    n = F.col("nodes")
    rows = _nodes(spark, sf_dir, True).select("page_id", extract.meta_data(n).alias("m"), extract.meta_map(n).alias("flat"))
    return rows.select("page_id", F.expr("variant_get(m, '$.og.type', 'string')").alias("kind"), F.expr("variant_get(m, '$.fb.app.id', 'bigint')").alias("app"), F.expr("variant_get(m, '$.description', 'string')").alias("description"), F.size("flat").cast("bigint").alias("keys"))


PAGE_META_DATA = """SELECT page_id, 'article' AS kind, page_id AS app, concat('About page ', page_id) AS description,
 (5 + (page_id % 4 = 2)::INT + (page_id % 2 = 0)::INT + (page_id % 3 < 2)::INT + (page_id % 3 < 2)::INT)::BIGINT AS keys FROM pages"""


def page_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of known providers in the main text of pages that have one put in."""
    frames = F.expr("concat('<article><p><iframe width=\"5\" src=\"http://www.', CASE page_id % 3 WHEN 0 THEN 'youtube.com/embed/' WHEN 1 THEN 'unknown.test/' ELSE 'vimeo.com/' END, page_id, '\"></iframe>The day was as it is and that is what it will be for all of us here and there.</p></article>')")
    rows = body.with_body(_pages(spark, sf_dir).select("page_id", frames.alias("html"))).select("page_id", F.explode("body.movies").alias("v"))
    return rows.select("page_id", "v.embed_type", "v.provider", "v.width", "v.src")


PAGE_VIDEOS = """SELECT page_id, 'iframe' AS embed_type, CASE page_id % 3 WHEN 0 THEN 'youtube' ELSE 'vimeo' END AS provider, '5' AS width,
 concat('http://www.', CASE page_id % 3 WHEN 0 THEN 'youtube.com/embed/' ELSE 'vimeo.com/' END, page_id) AS src FROM pages WHERE page_id % 3 <> 1"""


def page_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text alone, by the page's language."""
    return _nodes(spark, sf_dir).select("page_id", body.fulltext(F.col("html"), extract.meta_lang(F.col("nodes"))).alias("text"))


def page_known_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of pages whose text is known: boxes and links go, paragraphs stay in order."""
    html = F.expr("""concat('<html><body><div class="comments"><p>This is not what the story is about, and it is in a box.</p></div><div id="main"><p>It was the first of all days in ', page_id, ', and they were there.</p>',
 '<p><a href="/a">Only</a> <a href="/b">links</a></p><p>After that, there is <b>no more</b> to say about it<br>than this.</p></div></body></html>')""")
    return body.with_body(_pages(spark, sf_dir).select("page_id", html.alias("html"))).select("page_id", F.col("body.text").alias("text"), F.col("body.top_tag").alias("tag"))


PAGE_KNOWN_TEXT = """SELECT page_id, concat('It was the first of all days in ', page_id, ', and they were there.', chr(10), chr(10), 'Only links', chr(10), chr(10), 'After that, there is no more to say about it', chr(10), chr(10), 'than this.') AS text, 'div' AS tag FROM pages"""


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as articles, with everything that is extracted and computed."""
    rows = article.build(P.spread(_pages(spark, sf_dir, True)))
    lists = ("authors", "meta_keywords", "tags", "imgs", "movies", "keywords")
    return rows.drop("html", "meta_data").withColumns({c: F.array_join(c, "|") for c in lists})


def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Download states and URL validity of pages of which some lack html or failed."""
    html, error = F.expr("CASE WHEN page_id % 3 = 0 THEN NULL ELSE html END"), F.expr("CASE WHEN page_id % 6 = 0 THEN 'timeout' END")
    return _pages(spark, sf_dir).select("page_id", article.download_state(html, error).cast("bigint").alias("state"), article.is_valid_url(F.col("url")).alias("valid"))


PAGE_STATES = "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 1 WHEN page_id % 3 = 0 THEN 0 ELSE 2 END::BIGINT AS state, false AS valid FROM pages"


def page_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where refresh tags lead, and pages with the html of where they lead: of several pages with one address, a page's own."""
    pages = _pages(spark, sf_dir)
    to = F.expr("CASE WHEN page_id % 2 = 0 THEN concat('<meta http-equiv=\"Refresh\" content=\"0;URL=', url, '\">') ELSE concat('<meta http-equiv=\"refresh\" content=\"0; url=', url, '\">') END")
    made = pages.select("page_id", F.concat(F.lit("http://from.test/"), "page_id").alias("url"), to.alias("html"))
    return P.follow_refresh(made, pages, ("page_id",)).select("page_id", F.length("html").cast("bigint").alias("chars"))


PAGE_REFRESH = "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN length(html) ELSE length(concat('<meta http-equiv=\"refresh\" content=\"0; url=', url, '\">')) END::BIGINT AS chars FROM pages"


def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies by content type, and bytes decoded by what they declare."""
    kind = F.expr("CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'video/mp4; x' WHEN 2 THEN 'video/mp4' ELSE 'text/html' END")
    raw = F.expr("encode(concat('<meta charset=\"utf-8\">é', page_id), 'UTF-8')")
    return _pages(spark, sf_dir).select("page_id", P.response_html(F.col("url"), kind, {"application/pdf": "%PDF-", "video/mp4": ""}).alias("body"), P.to_unicode(raw).alias("decoded"))


PAGE_RESPONSES = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '%PDF-' WHEN 2 THEN '' ELSE url END AS body, concat('<meta charset=\"utf-8\">é', page_id) AS decoded FROM pages"


def image_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).selectExpr("page_id", "cast(page_id * 37 % 700 as int) AS width", "CASE WHEN page_id % 11 = 0 THEN NULL ELSE cast(page_id * 53 % 500 as int) END AS height", "concat(CASE WHEN page_id % 7 = 0 THEN '/Logo' ELSE '/i' END, page_id) AS src")
    a = images.area(F.col("width"), F.col("height"), F.col("src"))
    return rows.select("page_id", a.alias("area"), images.is_large_enough(a).alias("large"))


_AREA = """CASE WHEN width IS NULL OR height IS NULL OR width * height < 5000 OR width < 90 THEN 0.0 WHEN greatest(width, height) / least(width, height) > 16 / 9 THEN 0.0 WHEN regexp_matches(lower(src), 'sprite|logo') THEN width * height / 10 ELSE width * height END::DOUBLE"""
IMAGE_AREAS = f"""WITH i AS (SELECT page_id, page_id * 37 % 700 AS width, CASE WHEN page_id % 11 = 0 THEN NULL ELSE page_id * 53 % 500 END AS height, concat(CASE WHEN page_id % 7 = 0 THEN '/Logo' ELSE '/i' END, page_id) AS src FROM pages),
a AS (SELECT page_id, {_AREA} AS area FROM i) SELECT page_id, area, area > 5000 AS large FROM a"""


def image_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).selectExpr("page_id % 20 AS page_id", "cast(page_id * 37 % 700 as int) AS width", "cast(page_id * 53 % 500 as int) AS height", "concat('/i', page_id) AS url")
    return images.largest_image(rows)


IMAGE_LARGEST = f"""WITH i AS (SELECT page_id % 20 AS page_id, page_id * 37 % 700 AS width, page_id * 53 % 500 AS height, concat('/i', page_id) AS src FROM pages),
a AS (SELECT page_id, src, {_AREA} AS area FROM i), p AS (SELECT DISTINCT page_id FROM a)
SELECT p.page_id, b.src AS url FROM p LEFT JOIN (SELECT page_id, src FROM a WHERE area > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY area DESC, src) = 1) b USING (page_id)"""


def image_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram entropy and encoded addresses."""
    return _pages(spark, sf_dir).select("page_id", F.round(images.entropy(F.array(F.lit(1), F.lit(0), (F.col("page_id") % 4 + 1).cast("int"))), 6).alias("entropy"), images.clean_url(F.concat(F.lit("http://x.test/é"), "page_id")).alias("url"))


IMAGE_HELPERS = "SELECT page_id, round(-(1 / (k + 2) * log2(1 / (k + 2)) + (k + 1) / (k + 2) * log2((k + 1) / (k + 2))), 6) AS entropy, concat('http://x.test/%C3%A9', page_id) AS url FROM (SELECT page_id, page_id % 4 AS k FROM pages)"

QUERIES = {
    "page_languages": page_languages, "page_lang": page_lang, "page_elements": page_elements, "page_article_paragraphs": page_article_paragraphs, "page_titles": page_titles, "page_links": page_links, "page_text_urls": page_text_urls, "page_meta": page_meta,
    "page_authors": page_authors, "page_dates": page_dates, "page_tags": page_tags, "page_images": page_images, "page_meta_data": page_meta_data, "page_videos": page_videos, "page_fulltext": page_fulltext, "page_known_text": page_known_text,
    "page_articles": page_articles, "page_states": page_states, "page_refresh": page_refresh, "page_responses": page_responses, "image_areas": image_areas, "image_largest": image_largest, "image_helpers": image_helpers,
}
ORACLES = {
    "page_lang": PAGE_LANG, "page_elements": PAGE_ELEMENTS, "page_article_paragraphs": PAGE_ARTICLE_PARAGRAPHS, "page_titles": PAGE_TITLES, "page_links": PAGE_LINKS, "page_text_urls": PAGE_TEXT_URLS, "page_meta": PAGE_META,
    "page_authors": PAGE_AUTHORS, "page_dates": PAGE_DATES, "page_tags": PAGE_TAGS, "page_images": PAGE_IMAGES, "page_meta_data": PAGE_META_DATA, "page_videos": PAGE_VIDEOS, "page_known_text": PAGE_KNOWN_TEXT,
    "page_states": PAGE_STATES, "page_refresh": PAGE_REFRESH, "page_responses": PAGE_RESPONSES, "image_areas": IMAGE_AREAS, "image_largest": IMAGE_LARGEST, "image_helpers": IMAGE_HELPERS,
}
