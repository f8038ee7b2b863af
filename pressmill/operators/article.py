"""Articles: pages with everything that can be said about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions import urls
from pressmill.functions.stopwords import NAMES
from pressmill.operators import extract, images, nlp
from pressmill.operators.body import with_body
from pressmill.operators.config import Config
from pressmill.operators.dom import parse_dom

NOT_STARTED, FAILED, SUCCESS = 0, 1, 2


def download_state(html: Column, error: Column | None = None) -> Column:
    """0 not fetched, 1 failed, 2 fetched."""
    failed = F.lit(False) if error is None else F.coalesce(error != "", F.lit(False))
    return F.when(failed, FAILED).when(html.isNull(), NOT_STARTED).otherwise(SUCCESS).cast("tinyint")


def parse_articles(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """pages (url, html and any other columns) with all article columns.  A page without html isn't parsed: its texts are '', its lists empty."""
    nodes, url = F.col("nodes"), F.col("url")
    lang = extract.meta_lang(nodes)
    lang = F.when(lang.isin(*sorted(NAMES)), lang)
    frame = parse_dom(pages).withColumn("meta_lang", lang)
    frame = with_body(frame, language=F.coalesce("meta_lang", F.lit(config.language)) if config.use_meta_language else F.lit(config.language), keep_html=config.keep_article_html)
    parsed = F.size("nodes") > 0
    found = extract.absolute(extract.image_urls(nodes), url)
    top = F.get(extract.absolute(F.array(F.coalesce(F.nullif(extract.meta_image(nodes), F.lit("")), F.col("body.first_image"))), url), F.lit(0))
    frame = frame.withColumns({
        "source_url": F.when(urls.domain(url) != "", F.concat(F.coalesce(F.nullif(urls.scheme(url), F.lit("")), F.lit("http")), F.lit("://"), urls.domain(url))),
        "link_hash": F.md5(F.coalesce("html", F.lit(""))),
        "title": F.substring(extract.title(nodes), 1, config.max_title),
        "download_state": download_state(F.col("html")),
        "is_parsed": parsed,
        "text": F.substring(F.coalesce("body.text", F.lit("")), 1, config.max_text),
        "article_html": F.coalesce("body.article_html", F.lit("")),
        "authors": extract.authors(nodes, config.max_authors),
        "publish_date": extract.publish_date(nodes, url),
        "meta_description": extract.meta_description(nodes),
        "meta_site_name": extract.meta_site_name(nodes),
        "meta_favicon": extract.meta_favicon(nodes),
        "meta_type": extract.meta_type(nodes),
        "meta_keywords": extract.meta_keywords(nodes),
        "canonical_link": extract.canonical_link(nodes, url),
        "meta_data": extract.meta_data(nodes),
        "tags": extract.tags(nodes),
        "meta_img": F.coalesce(F.get(extract.absolute(F.array(F.nullif(extract.meta_image(nodes), F.lit(""))), url), F.lit(0)), F.lit("")),
        "imgs": found,
        "top_img": F.coalesce(top, F.lit("")),
        "movies": F.transform("body.movies", lambda v: v["src"]),
    })
    return frame.withColumn("imgs", F.array_union("imgs", F.filter(F.array("meta_img"), lambda s: s != ""))).drop("nodes", "body")


def with_top_images(articles: DataFrame, sizes: DataFrame, config: Config = Config()) -> DataFrame:
    """Articles of which those without a top image have their largest one (the first by address among equals), by a table of sizes (url, width, height).  Unless config.fetch_images articles stay as they are."""
    if not config.fetch_images:
        return articles
    lacking = articles.where("top_img = '' and size(imgs) > 0").select("url", "link_hash", F.explode("imgs").alias("__img")).distinct()
    each = lacking.join(sizes.select(F.col("url").alias("__img"), "width", "height"), "__img").withColumn("__area", images.area(F.col("width"), F.col("height"), F.col("__img"), config.image_ratio))
    best = each.where("__area > 0").groupBy("url", "link_hash").agg(F.min(F.struct((-F.col("__area")).alias("a"), "__img"))["__img"].alias("__top"))
    return articles.join(best, ["url", "link_hash"], "left").withColumn("top_img", F.coalesce(F.nullif("top_img", F.lit("")), "__top", F.lit(""))).select(*articles.columns)


def with_nlp(articles: DataFrame, config: Config = Config()) -> DataFrame:
    """Articles with keywords (of title and text, sorted) and summary."""
    frame = nlp.with_keywords(articles, "title", "__title_keywords", config.language)
    frame = nlp.with_summary(frame, language=config.language, most=config.max_summary_sentences, cut=config.max_summary)
    return frame.withColumn("keywords", nlp.article_keywords(F.col("__title_keywords"), F.col("keywords"), config.max_keywords)).drop("__title_keywords")


def is_valid_url(url: Column) -> Column:
    return urls.valid_article_url(url)


def is_valid_body(text: Column, title: Column, url: Column, html: Column, kind: Column | None = None, config: Config = Config()) -> Column:
    """Whether a body is an article's: by type, length, title and sentences."""
    words = F.size(F.split(text, " "))
    media = urls.is_media(url)
    return (
        F.when(F.coalesce(F.lit(None) if kind is None else kind == "article", F.lit(False)) & (words > config.min_word_count), True)
        .when(~media & (F.coalesce(text, F.lit("")) == ""), False)
        .when(F.size(F.split(title, " ")) < 2, False)
        .when(words < config.min_word_count, False)
        .when(F.size(F.split(text, r"\.")) < config.min_sentence_count, False)
        .when(F.coalesce(html, F.lit("")) == "", False)
        .otherwise(True)
    )


def require(frame: DataFrame, state: str, at_least: int, message: str) -> DataFrame:
    """frame, which raises when a row's state is below at_least: analysis before download or parsing."""
    return frame.withColumn(state, F.when(F.col(state) >= at_least, F.col(state)).otherwise(F.raise_error(F.lit(message))))


def build(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """Pages to articles with keywords and summaries."""
    return with_nlp(parse_articles(pages, config), config)
