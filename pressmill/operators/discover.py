"""Discovery of categories, feeds and articles of news sites, and the memo of URLs already seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressmill.functions import urls
from pressmill.operators import extract

#: A link with any of these in its path or subdomain leads to no category.
NO_CATEGORY = tuple(sorted(set("""
about academy account admin advert archive bebo board browse careers charts contact coupons developer donate events facebook faq feedback flickr forum
friendster help howto imgur info itunes jobs legal linkedin login mail maps mobile myspace newsletter password plus preferences privacy product profile
proxy purchase register search services shop shopping signup site-map siteindex sitemap stop store stumbleupon subscribe subscription terms tickets
twitter vimeo youtube
""".split()) | {"how to"}))  # fmt: skip
FEED_PATHS = ("/feed", "/feeds", "/rss")
MOST_FEEDS, MOST_ARTICLES, MOST_MEMO = 50, 5000, 20_000
SUBDOMAINS_OUT = ("m", "i")


def sources(frame: DataFrame, url: str = "url") -> DataFrame:
    """frame with scheme, domain and brand; rows of which the URL is no http(s) URL go."""
    u = F.col(url)
    return frame.where(u.isNotNull() & u.startswith("http") & u.contains("://")).withColumns({"scheme": urls.scheme(u), "domain": urls.domain(u), "brand": urls.site(u)})


def category_candidate(href: Column, source: Column) -> Column:
    """What a link gives as a category's address, before it is resolved; null for none."""
    link = F.struct(urls.domain(href).alias("dom"), urls.path(href).alias("path"), urls.scheme(href).alias("scheme"), urls.subdomain(href).alias("sub"))
    return urls.let(link, lambda p: urls.let(_candidate(p, href, source), lambda found: F.when(~F.lower(F.concat(urls.path(found), F.lit(" "), urls.subdomain(found))).rlike("|".join(w.replace("-", r"\-") for w in NO_CATEGORY)), found)))


def _candidate(link: Column, href: Column, source: Column) -> Column:
    dom, path, scheme, sub = (link[k] for k in ("dom", "path", "scheme", "sub"))

    def pieces(found):
        at = F.array_position(found, "index.html").cast("int")
        return F.when(at > 0, F.concat(F.slice(found, 1, F.greatest(at - 1, F.lit(0))), F.slice(found, at + 1, F.size(found)))).otherwise(found)

    short = urls.let(urls.let(F.filter(F.split(path, "/"), lambda c: c != ""), pieces), lambda p: (F.size(p) == 1) & (F.length(F.get(p, F.lit(0))) < 14))
    related = (urls.registered(href) == urls.registered(source)) | F.array_contains(F.split(sub, r"\."), urls.site(source))
    whole = F.concat(F.when(scheme != "", F.concat(scheme, F.lit("://"))).otherwise("//"), dom)
    bad = ((dom == "") & (path == "")) | path.startswith("#") | ((scheme != "") & ~scheme.isin("http", "https"))
    return F.when(bad, None).when(dom != "", F.when(related & ~sub.isin(*SUBDOMAINS_OUT), whole)).when(short, path)


def category_urls(homes: DataFrame, url: str = "url", nodes: str = "nodes") -> DataFrame:
    """source_url and url of each site's categories, each once, with the site's own address."""
    links = homes.select(F.col(url).alias("source_url"), F.explode(F.concat(F.transform(extract.anchors(F.col(nodes)), lambda a: a["href"]), F.array(F.lit("/")))).alias("href"))
    found = links.select("source_url", category_candidate(F.col("href"), F.col("source_url")).alias("c"), (F.col("href") == "/").alias("home"))
    found = found.select("source_url", F.when(F.col("home"), F.lit("/")).otherwise(F.col("c")).alias("c")).where("c is not null")
    slashed = F.concat("c", F.when(F.col("c").endswith("/"), "").otherwise("/"))
    schemed = F.when(slashed.startswith("://"), F.concat(F.lit("http"), slashed)).when(slashed.startswith("//"), F.concat(F.lit("http:"), slashed)).otherwise(slashed)
    plain = found.select("source_url", F.regexp_replace(schemed, "/$", "").alias("c")).distinct()
    return plain.select("source_url", urls.prepare_url(F.col("c"), F.col("source_url")).alias("url")).where("url <> ''").distinct()


def common_feeds(frame: DataFrame, url: str = "url") -> DataFrame:
    """source_url and url of places where feeds usually are."""
    u = F.col(url)
    user = F.regexp_extract(urls.path(u), "^/(@[^/]+)", 1)
    medium = (urls.site(u) == "medium") & (user != "")
    base = F.concat(urls.scheme(u), F.lit("://"), urls.domain(u))
    places = F.when(medium, F.array(F.concat(base, F.lit("/feed/"), user))).otherwise(F.array(*(F.concat(base, F.lit(p)) for p in FEED_PATHS)))
    return frame.select(u.alias("source_url"), F.explode(places).alias("url")).distinct()


def feed_urls(categories: DataFrame, source: str = "source_url", nodes: str = "nodes") -> DataFrame:
    """source_url and url of the feeds that categories link to: up to MOST_FEEDS of each source, each once."""
    links = categories.select(F.col(source).alias("source_url"), F.col("url").alias("__c"), F.posexplode(extract.feed_links(F.col(nodes), MOST_FEEDS)).alias("__i", "href"))
    w = W.partitionBy("source_url").orderBy("__c", "__i")
    top = links.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= MOST_FEEDS)
    return top.select("source_url", urls.prepare_url(F.col("href"), F.col("source_url")).alias("url")).where("url <> ''").distinct()


def feed_title(nodes: Column, brand: Column) -> Column:
    """The first title that isn't empty, else the brand."""
    return F.coalesce(F.get(F.filter(F.transform(extract.by_tag(nodes, "title"), lambda n: n["inner_text"]), lambda t: t != ""), F.lit(0)), brand)


def _site(frame: DataFrame) -> Column:
    """The site that rows of categories or feeds belong to: their column domain, or without one their address's."""
    return (F.col("domain") if "domain" in frame.columns else urls.domain(F.col("url"))).alias("domain")


def category_articles(categories: DataFrame, nodes: str = "nodes") -> DataFrame:
    """source_url (the category's), url, title and pos of the links in categories that look like articles."""
    return _category_articles(categories, nodes).drop("domain")


def _category_articles(categories: DataFrame, nodes: str = "nodes") -> DataFrame:
    links = categories.select(_site(categories), F.col("url").alias("source_url"), F.posexplode(extract.anchors(F.col(nodes))).alias("pos", "a"))
    found = links.select("domain", "source_url", urls.prepare_url(F.col("a.href"), F.col("source_url")).alias("url"), F.col("a.text").alias("title"), F.col("pos").cast("bigint").alias("pos"))
    return found.where(urls.valid_article_url(F.col("url")))


def feed_articles(feeds: DataFrame) -> DataFrame:
    """source_url (the feed's), url, title ('') and pos of the addresses in feeds (url, rss) that look like articles."""
    return _feed_articles(feeds).drop("domain")


def _feed_articles(feeds: DataFrame) -> DataFrame:
    links = feeds.select(_site(feeds), F.col("url").alias("source_url"), F.posexplode(extract.text_urls(F.col("rss"))).alias("pos", "url"))
    found = links.select("domain", "source_url", urls.prepare_url(F.col("url"), F.col("source_url")).alias("url"), F.lit("").alias("title"), F.col("pos").cast("bigint").alias("pos"))
    return found.where(urls.valid_article_url(F.col("url")))


def unique(articles: DataFrame, key: str | tuple[str, ...] = "url", order: str = "pos") -> DataFrame:
    """One row of each key (a column or several): the first one's place and the last one's values."""
    keys = (key,) if isinstance(key, str) else key
    values = [c for c in articles.columns if c not in (*keys, order)]
    best = articles.groupBy(*keys).agg(F.min(order).alias(order), F.max_by(F.struct(*values), F.struct(order, *values)).alias("__v"))
    return best.select(*(F.col(f"__v.{c}").alias(c) if c in values else F.col(c) for c in articles.columns))


def not_seen(articles: DataFrame, memo: DataFrame) -> DataFrame:
    """Articles whose (domain, url) the memo lacks; of a URL twice in one site's articles, one.  A page that one site has seen is still new to another.  Without a column domain it is source_url's."""
    own = articles if "domain" in articles.columns else articles.withColumn("domain", urls.domain(F.col("source_url")))
    return unique(own, ("domain", "url")).join(memo.select("domain", "url").distinct(), ["domain", "url"], "left_anti")


def remember(memo: DataFrame, seen: DataFrame, most: int = MOST_MEMO) -> DataFrame:
    """The new memo: old and new rows of (domain, url), each once.  A domain whose old memo holds more than most is forgotten."""
    full = memo.groupBy("domain").count().where(F.col("count") > most).select("domain")
    return memo.select("domain", "url").unionByName(seen.select("domain", "url")).distinct().join(full, "domain", "left_anti")


def forget(memo: DataFrame, domain: str) -> DataFrame:
    """The memo without a domain."""
    return memo.where(F.col("domain") != domain)


def memo_name(domain: Column) -> Column:
    """A domain as a file name."""
    return F.concat(F.regexp_replace(F.translate(domain, "/", "-"), "-+$", ""), F.lit(".txt"))


def memo_domain(name: Column) -> Column:
    """The domain of a file name; dashes come back as slashes."""
    return F.translate(F.regexp_replace(name, r"\.txt$", ""), "-", "/")


def generate_articles(categories: DataFrame, feeds: DataFrame, memo: DataFrame | None = None, most: int | None = MOST_ARTICLES) -> DataFrame:
    """domain, source_url, url, title and pos of each site's new articles from categories (url, nodes) and feeds (url, rss), each once a site and up to most of a site, the first ones by place; all of them where most is None.

    A site is a domain: that in a column of this name, or the category's or feed's own.  Where both have a URL the category's values stay and the feed's place.
    """
    found = _category_articles(categories).withColumn("rank", F.lit(1)).unionByName(_feed_articles(feeds).withColumn("rank", F.lit(0)))
    placed = found.withColumn("pos", F.col("rank") * F.lit(1 << 40) + F.col("pos")).drop("rank")
    new = unique(placed, ("domain", "url")) if memo is None else not_seen(placed, memo)
    if most is None:
        return new.select("domain", "source_url", "url", "title", "pos")
    first = new.withColumn("n", F.row_number().over(W.partitionBy("domain").orderBy("pos", "url"))).where(F.col("n") <= most)
    return first.select("domain", "source_url", "url", "title", "pos")


def cached(computed: DataFrame, cache: DataFrame, now: Column, key: str = "domain", days: int = 1) -> DataFrame:
    """Rows of cache not older than days (column computed_at), and computed rows of the keys that it has none for."""
    fresh = cache.where(F.col("computed_at") > now - F.expr(f"interval {days} days"))
    return fresh.unionByName(computed.withColumn("computed_at", now).join(fresh.select(key).distinct(), key, "left_anti"))


def by_source(frame: DataFrame, threads_per_source: int = 1, key: str = "source_url", total: int | None = None) -> DataFrame:
    """frame in partitions for fetching: each source's rows in threads_per_source of them, so that no site is asked by more at a time."""
    lane = F.pmod(F.xxhash64("url"), F.lit(threads_per_source))
    return frame.repartition(key, lane) if total is None else frame.repartition(total, key, lane)
