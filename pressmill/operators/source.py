"""News sites from their addresses to their articles: home pages, categories, feeds, articles, and what is left of them after download and parsing.

Every table holds all sites at once.  Pages come from a callable that takes a table of addresses (url) and gives url and html
for those it has: sources.pages.fetch, or stored(pages).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.operators import article, discover, dom, extract
from pressmill.operators.config import Config
from pressmill.sources.pages import follow_refresh, meta_refresh
from pressmill.sources.shared import keep

Fetch = Callable[[DataFrame], DataFrame]


def stored(pages: DataFrame) -> Fetch:
    """Pages (url, html) that are already there, in place of the network."""
    return lambda urls: urls.join(pages.select("url", "html"), "url")


def download(frame: DataFrame, fetch: Fetch) -> DataFrame:
    """frame with html: null where the page is missing or failed.  Each address is asked for once."""
    found = fetch(frame.select("url").where("url is not null").distinct()).select("url", "html").dropDuplicates(["url"])
    return frame.join(found, "url", "left")


def _there(frame: DataFrame) -> DataFrame:
    return frame.where("html is not null and html <> ''")


@dataclass(frozen=True)
class Sources:
    """Sites (url, scheme, domain, brand, description, html), their categories (domain, url, nodes) and feeds (domain, url, rss, title), and articles (domain, source_url, url, title, pos and what later steps add)."""

    sites: DataFrame
    categories: DataFrame
    feeds: DataFrame
    articles: DataFrame
    config: Config

    def download_articles(self, fetch: Fetch) -> Sources:
        """With the articles' html, or with config.follow_meta_refresh that of the page that a refresh tag leads to; articles without go."""
        found = _there(download(self.articles, fetch))
        if self.config.follow_meta_refresh:
            found = keep(found)
            targets = fetch(found.select(meta_refresh(F.col("html")).alias("url")).where("url is not null").distinct())
            found = follow_refresh(found, targets.dropDuplicates(["url"]))
        return replace(self, articles=keep(found))

    def parse_articles(self) -> Sources:
        """With all article columns; articles whose body is none go.  Titles of links give way to those of the pages."""
        parsed = article.parse_articles(self.articles.drop("title"), self.config)
        kind = F.col("meta_type")
        return replace(self, articles=parsed.where(article.is_valid_body(F.col("text"), F.col("title"), F.col("url"), F.col("html"), kind, self.config)))

    def remember(self, memo: DataFrame) -> DataFrame:
        """The memo after these articles."""
        return discover.remember(memo, self.articles, self.config.max_memo)

    def summary(self) -> DataFrame:
        """domain, brand, description, and how many categories, feeds and articles each site has."""
        counts = [getattr(self, k).groupBy("domain").agg(F.count("*").alias(k)) for k in ("categories", "feeds", "articles")]
        out = self.sites.select("domain", "brand", "description")
        for c in counts:
            out = out.join(c, "domain", "left")
        return out.na.fill(0, ["categories", "feeds", "articles"])


def build(sites: DataFrame, fetch: Fetch, memo: DataFrame | None = None, config: Config = Config(), most: int | None = discover.MOST_ARTICLES) -> Sources:
    """Discovers all sites in sites (url): each site's articles that the memo lacks, up to most of it (None: all).

    Rows that are no http(s) address go; a site is given once.  Home pages, categories and feeds that are missing or empty are left out.
    What was fetched is kept in the shared folder before the next step, so that no page is asked for again.
    """
    own = discover.sources(sites.select("url").distinct())
    homes = dom.parse_dom(keep(_there(download(own, fetch))))
    found = homes.select("domain", "brand", F.col("url").alias("source_url"))
    categories = discover.category_urls(homes).join(found, "source_url").select("domain", "source_url", "url").distinct()
    categories = dom.parse_dom(keep(_there(download(categories, fetch)))).where(F.size("nodes") > 0)
    common = discover.common_feeds(own).join(found, "source_url").select("domain", "source_url", "url")
    places = dom.parse_dom(_there(download(common, fetch))).where(F.size("nodes") > 0)
    feeds = discover.feed_urls(categories.select("source_url", "url", "nodes").unionByName(places.select("source_url", "url", "nodes")))
    feeds = dom.parse_dom(keep(_there(download(feeds, fetch)).join(found, "source_url")))
    feeds = feeds.select("domain", "url", F.col("html").alias("rss"), discover.feed_title(F.col("nodes"), F.col("brand")).alias("title"))
    articles = keep(discover.generate_articles(categories.select("domain", "url", "nodes"), feeds, memo if config.memoize_articles else None, most))
    sites = own.join(homes.select("url", "html", extract.meta_description(F.col("nodes")).alias("description")), "url", "left")
    return Sources(sites, categories.select("domain", "url", "nodes"), feeds, articles, config)
