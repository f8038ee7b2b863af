"""Page tables from files, texts, byte columns and the network."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.operators.config import Config

_CHARSET = re.compile(rb"""<meta[^>]+charset=["']?\s*([A-Za-z0-9_\-]+)""", re.IGNORECASE)


def spread(frame: DataFrame) -> DataFrame:
    """frame over more tasks where its scan has fewer than there are cores (a file of one row group is one task's).  No result depends on it, and a scan of more tasks isn't shuffled."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(2 * cores) if frame._jdf.rdd().getNumPartitions() < cores else frame  # noqa: SLF001


def files(spark: SparkSession, path: str) -> DataFrame:
    """url (file:...) and html of each file, decoded."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), to_unicode(F.col("content")).alias("html"))


def inline(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """url and html from memory."""
    return spark.createDataFrame(rows, "url string, html string")


def decode(data: bytes | None, declared: str | None = None) -> str | None:
    """Bytes as text: by mark, by the declared charset, by the page's own, as UTF-8, or as windows-1252."""
    if data is None:
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    own = _CHARSET.search(data)
    for name in (None if (declared or "").lower() == "iso-8859-1" else declared, own and own.group(1).decode(), "utf-8"):
        try:
            if name:
                return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("cp1252", "replace")


@F.pandas_udf(T.StringType())
def to_unicode(content: pd.Series) -> pd.Series:
    return pd.Series([decode(c) for c in content], dtype=object)


def response_html(body: Column, content_type: Column, ignored: dict[str, str]) -> Column:
    """body, or the default of an ignored content type, which is compared as it stands, parameters included."""
    out = F.lit(None).cast("string")
    for kind, default in ignored.items():
        out = F.coalesce(out, F.when(content_type == kind, F.lit(default)))
    return F.coalesce(out, body)


def meta_refresh(html: Column) -> Column:
    """The address that a page's refresh tag leads to; null without one.  The content has two parts at ';', and the second begins with url= without a blank."""
    tag = F.regexp_extract(html, r"""(?is)<meta[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*>""", 0)
    content = F.regexp_extract(tag, r"""(?is)content\s*=\s*("([^"]*)"|'([^']*)')""", 0)
    value = F.regexp_replace(F.regexp_replace(content, r"(?is)^content\s*=\s*[\"']", ""), r"[\"']$", "")
    parts = F.split(value, ";")
    second = F.get(parts, F.lit(1))
    return F.when((tag != "") & (F.size(parts) == 2) & F.lower(second).startswith("url="), F.regexp_replace(F.substring(second, 5, 1 << 20), "[\"']", ""))


def follow_refresh(pages: DataFrame, all_pages: DataFrame | None = None, same: tuple[str, ...] = ()) -> DataFrame:
    """pages in which one with a refresh tag has the html of the page that it leads to, if all_pages (url, html) has it; one step.

    Where all_pages has an address several times, a page gets the version equal to it in the columns same (of both tables), and of
    several such the least html by hash, so that no page becomes two.
    """
    keys = [f"__same{i}" for i in range(len(same))]
    named = (pages if all_pages is None else all_pages).select(F.col("url").alias("__to"), F.col("html").alias("__html"), *(F.col(c).alias(k) for c, k in zip(same, keys, strict=True)))
    targets = named.where("__to is not null").groupBy("__to", *keys).agg(F.min_by("__html", F.struct(F.xxhash64("__html"), "__html")).alias("__html"))
    on = F.col("__refresh") == F.col("__to")
    for c, k in zip(same, keys, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    return pages.withColumn("__refresh", meta_refresh(F.col("html"))).join(targets, on, "left").withColumn("html", F.coalesce("__html", "html")).drop("__refresh", "__to", "__html", *keys)


def fetch(urls: DataFrame, config: Config = Config(), partitions: int | None = None) -> DataFrame:
    """url, html, status and error of each row of urls, fetched by the executors: config.number_threads requests at a time in each of their partitions.

    Failures give a null html and the error's text (download state 1), as do other statuses than 2xx if config.http_success_only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        import requests

        session = requests.Session()
        session.headers.update(config.headers or {"User-Agent": config.user_agent})

        def one(url):
            try:
                r = session.get(url, timeout=config.request_timeout, proxies=config.proxies, allow_redirects=True)
                if config.http_success_only:
                    r.raise_for_status()
                kind = r.headers.get("Content-Type", "")
                if kind in config.ignored_content_types:
                    return config.ignored_content_types[kind], r.status_code, None
                charset = re.search(r"charset=([\w-]+)", kind)
                return decode(r.content, charset and charset.group(1)), r.status_code, None
            except requests.RequestException as e:
                return None, getattr(getattr(e, "response", None), "status_code", None), str(e)

        with ThreadPoolExecutor(config.number_threads) as pool:
            for batch in batches:
                found = list(pool.map(one, batch["url"]))
                yield pd.DataFrame({"url": batch["url"], "html": [f[0] for f in found], "status": pd.array([f[1] for f in found], "Int32"), "error": [f[2] for f in found]})

    rows = urls.select("url")
    return (rows if partitions is None else rows.repartition(partitions)).mapInPandas(run, "url string, html string, status int, error string")


def languages(spark: SparkSession) -> DataFrame:
    """code and name of the languages with stop words."""
    from pressmill.functions.stopwords import NAMES

    return spark.createDataFrame(sorted(NAMES.items()), "code string, name string")


#: Well-known news sites, to begin with.
POPULAR = tuple("abcnews.go.com aljazeera.com apnews.com arstechnica.com bbc.co.uk bloomberg.com cbc.ca cbsnews.com cnbc.com cnn.com dw.com economist.com elpais.com engadget.com euronews.com forbes.com foxnews.com ft.com independent.co.uk latimes.com lemonde.fr nature.com nbcnews.com newyorker.com npr.org nytimes.com politico.com reuters.com scientificamerican.com slate.com spiegel.de techcrunch.com theatlantic.com theguardian.com theverge.com time.com usatoday.com vox.com washingtonpost.com wired.com wsj.com".split())


def popular_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in POPULAR], "site string").select(F.concat(F.lit("http://"), "site").alias("url"))


def trending_titles(rss: DataFrame) -> DataFrame:
    """Titles of the entries of trend feeds (column rss), a row each; there is no network here, so the feeds are a table."""
    titles = F.regexp_extract_all(F.col("rss"), F.lit(r"(?is)<item\b.*?<title>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</title>"), 1)
    return rss.select(F.explode(titles).alias("title"))


AGENTS = ("Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 Chrome/124.0", "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:125.0) Gecko/20100101 Firefox/125.0", "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_4) AppleWebKit/605.1.15 Safari/605.1.15")


def user_agent(spark: SparkSession, seed: int = 0) -> DataFrame:
    """One of the browsers' names, by chance."""
    return spark.createDataFrame([(a,) for a in AGENTS], "agent string").orderBy(F.rand(seed)).limit(1)
