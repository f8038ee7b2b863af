"""Queries over URL operators.  pages.url knows few shapes, so that most run over URLs made from it that take every branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import urls as U

SHAPES = """CASE page_id % 12
 WHEN 0 THEN url
 WHEN 1 THEN concat(regexp_extract(url, '^https?://[^/]*', 0), '/2013/11/27/tech/story-', page_id, '.html')
 WHEN 2 THEN concat(regexp_extract(url, '^https?://[^/]*', 0), '/news/world-report-', page_id, '?id=', page_id, '&utm_source=x#top')
 WHEN 3 THEN concat(regexp_extract(url, '^https?://[^/]*', 0), '/about/news/', page_id)
 WHEN 4 THEN concat(regexp_extract(url, '^https?://[^/]*', 0), '/a-b-c-d-e-f-', page_id)
 WHEN 5 THEN concat(regexp_extract(url, '^https?://[^/]*', 0), '/a_b_c_d_e_f_', page_id, '/')
 WHEN 6 THEN concat(regexp_extract(url, '^https?://[^/]*', 0), '/files/report.', CASE WHEN page_id % 24 = 6 THEN 'pdf' ELSE 'HTML' END)
 WHEN 7 THEN concat('http://www.twitter.com/x/news/', page_id)
 WHEN 8 THEN concat('mailto:someone', page_id, '@example.com')
 WHEN 9 THEN concat(regexp_extract(url, '^https?://[^/]*', 0), '/gallery/index.html')
 WHEN 10 THEN concat('https://news.bbc.co.uk:8080/2014/apr/', page_id % 28 + 1, '/media/x', page_id)
 ELSE concat(regexp_extract(url, '^https?://[^/]*', 0), '/', page_id, '/slides/v') END"""


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr(SHAPES).alias("u"))


_FROM = f"(SELECT page_id, {SHAPES} AS u FROM pages)"
_P = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_TYPES = ", ".join(f"'{t}'" for t in U.PAGE_TYPES)
_STEPS = f"""
p AS (SELECT page_id, u, lower(regexp_extract(u, '{_P}', 1)) AS scheme, regexp_extract(u, '{_P}', 2) AS domain, regexp_extract(u, '{_P}', 3) AS path, regexp_extract(u, '{_P}', 4) AS query, regexp_extract(u, '{_P}', 5) AS fragment FROM {_FROM}),
l AS (SELECT *, string_split(lower(regexp_replace(regexp_replace(domain, '^.*@', ''), ':[0-9]*$', '')), '.') AS labels, list_filter(string_split(path, '/'), lambda c: c <> '') AS chunks FROM p),
s AS (SELECT *, CASE WHEN array_to_string(labels[-2:], '.') IN ({", ".join(f"'{x}'" for x in U.SUFFIXES)}) THEN 2 ELSE 1 END AS sz, CASE WHEN len(chunks) > 0 AND contains(chunks[-1], '.') THEN regexp_extract(chunks[-1], '\\.([^.]*)$', 1) END AS ending FROM l),
f AS (SELECT *, coalesce(CASE WHEN len(labels) - sz >= 1 THEN labels[len(labels) - sz] END, CASE WHEN len(labels) = 1 THEN labels[1] END, '') AS site, CASE WHEN len(labels) - sz > 1 THEN array_to_string(labels[1:len(labels) - sz - 1], '.') ELSE '' END AS subdomain, CASE WHEN ending <> '' AND (length(ending) <= 5 OR lower(ending) IN ({_TYPES})) THEN lower(ending) END AS filetype FROM s)"""


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    return _urls(spark, sf_dir).select("page_id", U.scheme(u).alias("scheme"), U.domain(u).alias("domain"), U.path(u).alias("path"), U.query(u).alias("query"), U.fragment(u).alias("fragment"), U.filetype(u).alias("filetype"))


URL_PARTS = f"WITH {_STEPS} SELECT page_id, scheme, domain, path, query, fragment, filetype FROM f"


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    return _urls(spark, sf_dir).select("page_id", U.site(u).alias("site"), U.subdomain(u).alias("subdomain"), U.registered(u).alias("registered"), U.is_media(u).alias("is_media"), U.is_absolute(u).alias("is_absolute"))


URL_HOSTS = f"""WITH {_STEPS} SELECT page_id, site, subdomain, array_to_string(labels[greatest(len(labels) - least(sz + 1, len(labels)) + 1, 1):], '.') AS registered,
 regexp_matches(u, '/(cloth|fashion|gallery|glamour|powerpoint|slide|video)') AS is_media,
 regexp_matches(u, '(?i)^(?:http|ftp)s?://(?:(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+[a-z0-9-]+\\.?|localhost)(?::[0-9]+)?(?:/?|[/?]\\S+)$') AS is_absolute FROM f"""


def url_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", "u", U.valid_article_url(F.col("u")).alias("valid"))


_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
URL_VALID = f"""WITH {_STEPS},
n AS (SELECT *, CASE WHEN len(chunks) > 0 THEN list_append(chunks[1:len(chunks) - 1], CASE WHEN contains(chunks[-1], '.') THEN string_split(chunks[-1], '.')[-2] ELSE chunks[-1] END) ELSE chunks END AS named FROM f),
i AS (SELECT *, CASE WHEN list_position(named, 'index') > 0 THEN list_concat(named[1:list_position(named, 'index') - 1], named[list_position(named, 'index') + 1:]) ELSE named END AS pieces FROM n),
d AS (SELECT *, pieces[-1] AS slug, len(string_split(pieces[-1], '-')) - 1 AS dashes, len(string_split(pieces[-1], '_')) - 1 AS bars FROM i)
SELECT page_id, u, CASE WHEN u IS NULL OR length(u) < 11 THEN false WHEN contains(u, 'mailto:') OR NOT (contains(u, 'http://') OR contains(u, 'https://')) THEN false
 WHEN NOT starts_with(path, '/') THEN false WHEN filetype IS NOT NULL AND filetype NOT IN ({_TYPES}) THEN false WHEN site IN ('amazon', 'doubleclick', 'twitter') THEN false
 WHEN (dashes > 4 OR bars > 4) AND dashes >= bars AND NOT list_contains(string_split(lower(slug), '-'), site) THEN true
 WHEN (dashes > 4 OR bars > 4) AND bars > dashes AND NOT list_contains(string_split(lower(slug), '_'), site) THEN true
 WHEN len(pieces) <= 1 THEN false WHEN list_has_any(pieces, {_list(U.SERVICE_PATHS)}) OR list_contains({_list(U.SERVICE_PATHS)}, subdomain) THEN false
 WHEN regexp_matches(u, '([./_-]?(?:19|20)[0-9]{{2}})[./_-]?(?:[0-3]?[0-9][./_-]|[0-9A-Za-z_]{{3,5}}[./_-])') THEN true
 WHEN len(list_filter(pieces, lambda c: list_contains({_list(U.NEWS_PATHS)}, lower(c)))) > 0 THEN true ELSE false END AS valid FROM d"""


def url_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", U.date_part(F.col("u")).alias("date_part"), U.url_date(F.col("u")).cast("string").alias("published"))


_D = r"[./_-]?(?:19|20)[0-9]{2}[./_-]?(?:[0-3]?[0-9][./_-]|[0-9A-Za-z_]{3,5}[./_-])(?:[0-3]?[0-9][./-]?)?"
_YMD = r"^[./_-]?((?:19|20)[0-9]{2})[./_-]?([0-9]{1,2}|[A-Za-z]{3,5})[./_-]([0-9]{1,2})"
URL_DATES = f"""WITH a AS (SELECT page_id, regexp_extract(u, '[^0-9A-Za-z_]({_D})', 1) AS date_part FROM {_FROM}),
b AS (SELECT *, regexp_extract(date_part, '{_YMD}', 1) AS y, regexp_extract(date_part, '{_YMD}', 2) AS m, regexp_extract(date_part, '{_YMD}', 3) AS d FROM a)
SELECT page_id, date_part, try_cast(CASE WHEN y <> '' THEN concat(y, '-', lpad(CASE WHEN regexp_matches(m, '^[0-9]') THEN m ELSE list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(left(m, 3)))::VARCHAR END, 2, '0'), '-', lpad(d, 2, '0')) END AS DATE)::VARCHAR AS published FROM b"""


def url_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    return _urls(spark, sf_dir).select("page_id", U.remove_args(u).alias("bare"), U.remove_args(u, ("id",), True).alias("kept"), U.escaped_fragment(F.concat(u, F.lit("#!x"))).alias("escaped"))


URL_ARGUMENTS = f"""WITH {_STEPS}, q AS (SELECT *, regexp_replace(u, '[?#].*$', '') AS bare, array_to_string(list_filter(string_split(query, '&'), lambda i: starts_with(i, 'id')), '&') AS k FROM f)
SELECT page_id, bare, concat(bare, CASE WHEN k <> '' THEN concat('?', k) ELSE '' END, CASE WHEN fragment <> '' THEN concat('#', fragment) ELSE '' END) AS kept, concat(u, '?_escaped_fragment_=x') AS escaped FROM q"""


def url_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative, absolute and redirecting links resolved against their page."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "^https?://[^/]*", 0).alias("base"))
    href = F.expr("CASE page_id % 4 WHEN 0 THEN concat('/a/', page_id) WHEN 1 THEN concat('b', page_id) WHEN 2 THEN 'http://other.example.test/x?y=1' ELSE concat('http://jump.test/go?url=http%3A%2F%2Fto.test%2F', page_id) END")
    return rows.select("page_id", U.prepare_url(href, F.concat("base", F.lit("/dir/page"))).alias("prepared"))


URL_PREPARED = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat(regexp_extract(url, '^https?://[^/]*', 0), '/a/', page_id) WHEN 1 THEN concat(regexp_extract(url, '^https?://[^/]*', 0), '/dir/b', page_id)
 WHEN 2 THEN 'http://other.example.test/x?y=1' ELSE concat('http://to.test/', page_id) END AS prepared FROM pages"""

QUERIES = {"url_parts": url_parts, "url_hosts": url_hosts, "url_valid": url_valid, "url_dates": url_dates, "url_arguments": url_arguments, "url_prepared": url_prepared}
ORACLES = {"url_parts": URL_PARTS, "url_hosts": URL_HOSTS, "url_valid": URL_VALID, "url_dates": URL_DATES, "url_arguments": URL_ARGUMENTS, "url_prepared": URL_PREPARED}
