"""URL expressions.  All are Columns, so that they are pushed below joins and Python."""

from __future__ import annotations

from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
PAGE_TYPES = tuple(sorted("asp aspx cgi htm html jhtml jsp md rhtml rst shtml xhtml".split()))
NEWS_PATHS = tuple(sorted("article feature featured gallery media news press radio slides slideshow story v video".split()))
SERVICE_PATHS = tuple(sorted("about account admin advert browse careers contact donate faq feedback howto info preferences privacy shop subscribe terms".split()))
SERVICE_DOMAINS = ("amazon", "doubleclick", "twitter")
#: Suffixes of two labels under which names are registered; all others have one.
SUFFIXES = tuple("ac.uk co.in co.jp co.ke co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.hk com.mx com.my com.ng com.ph com.pk com.sg com.tr com.tw com.ua com.vn edu.au gov.au gov.uk net.au ne.jp net.br or.jp org.au org.br org.nz org.uk".split())
#: A year, then a month by number or name, then perhaps a day, with separators; what it matches is the date part of a news URL.
DATE = r"([./\-_]?(?:19|20)\d{2})[./\-_]?(?:[0-3]?[0-9][./\-_]|\w{3,5}[./\-_])(?:[0-3]?[0-9][./\-]?)?"


def let(value: Column, fn) -> Column:
    """fn(value), with value computed once however often fn uses it."""
    return F.get(F.transform(F.array(value), lambda x: fn(x)), F.lit(0))


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def scheme(url: Column) -> Column:
    """'' where there is none; null for null."""
    return F.lower(_part(url, 1))


def domain(url: Column) -> Column:
    """The authority, with port and user."""
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def _labels(url: Column) -> Column:
    return F.split(F.lower(F.regexp_replace(F.regexp_replace(domain(url), r"^.*@", ""), r":\d*$", "")), r"\.")


def _suffix_size(labels: Column) -> Column:
    return F.when(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").isin(*SUFFIXES), 2).otherwise(1)


def site(url: Column) -> Column:
    """The registered name's label, without its suffix: 'example' of www.example.co.uk."""
    return let(_labels(url), _site)


def _site(labels: Column) -> Column:
    return F.coalesce(F.get(labels, F.size(labels) - _suffix_size(labels) - 1), F.when(F.size(labels) == 1, F.get(labels, F.lit(0))), F.lit(""))


def subdomain(url: Column) -> Column:
    """What stands before the registered name."""
    return let(_labels(url), _subdomain)


def _subdomain(labels: Column) -> Column:
    n = F.size(labels) - _suffix_size(labels) - 1
    return F.when(n > 0, F.array_join(F.slice(labels, 1, F.greatest(n, F.lit(0))), ".")).otherwise("")


def registered(url: Column) -> Column:
    """The registered name with its suffix."""
    return let(_labels(url), _registered)


def _registered(labels: Column) -> Column:
    n = F.least(_suffix_size(labels) + 1, F.size(labels))
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def chunks(url: Column) -> Column:
    """The path's non-empty pieces."""
    return F.filter(F.split(path(url), "/"), lambda c: c != "")


def filetype(url: Column) -> Column:
    """What follows the last dot of the last piece, in lower case, if it has up to 5 characters or is a page type; null otherwise."""
    return let(F.element_at(F.concat(F.array(F.lit("")), chunks(url)), -1), _filetype)


def _filetype(last: Column) -> Column:
    end = F.regexp_extract(last, r"\.([^.]*)$", 1)
    return F.when(last.contains(".") & (end != "") & ((F.length(end) <= 5) | F.lower(end).isin(*PAGE_TYPES)), F.lower(end))


def is_absolute(url: Column) -> Column:
    """Whether it is a whole http, https or ftps URL with a plausible host."""
    host = r"(?:(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:[a-z]{2,6}\.?|[a-z0-9-]{2,}\.?)|localhost|\d{1,3}(?:\.\d{1,3}){3}|\[?[a-f0-9]*:[a-f0-9:]+\]?)"
    return url.rlike(rf"(?i)\A(?:http|ftp)s?://{host}(?::\d+)?(?:/?|[/?]\S+)\z")


def date_part(url: Column) -> Column:
    """The part of a URL that looks like a date, after a character that is no word character; '' without one."""
    return F.regexp_extract(url, rf"(?<=\W){DATE}", 0)


def url_date(url: Column) -> Column:
    """The date in a URL, if it has year, month (number or English name) and day; null otherwise."""
    p = date_part(url)
    piece = lambda k: F.regexp_extract(p, r"^[./\-_]?((?:19|20)\d{2})[./\-_]?(\d{1,2}|[A-Za-z]{3,5})[./\-_](\d{1,2})", k)
    names = F.array(*(F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()))
    month = F.when(piece(2).rlike(r"^\d"), F.lpad(piece(2), 2, "0")).otherwise(F.lpad(F.array_position(names, F.lower(F.substring(piece(2), 1, 3))).cast("string"), 2, "0"))
    return F.try_to_timestamp(F.when(piece(1) != "", F.concat_ws("-", piece(1), month, F.lpad(piece(3), 2, "0"))), F.lit("yyyy-MM-dd")).cast("date")


def is_media(url: Column) -> Column:
    """Whether the URL leads to galleries, videos or fashion rather than text."""
    return url.rlike("/(?:cloth|fashion|gallery|glamour|powerpoint|slide|video)")


def valid_article_url(url: Column) -> Column:
    """Whether a URL looks like a news article's; the first rule that applies decides.

    Not if null, shorter than 11 or no http(s) URL; not for file types other than pages'; not for service domains.
    Yes for a last piece of more than four dashes or underscores that isn't the site's name; not for fewer than two
    pieces or a service path; yes for a date or a news path; otherwise not.
    """
    place = F.struct(path(url).alias("path"), _labels(url).alias("labels"))
    return let(place, lambda p: let(_named(p["path"]), lambda pieces: let(F.get(pieces, F.size(pieces) - 1), lambda slug: let(_site(p["labels"]), lambda label: _valid(url, p, pieces, slug, label)))))


def _named(path_: Column) -> Column:
    """The path's pieces, the last one without its type, and without the first that is 'index'."""

    def named(first):
        last = F.get(first, F.size(first) - 1)
        dotted = F.split(last, r"\.")
        return F.when(F.size(first) > 0, F.concat(F.slice(first, 1, F.greatest(F.size(first) - 1, F.lit(0))), F.array(F.when(last.contains("."), F.get(dotted, F.size(dotted) - 2)).otherwise(last)))).otherwise(first)

    def without(pieces):
        at = F.array_position(pieces, "index").cast("int")
        return F.when(at > 0, F.concat(F.slice(pieces, 1, F.greatest(at - 1, F.lit(0))), F.slice(pieces, at + 1, F.size(pieces)))).otherwise(pieces)

    return let(let(F.filter(F.split(F.regexp_replace(path_, "/$", ""), "/"), lambda c: c != ""), named), without)


def _valid(url: Column, place: Column, pieces: Column, slug: Column, label: Column) -> Column:
    kind = let(F.element_at(F.concat(F.array(F.lit("")), F.filter(F.split(place["path"], "/"), lambda c: c != "")), -1), _filetype)
    dashes = F.length(slug) - F.length(F.translate(slug, "-", ""))
    bars = F.length(slug) - F.length(F.translate(slug, "_", ""))
    absent = lambda sep: ~F.exists(F.split(F.lower(slug), sep), lambda x: x == label)
    long = F.coalesce((dashes > 4) | (bars > 4), F.lit(False))
    inside = lambda words: F.exists(pieces, lambda c: c.isin(*words))
    return (
        F.when(url.isNull() | (F.length(url) < 11), False)
        .when(url.contains("mailto:") | ~(url.contains("http://") | url.contains("https://")), False)
        .when(~place["path"].startswith("/"), False)
        .when(F.coalesce(~kind.isin(*PAGE_TYPES), F.lit(False)), False)
        .when(label.isin(*SERVICE_DOMAINS), False)
        .when(long & (dashes >= bars) & absent("-"), True)
        .when(long & (bars > dashes) & absent("_"), True)
        .when(F.size(pieces) <= 1, False)
        .when(inside(SERVICE_PATHS) | _subdomain(place["labels"]).isin(*SERVICE_PATHS), False)
        .when(url.rlike(DATE), True)
        .when(F.exists(pieces, lambda c: F.lower(c).isin(*NEWS_PATHS)), True)
        .otherwise(False)
    )


def remove_args(url: Column, keep: tuple[str, ...] = (), fragments: bool = False) -> Column:
    """The URL with only those query items that start with one of keep (none by default), and without its fragment unless asked for."""
    items = F.filter(F.split(query(url), "&"), lambda i: F.lit(False) if not keep else F.exists(F.array(*map(F.lit, keep)), lambda k: i.startswith(k)))
    q = F.array_join(items, "&")
    base = F.regexp_replace(url, r"[?#].*$", "")
    out = F.concat(base, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.concat(out, F.when(fragment(url) != "", F.concat(F.lit("#"), fragment(url))).otherwise("")) if fragments else out


def escaped_fragment(url: Column) -> Column:
    """#! as ?_escaped_fragment_=."""
    return F.replace(url, F.lit("#!"), F.lit("?_escaped_fragment_="))


def _redirected(url: str, source: str) -> str:
    a, b = urlsplit(url).netloc, urlsplit(source).netloc
    if a in b or b in a:
        return url
    return parse_qs(urlsplit(url).query).get("url", [url])[0]


@F.pandas_udf(T.StringType())
def prepare_url(url: pd.Series, source: pd.Series) -> pd.Series:
    """A URL resolved against its source (RFC 3986), and taken out of a foreign redirect's url= parameter; '' if it can't be read, as it is without a source, null for null."""

    def one(u, s):
        if u is None or not s:
            return u
        try:
            return _redirected(urljoin(s, u), s)
        except ValueError:
            return ""

    return pd.Series([one(u, s) for u, s in zip(url, source, strict=True)], dtype=object)
