"""Page metadata as expressions over the column nodes (see dom.parse_dom).

Every extractor is a Column, so that a query computes only those it selects.
Attributes match where they contain the value, case aside.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.functions import urls
from pressmill.functions.text import inner_trim
from pressmill.operators.dom import AUTHOR_ATTRS, AUTHOR_VALUES

NODES = F.col
#: Where publication dates stand: attribute, value, attribute with the date.
DATE_TAGS = (
    ("property", "rnews:datePublished", "content"), ("property", "article:published_time", "content"), ("name", "OriginalPublicationDate", "content"), ("itemprop", "datePublished", "datetime"), ("property", "og:published_time", "content"),
    ("name", "article_date_original", "content"), ("name", "publication_date", "content"), ("name", "sailthru.date", "content"), ("name", "PublishDate", "content"), ("pubdate", "pubdate", "datetime"), ("name", "publish_date", "content"),
)


def attr(n: Column, name: str) -> Column:
    return F.try_element_at(n["attrs"], F.lit(name))


def contains(n: Column, name: str, value: str) -> Column:
    return F.coalesce(F.lower(attr(n, name)).contains(value.lower()), F.lit(False))


def select(nodes: Column, where) -> Column:
    """The nodes for which where(node) holds, in document order."""
    return F.filter(nodes, where)


def having(nodes: Column, name: str, value: str) -> Column:
    """The nodes of which the attribute contains the value."""
    return F.filter(nodes, lambda n: contains(n, name, value))


def matching(nodes: Column, name: str, pattern: str) -> Column:
    """The nodes of which the attribute matches a regular expression somewhere."""
    return F.filter(nodes, lambda n: F.coalesce(attr(n, name).rlike(pattern), F.lit(False)))


def by_id(nodes: Column, value: str) -> Column:
    """The first node with this id; null without one."""
    return first(F.filter(nodes, lambda n: attr(n, "id") == value))


def siblings(nodes: Column, n: Column, before: bool = False) -> Column:
    """The elements after a node (or before it) with its parent, in document order."""
    return F.filter(nodes, lambda m: (m["parent_id"] == n["parent_id"]) & ((m["node_id"] < n["node_id"]) if before else (m["node_id"] > n["node_id"])))


def css(nodes: Column, selector: str) -> Column:
    """The nodes that a selector chooses, in document order: tags, #ids, .classes, [attr], [attr=value] (also ^=, $=, *= and ~=), descendants (a blank), children (>) and alternatives (,)."""
    found = [_css_path(nodes, s.strip()) for s in selector.split(",")]
    if len(found) == 1:
        return found[0]
    return urls.let(F.concat(*(F.transform(f, lambda n: n["node_id"]) for f in found)), lambda ids: F.filter(nodes, lambda n: F.array_contains(ids, n["node_id"])))


_SIMPLE = re.compile(r"""([A-Za-z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*["']?([^"'\]]*)["']?)?\s*\]""")


def _simple(part: str):
    """A condition on a node, for one compound such as a.b[c=d]."""
    at, tests = 0, []
    while at < len(part):
        m = _SIMPLE.match(part, at)
        if not m:
            raise ValueError(f"no selector that is known here: {part!r}")
        at = m.end()
        tag, ident, cls, name, op, value = m.groups()
        has = lambda n, k: F.concat(F.lit(" "), F.regexp_replace(F.coalesce(attr(n, k), F.lit("")), r"\s+", " "), F.lit(" "))
        if tag and tag != "*":
            tests.append(lambda n, t=tag.lower(): n["tag"] == t)
        elif ident:
            tests.append(lambda n, i=ident: attr(n, "id") == i)
        elif cls:
            tests.append(lambda n, c=cls: has(n, "class").contains(f" {c} "))
        elif name:
            tests.append({
                None: lambda n, k=name: attr(n, k).isNotNull(), "=": lambda n, k=name, v=value: attr(n, k) == v, "^=": lambda n, k=name, v=value: attr(n, k).startswith(v), "$=": lambda n, k=name, v=value: attr(n, k).endswith(v),
                "*=": lambda n, k=name, v=value: attr(n, k).contains(v), "~=": lambda n, k=name, v=value: has(n, k).contains(f" {v} "),
            }[op])

    def holds(n: Column) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & F.coalesce(t(n), F.lit(False))
        return out

    return holds


def _css_path(nodes: Column, selector: str) -> Column:
    steps = re.findall(r"(>?)\s*([^\s>]+)", selector)
    found = None
    for child, part in steps:
        holds = _simple(part)
        found = F.filter(nodes, holds) if found is None else _below(nodes, found, holds, bool(child))
    return found


def _below(nodes: Column, up: Column, holds, child: bool) -> Column:
    """The nodes for which holds, that are children (or descendants) of some of up."""
    inside = (lambda n, p: n["parent_id"] == p["node_id"]) if child else (lambda n, p: (n["node_id"] > p["node_id"]) & (n["node_id"] <= p["end_id"]))
    return urls.let(up, lambda u: F.filter(nodes, lambda n: holds(n) & F.exists(u, lambda p: inside(n, p))))


def by_tag(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def descendants(nodes: Column, n: Column) -> Column:
    """A node's descendants: node_id in (n.node_id, n.end_id]."""
    return F.slice(nodes, n["node_id"] + 2, n["end_id"] - n["node_id"])


def meta_content(nodes: Column, name: str, value: str) -> Column:
    """The first meta tag's content of which the attribute equals the value, trimmed; '' without one."""
    found = first(F.filter(nodes, lambda n: (n["tag"] == "meta") & (attr(n, name) == value)))
    return F.coalesce(F.trim(attr(found, "content")), F.lit(""))


def meta_type(nodes: Column) -> Column:
    return meta_content(nodes, "property", "og:type")


def meta_site_name(nodes: Column) -> Column:
    return meta_content(nodes, "property", "og:site_name")


def meta_description(nodes: Column) -> Column:
    return meta_content(nodes, "name", "description")


def meta_keywords(nodes: Column) -> Column:
    """The keywords between commas, trimmed; one empty keyword without the tag."""
    return F.transform(F.split(meta_content(nodes, "name", "keywords"), ","), lambda s: F.trim(s))


def meta_favicon(nodes: Column) -> Column:
    """The first icon link's address as written: '' without a link, null without an address."""
    links = F.filter(nodes, lambda n: (n["tag"] == "link") & contains(n, "rel", "icon"))
    return F.when(F.size(links) > 0, attr(first(links), "href")).otherwise("")


def meta_lang(nodes: Column) -> Column:
    """Two letters from the root's lang, else from a meta tag (content-language, then a name with lang); null if they aren't letters.  An empty lang attribute keeps the meta tags from being asked."""
    tag = lambda a, v: attr(first(F.filter(nodes, lambda n: (n["tag"] == "meta") & contains(n, a, v))), "content")
    value = F.coalesce(attr(first(nodes), "lang"), tag("http-equiv", "content-language"), tag("name", "lang"))
    two = F.substring(value, 1, 2)
    return F.when(two.rlike(r"\A[A-Za-z]{2}\z"), F.lower(two))


def canonical_link(nodes: Column, url: Column) -> Column:
    """The canonical link, else og:url, else ''.  Without a host it is put behind the page's host, after what it repeats of it."""
    link = attr(first(F.filter(nodes, lambda n: (n["tag"] == "link") & contains(n, "rel", "canonical"))), "href")
    found = F.trim(F.coalesce(F.nullif(link, F.lit("")), meta_content(nodes, "property", "og:url")))
    host = F.regexp_replace(urls.domain(url), r"(^.*@)|(:\d*$)", "")
    own = urls.path(found)
    at = F.locate("/", own, 1)
    again = F.instr(own, F.concat(host, F.lit("/")))
    rest = F.when((again > 0) & (host != ""), F.substring(own, again + F.length(host) + 1, F.length(own))).otherwise(F.when(at == 1, F.substring(own, F.lit(2), F.length(own))).otherwise(own))
    return F.when((found == "") | (urls.domain(found) != ""), found).otherwise(F.concat(urls.scheme(url), F.lit("://"), host, F.lit("/"), rest))


def image_urls(nodes: Column) -> Column:
    """The images' addresses as written, each once."""
    return F.array_distinct(F.filter(F.transform(by_tag(nodes, "img"), lambda n: attr(n, "src")), lambda s: s.isNotNull() & (s != "")))


def meta_image(nodes: Column) -> Column:
    """og:image, else an image_src link, else a meta name of og:image, else an icon link; '' without any, as written."""
    link = lambda p: attr(first(F.filter(nodes, lambda n: (n["tag"] == "link") & F.coalesce(attr(n, "rel").rlike(p), F.lit(False)))), "href")
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(meta_content(nodes, "property", "og:image")), some(link("(?i)img_src|image_src")), some(meta_content(nodes, "name", "og:image")), some(link("(?i)icon")), F.lit(""))


def tags(nodes: Column) -> Column:
    """Texts of links with rel=tag, else of links into tag, topic or keyword pages; each once."""
    texts = lambda where: F.array_distinct(F.filter(F.transform(F.filter(nodes, lambda n: (n["tag"] == "a") & where(n)), lambda n: n["inner_text"]), lambda t: t != ""))
    direct = texts(lambda n: F.coalesce(attr(n, "rel") == "tag", F.lit(False)))
    return F.when(F.size(direct) > 0, direct).otherwise(texts(lambda n: F.coalesce(attr(n, "href").rlike(r"/tag/|/tags/|/topic/|\?keyword="), F.lit(False))))


def anchors(nodes: Column) -> Column:
    """array of struct(href, text) of links with an address; the text is that before the link's first element."""
    return F.transform(F.filter(nodes, lambda n: (n["tag"] == "a") & (F.coalesce(attr(n, "href"), F.lit("")) != "")), lambda n: F.struct(attr(n, "href").alias("href"), n["text"].alias("text")))


def feed_links(nodes: Column, limit: int = 50) -> Column:
    """Addresses of the first RSS links."""
    return F.slice(F.transform(F.filter(nodes, lambda n: contains(n, "type", "application/rss+xml") & attr(n, "href").isNotNull()), lambda n: attr(n, "href")), 1, limit)


def text_urls(text: Column) -> Column:
    """http(s) addresses in a text whose tags are taken out."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, "<[^<]+?>", " "), F.lit(r"(https?://[!$-_a-z]+)"), 1), lambda s: F.trim(s))


# title


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^一-龥a-zA-Z0-9 ]", ""))


def split_title(text: Column, separator: str, hint: Column) -> Column:
    """The first piece that holds the hint (letters and digits alone), else the longest."""
    bare = lambda t: F.lower(F.regexp_replace(t, "[^a-zA-Z0-9 ]", ""))
    pieces = F.transform(F.split(text, separator), lambda s: F.trim(s))
    key = bare(hint)
    held = F.filter(pieces, lambda p: (key != "") & bare(p).contains(key))
    most = F.array_max(F.transform(pieces, lambda s: F.length(s)))
    best = F.when(F.size(held) > 0, first(held)).otherwise(first(F.filter(pieces, lambda p: F.length(p) == most)))
    return F.trim(F.replace(best, F.lit("&raquo;"), F.lit("»")))


def title(nodes: Column) -> Column:
    """The page's title, from its title, longest h1 (of more than two words) and og:title; '' without a title tag."""
    titles = F.transform(by_tag(nodes, "title"), lambda n: n["inner_text"])
    heads = F.transform(by_tag(nodes, "h1"), lambda n: n["inner_text"])
    found = F.struct(titles.alias("titles"), heads.alias("heads"), meta_content(nodes, "property", "og:title").alias("property"), meta_content(nodes, "name", "og:title").alias("name"))
    # Each step is bound once: written out, it would be computed wherever the rules below look at it.
    return urls.let(found, lambda x: urls.let(F.struct(F.coalesce(first(x["titles"]), F.lit("")).alias("text"), _head(x["heads"]).alias("h1"), F.when(x["property"] != "", x["property"]).otherwise(x["name"]).alias("fb"), F.size(x["titles"]).alias("n")), _choose))


def _head(heads: Column) -> Column:
    most = F.array_max(F.transform(heads, lambda s: F.length(s)))
    longest = urls.let(most, lambda m: F.coalesce(first(F.filter(heads, lambda h: F.length(h) == m)), F.lit("")))
    return urls.let(longest, lambda t: F.when(F.size(F.split(t, " ")) <= 2, "").otherwise(inner_trim(t)))


def _choose(x: Column) -> Column:
    text, h1, fb = x["text"], x["h1"], x["fb"]
    separated = (
        F.when(text.contains("|"), split_title(text, r"\|", h1))
        .when(text.contains("-"), split_title(text, " - ", h1))
        .when(text.contains("_"), split_title(text, "_", h1))
        .when(text.contains("/"), split_title(text, "/", h1))
        .when(text.contains(" » "), split_title(text, " » ", h1))
        .otherwise(text)
    )

    def rules(p: Column) -> Column:
        p_title, p_h1, p_fb = p["title"], p["h1"], p["fb"]
        chosen = (
            F.when(h1 == text, text)
            .when((p_h1 != "") & (p_h1 == p_fb), h1)
            .when((p_h1 != "") & p_title.contains(p_h1) & (p_fb != "") & p_title.contains(p_fb) & (F.length(h1) > F.length(fb)), h1)
            .when((p_fb != "") & (p_fb != p_title) & p_title.startswith(p_fb), fb)
            .otherwise(separated)
        )
        return urls.let(F.replace(chosen, F.lit("&#65533;"), F.lit("")), lambda c: F.when(p_h1 == _plain(c), h1).otherwise(c))

    return F.when(x["n"] == 0, "").otherwise(urls.let(F.struct(_plain(text).alias("title"), _plain(h1).alias("h1"), _plain(fb).alias("fb")), rules))


# authors


def author_lines(nodes: Column) -> Column:
    """Texts that may name authors: by attribute, then value, then place in the page."""
    some = F.filter(nodes, lambda n: F.lower(F.concat_ws(" ", *(attr(n, a) for a in AUTHOR_ATTRS))).rlike("|".join(map(re.escape, AUTHOR_VALUES))))

    def lines(few: Column) -> Column:
        each = [F.transform(having(few, a, v), lambda n: F.when(n["tag"] == "meta", attr(n, "content")).otherwise(n["inner_text"])) for a in AUTHOR_ATTRS for v in AUTHOR_VALUES]
        return F.filter(F.concat(*each), lambda s: s.isNotNull() & (s != ""))

    return urls.let(some, lines)


def byline(line: str) -> list[str]:
    """The names in a line such as 'By Ann Lee and Bo Yi, staff'."""
    line = re.sub(r"[bB][yY][:\s]|[fF]rom[:\s]", "", re.sub("<[^<]+?>", "", line)).strip()
    names, now = [], []
    for token in re.split(r"[^\w'\-.]", line):
        if token in ("and", ",", ""):
            if now:
                names.append(" ".join(now))
            now = []
        elif not any(c.isdigit() for c in token):
            now.append(token)
    return names + ([" ".join(now)] if len(now) >= 2 else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _names(lines: pd.Series) -> pd.Series:
    def one(found):
        seen: dict[str, str] = {}
        for line in () if found is None else found:
            for name in byline(line):
                if name:
                    seen.setdefault(name.lower(), name.title())
        return list(seen.values())

    return lines.map(one)


def authors(nodes: Column, most: int = 10) -> Column:
    """Up to so many names, each once, in title case."""
    return F.slice(_names(author_lines(nodes)), 1, most)


# date


@F.pandas_udf(T.TimestampType())
def _parsed(texts: pd.Series) -> pd.Series:
    from datetime import timezone

    from dateutil import parser

    def one(found):
        for s in () if found is None else found:
            try:
                d = parser.parse(s)
            except (ValueError, OverflowError, TypeError):
                continue
            return d.astimezone(timezone.utc).replace(tzinfo=None) if d.tzinfo else d
        return None

    return pd.Series([one(x) for x in texts], dtype="datetime64[ns]")


def date_texts(nodes: Column) -> Column:
    """The texts of publication date tags, one a rule, in the rules' order."""
    each = [attr(first(having(nodes, a, v)), c) for a, v, c in DATE_TAGS]
    return F.filter(F.array(*each), lambda s: s.isNotNull() & (s != ""))


def publish_date(nodes: Column, url: Column) -> Column:
    """The date in the URL if it is whole, else the first tag's that can be read (UTC); null otherwise."""
    return F.coalesce(urls.url_date(url).cast("timestamp"), _parsed(date_texts(nodes)))


# meta data


def meta_entries(nodes: Column) -> Column:
    """array of struct(key, value) of all meta tags with both, in document order."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    each = F.transform(by_tag(nodes, "meta"), lambda n: F.struct(F.coalesce(F.nullif(attr(n, "property"), F.lit("")), attr(n, "name")).alias("key"), some(F.coalesce(F.nullif(attr(n, "content"), F.lit("")), attr(n, "value"))).alias("value")))
    return F.filter(each, lambda e: e["key"].isNotNull() & (e["key"] != "") & e["value"].isNotNull())


def meta_map(nodes: Column) -> Column:
    """The last value of each key, flat."""
    e = meta_entries(nodes)
    last = F.filter(F.transform(e, lambda x, i: F.struct(x["key"].alias("key"), x["value"].alias("value"), F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"]).alias("again"))), lambda x: ~x["again"])
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["value"])))


def nest(entries: list[tuple[str, str]]) -> dict:
    """Keys a:b:c as nested dictionaries; digits as numbers.  A value in the way moves into the dictionary, under its own key at the top and under 'identifier' below."""
    out: dict = {}
    for key, text in entries:
        value: str | int = int(text) if text.isdigit() and text.isascii() else text
        head, *rest = key.split(":")
        if not rest:
            out[key] = value
            continue
        at = out.setdefault(head, {})
        if not isinstance(at, dict):
            at = out[head] = {head: at}
        for i, k in enumerate(rest):
            if i == len(rest) - 1:
                at[k] = value
                break
            if not isinstance(at.get(k, {}), dict):
                at[k] = {"identifier": at[k]}
            at = at.setdefault(k, {})
    return out


@F.pandas_udf(T.StringType())
def _nested(entries: pd.Series) -> pd.Series:
    import json

    return entries.map(lambda e: None if e is None else json.dumps(nest([(x["key"], x["value"]) for x in e]), ensure_ascii=False, sort_keys=True))


def meta_data(nodes: Column) -> Column:
    """All meta tags nested by ':', as VARIANT."""
    return F.parse_json(_nested(meta_entries(nodes)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def absolute(urls_: pd.Series, base: pd.Series) -> pd.Series:
    """Addresses resolved against the page's; those that can't be are dropped."""
    from urllib.parse import urljoin

    def one(found, b):
        out = []
        for u in () if found is None else found:
            try:
                out.append(urljoin(b or "", u))
            except ValueError:
                continue
        return out

    return pd.Series([one(u, b) for u, b in zip(urls_, base, strict=True)], dtype=object)
