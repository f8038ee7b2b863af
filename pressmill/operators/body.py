"""The main text of a page: scoring, the best node, its neighbours, videos, and its form as text and HTML."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import escape, unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pressmill.functions.stopwords import NAMES, stopwords
from pressmill.operators.clean import clean
from pressmill.operators.dom import VOID, Node, in_slices, parse, trim

PROVIDERS = ("youtube", "vimeo", "dailymotion", "kewego")
#: What stays in article HTML.
KEPT_TAGS = frozenset("a b blockquote br code dd dl dt em h1 h2 h3 h4 h5 h6 i img li ol p pre span strong tt ul".split())
_PUNCTUATION = str.maketrans("", "", string.punctuation)
MIN_STOPWORDS, BOOST_STOPWORDS, BOOST_REACH, NEIGHBOUR_SHARE = 2, 5, 3, 0.3


@lru_cache(64)
def _stop(language: str) -> frozenset[str]:
    return stopwords("ar" if language == "fa" else language)


def count_stopwords(text: str, language: str = "en") -> int:
    """As functions.text.stopword_stats counts."""
    stop = _stop(language)
    if language == "ko":
        return sum(w.endswith(s) for w in text.translate(_PUNCTUATION).split(" ") for s in stop)
    if language == "hi":
        return len(stop) * len(text.translate(_PUNCTUATION).split(" "))
    if language in ("ar", "fa"):
        return sum(w in stop for w in re.findall(r"\w+|[^\w\s]+", text))
    plain = text.translate(_PUNCTUATION)
    if language == "zh":
        chars = [c for c in plain if not c.isspace()]
        return sum(c in stop for c in chars) + sum(a + b in stop for a, b in zip(chars, chars[1:], strict=False))
    if language in ("ja", "th"):
        return sum(w in stop for w in re.findall(r"[ぁ-ゟ]+|[゠-ヿ]+|[一-鿿]+|[ก-๛]+|[A-Za-z0-9]+", plain))
    return sum(w in stop for w in plain.lower().split(" "))


def is_link_dense(n: Node) -> bool:
    """Whether links make up so much of the text, or are so many, that it is no prose."""
    links = n.elements("a")
    if not links:
        return False
    words = [w for w in n.inner_text().split() if any(c.isalnum() for c in w)]
    if not words:
        return True
    linked = "".join(a.inner_text() for a in links).split()
    return len(linked) / len(words) * len(links) >= 1.0


def _boosts(n: Node, language: str) -> bool:
    up = n.parent
    if up is None:
        return False
    seen = 0
    for s in reversed(up.children[: up.children.index(n)]):
        if s.tag == "p":
            if seen >= BOOST_REACH:
                return False
            if count_stopwords(s.inner_text(), language) > BOOST_STOPWORDS:
                return True
            seen += 1
    return False


def best_node(root: Node, language: str = "en") -> tuple[Node | None, dict[int, float]]:
    """The node that holds the main text (None if nothing could), and the scores by id()."""
    texts = []
    for tag in ("p", "pre", "td"):
        for n in root.elements(tag):
            c = count_stopwords(n.inner_text(), language)
            if c > MIN_STOPWORDS and not is_link_dense(n):
                texts.append((n, c))
    score: dict[int, float] = {}
    order: list[Node] = []
    total, boosted = len(texts), 0
    for i, (n, c) in enumerate(texts):
        boost = 0.0
        if _boosts(n, language):
            boosted += 1
            boost = 50.0 / boosted
        if total > 15 and total - i <= total * 0.25:
            boost = -((total * 0.25 - (total - i)) ** 2)
            if abs(boost) > 40:
                boost = 5.0
        up = int(c + boost)
        parent = n.parent
        for node, gain in ((parent, up), (parent.parent if parent else None, up / 2)):
            if node is None:
                continue
            if id(node) not in score:
                order.append(node)
                score[id(node)] = 0
            score[id(node)] = int(score[id(node)] + gain)
    top, most = None, 0
    for n in order:
        if score[id(n)] > most:
            top, most = n, score[id(n)]
        if top is None:
            top = n
    return top, score


@dataclass
class Video:
    embed_type: str
    provider: str | None
    width: str | None
    height: str | None
    embed_code: str
    src: str | None


def _video(n: Node, src: str | None) -> Video:
    return Video(n.tag, next((p for p in PROVIDERS if src and p in src), None), n.attrs.get("width"), n.attrs.get("height"), n.outer_html(), src)


def videos(top: Node) -> list[Video]:
    """Embedded videos of known providers; an embed within an object counts once."""
    out, done = [], set()
    for n in top.elements("iframe", "embed", "object", "video"):
        if id(n) in done or n.tag == "video":
            continue
        if n.tag == "object" or n.parent is not None and n.parent.tag == "object":
            done.update(id(e) for e in n.elements("embed")[:1])
            params = n.having("name", "movie", "param")
            if not params:
                continue
            v = _video(n, params[0].attrs.get("value"))
        else:
            v = _video(n, n.attrs.get("src"))
        if v.provider:
            out.append(v)
    return out


def add_neighbours(top: Node, language: str = "en") -> None:
    """Paragraphs before the node that read like its own go in front."""
    own = [c for p in [n for n in top.walk() if n.tag == "p"] if (c := count_stopwords(p.inner_text(), language)) > MIN_STOPWORDS and not is_link_dense(p)]
    base = sum(own) / len(own) if own else 100_000
    if top.parent is None:
        return
    siblings = top.parent.children
    for s in list(reversed(siblings[: siblings.index(top)])):
        if s.tag == "#comment":
            continue
        if s.tag == "p" and s.inner_text():
            copy = parse(s.outer_html()).children[-1].children[0]
            copy.parent = None
            top.insert(0, copy) if s.tail else (setattr(s, "tail", ""), top.insert(0, s))
            continue
        for p in s.elements("p"):
            text = p.inner_text()
            if text and count_stopwords(text, language) > base * NEIGHBOUR_SHARE and not is_link_dense(p):
                top.insert(0, Node("p", text=text))


def tidy(top: Node, language: str = "en") -> None:
    """Neighbours in, clusters of links out."""
    add_neighbours(top, language)
    for c in list(top.children):
        if c.tag not in ("p", "#comment") and is_link_dense(c):
            c.remove()


def article_html(top: Node) -> str:
    """The node with none but the tags of text, without scripts and handlers."""

    def tags(n: Node) -> tuple[str, str] | None:
        if n.tag in ("script", "style"):
            return None
        text = escape(n.text, False)
        if n.tag not in KEPT_TAGS:
            return text, ""
        start = f"<{n.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items() if not k.startswith("on") and k != "style" and not v.strip().lower().startswith("javascript:")) + ">"
        return (start, "") if n.tag in VOID else (start + text, f"</{n.tag}>")

    inner = top.written(tags, lambda n: "")
    return inner if top.tag in KEPT_TAGS else f"<div>{inner}</div>"


def _filled(top: Node) -> set[int]:
    """The nodes, by id(), that have text or an embedded object within."""
    out: set[int] = set()
    for n in reversed(list(top.walk())):
        if n.tag in ("object", "embed") or n.tag != "#comment" and n.text.strip() or any(id(c) in out or c.tail.strip() for c in n.children):
            out.add(id(n))
    return out


def formatted(top: Node) -> str:
    """The node's paragraphs, with an empty line between; changes the node."""
    for n in top.elements("a"):
        n.unwrap()
    for n in top.elements("br"):
        n.text = "\\n"
    for ul in [n for n in top.walk() if n.tag == "ul"]:
        for li in ul.elements("li")[:-1]:
            li.text = li.inner_text() + "\\n"
            for c in list(li.children):
                c.remove()
    for n in top.elements("b", "strong", "i", "br", "sup"):
        n.unwrap()
    filled = _filled(top)
    for n in reversed(top.elements()):
        if id(n) not in filled:
            n.remove()
    kids = [c for c in top.children if c.tag != "#comment"]
    if len(kids) >= 3 and kids[-1].attrs.get("class") != "zn-body__read-all" and kids[-1].height() >= 2:
        kids[-1].remove()
    parts = []
    for c in top.children:
        text = c.inner_text() if c.tag != "#comment" else ""
        if text:
            parts += [x.strip(" ") for x in trim(unescape(text)).split("\\n")]
    return "\n\n".join(parts)


@dataclass
class Body:
    text: str | None = None
    article_html: str = ""
    top_tag: str | None = None
    top_score: float | None = None
    first_image: str | None = None
    movies: list[Video] = field(default_factory=list)


def body(html: str | None, language: str = "en", keep_html: bool = False) -> Body:
    """Everything about a page's main text; Body() where there is none.  language: that of the stop words."""
    root = parse(html)
    if root is None:
        return Body()
    if language not in NAMES:
        language = "en"
    clean(root)
    top, score = best_node(root, language)
    if top is None:
        return Body()
    out = Body(top_tag=top.tag, top_score=float(score[id(top)]), movies=videos(top))
    tidy(top, language)
    out.first_image = next((i.attrs["src"] for i in top.elements("img") if i.attrs.get("src")), None)
    out.article_html = article_html(top) if keep_html else ""
    out.text = formatted(top)
    return out


VIDEO = T.StructType([T.StructField(k, T.StringType()) for k in ("embed_type", "provider", "width", "height", "embed_code", "src")])
BODY = T.StructType([T.StructField("text", T.StringType()), T.StructField("article_html", T.StringType()), T.StructField("top_tag", T.StringType()), T.StructField("top_score", T.DoubleType()), T.StructField("first_image", T.StringType()), T.StructField("movies", T.ArrayType(VIDEO))])


def with_body(pages: DataFrame, html: str = "html", language: str | None = None, keep_html: bool = False) -> DataFrame:
    """pages with a column body (BODY).  language: a column with each page's language, English where null or without one."""

    @F.arrow_udf(BODY)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = to_arrow_type(BODY)
        for pages, languages in in_slices(batches):
            found = (body(h, la or "en", keep_html) for h, la in zip(pages, languages, strict=True))
            yield pa.array([vars(b) | {"movies": [vars(v) for v in b.movies]} for b in found], kind)

    return pages.withColumn("body", run(html, F.lit("en") if language is None else F.coalesce(language, F.lit("en"))))


@F.arrow_udf(T.StringType())
def fulltext(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A page's main text; null where there is none.  Register it with spark.udf.register('fulltext', fulltext) for SQL."""
    for pages, languages in in_slices(batches):
        yield pa.array([body(h, la or "en").text for h, la in zip(pages, languages, strict=True)], pa.string())
