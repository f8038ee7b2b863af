"""Queries over text and NLP operators, on documents.  A document's title is its first line, cut as article titles are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import text as X
from pressmill.functions.stopwords import ENGLISH, NEWS
from pressmill.operators import article, nlp
from pressmill.operators.config import Config
from pressmill.sources.pages import spread


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "text", F.substring(F.substring_index("text", "\n", 1), 1, Config().max_title).alias("title"))


_list = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"
_GLUED = "list_filter(string_split(lower(regexp_replace({0}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_ ]', '', 'g')), ' '), lambda w: w <> '')"


def doc_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.stopword_stats(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", s.alias("s")).selectExpr("doc_id", "cast(s.stop_word_count as bigint) stop_word_count", "cast(s.word_count as bigint) word_count")


DOC_STOPWORDS = f"""WITH w AS (SELECT doc_id, string_split(lower(regexp_replace(text, '[!-/:-@\\[-`{{-~]', '', 'g')), ' ') AS words FROM documents)
SELECT doc_id, len(list_filter(words, lambda x: list_contains({_list(ENGLISH)}, x)))::BIGINT AS stop_word_count, len(words)::BIGINT AS word_count FROM w"""


def doc_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.with_keywords(_docs(spark, sf_dir)).select("doc_id", F.explode("keywords").alias("k")).select("doc_id", "k.word", "k.n", F.round("k.score", 9).alias("score"))


_KEYWORDS = f"""w AS (SELECT doc_id, title, text, {_GLUED.format('text')} AS words FROM (SELECT *, left(string_split(text, chr(10))[1], 200) AS title FROM documents)),
c AS (SELECT doc_id, total, word, count(*) AS n FROM (SELECT doc_id, len(words) AS total, unnest(words) AS word FROM w) WHERE NOT list_contains({_list(NEWS)}, word) GROUP BY ALL),
k AS (SELECT doc_id, word, n, n / total * 1.5 + 1 AS score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(word) DESC) <= 10)"""
DOC_KEYWORDS = f"WITH {_KEYWORDS} SELECT doc_id, word, n, round(score, 9) AS score FROM k"


def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("i", "sentence")).withColumn("i", F.col("i").cast("bigint"))


_ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|Gen|Col|Lt|Sgt|Rev|Hon|Inc|Ltd|Co|Corp|vs|etc|No|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|[A-Z]"
_SENTENCES = f"""list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\b({_ABBREVIATIONS})\\.(\\s)', '\\1' || chr(1) || '\\2', 'g'), '([.!?]["''”’)]*)\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda s: replace(s, chr(1), '.')), lambda s: length(s) > 10), lambda s: replace(s, chr(10), ''))"""
DOC_SENTENCES = f"SELECT doc_id, unnest(range(len(ss)))::BIGINT AS i, unnest(ss) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS ss FROM documents)"


def doc_sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = nlp.with_sentence_scores(nlp.with_keywords(_docs(spark, sf_dir))).select("doc_id", F.explode("scored").alias("s"))
    return scored.select("doc_id", F.col("s.i").cast("bigint").alias("i"), *(F.expr(f"floor(s.{c} * 1e6 + 0.5001) / 1e6").alias(c) for c in ("title_score", "length_score", "position_score", "sum_score", "density_score", "score")))


_SCORES = f"""{_KEYWORDS},
t AS (SELECT doc_id, list_filter({_GLUED.format('title')}, lambda x: NOT list_contains({_list(NEWS)}, x)) AS tw FROM w),
s AS (SELECT doc_id, unnest(range(len(ss))) AS i, unnest(ss) AS sentence, len(ss) AS total FROM (SELECT doc_id, {_SENTENCES} AS ss FROM documents)),
sw AS (SELECT *, {_GLUED.format('sentence')} AS words FROM s),
x AS (SELECT doc_id, i, unnest(words) AS word, unnest(range(len(words))) AS pos FROM sw),
h AS (SELECT x.doc_id, x.i, x.pos, x.word, k.score AS v FROM x JOIN k USING (doc_id, word)),
g AS (SELECT *, v * lag(v) OVER q / (pos - lag(pos) OVER q) ^ 2 AS pair FROM h WINDOW q AS (PARTITION BY doc_id, i ORDER BY pos)),
a AS (SELECT doc_id, i, sum(v) AS total_v, coalesce(sum(pair), 0) AS pairs, count(DISTINCT word) + 1 AS kk FROM g GROUP BY doc_id, i),
p AS (SELECT sw.doc_id, sw.i, sw.sentence, CASE WHEN len(tw) > 0 THEN len(list_filter(words, lambda y: list_contains(tw, y))) / len(tw) ELSE 0 END AS title_score, 1 - abs(20 - len(words)) / 20 AS length_score,
 CASE WHEN (sw.i + 1) / total <= 0.1 THEN 0.17 WHEN (sw.i + 1) / total <= 0.2 THEN 0.23 WHEN (sw.i + 1) / total <= 0.3 THEN 0.14 WHEN (sw.i + 1) / total <= 0.4 THEN 0.08 WHEN (sw.i + 1) / total <= 0.5 THEN 0.05 WHEN (sw.i + 1) / total <= 0.6 THEN 0.04 WHEN (sw.i + 1) / total <= 0.7 THEN 0.06 WHEN (sw.i + 1) / total <= 0.9 THEN 0.04 ELSE 0.15 END::DOUBLE AS position_score,
 CASE WHEN len(words) > 0 THEN coalesce(total_v, 0) / len(words) / 10 ELSE 0 END AS sum_score, CASE WHEN len(words) > 0 THEN coalesce(pairs / (kk * (kk + 1)), 0) ELSE 0 END AS density_score
 FROM sw JOIN t USING (doc_id) LEFT JOIN a ON sw.doc_id = a.doc_id AND sw.i = a.i),
r AS (SELECT *, round((title_score * 1.5 + (sum_score + density_score) / 2 * 10 * 2 + length_score + position_score) / 4, 9) AS score FROM p)"""
_ROUNDED = ", ".join(f"floor({c} * 1e6 + 0.5001) / 1e6 AS {c}" for c in ("title_score", "length_score", "position_score", "sum_score", "density_score", "score"))
DOC_SENTENCE_SCORES = f"WITH {_SCORES} SELECT doc_id, i::BIGINT AS i, {_ROUNDED} FROM r"


def doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.with_summary(_docs(spark, sf_dir)).select("doc_id", "summary")


DOC_SUMMARY = f"""WITH {_SCORES}, b AS (SELECT doc_id, i, sentence FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) <= 5)
SELECT d.doc_id, CASE WHEN length(d.text) > 0 AND length(string_split(d.text, chr(10))[1]) > 0 THEN left(coalesce(m.summary, ''), 5000) ELSE '' END AS summary
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(sentence, chr(10) ORDER BY i) AS summary FROM b GROUP BY doc_id) m USING (doc_id)"""


def doc_article_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = nlp.with_keywords(nlp.with_keywords(_docs(spark, sf_dir), "title", "tk"))
    return frame.select("doc_id", F.array_join(nlp.article_keywords(F.col("tk"), F.col("keywords")), " ").alias("keywords"))


DOC_ARTICLE_KEYWORDS = f"""WITH {_KEYWORDS},
tc AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_GLUED.format('title')}) AS word FROM w) WHERE NOT list_contains({_list(NEWS)}, word) GROUP BY ALL),
tk AS (SELECT doc_id, word FROM tc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(word) DESC) <= 10)
SELECT d.doc_id, coalesce(string_agg(u.word, ' ' ORDER BY encode(u.word)), '') AS keywords FROM documents d LEFT JOIN (SELECT doc_id, word FROM k UNION SELECT doc_id, word FROM tk) u USING (doc_id) GROUP BY d.doc_id"""


def doc_valid_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    url = F.concat(F.lit("http://x.test/"), F.when(F.col("doc_id") % 7 == 0, "video/").otherwise("a/"), "doc_id")
    kind = F.when(F.col("doc_id") % 5 == 0, "article").otherwise("")
    return docs.select("doc_id", article.is_valid_body(F.col("text"), F.col("title"), url, F.col("text"), kind).alias("valid"))


DOC_VALID_BODY = """WITH d AS (SELECT doc_id, text, left(string_split(text, chr(10))[1], 200) AS title, len(string_split(text, ' ')) AS words FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND words > 300 THEN true WHEN doc_id % 7 <> 0 AND text = '' THEN false WHEN len(string_split(title, ' ')) < 2 THEN false WHEN words < 300 THEN false
 WHEN len(string_split(text, '.')) < 7 THEN false WHEN text = '' THEN false ELSE true END AS valid FROM d"""


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    t = F.col("text")
    part = X.chunks(F.split(t, " "), 3)
    return c.select("conv_id", "turn", X.inner_trim(t).alias("trimmed"), X.is_ascii(t).alias("ascii"), X.valid_filename(t).alias("filename"), X.replace_all(t, ("a", "b"), ("b", "c")).alias("replaced"), F.array_join(F.get(part, F.lit(2)), " ").alias("last_third"))


TEXT_HELPERS = r"""SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS trimmed, regexp_full_match(text, '[\x00-\x7f]*') AS ascii, regexp_replace(text, '[^A-Za-z0-9_.() -]', '', 'g') AS filename,
 replace(replace(text, 'a', 'b'), 'b', 'c') AS replaced, array_to_string(string_split(text, ' ')[(len(string_split(text, ' ')) // 3) * 2 + 1:], ' ') AS last_third FROM conversations"""

QUERIES = {"doc_stopwords": doc_stopwords, "doc_keywords": doc_keywords, "doc_sentences": doc_sentences, "doc_sentence_scores": doc_sentence_scores, "doc_summary": doc_summary, "doc_article_keywords": doc_article_keywords, "doc_valid_body": doc_valid_body, "text_helpers": text_helpers}
ORACLES = {"doc_stopwords": DOC_STOPWORDS, "doc_keywords": DOC_KEYWORDS, "doc_sentences": DOC_SENTENCES, "doc_sentence_scores": DOC_SENTENCE_SCORES, "doc_summary": DOC_SUMMARY, "doc_article_keywords": DOC_ARTICLE_KEYWORDS, "doc_valid_body": DOC_VALID_BODY, "text_helpers": TEXT_HELPERS}
