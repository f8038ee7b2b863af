"""Keywords and summaries, within the row: no shuffle and no Python.

A text's words are sorted and counted by runs; sentences are scored by
expressions over their words.  Each step is kept apart from those that use it
(see _step), so that nothing is computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions.stopwords import NEWS, stopwords
from pressmill.functions.text import sentences, words_apart, words_glued
from pressmill.functions.urls import let

TOP_KEYWORDS, IDEAL_WORDS = 10, 20.0
#: Score of a sentence's place in the text: up to this share of it.
PLACES = ((0.1, 0.17), (0.2, 0.23), (0.3, 0.14), (0.4, 0.08), (0.5, 0.05), (0.6, 0.04), (0.7, 0.06), (0.8, 0.04), (0.9, 0.04), (1.0, 0.15))


def _stop(language: str) -> list[str]:
    return sorted(NEWS if language == "en" else stopwords(language))


def _step(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """frame with a column that the optimizer doesn't write out in the expressions over it: within a lambda it would be computed for each element.  A generator of one row keeps it apart, for filters too."""
    return frame.select("*", F.explode(F.array(value)).alias(name))


def content_words(words: Column, language: str = "en") -> Column:
    """words without stop words."""
    return F.filter(words, lambda w: ~w.isin(*_stop(language)))


def _most(frame: DataFrame, words: str, total: str, out: str, n: int, language: str) -> DataFrame:
    """Adds out: array of struct(n, word) of the words counted most, ties in reverse alphabetical order, and with total their scores."""
    s, at = f"__{out}_s", f"__{out}_at"
    frame = _step(frame, s, F.sort_array(content_words(F.col(words), language)))
    size = F.size(s)
    frame = _step(frame, at, F.when(size > 0, F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(F.col(s), i) != F.get(F.col(s), i - 1)))).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.slice(F.col(at), F.lit(2), F.greatest(F.size(at), F.lit(1))), F.array(size))
    counted = F.zip_with(F.col(at), F.slice(ends, F.lit(1), F.size(at)), lambda a, b: F.struct((b - a).alias("n"), F.get(F.col(s), a).alias("word")))
    top = F.slice(F.sort_array(counted, False), 1, n)
    return _step(frame, out, F.transform(top, lambda k: F.struct(k["word"].alias("word"), k["n"].cast("bigint").alias("n"), (k["n"] / F.col(total) * 1.5 + 1).alias("score")))).drop(s, at)


def with_keywords(docs: DataFrame, text: str = "text", out: str = "keywords", language: str = "en", split_newlines: bool = False) -> DataFrame:
    """docs with out: the ten words that occur most, with count and score (share of all words * 1.5 + 1).

    Words across a line break count as one unless split_newlines is set.  Null and empty texts have none.
    """
    w, n = f"__{out}_w", f"__{out}_n"
    split = words_apart if split_newlines else words_glued
    frame = _step(_step(docs, w, F.coalesce(split(F.col(text)), F.array().cast("array<string>"))), n, F.size(w))
    return _most(frame, w, n, out, TOP_KEYWORDS, language).drop(w, n)


def title_score(title_words: Column, words: Column) -> Column:
    """The share of the title's words (without stop words, which title_words lacks) that a sentence's words make up, with repetition."""
    return F.size(F.filter(words, lambda w: F.array_contains(title_words, w))) / F.greatest(F.size(title_words), F.lit(1))


def length_score(words: Column) -> Column:
    return 1 - F.abs(F.lit(IDEAL_WORDS) - F.size(words)) / IDEAL_WORDS


def position_score(i: Column, n: Column) -> Column:
    """The score of the i-th (from 1) of n sentences."""
    r = i / n
    out = F.when(r > 1, 0.0)
    for top, value in PLACES:
        out = out.when(r <= top, value)
    return out.otherwise(0.0)


def _value(keywords: Column, w: Column) -> Column:
    return F.try_element_at(keywords, w)


def sum_score(keywords: Column, words: Column) -> Column:
    """Keyword scores summed over the words, by the number of words and ten."""
    total = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(_value(keywords, w), F.lit(0.0)))
    return F.when(F.size(words) > 0, total / F.size(words) / 10.0).otherwise(0.0)


def density_score(keywords: Column, words: Column) -> Column:
    """Products of neighbouring keywords' scores by their squared distance, over k(k+1) for k - 1 distinct keywords."""
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.cast("double").alias("i"), _value(keywords, w).alias("v"), w.alias("w"))), lambda h: h["v"].isNotNull())
    start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("i"), F.lit(None).cast("double").alias("v"), F.array().cast("array<string>").alias("seen"))
    end = F.aggregate(hits, start, lambda a, h: F.struct((a["s"] + F.coalesce(a["v"] * h["v"] / F.pow(h["i"] - a["i"], 2), F.lit(0.0))).alias("s"), h["i"].alias("i"), h["v"].alias("v"), F.array_union(a["seen"], F.array(h["w"])).alias("seen")))
    return F.when(F.size(words) > 0, let(end, lambda e: e["s"] / ((F.size(e["seen"]) + 1) * (F.size(e["seen"]) + 2)))).otherwise(0.0)


def with_sentence_scores(docs: DataFrame, text: str = "text", title: str = "title", keywords: str = "keywords", language: str = "en") -> DataFrame:
    """docs with scored: array of struct(i, sentence, title_score, length_score, position_score, sum_score, density_score, score)."""
    kw = F.map_from_entries(F.transform(F.col(keywords), lambda k: F.struct(k["word"], k["score"])))
    frame = _step(_step(docs, "__kw", kw), "__title", F.array_compact(content_words(F.coalesce(words_glued(F.col(title)), F.array().cast("array<string>")), language)))
    frame = _step(_step(frame, "__sentences", F.coalesce(sentences(F.col(text)), F.array().cast("array<string>"))), "__words", F.transform("__sentences", words_glued))
    n = F.size("__sentences")
    parts = F.transform("__words", lambda w, i: F.struct(i.alias("i"), F.get(F.col("__sentences"), i).alias("sentence"), F.when(F.size("__title") > 0, title_score(F.col("__title"), w)).otherwise(0.0).alias("title_score"), length_score(w).alias("length_score"), position_score(i + 1, n).alias("position_score"), sum_score(F.col("__kw"), w).alias("sum_score"), density_score(F.col("__kw"), w).alias("density_score")))
    frame = _step(frame, "__parts", parts)
    total = lambda p: (p["title_score"] * 1.5 + (p["sum_score"] + p["density_score"]) / 2 * 10 * 2 + p["length_score"] + p["position_score"]) / 4
    names = ("i", "sentence", "title_score", "length_score", "position_score", "sum_score", "density_score")
    return _step(frame, "scored", F.transform("__parts", lambda p: F.struct(*(p[k].alias(k) for k in names), F.round(total(p), 9).alias("score")))).drop("__kw", "__title", "__sentences", "__words", "__parts")


def with_summary(docs: DataFrame, text: str = "text", title: str = "title", language: str = "en", most: int = 5, cut: int = 5000) -> DataFrame:
    """docs with keywords and summary: the sentences that score most, in the text's order, ties to the earlier; '' without text or title."""
    frame = with_sentence_scores(with_keywords(docs, text, language=language), text, title, language=language)
    ranked = F.slice(F.sort_array(F.transform("scored", lambda p: F.struct(p["score"].alias("score"), (-p["i"]).alias("late"), p["sentence"].alias("sentence"))), False), 1, max(most, 1))
    chosen = F.transform(F.sort_array(F.transform(ranked, lambda r: F.struct((-r["late"]).alias("i"), r["sentence"].alias("sentence")))), lambda r: r["sentence"])
    some = (F.coalesce(F.length(text), F.lit(0)) > 0) & (F.coalesce(F.length(title), F.lit(0)) > 0) & F.lit(most > 0)
    return frame.withColumn("summary", F.when(some, F.substring(F.array_join(chosen, "\n"), 1, cut)).otherwise("")).drop("scored")


def article_keywords(title_keywords: Column, text_keywords: Column, most: int = 35) -> Column:
    """Both sets of words as one, sorted."""
    word = lambda c: F.transform(c, lambda k: k["word"])
    return F.slice(F.sort_array(F.array_union(word(title_keywords), word(text_keywords))), 1, most)
