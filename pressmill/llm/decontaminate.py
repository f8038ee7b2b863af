"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised alike on both sides: words in lower case, one blank
between them, whatever else stood there dropped.  The automaton holds every
distinct normalised question and answer with a blank on either side, so that
it matches whole words.  It is built once, however large the benchmark, and written to the
shared folder as one file, which each worker reads once; a text is scanned once; each match's offsets are
mapped back to characters of the original.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.storage import file_system, keep, place, unused
from pressmill.llm.text import code_points, lowered, map_texts

#: Shorter questions and answers occur everywhere by chance: they are reported, but no document is dropped for them.
MIN_WORDS = 8
_BATCH = 1000


def normalise(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts normalised, each as ' words ' and then a line feed; each character's offset in its own text; each text's start in the result, one more than texts."""
    points, starts, lens = code_points(texts)
    table = lowered()
    low = table[np.minimum(points, len(table) - 1)]
    low = np.where(points >= len(table), points, low)
    owner = np.repeat(np.arange(len(texts)), lens + 1)
    offset = np.arange(len(points)) - starts[owner]
    last = offset == lens[owner]  # the 0 after a text: blank and line feed
    keep_ = low != 0
    keep_[1:] |= low[:-1] != 0
    keep_[starts] = True
    size = keep_.astype(np.int64) + (last | (offset == 0) & (low != 0))
    # A text that starts with a word gets a blank before it; the 0 after a text turns into a line feed, after a blank where a word was last.
    size[last] = 1 + np.append(low[:-1] != 0, False)[np.flatnonzero(last) - 1].astype(np.int64) * (lens > 0)
    at = np.append(0, np.cumsum(size))
    out = np.full(at[-1], 32, np.uint32)
    source = np.repeat(offset, size)
    word = np.flatnonzero(low != 0)
    out[at[word + 1] - 1] = low[word]
    out[at[np.flatnonzero(last) + 1] - 1] = 10
    return out.tobytes().decode("utf-32-le"), source, np.append(at[starts], at[-1])


def patterns(benchmark: DataFrame, columns: tuple[str, ...] = ("text",), min_words: int = 1) -> DataFrame:
    """item_id and normalised pattern of each distinct question or answer of at least min_words words.  Nulls, and texts without a word, are skipped; items of equal text are all kept."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.explode(F.array(*(F.col(c) for c in columns))).alias("text")).where("item_id is not null and text is not null")

    def run(texts, part):
        text, _, at = normalise(texts)
        own = [text[a : b - 1] for a, b in zip(at, at[1:], strict=False)]
        some = [p.count(" ") > min_words for p in own]
        yield {"item_id": part.column("item_id").filter(pa.array(some)), "pattern": [p for p, s in zip(own, some, strict=True) if s]}

    return map_texts(rows, run, "item_id bigint, pattern string").distinct()


def build(found: DataFrame) -> str:
    """The path of the automaton of patterns (see patterns), written to the shared folder.

    It is one automaton by definition: it takes some 100 bytes a character of the benchmark, in the driver and in each worker.
    Patterns come to the driver a partition at a time, each once with all its items.
    """
    import ahocorasick

    spark = found.sparkSession
    path = place(spark)
    automaton = ahocorasick.Automaton()
    for r in found.groupBy("pattern").agg(F.sort_array(F.collect_set("item_id")).alias("items")).toLocalIterator():
        automaton.add_word(r.pattern, (len(r.pattern), r.pattern.count(" ") - 1, tuple(r["items"])))
    if len(automaton):
        automaton.make_automaton()
    system, at = file_system(path)
    with system.open_output_stream(at) as out:
        pickle.dump(automaton, out, protocol=5)
    return path


@lru_cache(1)
def _automaton(path: str):
    system, at = file_system(path)
    with system.open_input_stream(at) as f:
        return pickle.loads(f.read())  # noqa: S301


def scan(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text_hash, item_id, begin, end (characters of the text; end is exclusive) and words of every occurrence, overlapping ones too, of the patterns of the automaton at path.

    Null and empty texts match nothing; equal rows each give their matches; no patterns or documents, no rows; a text may be of any length.
    """

    def run(texts, part):
        a = _automaton(path)
        if not len(a):
            return
        text, source, at = normalise(texts)
        hits = [(end, n, words, item) for end, (n, words, own) in a.iter(text) for item in own]
        if hits:
            end = np.array([h[0] for h in hits])
            first = end - np.array([h[1] for h in hits]) + 2
            owner = np.searchsorted(at, end, "right") - 1
            yield {"doc_id": part.column("doc_id").take(pa.array(owner)), "text_hash": part.column("text_hash").take(pa.array(owner)), "item_id": [h[3] for h in hits], "begin": source[first].astype(np.int32), "end": (source[end - 1] + 1).astype(np.int32), "words": np.array([h[2] for h in hits], np.int32)}

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_texts(docs, run, "doc_id bigint, text_hash bigint, item_id bigint, begin int, end int, words int")


def leaks(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...] = ("text",), min_words: int = 1) -> DataFrame:
    """doc_id, item_id, begin, end and words of each benchmark passage of at least min_words words in docs (see scan, and patterns)."""
    return scan(docs, build(patterns(benchmark, columns, min_words))).drop("text_hash")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...] = ("text",), min_words: int = MIN_WORDS) -> DataFrame:
    """docs without those that hold a benchmark passage of at least min_words words, all columns kept (of any names).

    Documents with null or empty texts stay; equal rows go or stay together; a null doc_id is told from every number; no rows give none; a text may be of any length.
    """
    own_id, own_none, own_hash, key, none, text_hash = unused(docs, "id", "none", "hash", "k", "null", "h")
    found = scan(docs, build(patterns(benchmark, columns, min_words)))
    gone = keep(found.select(F.coalesce("doc_id", F.lit(0)).alias(own_id), F.col("doc_id").isNull().alias(own_none), F.col("text_hash").alias(own_hash)).distinct())
    rows = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), none: F.col("doc_id").isNull(), text_hash: F.xxhash64("text")})
    return rows.join(gone, (F.col(key) == F.col(own_id)) & (F.col(none) == F.col(own_none)) & (F.col(text_hash) == F.col(own_hash)), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
