"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 (DIMENSIONS long, fixed by SEED).
A trigram's vector is the product of its letters' vectors, the first rotated
twice and the second once; a text's profile is the sum over all its trigrams.
A language's prototype bundles the profiles, at unit length, of labelled
documents, and a text belongs to the prototype of largest cosine.
Letters are lower case; whatever stands between words is one blank.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressmill.llm.text import code_points, lowered, map_texts, slices, small_batches

DIMENSIONS, SEED = 1024, 11
#: Prototypes are bundled from at most so many labelled documents of a language, those of least hashed doc_id (an argument of train).
SAMPLE_PER_LANGUAGE = 400
#: A text is rejected if its cosine is less than MIN_COSINE, less the error that a sample of so few trigrams has: SLACK by the root of their number.  One without letters is rejected too.
MIN_COSINE, SLACK = 0.22, 0.7
_LATIN, _SYMBOLS, _BLOCK = 0x250, 4096, 1024


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Each code point's symbol (0: a blank; from 0x250 on, letters share 3,504 symbols by remainder, so that those of one alphabet have their own), and the symbols' vectors."""
    low = lowered().astype(np.int64)
    digit = np.array([chr(i).isdigit() and not 0xD800 <= i < 0xE000 for i in range(len(low))])
    symbol = np.where((low == 0) | digit, 0, np.where(low < _LATIN, low, _LATIN + low % (_SYMBOLS - _LATIN)))
    return symbol, np.random.default_rng(SEED).integers(0, 2, (_SYMBOLS, DIMENSIONS), np.int8) * np.int8(2) - np.int8(1)


def _bound(grams: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The vectors of trigrams: the product of their letters' vectors, the first rotated twice and the second once."""
    return (np.roll(v[grams // _SYMBOLS**2], 2, axis=1) * np.roll(v[grams // _SYMBOLS % _SYMBOLS], 1, axis=1) * v[grams % _SYMBOLS]).astype(np.float32)


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' profiles, (n, DIMENSIONS), and how many trigrams each has."""
    symbol, v = _letters()
    points, starts, lens = code_points(texts)
    s = symbol[np.minimum(points, len(symbol) - 1)]
    owner = np.repeat(np.arange(len(texts)), lens + 1)
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    s, owner = s[keep], owner[keep]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    total = np.zeros(len(texts), np.int64)
    if len(s) < 3:
        return out, total
    same = owner[2:] == owner[:-2]
    gram = ((s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:])[same]
    total += np.bincount(owner[2:][same], minlength=len(texts))
    both = np.sort(gram << 16 | owner[2:][same])
    new = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    count = np.diff(np.append(new, len(both))).astype(np.float32)
    gram, owner = both[new] >> 16, both[new] & 0xFFFF
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    for at in range(0, len(first), _BLOCK):  # so many distinct trigrams at a time
        own = first[at : at + _BLOCK]
        lo, hi = own[0], first[at + _BLOCK] if at + _BLOCK < len(first) else len(gram)
        g = gram[own]
        c = np.zeros((len(texts), len(own)), np.float32)
        c[owner[lo:hi], np.searchsorted(own, np.arange(lo, hi), "right") - 1] = count[lo:hi]
        out += c @ _bound(g, v)
    return out, total


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def least(trigrams: np.ndarray) -> np.ndarray:
    """The cosine that a text of so many trigrams needs."""
    return MIN_COSINE - SLACK / np.sqrt(np.maximum(trigrams, 1))


def train(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Prototypes of the languages in column lang, from at most sample documents of each.  Rows with a null or empty text, id or language teach nothing; no rows, no prototypes."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")
    known = docs.where("doc_id is not null and lang is not null")
    w = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("lang", "doc_id").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample).drop("n")

    def run(texts, part):
        p = _unit(profiles(texts)[0])
        langs = np.array(part.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            yield {"lang": [lang], "v": pa.array([p[langs == lang].sum(0)], pa.list_(pa.float32()))}

    # The sample's size is fixed, so its ids may be broadcast.
    parts = map_texts(known.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi"), run, "lang string, v array<float>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum(F.round("x", 4).cast("decimal(20, 4)")).cast("double").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r.lang, np.zeros(DIMENSIONS))[r.i] = r.x
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v)) > 0}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """docs, all columns kept, with language, cosine and accepted under names that docs mustn't have: __pm_language, __pm_cosine, __pm_accepted.

    A text without letters (also null and empty) has no language, cosine 0 and isn't accepted; without prototypes no text is.  Ties go to the first
    language by name; each of several equal rows has the same answer; a text may be of any length; no rows give none.
    """
    small_batches(docs.sparkSession)
    names = sorted(prototypes)
    table = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, DIMENSIONS))
    arrow_names = np.array([*names, None], object)

    def answer(texts):
        profile, trigrams = profiles(texts)
        cosine = _unit(profile) @ table.T.astype(np.float32)
        best = cosine.argmax(1) if len(names) else np.full(len(texts), -1)
        top = np.round(cosine.max(1), 6).astype(np.float64) if len(names) else np.zeros(len(texts))
        best = np.where(trigrams > 0, best, -1)
        return arrow_names[best], np.where(trigrams > 0, top, 0), (best >= 0) & (top >= least(trigrams))

    @F.pandas_udf("language string, cosine double, accepted boolean")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch]
            parts = [answer(texts[a + i : a + j]) for a in range(0, len(texts), 256) for i, j in slices(texts[a : a + 256])]
            yield pd.DataFrame({k: np.concatenate([p[n] for p in parts]) if parts else [] for n, k in enumerate(("language", "cosine", "accepted"))})

    # A filter on the answer would be pushed below it and ask for it twice.
    found = docs.withColumn("__pm_found", udf.asNondeterministic()("text"))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(f"__pm_found.{k}").alias(f"__pm_{k}") for k in ("language", "cosine", "accepted")))
