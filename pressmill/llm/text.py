"""Vectorised text kernels shared by the operators.

Texts of an Arrow batch are laid end to end as code points and handled by
array operations; there is no Python loop over characters or words.  A word is
a maximal run of letters, digits and combining marks; words compare without
case.  Batches are cut into slices of about a quarter of a million characters so
that a worker's memory doesn't depend on the batch; a longer text is a slice alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_CHARS = 1 << 18
_TOP = 0x20000  # code points from here on count as this one's class: a letter without case
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser: spreads 64-bit values evenly."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def lowered() -> np.ndarray:
    """For each code point its lower-case form, or 0 where it is in no word."""
    out = np.zeros(_TOP, np.uint32)
    for i in range(_TOP):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isalnum() or unicodedata.category(c)[0] == "M":
            out[i] = ord(c.lower()[0])
    return out


@lru_cache(1)
def _values() -> np.ndarray:
    low = lowered()
    return np.where(low > 0, mix(low.astype(np.uint64) + np.uint64(1)) | np.uint64(1), np.uint64(0))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n, _BASE), np.full(n, _INVERSE)
    p[0] = q[0] = 1
    return np.cumprod(p), np.cumprod(q)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with a 0 after each, and each one's start and length."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(lens[:-1] + 1, out=starts[1:])
    return points, starts, lens


class Words:
    """The words of several texts: hash, begin and end (offsets into points), and bounds (of each text's words, one more than texts)."""

    def __init__(self, texts: list[str]):
        self.points, self.starts, self.lens = code_points(texts)
        n = len(self.points)
        value = _values()[np.minimum(self.points, _TOP - 1)]
        inside = np.zeros(n + 1, np.int8)
        inside[:n] = value != 0
        step = np.diff(inside, prepend=np.int8(0))
        self.begin, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        up, down = _powers(1 << max(18, int(n).bit_length()))
        value *= up[:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        self.hash = mix((total[self.end] - total[self.begin]) * down[self.begin])
        self.bounds = np.append(np.searchsorted(self.begin, self.starts), len(self.begin))

    def owner(self) -> np.ndarray:
        """For each word the text that it is in."""
        return np.repeat(np.arange(len(self.starts)), np.diff(self.bounds))


def word_hash(word: str) -> int:
    """The hash of one word, as Words has it."""
    return int(Words([word]).hash[0])


def distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of owner (below 65536) and the upper 48 bits of h, in order."""
    both = np.sort(owner.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of so many words, by its first word, and which of them lie within one text."""
    n = len(w.hash)
    out = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        out *= np.uint64(0x100000001B3)
        out += w.hash[k : k + len(out)]
    owner = w.owner()
    return mix(out), owner[: len(out)] == owner[size - 1 :] if len(out) else np.zeros(0, bool)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters each."""
    i = total = 0
    for j, t in enumerate(texts):
        if j > i and total + len(t) > limit:
            yield i, j
            i, total = j, 0
        total += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of an Arrow batch where they are Spark's defaults: rows of whole texts are large, and a batch is held on both sides."""
    for key, default, own in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "8m")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == default:
            spark.conf.set(key, own)


def map_texts(df: DataFrame, fn: Callable[[list[str], pa.RecordBatch], Iterator[dict] | None], schema: str, limit: int = SLICE_CHARS) -> DataFrame:
    """Runs fn over slices of df, whose column text becomes a list of strings with '' for null.  fn yields dictionaries of columns."""
    from pyspark.sql.types import StructType, _parse_datatype_string  # noqa: PLC2701
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    small_batches(df.sparkSession)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # Python strings of a bounded part of the batch at a time
                part = batch.slice(at, 256)
                at += part.num_rows
                texts = [t or "" for t in part.column("text").to_pylist()]
                for i, j in slices(texts, limit):
                    for out in fn(texts[i:j], part.slice(i, j - i)):
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, out[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, parsed)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array of so many values each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
