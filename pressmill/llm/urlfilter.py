"""A URL filter: gradient-boosted trees on lexical features.

Labels come with the URLs (a column, or a table of labelled URLs).  Where there are none a seed list stands in for
public block lists: a host is bad if one of its name's parts is in SEEDS, and good otherwise.  The
trees see lengths, depths, shares of characters, entropy, counts of parameters, and how often labelled URLs of the same top-level domain
were bad; no part of the host's name, and for a URL that they are fitted on its own label isn't counted in that rate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.llm.storage import keep
from pressmill.llm.text import code_points, map_texts

SEEDS = ("casino", "pills", "adult", "bets", "spam", "ads")
#: The trees are fitted on at most so many labelled URLs, those of least hash (an argument of train); statistics of suffixes come from all of them.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, SMOOTHING = 60, 3, 32, 0.2, 20.0
FEATURES = ("length", "host_length", "path_length", "query_length", "depth", "digits", "hyphens", "host_hyphens", "dots", "entropy", "host_entropy", "parameters", "escapes", "secure", "labels", "vowels", "suffix_rate")


def seed_label(url: Column) -> Column:
    """1 for a host with a part in SEEDS, else 0; null without a host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.when(host != "", F.arrays_overlap(F.split(host, r"[.\-:@]"), F.array(*map(F.lit, SEEDS))).cast("int"))


def _suffixes(urls: list[str]) -> list[str]:
    return [u.partition("://")[2].partition("/")[0].partition("?")[0].partition("#")[0].lower().rpartition(".")[2] for u in urls]


def _entropy(owner: np.ndarray, points: np.ndarray, n: int) -> np.ndarray:
    key, count = np.unique(owner * (1 << 21) + points, return_counts=True)
    own = key >> 21
    total = np.bincount(own, count, n)
    p = count / total[own]
    return np.bincount(own, -p * np.log2(p), n)


def features(urls: list[str], suffix_rate: list[float]) -> np.ndarray:
    """(n, 17) features in the order of FEATURES, given the rate of each URL's suffix."""
    n = len(urls)
    points, starts, lens = code_points(urls)
    points = points.astype(np.int64)
    owner = np.repeat(np.arange(n), lens + 1)
    cuts = []
    for u in urls:
        a = u.find("://") + 3 if "://" in u else 0
        b = min((i for i in (u.find(c, a) for c in "/?#") if i >= 0), default=len(u))
        q = u.find("?", b)
        q = len(u) if q < 0 else q
        cuts.append((a, b, q))
    a, b, q = np.array(cuts, np.int64).reshape(-1, 3).T
    offset = np.arange(len(points)) - starts[owner]
    real = offset < lens[owner]
    host = real & (offset >= a[owner]) & (offset < b[owner])
    path = real & (offset >= b[owner]) & (offset < q[owner])
    query = real & (offset >= q[owner])
    count = lambda m: np.bincount(owner[m], minlength=n).astype(float)
    digit, hyphen = (points >= 48) & (points <= 57), points == 45
    size = np.maximum(lens, 1)
    vowel = np.isin(points | 32, [97, 101, 105, 111, 117])
    return np.stack([
        lens.astype(float), (b - a).astype(float), (q - b).astype(float), (lens - q).astype(float), count(path & (points == 47)), count(real & digit) / size, count(real & hyphen), count(host & hyphen), count(host & (points == 46)),
        _entropy(owner[real], points[real], n), _entropy(owner[host], points[host], n), count(query & (points == 61)), count(real & (points == 37)), np.array([float(u.startswith("https")) for u in urls]),
        count(host & ((points == 46) | (points == 45))) + 1, count(host & vowel) / np.maximum(b - a, 1), np.asarray(suffix_rate, float),
    ], axis=1).reshape(n, len(FEATURES))


class Trees:
    """Boosted regression trees for the logistic loss, on features cut into BINS bins by quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
        self.base, self.trees = np.log(share / (1 - share)), []
        if len(y) == 0 or y.min() == y.max():
            return
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
        z = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            leaf = np.zeros(len(y), np.int64)
            feature, border = np.full(2**DEPTH - 1, -1), np.zeros(2**DEPTH - 1)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                choice = np.full((width, 2), -1)
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    key = (leaf - first) * BINS + binned[f]
                    G, H = (np.bincount(key, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h))
                    gain = G**2 / (H + 1) + (G[:, -1:] - G) ** 2 / (H[:, -1:] - H + 1) - G[:, -1:] ** 2 / (H[:, -1:] + 1)
                    gain = gain[:, : len(edges[f])]
                    at = gain.argmax(1)
                    better = gain[np.arange(width), at] > best
                    best[better] = gain[np.arange(width), at][better]
                    choice[better] = np.stack([np.full(width, f), at], 1)[better]
                for k, (f, e) in enumerate(choice):
                    if f >= 0:
                        feature[first + k], border[first + k] = f, edges[f][e]
                leaf = self._down(leaf, x, feature, border)
            own = leaf - (2**DEPTH - 1)
            value = RATE * np.bincount(own, g, 2**DEPTH) / (np.bincount(own, h, 2**DEPTH) + 1)
            self.trees.append((feature, border, value))
            z += value[own]

    @staticmethod
    def _down(leaf: np.ndarray, x: np.ndarray, feature: np.ndarray, border: np.ndarray) -> np.ndarray:
        f = feature[leaf]
        right = (f >= 0) & (x[np.arange(len(x)), f] > border[leaf])
        return 2 * leaf + 1 + right

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of being bad."""
        z = np.full(len(x), self.base)
        for feature, border, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                leaf = self._down(leaf, x, feature, border)
            z += value[leaf - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-z))


def _with_suffix(rows: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def suffix(url: pd.Series) -> pd.Series:
        return pd.Series(_suffixes(url.fillna("").tolist()))

    return rows.withColumn("suffix", suffix("url"))


class Filter:
    """Statistics of all labelled URLs' suffixes, as a table, and trees fitted on a sample; rows: distinct url and y (0 or 1)."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE):
        rows = keep(_with_suffix(rows))
        n, good = rows.agg(F.count("*"), F.avg("y")).first()
        self.prior = float(good or 0.0)
        self.rates = keep(rows.groupBy("suffix").agg(F.sum("y").alias("bad"), F.count("*").alias("n")))
        # The least hashes: all but a few of the URLs that can't be among them are left out before the sort, so that no task sends many.
        share = min(1.0, (sample + 6 * sample**0.5 + 60) / max(n, 1))
        few = rows.where(F.xxhash64("url") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).orderBy(F.xxhash64("url"), "url").limit(sample)
        # A URL's own label doesn't count in the rate that the trees are shown for it.
        rate = (F.col("bad") - F.col("y") + SMOOTHING * self.prior) / (F.col("n") - 1 + SMOOTHING)
        found = few.join(self.rates, "suffix").select("url", "y", rate.alias("rate")).orderBy(F.xxhash64("url"), "url", "y").collect()
        self.trees = Trees(features([r.url for r in found], [r.rate for r in found]), np.array([r.y for r in found], float))

    def rated(self, rows: DataFrame) -> DataFrame:
        """rows with the suffix_rate of their suffix: the prior where no labelled URL has it."""
        rate = (F.col("bad") + SMOOTHING * self.prior) / (F.col("n") + SMOOTHING)
        return rows.join(self.rates.select("suffix", rate.alias("suffix_rate")), "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(self.prior)))


def train(pages: DataFrame, label: Column | None = None, sample: int = SAMPLE) -> Filter:
    """A filter from pages' labelled URLs (label: a column or expression of pages that is 0, 1 or null, by default the seed list's); the trees are fitted on at most sample of them.

    Null URLs teach nothing; repeated rows count once; a URL with both labels counts as one of each; no labels, or only one kind, give their share for every URL.
    """
    return Filter(pages.select("url", (seed_label(F.col("url")) if label is None else label).cast("int").alias("y")).where("url is not null and y is not null").distinct(), sample)


def score(pages: DataFrame, model: Filter) -> DataFrame:
    """page_id, url, bad (the probability) and accepted (below 0.5) of each row.

    A null or empty URL has bad null and isn't accepted.  Repeated rows have a row each; URLs may be of any length; equal URLs score alike; no rows give none.
    """
    handle = pages.sparkSession.sparkContext.broadcast(model.trees)

    def run(texts, part):
        bad = np.round(handle.value.predict(features(texts, part.column("suffix_rate").to_pylist())), 6)
        some = np.array([bool(t) for t in texts])
        yield {"page_id": part.column("page_id"), "url": part.column("text"), "bad": [x if s else None for x, s in zip(bad.tolist(), some, strict=True)], "accepted": (bad < 0.5) & some}

    rows = model.rated(_with_suffix(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url")))
    return map_texts(rows.select("page_id", F.col("url").alias("text"), "suffix_rate"), run, "page_id bigint, url string, bad double, accepted boolean")
