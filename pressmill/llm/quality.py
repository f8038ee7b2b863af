"""A quality classifier from weak labels.

Nine heuristic labellers vote good (1), bad (0) or abstain on each document;
they overlap and err.  Expectation-maximisation over the counts of vote
patterns (3^9 at most, whatever the corpus) estimates each labeller's chances
of each vote on good and on bad documents and the share of good ones, and so the posterior
of each pattern.  These posteriors train a linear scorer over hashed features (character
trigrams, and a few shares of the text, each hashed with the tenth it lies in), which then judges every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.text import Words, distinct, lists, map_texts, mix, shingles

#: The scorer is fitted on at most so many documents, those of least hash (an argument of train); the label model counts all.
SAMPLE = 4000
DIMENSIONS = 1 << 14
ROUNDS, STEP = 150, 0.3
LABELLERS = ("symbols", "capitals", "runs", "repeats", "length", "prose", "variety", "separators", "small_words")


def shares(texts: list[str]) -> dict[str, np.ndarray]:
    """What the labellers and the scorer look at: for each text how many words and runs of 5 words it has, and shares and means of them."""
    w = Words(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n), w.lens + 1)
    p = w.points
    per = lambda mask: np.bincount(owner[mask], minlength=n)
    words = np.diff(w.bounds)
    text_of = w.owner()
    inside = np.bincount(text_of, w.end - w.begin, n)
    blank = (p == 32) | (p == 10) | (p == 9) | (p == 13) | (p == 0)
    space = per(blank) - 1
    upper = per((p >= 65) & (p <= 90))
    lower = per((p >= 97) & (p <= 122))
    stops = per((p == 46) | (p == 33) | (p == 63))
    # Marks with white space on both sides.
    gap = np.append(True, np.append(blank, True))
    alone = np.flatnonzero(gap[:-2] & ~blank & gap[2:])
    word_at = np.zeros(len(p) + 1, np.int8)
    word_at[w.begin] = 1
    alone = np.bincount(owner[alone[word_at[alone] == 0]], minlength=n)
    many = np.maximum(words, 1)
    same = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (text_of[1:] == text_of[:-1]))
    sh, ok = shingles(w, 5)
    total = np.bincount(text_of[: len(sh)][ok], minlength=n)
    own, _ = distinct(text_of[: len(sh)][ok], sh[ok])
    return {
        "words": words,
        "total": total,
        "symbols": (w.lens - inside - space) / np.maximum(w.lens, 1),
        "capitals": upper / np.maximum(upper + lower, 1),
        "runs": np.bincount(text_of[same], minlength=n) / many,
        "repeats": np.where(total > 0, 1 - np.bincount(own, minlength=n) / np.maximum(total, 1), 0),
        "length": inside / many,
        "stops": stops / many,
        "separators": alone / many,
        "small_words": np.bincount(text_of[w.end - w.begin <= 3], minlength=n) / many,
    }


def votes(texts: list[str]) -> np.ndarray:
    """(n, 9) votes: 1 good, 0 bad, 2 abstains."""
    s = shares(texts)
    words, some = s["words"], s["words"] > 0
    out = np.full((len(texts), len(LABELLERS)), 2, np.int64)
    never = np.zeros(len(texts), bool)
    for k, (good, bad) in enumerate((
        (never, (s["symbols"] > 0.12) & (words >= 8)),
        (never, s["capitals"] > 0.5),
        (never, s["runs"] > 0.2),
        (never, s["repeats"] > 0.5),
        (words >= 40, words < 2),
        ((s["stops"] < 0.5) & (s["stops"] > 0) & (s["symbols"] < 0.1) & (s["capitals"] < 0.3), (s["stops"] > 0.7) & (words >= 8)),
        ((s["runs"] < 0.03) & (s["repeats"] < 0.1) & (s["total"] > 0), (s["length"] <= 2) | (s["length"] > 16)),
        (never, s["separators"] > 0.25),
        (s["small_words"] > 0.2, (s["small_words"] < 0.04) & (words >= 10)),
    )):
        out[good & some, k] = 1
        out[bad & some, k] = 0
    return out


def codes(v: np.ndarray) -> np.ndarray:
    """A number for each row of votes."""
    return v @ 3 ** np.arange(v.shape[1])


class LabelModel:
    """Each labeller's chances of each vote (bad, good, abstain) on bad and on good documents, estimated from counts of vote patterns.

    It starts from the view that one vote for bad outweighs others, as these labellers seldom cry wolf, and lets
    expectation-maximisation correct that.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray):
        m = patterns.shape[1]
        weight = counts.astype(float)
        good = np.where((patterns == 0).any(1), 0.1, np.where((patterns == 1).any(1), 0.9, 0.5))
        self.prior, self.chance = 0.5, np.full((2, m, 3), 1 / 3)
        for _ in range(200):
            for y, q in ((0, (1 - good) * weight), (1, good * weight)):
                cast = np.stack([(q[:, None] * (patterns == v)).sum(0) for v in range(3)], 1)
                self.chance[y] = (cast + 0.5) / (cast.sum(1, keepdims=True) + 1.5)
            self.prior = float(np.clip((good * weight).sum() / max(weight.sum(), 1), 0.02, 0.98))
            new = self.posterior(patterns)
            done = np.abs(new - good).max(initial=0) < 1e-9
            good = new
            if done:
                break

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability that documents with such votes are good."""
        each = np.arange(patterns.shape[1])
        zero, one = (np.log(self.chance[y][each, patterns]).sum(1) for y in (0, 1))
        return 1 / (1 + np.exp(np.clip(zero + np.log(1 - self.prior) - one - np.log(self.prior), -50, 50)))


def all_patterns() -> np.ndarray:
    """Every pattern of votes, by its number."""
    m = len(LABELLERS)
    return np.arange(3**m)[:, None] // 3 ** np.arange(m) % 3


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of characters (as written) and each one's text."""
    w_points, lens = _points(texts)
    owner = np.repeat(np.arange(len(texts)), lens + 1)
    if len(w_points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = w_points.astype(np.uint64)
    ok = owner[:-2] == owner[2:]
    h = mix((p[:-2] << np.uint64(42) | p[1:-1] << np.uint64(21) | p[2:])[ok])
    return (h >> np.uint64(50)).astype(np.int64), owner[:-2][ok]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    from pressmill.llm.text import code_points

    points, _, lens = code_points(texts)
    return points, lens


_TENTHS = ("symbols", "capitals", "runs", "repeats", "stops", "separators", "small_words")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hashed index and value of the scorer's features, distinct and in order: the share of each trigram, and for each of _TENTHS which tenth it lies in."""
    h, owner = trigrams(texts)
    n = len(texts)
    key, count = np.unique(owner * DIMENSIONS + h, return_counts=True)
    own = key // DIMENSIONS
    value = count / np.maximum(np.bincount(own, count, n), 1)[own]
    found = shares(texts)
    tenth = np.stack([np.clip(found[k] * 10, 0, 10).astype(np.uint64) for k in _TENTHS], 1) + np.arange(len(_TENTHS), dtype=np.uint64) * np.uint64(11)
    extra = (mix(tenth + np.uint64(1 << 40)) >> np.uint64(50)).astype(np.int64)
    key = np.append(key, (np.arange(n)[:, None] * DIMENSIONS + extra).ravel())
    value = np.append(value, np.full(n * len(_TENTHS), 0.1))
    order = np.argsort(key, kind="stable")
    return key[order] // DIMENSIONS, key[order] % DIMENSIONS, value[order]


def scores(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The scorer's probabilities that texts are good."""
    own, index, value = features(texts)
    z = np.bincount(own, weights[index] * value, len(texts)) + bias
    return np.round(1 / (1 + np.exp(-np.clip(z, -50, 50))), 6)


def fit(index: np.ndarray, value: np.ndarray, row: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer over sparse rows (Adagrad on the whole sample; both classes weigh alike)."""
    w, b = np.zeros(DIMENSIONS), 0.0
    if not len(target):
        return w, b
    share = np.clip(target.mean(), 0.01, 0.99)
    weight = target / share / 2 + (1 - target) / (1 - share) / 2
    seen, seen_b = np.full(DIMENSIONS, 1e-8), 1e-8
    for _ in range(ROUNDS):
        z = np.bincount(row, value * w[index], len(target)) + b
        err = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(target)
        g = np.bincount(index, value * err[row], DIMENSIONS) + 1e-6 * w
        seen += g * g
        seen_b += err.sum() ** 2
        w -= STEP * 10 * g / np.sqrt(seen)
        b -= STEP * err.sum() / np.sqrt(seen_b)
    return w, float(b)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, np.ndarray, float]:
    """The label model, from all documents, and the scorer's weights and bias, from at most sample of them.  Rows equal in doc_id and text count each for the first and once for the second; no rows give a scorer of no opinion."""
    docs = docs.select(F.xxhash64("doc_id", "text").alias("node"), "text")
    counted = map_texts(docs, lambda texts, part: iter([{"code": codes(votes(texts))}]), "code int").groupBy("code").count().collect()
    seen = np.array([r.code for r in counted], np.int64)
    model = LabelModel(all_patterns()[seen], np.array([r["count"] for r in counted], np.int64))
    posterior = model.posterior(all_patterns())
    chosen = docs.select("node").distinct().orderBy("node").limit(sample)

    def run(texts, part):
        own, index, value = features(texts)
        counts = np.bincount(own, minlength=len(texts))
        yield {"node": part.column("node"), "target": posterior[codes(votes(texts))], "index": lists(index.astype(np.int16), counts, pa.int16()), "value": lists(value.astype(np.float32), counts, pa.float32())}

    found = map_texts(docs.join(F.broadcast(chosen), "node", "left_semi"), run, "node bigint, target double, index array<smallint>, value array<float>").dropDuplicates(["node"]).orderBy("node").toArrow()
    index, value = (found.column(c).combine_chunks() for c in ("index", "value"))
    size = np.diff(index.offsets.to_numpy()) if len(index) else np.zeros(0, np.int64)
    w, b = fit(np.asarray(index.flatten()).astype(np.int64), np.asarray(value.flatten()).astype(np.float64), np.repeat(np.arange(len(size)), size), found.column("target").to_numpy())
    return model, w, b


def judge(docs: DataFrame, model: LabelModel, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, posterior (of the labellers' votes), score (of the linear scorer) and accepted (score of at least 0.5) of each row.

    A null, empty or white-space text gets no votes, posterior and score 0, and isn't accepted.  Equal rows have a row each and are judged alike; texts may be of
    any length; no rows give none.
    """
    posterior = np.round(model.posterior(all_patterns()), 6)

    def run(texts, part):
        some = np.array([bool(t.strip()) for t in texts])
        s = np.where(some, scores(texts, weights, bias), 0)
        yield {"doc_id": part.column("doc_id"), "posterior": np.where(some, posterior[codes(votes(texts))], 0), "score": s, "accepted": s >= 0.5}

    return map_texts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, posterior double, score double, accepted boolean")
