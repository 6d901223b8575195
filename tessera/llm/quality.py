"""Quality by pairwise ranking: Bradley-Terry strengths learnt from preference pairs of labelled documents.

Each document is a vector of properties of its whole text. For pairs of a
preferred (label 1) and another (label 0) document, a weight vector is fitted
by logistic loss on the difference of the two vectors. The strength of a
document is its weighted sum; the threshold is a quantile of the strengths of
the labelled sample, and the score is a logistic of the distance to it, placed
so that the threshold scores ``CUT``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts

#: A score from here on is predicted to be label 1.
CUT = 0.3
#: The fit reads at most so many labelled rows, those with the smallest hashes of doc_id.
MAX_LABELLED = 20_000
#: Preference pairs drawn from them.
PAIRS = 200_000

FEATURES = ["bias_free_length", "upper", "digit", "space", "punct", "symbol", "bang", "bar", "bytes", "mean_word", "long_words", "odd_words", "caps_words", "distinct_words", "distinct_lines", "repeat_lines", "line_words", "top_word", "short_words"]

_CLASS = np.zeros(256, np.int64)
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[ord(c) for c in "0123456789"]] = 2
_CLASS[[9, 10, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4
_CLASS[[ord(c) for c in "#$%&*<>{}[]@^~`+=_/\\"]] = 5
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7
_CLASS[128:] = 8


def features(text: str) -> list[float]:
    """The properties of a whole text, each within a bounded range; all 0 of an empty one."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) / len(raw)
    lines = text.split("\n")
    counts = Counter(text.split())
    n = counts.total() or 1
    chars = long_ = short = odd = caps = 0
    for w, c in counts.items():
        size = len(w)
        chars += c * size
        if size <= 3:
            short += c
        elif size > 16:
            long_ += c
        if not w.isalpha():
            w = w.rstrip(".,;:!?")
            if not w.isalpha():
                odd += c
        if size > 1 and w.isupper():
            caps += c
    distinct = len(set(lines)) / len(lines)
    return [
        float(np.log1p(len(raw))) / 16,
        *np.sqrt(share[1:9]).tolist(),  # roots keep small shares apart
        min(1.0, chars / n / 20),
        sqrt(long_ / n),
        sqrt(odd / n),
        sqrt(caps / n),
        len(counts) / n,
        distinct,
        sqrt(1 - distinct),
        min(1.0, n / len(lines) / 100),
        max(counts.values(), default=0) / n,
        sqrt(short / n),
    ]


@dataclass(frozen=True)
class Ranker:
    mean: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = (x - np.array(self.mean)) @ np.array(self.weights)
        z = np.clip((s - self.threshold) * self.scale + np.log(CUT / (1 - CUT)), -40, 40)
        return np.where(s >= self.threshold, np.maximum(1 / (1 + np.exp(-z)), CUT), np.minimum(1 / (1 + np.exp(-z)), np.nextafter(CUT, 0)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, seed: int = 1) -> Ranker:
    """Weights from ``pairs`` drawn pairs (label 1 over label 0), by Newton's steps on the ridge-penalised logistic loss.

    The threshold is the quantile of strengths that has the share of label 0
    below it. Without both labels every text scores 0.5.
    """
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(tuple(mean), (0.0,) * x.shape[1], -float(np.log(7 / 3)), 1.0)
    rng = np.random.default_rng(seed)
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        grad = d.T @ (p - 1) + ridge * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = (x - mean) @ w
    # The threshold lies between two neighbouring strengths of the sample.
    order = np.sort(s)
    k = min(len(bad), len(order) - 1)
    threshold = float((order[k - 1] + order[k]) / 2)
    return Ranker(tuple(map(float, mean)), tuple(map(float, w)), threshold, 1.0)


def labelled_rows(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """At most ``most`` labelled ids that may be learnt from: crc32 of the id's text mod 5 is not 0."""
    ok = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return ok.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Ranker:
    """Fit on a bounded sample of labelled documents; only their feature vectors come to the driver."""
    sample = docs.select("doc_id", "text").join(F.broadcast(labelled_rows(labels, most)), "doc_id")

    def make():
        return lambda texts: {"x": [features(t) for t in texts]}

    got = map_texts(sample, ["doc_id", "quality"], "x array<double>", make).toArrow()
    order = np.lexsort((np.array([str(v) for v in got["x"].to_pylist()]), got["doc_id"].to_numpy())) if len(got) else []
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))[order]
    y = np.array(got["quality"].to_pylist(), dtype=int)[order]
    return fit(x, y)


def scored(docs: DataFrame, ranker: Ranker, ids: list[str] | None = None) -> DataFrame:
    """ids, held_out, score and predicted of each row's whole text; null counts as empty; repeated rows give repeated rows."""

    def make():
        return lambda texts: {"score": ranker.score(np.array([features(t) for t in texts])).tolist()}

    out = map_texts(docs, ids or ["doc_id"], "score double", make)
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int")).withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))
