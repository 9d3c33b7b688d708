"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over hashed words and starts of words (present or not). It learns from confirmed toxic
texts and from unlabelled ones: with class prior p, the risk on negatives is the unlabelled
risk less p times the positives' share of it, held at zero or above (where it falls below,
the step goes the other way, so the model can't fit by calling everything unlabelled safe).
An L1 step keeps the weights of ordinary words at zero, so long texts gather no noise.

Learning reads a bounded, seeded sample: about ``POSITIVES`` toxic and ``UNLABELLED`` other
texts. Null and empty texts score as a text without a known word. Without a confirmed toxic
text every score is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from presslens.llm.common import bounded_sample, text_value

BUCKETS = 2**18
STARTS = (5, 6, 7, 8)
POSITIVES = 1500
UNLABELLED = 5000
TOKEN = re.compile(r"\w+")
CACHE_WORDS = 200_000


def features(word: str) -> list[int]:
    """Buckets of a word and of its starts; compounds share the start of what they are made of."""
    parts = [word, *(f"{word[:k]}-" for k in STARTS if k < len(word))]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def buckets(text: str) -> list[int]:
    """The hashed features of a text, each once."""
    return sorted({b for word in set(TOKEN.findall(text.lower())) for b in features(word)})


class _Weights(dict):
    """Weighted buckets by word, filled as words come up and emptied when it grows too large."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE_WORDS:
            self.clear()
        out = self[word] = tuple(b for b in features(word) if b in self.weights)
        return out

    def __reduce__(self):
        return _Weights, (self.weights,)


@dataclass
class Model:
    weights: dict[int, float]
    offset: float
    cache: _Weights = field(init=False, repr=False)

    def __post_init__(self):
        self.cache = _Weights(self.weights)

    def score(self, text: str) -> float:
        hits = set().union(*map(self.cache.__getitem__, set(TOKEN.findall(text.lower()))))
        z = self.offset + math.fsum(self.weights[b] for b in hits)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``; empty runs are 0."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def train(positive: list[list[int]], unlabelled: list[list[int]], prior: float, rounds: int = 200, rate: float = 0.05, l1: float = 4e-4) -> Model:
    """Full-batch Adam on the non-negative risk under the logistic loss, with a proximal L1 step."""
    if not positive:
        return Model({}, -50.0)
    rows = positive + unlabelled
    flat = np.fromiter((b for r in rows for b in r), np.int64)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    lengths = np.diff(starts)
    used, flat = np.unique(flat, return_inverse=True)
    n_pos, n_unl = len(positive), max(len(unlabelled), 1)
    w, c = np.zeros(len(used)), math.log(prior / (1 - prior))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for i in range(1, rounds + 1):
        z = np.clip(c + _sums(w[flat], starts), -50, 50)
        p = 1 / (1 + np.exp(-z))
        negative_risk = np.logaddexp(0, z)
        gap = negative_risk[n_pos:].sum() / n_unl - prior * negative_risk[:n_pos].mean()
        pull = np.zeros(len(rows))
        if gap >= 0:
            pull[:n_pos] = prior / n_pos * ((p[:n_pos] - 1) - p[:n_pos])
            pull[n_pos:] = p[n_pos:] / n_unl
        else:
            pull[:n_pos] = prior / n_pos * p[:n_pos]
            pull[n_pos:] = -p[n_pos:] / n_unl
        slope = np.append(np.bincount(flat, np.repeat(pull, lengths), len(used)), pull.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        c -= step[-1]
        scaled = rate * l1 / (np.sqrt(v[:-1] / (1 - 0.99**i)) + 1e-8)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - scaled, 0)
    return Model({int(b): float(x) for b, x in zip(used, w) if x}, float(c))


def fit(docs: DataFrame, labels: DataFrame, pool: Column, label: str = "toxic", seed: int = 9, doc_id: str = "doc_id", text: str = "text", prior: float | None = None) -> Model:
    """Learn from the rows of ``labels`` (doc_id, ``label``) and from unlabelled ``docs`` in ``pool``.

    ``prior`` is the share of toxic texts; by default the share among the labels.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic = counts.get(1, 0)
    if not toxic:
        return train([], [], 0.5)
    prior = toxic / sum(counts.values()) if prior is None else prior
    prior = min(max(prior, 1e-4), 0.9)
    features = F.arrow_udf(_bucket_lists, "array<int>")
    confirmed = bounded_sample(known.where("y = 1"), doc_id, POSITIVES, seed, toxic).select(doc_id)
    # at most 2 * POSITIVES ids
    positive = docs.select(doc_id, text).join(F.broadcast(confirmed), doc_id, "left_semi")
    other = bounded_sample(docs.where(pool).select(doc_id, text), doc_id, UNLABELLED, seed)
    lists = [[r[0] for r in sorted(df.select(features(F.col(text)), doc_id).collect(), key=lambda r: (r[1], r[0]))] for df in (positive, other)]
    return train(*lists, prior)


def _bucket_lists(texts: pa.Array) -> pa.Array:
    return pa.array([buckets(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))


def score(model: Model, text: Column | str = "text") -> Column:
    """Probability of label 1."""
    return text_value(model.score, "double")(text)
