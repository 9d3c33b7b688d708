"""Quality by compression: which dictionary, of good or of bad text, packs a text better?

Two zstandard dictionaries are built from blocks of labelled good and bad texts. A text is
compressed in blocks with either; the difference of the two sizes over their sum, a number
between -1 and 1, is turned into a probability by a logistic curve that is fitted on other
labelled texts. The whole text counts, block by block.

Learning reads a bounded, seeded sample: about ``SAMPLE_TEXTS`` texts of a label for the
dictionaries (at most ``SAMPLE_BLOCKS`` blocks) and as many for the curve. Null and empty
texts score the share of good texts. Without texts of both labels every score is that share,
or a half without any label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from presslens.llm.common import bounded_sample, text_value

SAMPLE_TEXTS = 1500
SAMPLE_BLOCKS = 4000
BLOCK_BYTES = 2048
DICTIONARY_BYTES = 65536
LEVEL = 3


def dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary, or the blocks themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:]


@dataclass(frozen=True)
class Pair:
    """The two dictionaries; compressors are made where they are used."""

    good: bytes
    bad: bytes

    @cached_property
    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        return out

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad}

    def difference(self, text: str) -> float:
        """(bad size - good size) / (bad size + good size): above 0 if good text is nearer."""
        raw = text.encode("utf-8", "surrogatepass")
        sizes = [0, 0]
        for at in range(0, len(raw), BLOCK_BYTES):
            block = raw[at : at + BLOCK_BYTES]
            for k, compressor in enumerate(self.compressors):
                sizes[k] += len(compressor.compress(block))
        return (sizes[1] - sizes[0]) / sum(sizes) if raw else 0.0


@dataclass(frozen=True)
class Model:
    pair: Pair | None
    slope: float
    offset: float
    prior: float

    def score(self, text: str) -> float:
        if self.pair is None or not text:
            return self.prior
        z = self.slope * self.pair.difference(text) + self.offset
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, by damped Newton steps."""
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)

    def loss(v: np.ndarray) -> float:
        z = design @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge * v @ v)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        slope = design.T @ (p - y) + 2 * ridge * w
        curve = design.T @ (design * (p * (1 - p))[:, None]) + np.eye(2) * (2 * ridge + 1e-9)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 5, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Dictionaries and curve from the rows of ``labels`` (doc_id, ``label`` 0 or 1; null is no label)."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Model(None, 0.0, 0.0, prior)
    chosen = [bounded_sample(known.where(F.col("y") == y), doc_id, 2 * SAMPLE_TEXTS, seed, n) for y, n in sorted(counts.items())]
    sample = chosen[0].unionByName(chosen[1])
    # at most four times 2 * SAMPLE_TEXTS rows of an id and a label
    texts = docs.select(doc_id, F.col(text).alias("t")).where(F.length("t") > 0).join(F.broadcast(sample), doc_id)
    texts = texts.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), doc_id), F.lit(2)))
    size = F.lit(BLOCK_BYTES)
    pieces = texts.where("part = 0").select(
        "y", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / size).cast("int")), lambda k: F.substr("t", k * size + 1, size))), doc_id
    ).withColumn("turn", F.xxhash64(F.lit(seed + 2), doc_id, "pos"))
    blocks: list[list[bytes]] = []
    for y in (1, 0):
        rows = pieces.where(F.col("y") == y).orderBy("turn", doc_id, "pos").select("col").limit(SAMPLE_BLOCKS).collect()
        blocks.append([r.col.encode("utf-8", "surrogatepass") for r in rows])
    if not all(blocks):
        return Model(None, 0.0, 0.0, prior)
    pair = Pair(dictionary(blocks[0]), dictionary(blocks[1]))
    rest = texts.where("part = 1").select("y", text_value(pair.difference, "double")("t").alias("d"), doc_id)
    rows = sorted((r.d, r.y) for r in rest.collect())
    if len({y for _, y in rows}) < 2:
        return Model(None, 0.0, 0.0, prior)
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    # every label weighs as in the whole table, however it was sampled
    curve = logistic(x, y)
    seen = y.mean()
    shift = math.log(prior / (1 - prior)) - math.log(seen / (1 - seen))
    return Model(pair, curve[0], curve[1] + shift, prior)


def score(model: Model, text: Column | str = "text") -> Column:
    """Probability of label 1."""
    return text_value(model.score, "double")(text)
