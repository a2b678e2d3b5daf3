"""Quality scores: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

A text's n-grams are its words, pairs of words, and pairs and triples of word shapes
(letters, digits or marks; their case; whether they repeat the word before).  Their
values are their shares of the text, so that long and short texts are alike.

Defined results: a null or empty text has no n-gram and is scored by the bias alone.
With no labelled row every score is 0.5.  Several labels of one document count as the
largest.  Repeated documents each get the same score.  Texts of any length are read whole, and
kept columns may have any names; one named score is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscube.llm.annotate import annotate, bounded, lessons, sigmoid
from corpuscube.llm.spans import LOWER, U, Prefix, chunks, mix, segment_sums

BITS = 18
SCALE = 30.0

_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 mark
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text, and where each text's begin (one more than texts)."""
    docs = len(off) - 1
    kind = _KIND[data]
    change = np.empty(len(data), bool)
    change[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    bounds = np.searchsorted(starts, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(docs + 1, np.int64)
    h = Prefix(LOWER[data]).of(starts, ends)
    caps = np.concatenate([[0], np.cumsum(_UPPER[data])])
    n_caps, size = caps[ends] - caps[starts], ends - starts
    case = np.where(n_caps == 0, 0, np.where(n_caps == size, 2, np.where((n_caps == 1) & (_UPPER[data[starts]] == 1), 1, 3)))
    k = kind[starts].astype(np.int64)
    shape = k * 4 + case + np.where(k == 3, 16 * (1 + data[starts].astype(np.int64)) + 8192 * np.minimum(size, 4), 8192 * np.minimum(size, 2))
    same = np.zeros(len(h), np.int64)
    same[1:] |= h[1:] == h[:-1]
    same[2:] |= 2 * (h[2:] == h[:-2])
    first = bounds[:-1][bounds[:-1] < len(h)]
    second = first + 1
    same[first] = 0
    same[second[second < len(h)]] &= 1
    shape = mix((shape + 65536 * same).astype(np.uint64) + U(1))
    before, before2 = np.roll(h, 1), np.roll(shape, 1)
    before3 = np.roll(shape, 2)
    before[first], before2[first], before3[first] = U(7), U(7), U(7)
    before3[second[second < len(h)]] = U(7)
    pair = mix(h * U(3) + before)
    shape2 = mix(shape * U(5) + before2)
    shape3 = mix(shape2 * U(9) + before3)
    all4 = np.stack([h, pair, shape2, shape3], 1).reshape(-1)
    return (all4 >> U(64 - BITS)).astype(np.int64), bounds * 4


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def margins(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        grams, bounds = ngrams(data, off)
        return segment_sums(self.weights[grams], bounds) * SCALE / np.maximum(np.diff(bounds), 1) + self.bias

    def transform(self, docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
        """Adds score, the chance that a text is labelled 1."""
        model = self
        return annotate(docs, text, keep, [("score", "double")], lambda: lambda data, off: (sigmoid(model.margins(data, off)),))


class Leader:
    """Per-coordinate follow-the-regularised-leader state of a logistic regression."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (sigmoid(np.array(w @ x)) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", most: int = 16000, most_bytes: int = 96 << 20, passes: int = 3, shards: int = 4) -> QualityModel:
    """Learn from about `most` labelled rows at most, chosen by a hash of the key, up to
    `most_bytes` bytes of text.

    The rows are dealt over `shards` tasks, however many they are; each runs `passes` passes
    over its own rows, in the order of their keys' hashes, and the models are averaged.  What
    a task and the driver hold depends on these parameters alone."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("__y"))
    picked = bounded(known, key, most)
    rows = lessons(docs, picked.select(key, F.col("__y").cast("double").alias("y")), text, key, most_bytes)
    rows = rows.withColumn("shard", F.pmod("o", F.lit(shards)))

    def learn(group: pa.Table) -> pa.Table:
        seen: list[tuple[tuple[int, int], np.ndarray, np.ndarray, float]] = []
        order, y = group["o"].to_pylist(), group["y"].to_pylist()
        for lo, hi, data, off in chunks(group["x"]):
            grams, bounds = ngrams(data, off)
            for i in range(hi - lo):
                at, n = np.unique(grams[bounds[i] : bounds[i + 1]], return_counts=True)
                x = np.append(n * (SCALE / max(1, n.sum())), 1.0)
                seen.append(((order[lo + i], crc32(data[off[i] : off[i + 1]])), np.append(at, 1 << BITS).astype(np.int32), x.astype(np.float32), y[lo + i]))
        seen.sort(key=lambda r: r[0])
        model = Leader()
        for _ in range(passes):
            for _, at, x, y_ in seen:
                model.update(at, x.astype(np.float64), y_)
        w = model.weights()
        at = np.flatnonzero(w)
        return pa.table({"n": pa.array([len(seen)]), "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "w": pa.array([w[at].tobytes()], pa.binary())})

    made = rows.groupBy("shard").applyInArrow(learn, "n bigint, at binary, w binary").collect()
    w = np.zeros((1 << BITS) + 1)
    for r in made:
        w[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["w"]) * (r["n"] / sum(x["n"] for x in made))
    return QualityModel(w[:-1], float(w[-1]))
