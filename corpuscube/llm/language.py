"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier per bit, logistic regression on
hashed byte n-grams, predicts that bit; loss-weighted decoding chooses the nearest
codeword and flags a text whose two nearest codewords cost nearly the same.

Defined results: a null text, an empty one and one without a letter give `und`, score 0
and no ambiguity flag; so does every text if nothing was learned.  Ties between
codewords go to the smaller language name.  Repeated rows each count in learning and
each get a result.  Null labels teach nothing.  Texts of any length are read whole, and kept columns
may have any names; those named lang_pred, score and ambiguous are replaced.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from corpuscube.llm.annotate import annotate, sigmoid
from corpuscube.llm.spans import LOWER, chunks, release

DIM = 4096
ROWS = 256
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = LOWER[65:91]
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Root-scaled counts of hashed 2- and 3-grams of bytes, each row of unit length.
    Bytes that are no letter count as spaces; no n-gram spans two texts."""
    docs = len(off) - 1
    x = _FOLD[data].astype(np.uint32)
    who = np.repeat(np.arange(docs, dtype=np.int64) * DIM, np.diff(off))
    counts = np.zeros(docs * DIM)
    edges = off[1:-1]
    for n in (2, 3):
        if len(x) < n:
            continue
        h = x[: len(x) - n + 1] * np.uint32(0x9E3779B1)
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) + x[k : len(x) - n + 1 + k] * np.uint32(0x85EBCA77)
            h *= np.uint32(0xC2B2AE3D)
        h = (h >> np.uint32(20)).astype(np.int64) | 1
        for k in range(1, n):  # an n-gram over an edge goes to column 0, which is cleared
            cross = edges - k
            h[cross[(cross >= 0) & (cross < len(h))]] = 0
        counts += np.bincount(who[: len(h)] + h, minlength=docs * DIM)
    out = np.sqrt(counts.reshape(docs, DIM), dtype=np.float64)
    out[:, 0] = 0
    return (out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1 whose columns differ from each other and from each other's
    opposites: every such column up to 6 languages, else a seeded choice of 12 log2(n)."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        columns = [[1] + [1 if c >> r & 1 else -1 for r in range(n - 1)] for c in range((1 << (n - 1)) - 1)]
        return np.array(columns, float).T
    rng, wanted, best = np.random.default_rng(7), int(np.ceil(12 * np.log2(n))), None
    for _ in range(50):
        code = np.where(rng.random((n, wanted)) < 0.5, -1.0, 1.0)
        apart = (wanted - code @ code.T) / 2 + wanted * np.eye(n)
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Of each codeword, the bits' logistic losses weighted by how far to trust each bit."""
        margins = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -margins * word) * self.trust).sum(1) for word in self.code], 1)

    def transform(self, docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
        """Adds lang_pred, score (the share of the codeword among all, by loss) and ambiguous."""
        model = self

        def make():
            def f(data, off):
                n = len(off) - 1
                lang, score, doubt = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
                ascii_letters = np.concatenate([[0], np.cumsum(_FOLD[data] != 32)])
                some = ascii_letters[off[1:]] > ascii_letters[off[:-1]]
                plain = np.concatenate([[0], np.cumsum((_FOLD[data] != 32) & (data < 128))])
                for i in np.flatnonzero(some & (plain[off[1:]] == plain[off[:-1]])):
                    some[i] = regex.search(r"\p{L}", data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")) is not None
                if model.languages:
                    loss = model.losses(features(data, off))
                    share = np.exp(loss.min(1, keepdims=True) - loss)
                    share /= share.sum(1, keepdims=True)
                    best = loss.argmin(1)
                    top = np.sort(share, 1)
                    gap = top[:, -1] - top[:, -2] if share.shape[1] > 1 else np.ones(n)
                    for i in np.flatnonzero(some):
                        lang[i], score[i], doubt[i] = model.languages[best[i]], min(1.0, top[i, -1]), gap[i] < 0.2
                return lang, score, doubt

            return f

        return annotate(docs, text, keep, [("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")], make, most=ROWS)


def _learn(x: np.ndarray, labels: list[str], steps: int) -> LanguageModel:
    languages = sorted(set(labels))
    code = codewords(len(languages))
    place = {v: i for i, v in enumerate(languages)}
    y = np.array([place[v] for v in labels])
    targets = (code[y] > 0).astype(np.float32)
    rare = np.bincount(y, minlength=len(languages))
    each = (len(y) / (len(languages) * rare[y])).astype(np.float32)[:, None]  # each language counts alike
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = (sigmoid(x @ w + b).astype(np.float32) - targets) * each / len(y)
        for p, grad, a, c in ((w, x.T @ g + 1e-6 * w, m, v), (b, g.sum(0), mb, vb)):
            a += 0.1 * (grad - a)
            c += 0.01 * (grad * grad - c)
            p -= 0.5 * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.99**t)) + 1e-8)
    right = (((x @ w + b > 0) == (targets > 0)) * each).sum(0) / each.sum()
    return LanguageModel(languages, code, w.astype(np.float64), b.astype(np.float64), np.maximum(2 * right - 1, 0.05))


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", most: int = 6000, steps: int = 60) -> LanguageModel:
    """Learn from at most about `most` rows, an equal bound for each language, chosen by a
    hash of the key.  Each becomes DIM numbers where it is read, and only those go to the one
    learning task: it holds at most about most x DIM numbers, whatever the texts' length."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("string").alias("y"), F.col(text).alias("x"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.ones((0, 1)), np.zeros((DIM, 1)), np.zeros(1), np.ones(1))
    bound = max(20, most // len(counts))
    at = F.create_map(*[F.lit(v) for y, n in counts.items() for v in (y, int((1 << 40) * min(1.0, bound / n)))])
    picked = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "k"), F.lit(1 << 40)) < at[F.col("y")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(0), most=ROWS):
                body = pa.array([x.tobytes() for x in features(data, off).astype(np.float16)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), body], names=["y", "f"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, labels = [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            parts += [np.frombuffer(x, np.float16) for x in batch.column(1).to_pylist()]
        if labels:
            order = np.lexsort((np.array([zlib.crc32(x) for x in parts]), np.array(labels)))  # whatever order rows come in
            model = pickle.dumps(_learn(np.stack([parts[i] for i in order]).astype(np.float32), [labels[i] for i in order], steps))
            del parts
            release()
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    made = picked.select("x", "y").mapInArrow(read, "y string, f binary").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0]["model"])
