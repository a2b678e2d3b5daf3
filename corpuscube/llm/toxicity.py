"""Toxic spans and scores by a linear-chain conditional random field.

Tokens are runs of letters.  Only documents are labelled, so tokens get their labels by
evidence: within documents labelled toxic, those tokens are toxic whose word or prefix
occurs in toxic documents far more often than chance allows.  The field has two states,
hashed word, prefix and suffix features and a transition weight for each pair of states.
Forward-backward marginals mark the offending spans; the largest one and their sum give
the document's score.

Defined results: a null or empty text, or one without letters, has no span and the score
of a document without evidence.  With no label at all every score is 0.  Several labels
of one document count as the largest.  Repeated documents each get the same result, up to the
rounding of doubles.  Texts of any length are read whole, and kept columns may have any names; those
named score, span_starts and span_ends are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscube.llm.annotate import annotate, bounded, lessons, sigmoid
from corpuscube.llm.spans import LOWER, U, Prefix, chunks, release, runs, segment_sums

BITS = 18
BLOCK = 128
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
#: Features of a token, in order: the word, its first bytes, as many as here, its last 4 bytes.
PREFIXES = (4, 5, 6, 7, 8, 9)
N_FEATURES = len(PREFIXES) + 2


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case; every character keeps its length."""
    out = LOWER[data]
    if len(out) > 1:
        second = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][second] += 0x20
    return out


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and each document's bounds of the tokens, and their hashed features."""
    starts, ends, bounds = runs(_LETTER[data], off)
    prefix = Prefix(lowered(data))
    cuts = [(starts, ends), *((starts, np.minimum(starts + n, ends)) for n in PREFIXES), (np.maximum(ends - 4, starts), ends)]
    found = np.stack([(prefix.of(a, b) * U(2 * k + 3) >> U(64 - BITS)).astype(np.int32) for k, (a, b) in enumerate(cuts)], 1) if len(starts) else np.zeros((0, N_FEATURES), np.int32)
    return starts, ends, bounds, found


def chain(n0: np.ndarray, n1: np.ndarray, d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
    """x[t] = (n0[t] + n1[t] x[t-1]) / (d0[t] + d1[t] x[t-1]); x before the first is 1.

    The maps are composed within blocks, all blocks at once, then the blocks are chained."""
    n = len(n0)
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n
    n0, n1, d0, d1 = (np.concatenate([x, np.full(pad, v)]).reshape(blocks, BLOCK).T.copy() for x, v in ((n0, 1.0), (n1, 0.0), (d0, 1.0), (d1, 0.0)))
    a, b, c, d = n1[0].copy(), n0[0].copy(), d1[0].copy(), d0[0].copy()
    for t in range(1, BLOCK):
        a, b, c, d = n1[t] * a + n0[t] * c, n1[t] * b + n0[t] * d, d1[t] * a + d0[t] * c, d1[t] * b + d0[t] * d
        s = 1.0 / (a + b + c + d)
        a, b, c, d = a * s, b * s, c * s, d * s
    first, x = [], 1.0
    for p, q, r, s in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True):
        first.append(x)
        x = (q + p * x) / (s + r * x)
    x, out = np.array(first), np.empty((BLOCK, blocks))
    for t in range(BLOCK):
        x = (n0[t] + n1[t] * x) / (d0[t] + d1[t] * x)
        out[t] = x
    return out.T.reshape(-1)[:n]


def forward_backward(evidence: np.ndarray, bounds: np.ndarray, start: float, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds of state 1 against 0 in the forward and the backward messages of each token.

    evidence: state 1's log potential of each token; move[i, j]: from state i to j."""
    n = len(evidence)
    w, m = np.exp(np.clip(evidence, -30, 30)), np.exp(move)
    first, last = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0] - 1
    n0, n1, d0, d1 = w * m[0, 1], w * m[1, 1], np.full(n, m[0, 0]), np.full(n, m[1, 0])
    n0[first], n1[first], d0[first], d1[first] = w[first] * np.exp(start), 0, 1, 0
    ahead = chain(n0, n1, d0, d1)
    after = np.append(w[1:], 1.0)
    n0, n1, d0, d1 = np.full(n, m[1, 0]), m[1, 1] * after, np.full(n, m[0, 0]), m[0, 1] * after
    n0[last], n1[last], d0[last], d1[last] = 1, 0, 1, 0
    return ahead, chain(n0[::-1], n1[::-1], d0[::-1], d1[::-1])[::-1]


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    start: float
    move: np.ndarray
    final: np.ndarray

    def marginals(self, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not len(found):
            return np.zeros(0)
        ahead, back = forward_backward(self.weights[found].sum(1) + self.bias, bounds, self.start, self.move)
        odds = ahead * back
        return odds / (1 + odds)

    def scores(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return sigmoid(summary(p, bounds) @ self.final)

    def transform(self, docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
        """Adds score, and span_starts and span_ends: offsets in code points of the runs of
        tokens whose marginal is a half or more."""
        model = self

        def make():
            def f(data, off):
                starts, ends, bounds, found = tokens(data, off)
                p = model.marginals(found, bounds)
                bad = p >= 0.5
                lo, hi, at = runs(bad, bounds)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = np.repeat(chars[off[:-1]], np.diff(at))
                a, b = (chars[starts[lo]] - base).tolist(), (chars[ends[hi - 1]] - base).tolist()
                return model.scores(p, bounds), [a[i:j] for i, j in zip(at[:-1], at[1:])], [b[i:j] for i, j in zip(at[:-1], at[1:])]

            return f

        return annotate(docs, text, keep, [("score", "double"), ("span_starts", "array<bigint>"), ("span_ends", "array<bigint>")], make)


def summary(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each document: 1, its largest marginal, the logarithm of 1 plus their sum."""
    padded = np.append(p, 0.0)
    most = np.maximum.reduceat(padded, bounds[:-1])
    most[np.diff(bounds) == 0] = 0
    return np.stack([np.ones(len(most)), most, np.log1p(segment_sums(p, bounds))], 1)


def evident(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of each word or prefix feature, whether it marks a token as toxic: it occurs in
    toxic documents so much more often than in others that chance does so less than about
    once in twenty thousand times, and three quarters of its documents are toxic.  Copies of a
    document are one observation: what counts is after how many different words it occurs."""
    inside = np.zeros((2, 1 << BITS))
    for x, label in zip(found, y, strict=True):
        inside[int(label), np.unique(x[:, : N_FEATURES - 1])] += 1
    n, p0 = inside.sum(0), np.clip(y.mean(), 1e-4, 1 - 1e-4)
    q = np.clip(inside[1] / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    apart = q * np.log(q / p0) + (1 - q) * np.log((1 - q) / (1 - p0))
    marks = (q > 0.75) & (n * apart > 8)
    pairs = [np.zeros(0, np.int64)]
    for x, label in zip(found, y, strict=True):
        if label and len(x):
            before = np.concatenate([[0], x[:-1, 0]]).astype(np.int64)
            for k in range(N_FEATURES - 1):
                at = np.flatnonzero(marks[x[:, k]])
                pairs.append(x[at, k].astype(np.int64) << BITS | before[at])
    contexts = np.bincount(np.unique(np.concatenate(pairs)) >> BITS, minlength=1 << BITS)
    return marks & (np.minimum(contexts, n) * apart > 8)


def _learn(found: list[np.ndarray], y: np.ndarray, passes: int) -> ToxicityModel:
    marks = evident(found, y)
    rng = np.random.default_rng(11)
    used = rng.permutation(len(y))
    w, state = np.zeros(1 << BITS), np.zeros(6)  # state: start, then move row by row, then every token's bias
    gw, gs = np.full(1 << BITS, 1e-3), np.full(6, 1e-3)
    for _ in range(passes):
        for lo in range(0, len(used), 32):
            group = [i for i in used[lo : lo + 32] if len(found[i])]
            if not group:
                continue
            x = np.concatenate([found[i] for i in group])
            bounds = np.concatenate([[0], np.cumsum([len(found[i]) for i in group])])
            label = np.concatenate([marks[found[i][:, : N_FEATURES - 1]].any(1) * y[i] for i in group]).astype(np.float64)
            start, move = state[0], state[1:5].reshape(2, 2)
            e = w[x].sum(1) + state[5]
            ahead, back = forward_backward(e, bounds, start, move)
            p = ahead * back / (1 + ahead * back)
            error = p - label
            g = np.bincount(x.reshape(-1), weights=np.repeat(error, N_FEATURES), minlength=1 << BITS) / len(group)
            at = np.flatnonzero(g)
            gs_now = np.zeros(6)
            gs_now[5] = error.sum() / len(group)
            first = bounds[:-1]
            gs_now[0] = error[first].sum() / len(group)
            inner = np.ones(len(x), bool)
            inner[first] = False
            inner = np.flatnonzero(inner)
            f, b, now = ahead[inner - 1], back[inner], np.exp(np.clip(e[inner], -30, 30))
            pairs = np.stack([np.exp(move[0, 0]) + 0 * f, np.exp(move[0, 1]) * now * b, np.exp(move[1, 0]) * f, np.exp(move[1, 1]) * f * now * b])
            pairs /= pairs.sum(0)
            u, v = label[inner - 1], label[inner]
            gs_now[1:5] = (pairs - np.stack([(1 - u) * (1 - v), (1 - u) * v, u * (1 - v), u * v])).sum(1) / len(group)
            gw[at] += g[at] ** 2
            w[at] -= 0.5 * (g[at] + 1e-4 * w[at]) / np.sqrt(gw[at])
            gs += gs_now**2
            state -= 0.5 * (gs_now + 1e-4 * state) / np.sqrt(gs)
    model = ToxicityModel(w, float(state[5]), float(state[0]), state[1:5].reshape(2, 2).copy(), np.zeros(3))
    rows = []
    for lo in range(0, len(found), 256):
        part = found[lo : lo + 256]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in part])])
        rows.append(summary(model.marginals(np.concatenate(part), bounds), bounds))
    x, final = np.concatenate(rows), np.zeros(3)
    for _ in range(30):  # Newton's method on a ridge logistic regression of three weights
        p = sigmoid(x @ final)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.05, 0.05])
        final -= np.linalg.solve(h, x.T @ (p - y) + np.array([1e-3, 0.05, 0.05]) * final)
    model.final = final
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", most: int = 9000, most_bytes: int = 48 << 20, passes: int = 6) -> ToxicityModel:
    """Learn from about `most` labelled rows at most, chosen by a hash of the key, and of those
    from all, in the order of another hash, up to `most_bytes` bytes of text; that bounds what
    the one learning task holds, whatever the input."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("__y"))
    picked = bounded(known, key, most)
    rows = lessons(docs, picked.select(key, F.col("__y").cast("double").alias("y")), text, key, most_bytes)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[tuple[int, int], np.ndarray, float]] = []
        for batch in batches:
            order, y = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, hi, data, off in chunks(batch.column(1)):
                _, _, bounds, found = tokens(data, off)
                seen += [((order[lo + i], crc32(data[off[i] : off[i + 1]])), found[bounds[i] : bounds[i + 1]], y[lo + i]) for i in range(hi - lo)]
        seen.sort(key=lambda r: r[0])
        if seen:
            model = _learn([r[1] for r in seen], np.array([r[2] for r in seen]), passes)
            del seen
            release()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rows.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else ToxicityModel(np.zeros(1 << BITS), 0.0, 0.0, np.zeros((2, 2)), np.array([-40.0, 0, 0]))
