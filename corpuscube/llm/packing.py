"""Packing documents into training sequences of equal attention cost.

A document's tokens, and an end token, are cut into pieces: full sequences first, then one
remainder.  Remainders go in descending order to the sequence of lowest estimated cost
(tokens, and the square of each piece's tokens for attention) that has room.  The sequences
of a window are as many as its tokens need, so where no sequence has room for a whole
remainder it is cut; at most one sequence's worth of a window of WINDOW tokens is padding.

Texts are tokenized by words, runs of anything but ASCII white space, each distinct word once:
the tokenizer never joins across white space.  Words are found by a hash and compared byte by
byte.  There is no shuffle; a task holds one window.  Sequence numbers carry the task's number in their upper half.

Defined results: a null or empty text is the end token alone.  Repeated rows are documents
of their own.  A text of any length is tokenized whole.  Of the input's columns only the key
is returned, under its own name, which must not be one of the columns made.  An empty table
gives no piece.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpuscube.llm.spans import LOWER, SPACE, Prefix, chunks, owners, release, runs, same_bytes

WINDOW = 1 << 22
KNOWN = 1 << 20
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


class WordTokens:
    """Token ids of texts, by way of a table of the words met so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.spelled, self.written = np.zeros(1 << 16, np.uint8), 0
        self.spelled_at, self.spelled_size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, words: list[bytes]) -> list[list[int]]:
        told = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [e.ids for e in told]

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        ids = self.ids(words)
        long = np.fromiter(map(len, words), np.int64, len(words))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(size.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        place = np.searchsorted(self.known, hashes)
        at = self.used + np.cumsum(size) - size
        self.known, self.at, self.size = np.insert(self.known, place, hashes), np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.spelled_at = np.insert(self.spelled_at, place, self.written + np.cumsum(long) - long)
        self.spelled_size = np.insert(self.spelled_size, place, long)
        body = np.frombuffer(b"".join(words), np.uint8)
        while self.written + len(body) + 8 > len(self.spelled):
            self.spelled = np.concatenate([self.spelled, np.zeros_like(self.spelled)])
        self.spelled[self.written : self.written + len(body)] = body
        self.written += len(body)
        self.used += total

    def encode(self, data: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's followed by `end`, and where each text's begin."""
        if len(self.known) > KNOWN or self.written > 16 * KNOWN:
            self.forget()
        special = ((data[:-1] == 60) & (data[1:] == 124)).any()  # "<|" can begin a special token, which has marks and case
        # the tokenizer lower-cases; no character below U+0100 composes differently in lower case
        body = data if special or (data >= 0xC4).any() else LOWER[data]
        inside = ~SPACE[data]
        starts, ends, _ = runs(inside, off)
        if len(starts) and not special:
            # a mark after a letter or digit always begins a token of its own
            solid = _ALNUM[data]
            solid[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            cut = np.zeros(len(data), bool)
            cut[1:] = solid[:-1] & _MARK[data[1:]]
            cut[starts] = False
            cut = np.flatnonzero(cut)
            cut = cut[cut < ends[np.searchsorted(starts, cut, "right") - 1]]
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        bounds = np.searchsorted(starts, off)
        distinct, first, which = np.unique(self.hashed(body, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        fresh = np.ones(len(distinct), bool)
        inner = place < len(self.known)
        fresh[inner] = self.known[place[inner]] != distinct[inner]
        if fresh.any():
            raw = body.tobytes()
            new = first[fresh]
            self.learn(distinct[fresh], [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            place = np.searchsorted(self.known, distinct)
        length = ends - starts
        spare = np.concatenate([body, np.zeros(8, np.uint8)])
        told = (self.spelled_size[place] == length[first]) & same_bytes(spare, starts[first], self.spelled, self.spelled_at[place], np.minimum(length[first], self.spelled_size[place]))
        right = told[which] & (length == length[first][which]) & same_bytes(spare, starts, spare, starts[first][which], np.minimum(length, length[first][which]))
        if not right.all():
            return self._each(body, starts, ends, bounds, end)
        of = place[which]
        size = self.size[of]
        total = np.concatenate([[0], np.cumsum(size)])
        docs = len(off) - 1
        begin = total[bounds] + np.arange(docs + 1)
        out = np.full(begin[-1], end, np.uint32)
        shift = np.arange(docs, dtype=np.int64)[owners(bounds)]  # end tokens before each word
        word_at = np.arange(total[-1])
        out[word_at + np.repeat(shift, size)] = self.pool[word_at + np.repeat(self.at[of] - total[:-1], size)]
        return out, begin


    @staticmethod
    def hashed(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return Prefix(body).of(starts, ends)

    def _each(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for a chunk in which two different words have one hash: word by word."""
        raw = body.tobytes()
        words = self.ids([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        docs = [[i for ids in words[a:b] for i in ids] + [end] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return np.array([i for x in docs for i in x], np.uint32), np.cumsum([0, *map(len, docs)])


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One table a worker process, which runs many tasks: what a word's tokens are does not
    depend on who asks, so later tasks find most words known."""
    return WordTokens(path)


def assign(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Pack documents of these token counts: (document, start, length, sequence, offset)."""
    full = tokens // capacity
    doc = np.repeat(np.arange(len(tokens)), full)
    n = len(doc)
    start = (np.arange(n) - np.repeat(np.cumsum(full) - full, full)) * capacity
    parts = [(doc, start, np.full(n, capacity), np.arange(n), np.zeros(n, np.int64))]
    rest = tokens - full * capacity
    order = np.argsort(-rest, kind="stable")
    order = order[rest[order] > 0]
    count = -(-int(rest.sum()) // capacity)
    room, cost = np.full(count, capacity, np.int64), np.zeros(count)
    rows = []
    for d, r, s in zip(order.tolist(), rest[order].tolist(), (full * capacity)[order].tolist(), strict=True):
        while r:
            costs = np.where(room >= r, cost, np.inf)
            at = int(costs.argmin())
            if room[at] < r:  # nowhere as a whole
                at = int(np.where(room > 0, cost, np.inf).argmin())
            k = min(r, int(room[at]))
            rows.append((d, s, k, n + at, capacity - int(room[at])))
            room[at] -= k
            cost[at] += k + k * k / capacity
            r, s = r - k, s + k
    if rows:
        parts.append(tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)))
    return tuple(np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(5))


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = 2048, end: int = 1) -> DataFrame:
    """One row a piece: the key, start, length, ids (little-endian unsigned 32-bit numbers),
    doc_tokens, sequence_id and offset.  tokenizer: the place of a tokenizer's file."""
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("x"))
    kind = docs.schema[key].dataType.simpleString()

    def packed(keys: list[pa.Array], parts: list[tuple[np.ndarray, np.ndarray]], first: int) -> tuple[pa.RecordBatch, int]:
        ids = np.concatenate([x for x, _ in parts])
        base = np.cumsum([0, *[len(x) for x, _ in parts]])
        begin = np.concatenate([b[:-1] + o for (_, b), o in zip(parts, base)] + [base[-1:]])
        tokens = np.diff(begin)
        doc, start, length, sequence, offset = assign(tokens, capacity)
        order = np.lexsort((start, doc))
        doc, start, length, sequence, offset = (x[order] for x in (doc, start, length, sequence, offset))
        # pieces in order of document and start lie end to end: ids is their concatenation
        cuts = np.append(np.cumsum(length) - length, len(ids)) * 4
        body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
        columns = [pa.concat_arrays(keys).take(pa.array(doc)), pa.array(start), pa.array(length), body, pa.array(tokens[doc]), pa.array(sequence + first), pa.array(offset)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]), int(sequence.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first = word_tokens(tokenizer), TaskContext.get().partitionId() << 32
        keys, parts, held = [], [], 0
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1), 1 << 21):
                parts.append(words.encode(data, off, end))
                keys.append(batch.column(0).slice(lo, hi - lo))
                held += len(parts[-1][0])
                if held >= WINDOW:
                    made, n = packed(keys, parts, first)
                    yield made
                    keys, parts, held, first = [], [], 0, first + n
                    release()
        if parts:
            yield packed(keys, parts, first)[0]

    made = source.mapInArrow(run, f"key {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return made.withColumnRenamed("key", key)
