"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line) hashes to a wide vector: LANES numbers modulo 2**64 from a
cryptographic hash of its bytes, and COUNTERS numbers modulo 2**16, the signed sketch of
its pairs of words.  A document's fingerprint is the sum of its paragraphs' vectors.  So
the order of paragraphs does not matter, and inserting or deleting paragraphs adds or
subtracts their vectors alone: the fingerprint of an edited text costs what the edit touches.
The first part tells equal multisets of paragraphs from others; the cosine of the second
parts, 0 at least, is the likeness of two documents.

Defined results: a null text is an empty one, and an empty text is one empty paragraph.
Texts of any length are read whole.  Rows of one id, and those without one, follow one another in the
order of their texts and lie in one range; the id 2**63 - 1 is not told from a missing one.
Equal fingerprints have likeness 1; else a document without words has likeness 0 to any.
A counter wraps, and likeness suffers, only where one text repeats a pair over 32,767 times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuscube.llm import ranges
from corpuscube.llm.annotate import annotate
from corpuscube.llm.spans import CHUNK, SPACE, U, Prefix, flat, mix, owners, runs
from corpuscube.llm.tables import width

LANES, COUNTERS = 16, 128


class Vectors:
    """Sums of paragraph vectors, one row a document."""

    def __init__(self, lanes: np.ndarray, counters: np.ndarray):
        self.lanes, self.counters = lanes, counters

    def __add__(self, other: Vectors) -> Vectors:
        return Vectors(self.lanes + other.lanes, self.counters + other.counters)

    def __sub__(self, other: Vectors) -> Vectors:
        return Vectors(self.lanes - other.lanes, self.counters - other.counters)

    def take(self, at) -> Vectors:
        return Vectors(self.lanes[at], self.counters[at])

    def text(self) -> list[str]:
        """As hexadecimal digits: the lanes, then the counters."""
        both = np.concatenate([self.lanes.astype(">u8").view(np.uint8).reshape(-1, 8 * LANES), self.counters.astype(">u2").view(np.uint8).reshape(-1, 2 * COUNTERS)], 1)
        return [x.tobytes().hex() for x in both]

    def likeness(self, other: Vectors) -> np.ndarray:
        a, b = self.counters.view(np.int16).astype(np.float64), other.counters.view(np.int16).astype(np.float64)
        size = np.sqrt((a * a).sum(1) * (b * b).sum(1))
        cosine = np.clip((a * b).sum(1) / np.maximum(size, 1e-9), 0, 1)
        return np.where((self.lanes == other.lanes).all(1) & (a == b).all(1), 1.0, cosine)


class Paragraphs:
    """The paragraphs of a chunk of texts and their vectors."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        breaks = np.flatnonzero(data == 10)
        n_before = np.searchsorted(breaks, off)
        self.bounds = n_before + np.arange(len(off))  # a text has one paragraph more than breaks
        docs = len(off) - 1
        self.starts, self.ends = np.empty(self.bounds[-1], np.int64), np.empty(self.bounds[-1], np.int64)
        at = np.arange(len(breaks)) + np.searchsorted(off[1:], breaks, "right")
        self.ends[at], self.starts[at + 1] = breaks, breaks + 1
        self.starts[self.bounds[:-1]], self.ends[self.bounds[1:] - 1] = off[:-1], off[1:]
        body = data.tobytes()
        digests = b"".join([hashlib.shake_128(body[a:b]).digest(8 * LANES) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)])
        self.lanes = np.frombuffer(digests, np.uint64).reshape(-1, LANES)
        starts, ends, _ = runs(~SPACE[data], off)
        edge = np.searchsorted(self.starts, starts, "right") - 1  # each word's paragraph; words hold no break
        h = Prefix(data).of(starts, ends)
        pair = mix(h[:-1] * U(3) + h[1:])
        joined = edge[:-1] == edge[1:]
        alone = np.ones(len(h), bool)
        alone[:-1] &= ~joined
        alone[1:] &= ~joined
        h, self.of = np.concatenate([pair[joined], h[alone]]), np.concatenate([edge[:-1][joined], edge[alone]])
        self.cell, self.sign = (h & U(COUNTERS - 1)).astype(np.int64), 1.0 - 2.0 * ((h >> U(32)) & U(1)).astype(np.float64)
        self.docs, self.doc = docs, owners(self.bounds)

    def sums(self, first: np.ndarray | None = None) -> Vectors:
        """Of each text, over its paragraphs from number `first` on (all if None)."""
        from_ = self.bounds[:-1] if first is None else first
        total = np.zeros((len(self.lanes) + 1, LANES), np.uint64)
        np.cumsum(self.lanes, 0, out=total[1:])
        lanes = total[self.bounds[1:]] - total[from_]
        cell, sign, of = self.cell, self.sign, self.of
        if first is not None:
            used = of >= from_[self.doc[of]]
            cell, sign, of = cell[used], sign[used], of[used]
        counters = np.bincount(self.doc[of] * COUNTERS + cell, weights=sign, minlength=self.docs * COUNTERS)
        return Vectors(lanes, counters.astype(np.int64).astype(np.uint16).reshape(self.docs, COUNTERS))


def compare(data: np.ndarray, off: np.ndarray) -> tuple:
    """For each text but the last, which is only the one after: n_chars, the edited text's
    SHA-256, both fingerprints, and the likeness to the edited and to the next text."""
    docs = len(off) - 2
    paragraphs = Paragraphs(data, off)
    whole = paragraphs.sums()
    chars = np.flatnonzero((data & 0xC0) != 0x80)  # where each code point begins
    c_off = np.searchsorted(chars, off)
    chars = np.append(chars, len(data))
    n = np.diff(c_off)
    cut = n[:-1] // 4
    stop = np.where(cut > 0, chars[c_off[1:-1] - cut], off[1:-1])
    head = np.where(cut > 0, chars[np.minimum(c_off[1:-1] + cut, c_off[2:])], off[1:-1])
    head = np.minimum(head, off[2:])  # the next text's part ends here
    touched = np.searchsorted(paragraphs.starts, stop, "right") - 1  # the paragraph that the cut is in
    touched = np.clip(touched, paragraphs.bounds[:-2], paragraphs.bounds[1:-1] - 1)
    body = memoryview(np.ascontiguousarray(data))
    shas, tails = [], []
    for a, p, s, b, h in zip(off[:-2].tolist(), paragraphs.starts[touched].tolist(), stop.tolist(), off[1:-1].tolist(), head.tolist(), strict=True):
        sha = hashlib.sha256(body[a:s])
        sha.update(body[b:h])
        shas.append(sha.hexdigest())
        tails += [body[p:s], body[b:h]]
    size = (stop - paragraphs.starts[touched]) + (head - off[1:-1])
    inserted = Paragraphs(np.frombuffer(b"".join(tails), np.uint8), np.concatenate([[0], np.cumsum(size)])).sums()
    removed = paragraphs.sums(np.append(touched, paragraphs.bounds[-1]))
    mine = whole.take(slice(0, docs))
    edited = mine - removed.take(slice(0, docs)) + inserted
    return n[:-1], shas, mine.text(), edited.text(), mine.likeness(edited), mine.likeness(whole.take(slice(1, None)))


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all if None) and fingerprint; one pass, no shuffle."""
    return annotate(docs, text, keep, [("fingerprint", "string")], lambda: lambda data, off: (Paragraphs(data, off).sums().text(),))


def edited_neighbours(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next of every row; equal ids follow one another in the order of their texts, null ids
    come last.  Texts move once, into ranges of ids; a range's first text also goes to the
    range before, so that each text meets the next one."""
    spark = docs.sparkSession
    order = F.coalesce(docs[key], F.lit((1 << 63) - 1))
    parts = width(spark)
    rows = docs.select(order.alias("o"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("x"))
    bounds = ranges.bounds(rows, "o", parts)
    firsts = {r["b"]: r["m"] for r in rows.select(ranges.bisect(F.col("o"), bounds).alias("b"), "o").groupBy("b").agg(F.min("o").alias("m")).collect()}
    full = sorted(firsts)
    before = {firsts[b]: a for a, b in zip([full[-1:], *[[x] for x in full]], full)} if full else {}
    also = F.lit(None).cast("int")
    if before:
        also = F.element_at(F.create_map(*[F.lit(x) for o, a in before.items() for x in (o, a[0])]), F.col("o"))
    here = ranges.bisect(F.col("o"), bounds)
    copies = F.when(also.isNotNull(), F.array(F.struct(here.alias("b"), F.lit(0).alias("s")), F.struct(also.alias("b"), F.lit(1).alias("s")))).otherwise(F.array(F.struct(here.alias("b"), F.lit(0).alias("s"))))
    dealt = rows.withColumn("at", F.explode(copies)).select(F.col("at.b").alias("b"), F.col("at.s").alias("s"), "o", "id", "x")
    dealt = dealt.repartitionById(parts, F.col("b")).sortWithinPartitions("b", "s", "o", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            if not table.num_rows:
                continue
            side = table["s"].to_numpy()
            ids = table["id"].combine_chunks()
            data, off = flat(table["x"])
            lo, last = 0, table.num_rows - 1
            while lo < last:
                hi = min(last, max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1))
                made = compare(data[off[lo] : off[hi + 1]], off[lo : hi + 2] - off[lo])
                real = pa.array(side[lo:hi] == 0)
                out = [ids.slice(lo, hi - lo), *[pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).filter(real)
                lo = hi
            held = table.slice(last).combine_chunks().to_batches()[0]

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("s", "id", "x").mapInArrow(run, schema)
