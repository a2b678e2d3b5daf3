"""Removing repeated passages with run-length indexes.

Every byte goes that a string of `length` bytes covers which also starts in a document
with a smaller id; texts are taken as UTF-8 bytes and judged as they came in.

Each string has an anchor, the GRAM bytes in it whose hash is least: equal strings have
equal anchors.  An anchor's context is what strings around it can reach.  So:

1. Texts move once, into cells, ranges of ids of about equally many bytes.  A cell sends its
   distinct anchors with their contexts' hashes, packed, to buckets by anchor.
2. A bucket answers each cell for each of its entries: does the same context occur in an
   earlier cell; is the anchor shared between different contexts.
3. The first cell of a context that shares its anchor sends the context itself.
4. A bucket indexes these contexts (all but each anchor's last one) by a run-compressed
   Burrows-Wheeler transform with sampled run ends, streams matching statistics of all but
   each anchor's first one over it, and answers which strings begin a match of full length
   that an earlier document holds.  Contexts of an anchor that are too many for one index are
   dealt by what the strings of half of the anchor's places in them have in common, and so on.
5. The cells mark the strings, and cut.

Copies of a text or passage cost a cell one entry however many there are, and cost a bucket one
entry a cell; contexts are indexed once.  Answers are bits in the order of the entries.

Contexts are held to be equal where 128 bits of hashes are (32 of the anchor's, 64 and 32 of two
unrelated ones of the context); among 10**13 contexts two others agree with a chance under
10**-12.  Differing contexts are compared by their bytes.

Defined results: a null text is an empty one.  Rows with equal ids are one document's
versions: neither removes from the other.  Null ids come last, all in one cell, as rows of one
id are; a cell of 2 GiB or more is an error, never a wrong result.  Texts under `length` bytes
stay whole.  The id 2**63 - 1 is not told from a missing one.  Kept columns may have any names; those
named n_bytes, span_starts, span_ends and kept are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpuscube.llm import ranges
from corpuscube.llm.rindex import RunLengthIndex
from corpuscube.llm.spans import CHUNK, U, Prefix, chunks, flat, mix, release, runs, same_bytes
from corpuscube.llm.tables import stored, width

GRAM = 24
#: Bytes of contexts that one index holds, about; bytes of a cell's texts, about.
INDEXED, CELL = 1 << 20, 128 << 20
UNIT = 4096


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of every anchor: its document, its context's start and end, how far in the context it
    begins, and the hashes of the anchor and (64 bits, with that place, and 32) of the context.  A
    window's anchor is the leftmost least-hashed gram in it."""
    grams, n = length - GRAM + 1, len(data)
    none = np.zeros(0, np.int64)
    starts = n - length + 1
    if starts <= 0:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint32)
    inside = np.zeros(n + 1, np.int32)
    long = np.diff(off) >= length
    inside[off[:-1][long]] = 1
    inside[off[1:][long] - length + 1] -= 1
    inside = np.cumsum(inside)[:starts] > 0  # windows within one document
    prefix = Prefix(data)
    h = prefix.all(GRAM)
    least = h * U(0x9FB21C651E98DF25)
    least &= U(0xFFFFFFFF00000000)
    least |= np.arange(n - GRAM + 1, dtype=np.uint64)
    done, wide = 1, least
    while 2 * done <= grams:
        wide = np.minimum(wide[:-done], wide[done:])
        done *= 2
    if done < grams:
        wide = np.minimum(wide[: len(wide) - (grams - done)], wide[grams - done :])
    place = (wide[:starts] & U(0xFFFFFFFF)).astype(np.int64)[inside]
    place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
    doc = np.searchsorted(off, place, "right") - 1
    lo, hi = np.maximum(place - (length - GRAM), off[doc]), np.minimum(place + length, off[doc + 1])
    # in periodic texts contexts of equal bytes can have their anchors at different places: they are not one
    whole = mix(prefix.of(lo, hi) + (place - lo).astype(np.uint64))
    return doc, lo, hi, place - lo, mix(h[place]), whole, (Prefix(data, 1).of(lo, hi) >> U(32)).astype(np.uint32)


class Cell:
    """The texts of a cell, in order of id, and their distinct (anchor, context) entries."""

    def __init__(self, table: pa.Table, length: int, buckets: int):
        order = np.argsort(table["__o"].to_numpy(), kind="stable")
        self.table = table.take(pa.array(order))
        ids = self.table["__o"].to_numpy()
        self.rank = np.cumsum(np.concatenate([[0], (ids[1:] != ids[:-1]).astype(np.int64)])) if len(ids) else np.zeros(0, np.int64)
        self.data, self.off = flat(self.table["__x"])
        if len(self.data) >= 1 << 31:  # places are held as 32-bit numbers
            raise ValueError("rows of one id, or without an id, have 2 GiB of text or more")
        parts = [(np.zeros(0, np.int32),) * 3 + (np.zeros(0, np.int8), *(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.uint32))]
        for lo, _, data, off in chunks(self.table["__x"].combine_chunks(), CHUNK // 2):
            doc, a, b, at, h, c, d = anchors(data, off, length)
            base = self.off[lo]
            parts.append(((doc + lo).astype(np.int32), (a + base).astype(np.int32), (b + base).astype(np.int32), at.astype(np.int8), h, c, d))
        self.doc, self.lo, self.hi, self.at, h, c, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        # in order of the anchor's first bits, which name its bucket, then of a hash of both
        key = (h & U(0xFFFFF00000000000)) | (mix(h + c * U(5)) >> U(20))
        by = np.argsort(key, kind="stable")
        same = lambda x: x[by[1:]] == x[by[:-1]]
        one = same(h) & same(c) & same(d)
        if (one != same(key)).any():  # different contexts of one sorting key
            by = np.lexsort((d, c, h, key))
            one = same(h) & same(c) & same(d)
        del key
        new = np.concatenate([[True], ~one])[: len(by)]
        self.entry = np.empty(len(by), np.int32)
        self.entry[by] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.h, self.c, self.d = h[by[first]], c[by[first]], d[by[first]]
        bucket = ((self.h >> U(44)) * U(buckets)) >> U(20)
        self.cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        ranks = self.rank[self.doc]
        self.first_rank = np.minimum.reduceat(ranks[by], first) if len(first) else np.zeros(0, np.int64)
        self.ranks = ranks
        # one occurrence, in the first document that has the context
        self.sample = np.zeros(len(first), np.int64)
        mine = np.flatnonzero(ranks == self.first_rank[self.entry]) if len(first) else np.zeros(0, np.int64)
        self.sample[self.entry[mine[::-1]]] = mine[::-1]

    def answers(self, replies: pa.Table, kind: int) -> np.ndarray:
        """The answers of one kind, a number for each entry (kind 1) or context sent (kind 2)."""
        got = {b: x for k, b, x in zip(replies["kind"].to_pylist(), replies["bucket"].to_pylist(), replies["body"].to_pylist(), strict=True) if k == kind}
        dtype = np.uint8 if kind == 1 else np.dtype("<u8")
        return np.concatenate([np.frombuffer(got[b], dtype) for b in sorted(got)]) if got else np.zeros(0, dtype)

    def flags(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Of each entry: whether an earlier cell has its context; and those that this cell sends.
        An anchor that only one document has is not sent, though its contexts differ."""
        told = self.answers(replies, 1)
        alone = told == 3
        if alone.any():
            _, anchor = np.unique(self.h, return_inverse=True)
            first, last = np.full(len(self.h), len(self.rank)), np.zeros(len(self.h), np.int64)
            np.minimum.at(first, anchor, self.first_rank)
            np.maximum.at(last, anchor[self.entry], self.ranks)
            alone &= (first == last)[anchor]
        return told == 1, np.flatnonzero((told >= 2) & ~alone)


_PACKED = "bucket int, cell int, a binary, b binary, c binary"


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(list(x), k) for n, x, k in zip(("bucket", "cell", "a", "b", "c"), columns, kinds, strict=True)})


def _reply(kind: int, cells: list[int], buckets: list[int], bodies: list[bytes]) -> pa.Table:
    return pa.table({"__cell": pa.array(cells, pa.int32()), "kind": pa.array([kind] * len(cells), pa.int32()), "bucket": pa.array(buckets, pa.int32()), "body": pa.array(bodies, pa.binary())})


_REPLY = "__cell int, kind int, bucket int, body binary"


def shared(table: pa.Table) -> pa.Table:
    """Step 2, for one bucket: 1 if an earlier cell has the context; else, if the anchor has
    another context too, 2, or 3 where all of them are in one cell; else 0."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("cell", "bucket", "a", "b", "c")), strict=True), key=lambda r: r[0])
    h, c, d = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in ((2, "<u4"), (3, "<u8"), (4, "<u4")))
    key = (h.astype(np.uint64) << U(32)) | (c >> U(32))
    by = np.argsort(key, kind="stable")  # rows of one key stay in order of cell
    same = lambda x: x[by[1:]] == x[by[:-1]]
    one = same(key) & same(c) & same(d)
    if (one != same(key)).any():  # different contexts of one sorting key
        by = np.lexsort((d, c, key))
        one = same(key) & same(c) & same(d)
    k = key[by]
    new = np.concatenate([[True], ~one])
    told = np.zeros(len(k), np.uint8)
    told[by[~new]] = 1
    first = by[new]
    anchor = k[new] >> U(32)
    edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    many = np.repeat(np.diff(np.append(edge, len(anchor))) > 1, np.diff(np.append(edge, len(anchor))))
    told[first[many]] = 2
    cell = np.repeat([r[0] for r in rows], [len(r[2]) // 4 for r in rows])[by]
    every = np.flatnonzero(np.concatenate([[True], (k >> U(32))[1:] != (k >> U(32))[:-1]]))
    one = np.minimum.reduceat(cell, every) == np.maximum.reduceat(cell, every)
    told[first[many & np.repeat(one, np.diff(np.append(edge, len(anchor))))]] = 3
    at = np.cumsum([0, *[len(r[2]) // 4 for r in rows]])
    return _reply(1, [r[0] for r in rows], [r[1] for r in rows], [told[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])


def earlier(h: np.ndarray, order: np.ndarray, body: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Step 4: for each context, which of its windows (bit j: the one at its j-th byte) a
    context of smaller order holds.  Contexts lie in body; those of one anchor are all here."""
    n = len(h)
    out = np.zeros(n, np.uint64)
    by = np.lexsort((order, h))
    hs = h[by]
    head = np.concatenate([[True], hs[1:] != hs[:-1]])
    tail = np.concatenate([hs[1:] != hs[:-1], [True]])
    texts, asked = by[~tail], by[~head]  # an anchor's last one can't come before, its first not after another
    if not len(asked):
        return out
    wide = int(size.max())

    def symbols(which: np.ndarray, columns: int) -> np.ndarray:
        across = np.arange(columns)
        fits = across < size[which][:, None]
        return np.where(fits, body[np.where(fits, start[which][:, None] + across, 0)].astype(np.int16) + 1, 0)

    grid = symbols(texts, wide + 1)
    used = np.arange(wide + 1) <= size[texts][:, None]  # each context and one end mark
    index = RunLengthIndex(grid[used], classes_at=length)
    owner = np.repeat(np.arange(len(texts)), size[texts] + 1)
    left = np.broadcast_to(size[texts][:, None] - np.arange(wide + 1), grid.shape)[used]
    whole = left >= length
    least = np.full(int(index.classes.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, index.classes[whole], order[texts][owner[whole]])
    for lo in range(0, len(asked), 20000):
        which = asked[lo : lo + 20000]
        found, where = index.matching_statistics(symbols(which, wide))
        found, where = found[:, : wide - length + 1], where[:, : wide - length + 1]
        hit = (found >= length) & (least[index.classes[where]] < order[which][:, None])
        bits = (hit.astype(np.uint64) << np.arange(hit.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)
        out[which] = bits
    return out


def _classes(body: np.ndarray, start: np.ndarray, wide: int) -> np.ndarray:
    """A number for each of the strings of `wide` bytes at these places, equal for equal ones."""
    rows = np.ascontiguousarray(body[start[:, None] + np.arange(wide)])
    return np.unique(rows.view(f"V{wide}").reshape(-1), return_inverse=True)[1]


def _hashes(lanes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each of these spans, 8 bytes at a time.  lanes: the 8 bytes from each place on."""
    out, left, done = size.astype(np.uint64), np.arange(len(size)), 0
    while len(left):
        rest = size[left] - done
        unused = (U(8) * (U(8) - np.minimum(rest, 8).astype(np.uint64))).astype(np.uint64)
        out[left] = mix((out[left] ^ (lanes[start[left] + done] << unused)) * U(0x9FB21C651E98DF25))
        done += 8
        left = left[rest > 8]
    return out


def shared_part(at: np.ndarray, body: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each context, its first window and its last that may be in another one, by a hash of
    windows that have equally many bytes before the anchor; (length, -1) if there is none.
    body has 8 bytes to spare at its end."""
    lanes = np.ndarray((len(body) - 7,), "<u8", body, strides=(1,))
    first, last = np.full(len(at), length), np.full(len(at), -1)
    for r in range(length - GRAM + 1):
        j = at - r
        which = np.flatnonzero((j >= 0) & (j + length <= size))
        s = start[which] + j[which]
        key = np.zeros(len(s), np.uint64)
        for k in (*range(0, length - 7, 8), length - 8):
            key = (key ^ lanes[s + k]) * U(0x9FB21C651E98DF25)
            key ^= key >> U(29)
        by = np.argsort(key)
        same = np.flatnonzero(key[by[1:]] == key[by[:-1]])
        some = which[np.unique(np.concatenate([by[same], by[same + 1]]))]
        first[some], last[some] = np.minimum(first[some], j[some]), np.maximum(last[some], j[some])
    return first, last


def judged(h: np.ndarray, order: np.ndarray, at: np.ndarray, body: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, most: int = INDEXED) -> np.ndarray:
    """For each context, which of its windows a context of smaller order and of its anchor holds.

    Only the parts of contexts go on whose windows may be in another one, and of parts of equal
    bytes only that of the smallest order: the line that many texts share is indexed once."""
    body = np.concatenate([body, np.zeros(8, np.uint8)])
    bits = np.zeros(len(h), np.uint64)
    first, last = shared_part(at, body, start, size, length)
    mine = np.flatnonzero(last >= 0)
    if not len(mine):
        return bits
    begin, wide = start[mine] + first[mine], last[mine] - first[mine] + length
    key = _hashes(np.ndarray((len(body) - 7,), "<u8", body, strides=(1,)), begin, wide) ^ mix(h[mine].astype(np.uint64) << U(8) | (at - first)[mine].astype(np.uint64))
    by = np.lexsort((order[mine], key))
    new = np.concatenate([[True], key[by[1:]] != key[by[:-1]]])
    of = np.empty(len(mine), np.int64)
    of[by] = by[new][np.cumsum(new) - 1]
    equal = (wide == wide[of]) & (h[mine] == h[mine[of]]) & ((at - first)[mine] == (at - first)[mine[of]])
    equal[equal] = same_bytes(body, begin[equal], body, begin[of[equal]], wide[equal])
    of = np.where(equal, of, np.arange(len(mine)))
    one = np.flatnonzero(of == np.arange(len(mine)))
    found = np.zeros(len(mine), np.uint64)
    found[one] = indexed(h[mine[one]], order[mine[one]], (at - first)[mine[one]], body, begin[one], wide[one], length, most)
    every = (U(1) << (wide - length + 1).astype(np.uint64)) - U(1)
    bits[mine] = np.where(order[mine] > order[mine[of]], every, found[of]) << first[mine].astype(np.uint64)
    return bits


def indexed(h: np.ndarray, order: np.ndarray, at: np.ndarray, body: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, most: int = INDEXED) -> np.ndarray:
    """earlier() by indexes that hold about `most` bytes each.

    A window holds its anchor after r bytes of its own, 0 <= r <= length - GRAM, and equal
    windows have equal anchors after equally many.  Where an anchor's contexts are too many,
    windows of the lower and of the upper half of these r are judged apart: those of each half
    have some bytes around the anchor in common, by which contexts are dealt; and so on until
    there is one r, and equal windows are what is left to tell."""
    bits = np.zeros(len(h), np.uint64)

    def resolve(which: np.ndarray, group: np.ndarray, r0: int, r1: int) -> None:
        lo, hi = np.maximum(at[which] - r1, 0), np.minimum(at[which] - r0 + length, size[which])
        some = hi - lo >= length
        which, lo, hi = which[some], lo[some], hi[some]
        if not len(which):
            return
        _, group = np.unique(group[some], return_inverse=True)
        weight = np.bincount(group, hi - lo)
        if r0 == r1:  # one window a context: the first of equal ones stays
            same = _classes(body, start[which] + lo, length)
            least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, same, order[which])
            bits[which] |= (order[which] > least[same]).astype(np.uint64) << lo.astype(np.uint64)
            return
        large = weight > most
        batch = np.where(large, -1, (np.cumsum(np.where(large, 0, weight)) // most).astype(np.int64))[group]
        by = np.argsort(batch, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(batch[by])) + 1):
            if batch[part[0]] >= 0:
                mine = which[part]
                bits[mine] |= earlier(group[part], order[mine], body, start[mine] + lo[part], (hi - lo)[part], length) << lo[part].astype(np.uint64)
        for g in np.flatnonzero(large).tolist():
            mine = which[group == g]
            for x0, x1 in ((r0, (r0 + r1) // 2), ((r0 + r1) // 2 + 1, r1)):
                has = np.maximum(at[mine] - x1, 0) + length <= np.minimum(at[mine] - x0 + length, size[mine])
                if has.any():
                    here = mine[has]
                    resolve(here, _classes(body, start[here] + at[here] - x0, length - (x1 - x0)), x0, x1)

    resolve(np.arange(len(h)), h, 0, length - GRAM)
    return bits


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: Sequence[str] | None = None, length: int = 50, as_text: bool = False) -> DataFrame:
    """The columns `keep` of docs (all if None) and n_bytes, span_starts and span_ends (the
    removed runs, in bytes) and kept, the bytes that stay.  A kept column that has one of
    these names is replaced.  as_text: kept is a string, without the characters of which only
    a part stays.  length: 2 * GRAM to 80 bytes."""
    if not 2 * GRAM <= length <= 80:
        raise ValueError("length must be from 48 to 80")
    made = {"n_bytes", "span_starts", "span_ends", "kept"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    order = F.coalesce(docs[key].cast("bigint"), F.lit((1 << 63) - 1))
    body = docs[text].cast("string")
    # a row counts once for each UNIT bytes of its text, so that cells are alike in bytes
    sizes = stored(docs.select(order.alias("o"), F.coalesce(F.octet_length(body), F.lit(0)).alias("n")), "repeats-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = buckets = max(width(docs.sparkSession), -(-total // CELL))
    weighted = sizes.select("o", F.explode(F.sequence(F.lit(0), F.expr(f"n div {UNIT}"))).alias("i")).select("o")
    bounds = ranges.bounds(weighted, "o", parts)
    # the columns that are kept go by numbers, so that their names clash with nothing
    cells = docs.select(ranges.bisect(order, bounds).cast("int").alias("__cell"), order.alias("__o"), body.alias("__x"), *[docs[c].alias(f"c{i}") for i, c in enumerate(names)])

    def send(table: pa.Table) -> pa.Table:
        cell, at = Cell(table, length, buckets), table["__cell"][0].as_py()
        low = lambda x, i, j: (x[i:j] & U(0xFFFFFFFF)).astype("<u4").tobytes()
        made = _rows([(b, at, low(cell.h, i, j), cell.c[i:j].astype("<u8").tobytes(), cell.d[i:j].astype("<u4").tobytes()) for b, (i, j) in enumerate(zip(cell.cuts[:-1], cell.cuts[1:], strict=True)) if j > i])
        del cell
        release()
        return made

    replies = cells.groupBy("__cell").applyInArrow(send, _PACKED).groupBy("bucket").applyInArrow(shared, _REPLY)

    def contexts(table: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows:
            return _rows([])
        cell, at = Cell(table, length, buckets), table["__cell"][0].as_py()
        _, mine = cell.flags(told)
        rows = []
        for b, (i, j) in enumerate(zip(*(np.searchsorted(mine, x) for x in (cell.cuts[:-1], cell.cuts[1:])), strict=True)):
            if j > i:
                which = mine[i:j]
                s = cell.sample[which]
                numbers = np.stack([(cell.h[which] & U(0xFFFFFFFF)).astype(np.int64), cell.first_rank[which], (cell.hi[s] - cell.lo[s]).astype(np.int64) | cell.at[s].astype(np.int64) << 8]).astype("<i8")
                rows.append((b, at, numbers.tobytes(), b"".join([cell.data[x:y].tobytes() for x, y in zip(cell.lo[s].tolist(), cell.hi[s].tolist(), strict=True)]), None))
        del cell
        release()
        return _rows(rows)

    def judge(table: pa.Table) -> pa.Table:
        rows = list(zip(table["cell"].to_pylist(), table["bucket"].to_pylist(), table["a"].to_pylist(), table["b"].to_pylist(), strict=True))
        numbers = [np.frombuffer(r[2], "<i8").reshape(3, -1) for r in rows]
        h, rank, both = np.concatenate(numbers, 1)
        size, at = both & 255, both >> 8
        counts = [x.shape[1] for x in numbers]
        when = np.repeat(np.array([r[0] for r in rows], np.int64) << 40, counts) + rank
        body = np.frombuffer(b"".join([r[3] for r in rows]), np.uint8)
        bits = judged(h, when, at, body, np.cumsum(size) - size, size, length)
        release()
        at = np.cumsum([0, *counts])
        return _reply(2, [r[0] for r in rows], [r[1] for r in rows], [bits[a:b].astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])

    sent = cells.groupBy("__cell").cogroup(replies.groupBy("__cell")).applyInArrow(contexts, _PACKED)
    verdicts = sent.groupBy("bucket").applyInArrow(judge, _REPLY)

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        cell = Cell(table, length, buckets)
        lo, hi = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        if told.num_rows:
            before, mine = cell.flags(told)
            windows = np.zeros(len(cell.h), np.uint64)
            windows[mine] = cell.answers(told, 2)
            gone = before[cell.entry] | (cell.ranks > cell.first_rank[cell.entry])
            lo.append(cell.lo[gone])
            hi.append(cell.hi[gone])
            part = np.flatnonzero(~gone & (windows[cell.entry] > 0))
            for j in range(length - GRAM + 1):
                one = part[(windows[cell.entry[part]] >> U(j)) & U(1) == 1]
                lo.append(cell.lo[one] + j)
                hi.append(cell.lo[one] + (j + length))
        # only how many begin and end at a place matters, so both are sorted alone
        lo, hi = np.sort(np.concatenate(lo)), np.sort(np.concatenate(hi))
        made = []
        for i, j, data, off in chunks(cell.table["__x"].combine_chunks(), CHUNK):
            base, n = cell.off[i], len(data)
            # what ends where this chunk begins, ended in the one before
            at = [np.bincount(x[np.searchsorted(x, base, side) : np.searchsorted(x, base + n)] - base, minlength=n)[:n] for x, side in ((lo, "left"), (hi, "right"))]
            away = np.cumsum(at[0] - at[1]) > 0
            # runs cross no document's edge, and neither do strings, so an end at the chunk's edge needs no mark
            starts, ends, begin = runs(away, off)
            inner = np.repeat(off[:-1], np.diff(begin))
            spans = [pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array((x - inner).astype(np.int64))) for x in (starts, ends)]
            kept_off = np.concatenate([[0], np.cumsum(~away)])[off]
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(kept_off.astype(np.int64)), pa.py_buffer(data[~away])]).cast(pa.binary())
            if as_text:
                body = pa.array([x.decode("utf-8", "ignore") for x in body.to_pylist()], pa.string())
            made.append(pa.table([*(cell.table[f"c{c}"].slice(i, j - i) for c in range(len(names))), pa.array(np.diff(off)), *spans, body], names=[*names, "n_bytes", "span_starts", "span_ends", "kept"]))
        del cell
        release()
        return pa.concat_tables(made)

    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("n_bytes", T.LongType()), T.StructField("span_starts", T.ArrayType(T.LongType())), T.StructField("span_ends", T.ArrayType(T.LongType())), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    return cells.groupBy("__cell").cogroup(replies.unionByName(verdicts).groupBy("__cell")).applyInArrow(cut, schema)
