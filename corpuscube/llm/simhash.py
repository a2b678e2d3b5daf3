"""Near-duplicates by SimHash, compared bit-sliced.

A text's fingerprint has a bit set where over half of its word shingles' hashes have it.
Fingerprints that differ in at most RADIUS bits are linked.  64 bits are cut into
radius + 2 parts; two linked fingerprints agree in at least two whole parts, so each pair
of parts is a table of buckets, and within a bucket all pairs are compared: bit planes are
stored vertically, 64 pairs to a word, differing bits are added by carry-save counters, and
blocks of pairs that all exceed the radius are abandoned.  A bucket sends the edges of a
forest only, and a bucket of more than TILE fingerprints is cut into pairs of tiles.

That finds every link of a small radius.  Texts whose shingles are alike by four fifths
differ in ten bits on average, with no bound; for such a radius the parts would be too short,
so buckets can instead be the least hashes of the texts' shingles under KEYS orders (two such
texts share none of them once in 15,000 times), and the forest's links, nearest first, are
then held against the exact share of common shingles.  A forest's links may fail where others
would not, and alike texts may lie beyond the radius, so buckets whose texts are not of one
component after that get the texts' shingles, and all pairs of different components are held
against them, whatever their distance.

Only distinct fingerprints are compared, where similarity is asked for only distinct sets of
shingles (by a hash of 64 bits of the whole set), so exact copies cost an aggregate.  The exact
components come from star contraction.

Defined results: texts without a word, null ones among them, have fingerprint 0, which is
linked like any other, and by similarity the empty set.  A component is named by its smallest
id; rows without an id have their component's all the same; repeated rows and ids each keep their
row.  Texts of any length are taken whole.  A kept column must not be named fp, node, keys, size,
fingerprint or component_id; other columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpuscube.llm.annotate import annotate
from corpuscube.llm.graph import components
from corpuscube.llm.spans import LOWER, SPACE, U, release, runs
from corpuscube.llm.tables import stored, width

RADIUS = 2
TILE = 4096
SMALL = 64
KEYS = 6
#: Of sets of shingles that are compared with each other: how many, and how many shingles.
SETS, SHINGLES = 1024, 1 << 20
_ORDERS = [U(pow(0x9E3779B97F4A7C15, 2 * k + 3, 1 << 64)) for k in range(KEYS)]
_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def _round(acc: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _rotate(acc + v * _P2, 31) * _P1


def xxh64(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many spans of one buffer, spans of one length at a time."""
    out = np.empty(len(starts), np.uint64)
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(body) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(body) + 1,), "<u4", padded, strides=(1,))
    size = ends - starts
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    raw = None
    with np.errstate(over="ignore"):
        for length, at, stop in zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            which = order[at:stop]
            if length > 512:
                raw = body.tobytes() if raw is None else raw
                out[which] = [xxhash.xxh64_intdigest(raw[s : s + length], seed) for s in starts[which].tolist()]
                continue
            p, left = starts[which], length
            if length >= 32:
                acc = [np.full(len(p), x, np.uint64) for x in (U(seed) + _P1 + _P2, U(seed) + _P2, U(seed), U(seed) - _P1)]
                while left >= 32:
                    acc = [_round(a, eight[p + 8 * k]) for k, a in enumerate(acc)]
                    p, left = p + 32, left - 32
                h = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
                for a in acc:
                    h = (h ^ _round(np.zeros_like(a), a)) * _P1 + _P4
            else:
                h = np.full(len(p), U(seed) + _P5, np.uint64)
            h = h + U(length)
            while left >= 8:
                h = _rotate(h ^ _round(np.zeros_like(h), eight[p]), 27) * _P1 + _P4
                p, left = p + 8, left - 8
            if left >= 4:
                h = _rotate(h ^ (four[p].astype(np.uint64) * _P1), 23) * _P2 + _P3
                p, left = p + 4, left - 4
            for _ in range(left):
                h = _rotate(h ^ (body[p].astype(np.uint64) * _P5), 11) * _P1
                p = p + 1
            h = (h ^ (h >> U(33))) * _P2
            h = (h ^ (h >> U(29))) * _P3
            out[which] = h ^ (h >> U(32))
    return out


def shingles(data: np.ndarray, off: np.ndarray, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `size` words, repeats included, and each text's bounds.
    A-Z count as lower case; a text of fewer words has one shingle, one without a word none."""
    inside = ~SPACE[data]
    starts, ends, bounds = runs(inside, off)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    length = ends - starts
    word_of = np.repeat(np.arange(len(starts)), length)
    body = np.full(int(length.sum()) + len(starts), 32, np.uint8)  # each word and a space
    body[np.arange(len(word_of)) + word_of] = LOWER[data][inside]
    begin = np.cumsum(length + 1) - length - 1
    n = np.diff(bounds)
    spans = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    edges = np.concatenate([[0], np.cumsum(spans)])
    first = np.arange(edges[-1]) + np.repeat(bounds[:-1] - edges[:-1], spans)
    last = first + np.repeat(np.minimum(n, size) - 1, spans)
    return xxh64(body, begin[first], begin[last] + length[last], seed), edges


def simhashes(data: np.ndarray, off: np.ndarray, size: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text."""
    return _majority(*shingles(data, off, size, seed))


def _majority(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out, spans = np.zeros(len(edges) - 1, np.uint64), np.diff(edges)
    some = spans > 0
    if some.any():
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, edges[:-1][some], axis=0, dtype=np.int32)
        over = (2 * counts > spans[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _least(h: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Of each text, the least hash of its shingles under each order; none without a word."""
    some = np.diff(edges) > 0
    out = np.zeros((len(some), KEYS), np.uint64)
    if some.any():
        for k, order in enumerate(_ORDERS):
            out[some, k] = np.minimum.reduceat(h * order, edges[:-1][some])
    return [row.view(np.int64) if ok else row[:0].view(np.int64) for row, ok in zip(out, some.tolist(), strict=True)]


def distinct(h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted, and their bounds."""
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    h = h[np.lexsort((h, owner))]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[first], np.concatenate([[0], np.cumsum(first)])[edges]


def planes(values: np.ndarray) -> np.ndarray:
    """64 bit planes of n values, 64 values to a word; bits beyond n are 0."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-len(values) // 64) * 64), np.uint8)
    padded[:, : len(values)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def near(differ, shape: tuple[int, ...], radius: int) -> np.ndarray:
    """Words whose bits say which pairs differ in at most `radius` bits.

    differ(bit, rows): for the blocks `rows` (of shape[0] in all), words in which a set bit
    says that a pair differs in that bit.  Carry-save counters hold the distances, `over`
    those that no counter can hold; after every 8 bits, blocks that exceed it are dropped."""
    rows, n = np.arange(shape[0]), radius.bit_length()
    count = [np.zeros(shape, np.uint64) for _ in range(n)]
    over = np.zeros(shape, np.uint64)
    out = np.zeros(shape, np.uint64)

    def exceeded() -> np.ndarray:
        more, same = over.copy(), ~over
        for k in reversed(range(n)):
            if radius >> k & 1:
                same &= count[k]
            else:
                more |= same & count[k]
                same &= ~count[k]
        return more

    for bit in range(64):
        carry = differ(bit, rows)
        for k in range(n):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if bit % 8 == 7 and bit < 63:
            gone = ~exceeded() == 0
            alive = ~(gone if gone.ndim == 1 else gone.all(1))
            if not alive.all():
                rows, over, count = rows[alive], over[alive], [c[alive] for c in count]
                if not len(rows):
                    return out
    out[rows] = ~exceeded()
    return out


def _set_bits(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little")[:n])


def links(prints: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions whose prints lie within radius, of one group each; group is sorted."""
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(edge, len(group)))
    left, right = [], []
    rest = np.repeat(np.where(size <= SMALL, edge + size, 0), size)  # the group's end; 0: a large one
    at = np.arange(len(group))
    lag = 1
    while True:  # all pairs of neighbours at one distance, over all small groups at once
        at = at[at + lag < rest[at]]
        if not len(at):
            break
        p = planes(prints[at] ^ prints[at + lag])
        found = _set_bits(near(lambda b, r, p=p: p[b][r], p[0].shape, radius), len(at))
        left.append(at[found])
        right.append(at[found] + lag)
        lag += 1
    for a, n in zip(edge[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        mine = prints[a : a + n]
        p = planes(mine)
        for lo in range(0, n, 256):
            q = mine[lo : lo + 256]
            ask = lambda b, r, p=p, q=q: p[b][None, :] ^ (U(0) - ((q[r] >> U(b)) & U(1)))[:, None]
            hit = near(ask, (len(q), p.shape[1]), radius)
            row, word = np.nonzero(hit)
            for r in np.unique(row).tolist():
                to = _set_bits(hit[r], n)
                to = to[to > lo + r]
                left.append(np.full(len(to), a + lo + r))
                right.append(a + to)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) between n positions make a spanning forest of least total
    distance: every component takes its nearest link, all at once, until none joins two."""
    root, chosen, left = np.arange(n), [np.zeros(0, np.int64)], np.arange(len(a))
    while True:
        left = left[root[a[left]] != root[b[left]]]
        if not len(left):
            return np.concatenate(chosen)
        rank = (far[left].astype(np.int64) << 40) | left  # a total order, so that no cycle arises
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, root[a[left]], rank)
        np.minimum.at(best, root[b[left]], rank)
        took = np.unique(best[best < np.iinfo(np.int64).max]) & ((1 << 40) - 1)
        chosen.append(took)
        x, y = root[a[took]], root[b[took]]
        while (x != y).any():
            low = np.minimum(x, y)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (root[root] != root).any():
                root = root[root]
            x, y = root[a[took]], root[b[took]]


def by_parts(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, t, k): the buckets in which fingerprints within radius are sure to meet."""
    parts = radius + 2
    ends = [64 * k // parts for k in range(parts + 1)]
    piece = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(ends, ends[1:])]
    tables = [F.struct(F.lit(i).alias("t"), F.xxhash64(F.lit(i), *[piece[k] for k in c]).alias("k")) for i, c in enumerate(combinations(range(parts), 2))]
    return prints.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", "x.t", "x.k")


def linked(keyed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints of buckets (fp, t, k) as all links
    within radius in any bucket would; where there is a column `node`, the edges are of nodes."""
    spark = keyed.sparkSession
    names = ["node", "fp"] if "node" in keyed.columns else ["fp"]
    # a bucket is counted by a partial aggregate, and the join back is one that adaptive
    # execution splits, so that no task holds a large bucket before it is cut into tiles
    keyed = keyed.join(keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["t", "k"])
    tiles = F.ceil(F.col("n") / TILE)
    mine = F.pmod(F.xxhash64(F.lit("tile"), names[0]), tiles)
    keyed = keyed.select(*names, "t", "k", "n", mine.alias("mine"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    keyed = keyed.select(*names, F.xxhash64("t", "k", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"))
    spread = keyed.repartition(width(spark), "g").sortWithinPartitions("g", names[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, fp, g = (np.zeros(0, np.int64) for _ in range(3))

        def done(node: np.ndarray, fp: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
            prints = fp.view(np.uint64)
            a, b = links(prints, g, radius)
            used = forest(len(fp), a, b, np.bitwise_count(prints[a] ^ prints[b]))
            return pa.RecordBatch.from_arrays([pa.array(node[a[used]]), pa.array(node[b[used]])], names=["u", "v"])

        for batch in batches:
            node, fp, g = (np.concatenate([old, batch.column(k).to_numpy()]) for old, k in zip((node, fp, g), (0, len(names) - 1, len(names)), strict=True))
            if len(g) and g[0] != g[-1]:
                cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
                yield done(node[:cut], fp[:cut], g[:cut])
                node, fp, g = node[cut:], fp[cut:], g[cut:]
        if len(g):
            yield done(node, fp, g)
        release()

    return spread.select(*names, "g").mapInArrow(run, "u bigint, v bigint")


def _nodes(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Of each text, a hash of its distinct shingles as they are here, sorted."""
    return np.array([xxhash.xxh64_intdigest(h[i:j].tobytes()) for i, j in zip(edges[:-1], edges[1:], strict=True)], np.uint64).view(np.int64)


def _sets(nodes: DataFrame, each: DataFrame, docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(node, s): the distinct shingles of `nodes`, from the texts of their smallest ids; other
    texts of these ids fall away, and texts without an id are all looked at."""

    def sets(data: np.ndarray, off: np.ndarray) -> tuple:
        h, at = distinct(*shingles(data, off, size))
        return _nodes(h, at), [h[i:j].view(np.int64) for i, j in zip(at[:-1], at[1:], strict=True)]

    ends = nodes.join(each, "node").select(F.col("node").alias("of"), F.col("least").alias("__k"))
    texts = docs.select(F.col(key).alias("__k"), F.col(text).alias("x"))
    known = texts.join(ends, "__k").select("of", "x").unionByName(texts.where("__k is null").select(F.lit(None).cast("bigint").alias("of"), "x"))
    known = annotate(known, "x", ["of"], [("node", "bigint"), ("s", "array<bigint>")], lambda: sets)
    known = known.where("of is null or of = node").select("node", "s").join(nodes, "node", "leftsemi")
    return known.groupBy("node").agg(F.first("s").alias("s"))


def _held(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges whose texts share at least `similarity` of their distinct shingles."""
    pairs = edges.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return pairs.where(common >= similarity * (F.size("a") + F.size("b") - common)).select("u", "v")


def alike(h: np.ndarray, at: np.ndarray, root: np.ndarray, low: np.ndarray, tile: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect the sets h[at[i] : at[i + 1]], of components `root`, as all pairs
    would that share `similarity`; not those of two low sets or, of two tiles, of one."""
    n, size = len(root), np.diff(at)
    owner, alive = np.repeat(np.arange(n), size), np.ones(n, bool)
    _, code, often = np.unique(h, return_inverse=True, return_counts=True)
    while True:  # a set that shares too few of its shingles with all others has no partner
        few = alive & (np.bincount(owner, often[code] > 1, n) < similarity * size)
        if not few.any():
            break
        alive &= ~few
        owner, code = owner[alive[owner]], code[alive[owner]]
        often = np.bincount(code, minlength=len(often))
    if alive.sum() < 2:
        return []
    owner, code = owner[often[code] > 1], code[often[code] > 1]
    post = owner[np.argsort(code, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(often)))])
    mine = np.searchsorted(owner, np.arange(n + 1))
    _, root, members = np.unique(root, return_inverse=True, return_counts=True)
    across = tile.min() != tile.max()
    out = []
    for i in np.argsort(members[root], kind="stable").tolist():  # the smallest components first
        if not alive[i]:
            continue
        alive[i] = False
        may = alive & (root != root[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]))
        if low[i]:
            may &= ~low
        if across:
            may &= tile != tile[i]
        if not may.any():
            continue
        first = begin[code[mine[i] : mine[i + 1]]]
        many = begin[code[mine[i] : mine[i + 1]] + 1] - first
        common = np.bincount(post[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=n)
        hit = np.flatnonzero(may & (common >= similarity * (size[i] + size - common)))
        for other, j in zip(*np.unique(root[hit], return_index=True), strict=True):
            out.append((i, int(hit[j])))
            root[root == other] = root[i]
    return out


def _missed(each: DataFrame, edges: DataFrame, sets_of, similarity: float) -> DataFrame:
    """Edges (u, v) that connect what `edges` leave apart as all links of similar sets would
    that meet in a bucket.  Sets meet by size, too, since similar ones are of one class of
    sizes or of neighbouring ones."""
    spark = each.sparkSession
    root = components(edges).select("node", "root")
    keyed = each.join(root, "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"), F.posexplode("keys").alias("t", "k"))
    of = F.floor(F.log("size") * ((1 - 1e-9) / max(-float(np.log(similarity)), 1e-6)))
    either = F.array(F.struct(of.alias("c"), F.lit(False).alias("low")), F.struct((of + 1).alias("c"), F.lit(True).alias("low")))
    keyed = keyed.withColumn("x", F.explode(either)).select("node", "size", "root", "t", "k", "x.c", "x.low")
    open_ = keyed.groupBy("t", "k", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("low").alias("lows"))
    keyed = stored(keyed.join(open_.where("r0 < r1 and not lows").select("t", "k", "c", "n", "w"), ["t", "k", "c"]), "simhash-open")
    tiles = F.greatest(F.ceil(F.col("n") / SETS), F.ceil(F.col("w") / SHINGLES))
    mine = F.pmod(F.xxhash64(F.lit("tile"), "node"), tiles)
    keyed = keyed.select("node", "root", "low", "t", "k", "c", mine.alias("mine"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    keyed = keyed.select("node", "root", "low", "mine", F.xxhash64("t", "k", "c", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"))
    sets = sets_of(keyed.select("node").distinct())
    spread = keyed.join(sets, "node").repartition(width(spark), "g").sortWithinPartitions("g").select("g", "node", "root", "low", "mine", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: pa.Table) -> pa.RecordBatch:
            node, root, low, tile = (group.column(k).to_numpy() for k in range(1, 5))
            s = group.column(5).combine_chunks()
            at = np.concatenate([[0], np.cumsum(s.value_lengths().to_numpy())])
            made = alike(s.flatten().to_numpy(), at, root, low, tile, similarity)
            return pa.RecordBatch.from_arrays([pa.array(node[[x[k] for x in made]], pa.int64()) for k in range(2)], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]]).tolist()
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and held[0].column(0)[0].as_py() != g[lo]:
                        yield done(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield done(pa.Table.from_batches(held))
        held.clear()
        release()

    return spread.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: Sequence[str] = (), shingle: int = 3, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """The key and the columns `keep` of every row, fingerprint (16 hexadecimal digits) and
    component_id, the smallest key that a row's component holds.

    similarity None: all fingerprints within radius are linked.  Else texts are that share one
    of KEYS least shingles and as large a part of all their distinct shingles; the radius only
    says which of them are tried first."""
    node = "fp" if similarity is None else "node"
    fields = [("fp", "bigint")] + ([] if similarity is None else [("node", "bigint"), ("keys", "array<bigint>"), ("size", "bigint")])

    def prints_of(data: np.ndarray, off: np.ndarray) -> tuple:
        h, edges = shingles(data, off, shingle)
        fp = _majority(h, edges).view(np.int64)
        if similarity is None:
            return (fp,)
        h, edges = distinct(h, edges)
        return fp, _nodes(h, edges), _least(h, edges), np.diff(edges)

    prints = stored(annotate(docs, text, [key, *keep], fields, lambda: prints_of), "simhash-prints")
    # null keys are never the smallest
    first = [F.min(key).alias("least")] + ([] if similarity is None else [F.min_by(c, F.struct(F.col(key).isNull(), F.col(key))).alias(c) for c in ("fp", "keys", "size")])
    each = stored(prints.groupBy(node).agg(*first, F.count(F.lit(1)).alias("n")), "simhash-distinct")
    if similarity is None:
        edges = linked(by_parts(each, radius), radius)
    else:
        edges = linked(each.select("node", "fp", F.posexplode("keys").alias("t", "k")), radius)
        sets_of = lambda nodes: _sets(nodes, each, docs, text, key, shingle)
        edges = stored(edges.distinct(), "simhash-edges")
        ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
        edges = stored(_held(edges, sets_of(ends), similarity), "simhash-held")
        edges = edges.unionByName(_missed(each, edges, sets_of, similarity))
    root = components(edges)
    of = each.join(root.select(F.col("node").alias(node), "root"), node, "left").select(node, "least", "n", F.coalesce("root", node).alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members"))
    of = of.join(least.where("members > 1"), "root").select(node, "component_id")
    out = prints.join(of, node, "left")
    return out.select(key, *keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", key).alias("component_id"))
