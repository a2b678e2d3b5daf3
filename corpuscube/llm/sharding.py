"""Sharding by histogram sort, in DataFrame operations.

Rows are ordered by a hash of the text, then one of the key, so equal texts lie together.
Shard boundaries are sought in that order: each round counts the exact bytes below evenly
spaced probes within the intervals that still hold a boundary, on all partitions, and
keeps the interval around each target, until a probe meets the tolerance.  Boundaries fall
between groups of equal texts where one is near enough and cut a group only where it is
larger than that.  Then one exchange moves the rows.

Rounds read a stored table of three numbers a row.  What the driver sees of each round is
bounded by the shards and PROBES.  Slots are numbered in cells, slices of a shard by
hash, and a cell with many copies of one text is sliced by the key, so no task numbers a shard.

Defined results: a null text is an empty one, of size 1.  Rows that agree in text and key
share a shard.  Shards can be empty if there are fewer rows than shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscube.llm.tables import stored

#: Probes a round over all intervals together; cells that numbering uses.
PROBES = 1 << 16
CELL_BITS = 12
SLICE_BITS = 6
WIDTH = 63


def _bits(column: Column, n: int) -> Column:
    """The first n of the WIDTH bits of a key."""
    return F.shiftrightunsigned(column, WIDTH - n)


def order_keys(text: Column, key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1), F.shiftrightunsigned(F.xxhash64(F.lit("key"), key), 1)


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.01) -> list[tuple[int, int]]:
    """(k1, k2) from which on a row belongs to the next shard, shards - 1 of them, for keys
    (k1, k2, size).  tolerance: of a shard's ideal size."""
    per_round = max(2, PROBES.bit_length() - 1 - max(1, shards - 1).bit_length())
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    found: dict[int, tuple[int, int]] = {}
    # boundary -> (k1 of the group searched or None, its prefix, the prefix's bits, bytes below the interval)
    open_at = {j: (None, 0, 0, 0) for j in range(1, shards)}
    while open_at:
        rows = None
        for group, depth in {(v[0] is not None, v[2]) for v in open_at.values()}:
            here = {v[:3] for v in open_at.values() if (v[0] is not None, v[2]) == (group, depth)}
            bits = min(WIDTH, depth + per_round)
            column = F.col("k2" if group else "k1")
            inside = keys
            if group:
                inside = inside.where(F.col("k1").isin([h[0] for h in here]))
            if depth:
                inside = inside.where(_bits(column, depth).isin([h[1] for h in here]))
            part = inside.groupBy((F.col("k1") if group else F.lit(None).cast("bigint")).alias("g"), _bits(column, bits).alias("at")).agg(F.sum("size").alias("b"), F.min(column).alias("lo"), F.max(column).alias("hi")).withColumn("bits", F.lit(bits))
            rows = part if rows is None else rows.unionByName(part)
        seen: dict[tuple, list] = {}
        for r in rows.collect():
            seen.setdefault((r["g"], r["bits"]), []).append((r["at"], r["b"], r["lo"], r["hi"]))
        for v in seen.values():
            v.sort()
        following = {}
        for j, (group, prefix, depth, below) in open_at.items():
            bits = min(WIDTH, depth + per_round)
            goal, slack = j * total / shards, tolerance * total / shards
            bins = [x for x in seen.get((group, bits), []) if depth == 0 or x[0] >> (bits - depth) == prefix]
            for at, size, lo, hi in bins:
                if below + size >= goal:
                    break
                below += size
            else:  # no rows at all
                found[j] = (0, 0)
                continue
            edge = lambda k: (group, k) if group is not None else (k, 0)
            down, rise = goal - below, below + size - goal
            if min(down, rise) <= slack or (group is not None and lo == hi):
                found[j] = edge(lo) if down <= rise else edge(hi + 1)
            elif group is None and lo == hi:
                following[j] = (lo, 0, 0, below)
            else:
                following[j] = (group, at, bits, below)
        open_at = following
    return [found[j] for j in range(1, shards)]


def shard_of(k1: Column, k2: Column, at: list[tuple[int, int]]) -> Column:
    """How many boundaries lie at or below a row."""
    if len(at) <= 64:
        out = F.lit(0)
        for a, b in at:
            out = out + ((k1 > a) | ((k1 == a) & (k2 >= b))).cast("int")
        return out
    edges = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in at])
    return F.size(F.filter(edges, lambda e: (k1 > e["a"]) | ((k1 == e["a"]) & (k2 >= e["b"]))))


def shard(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", tolerance: float = 0.01) -> DataFrame:
    """The rows of docs with size (UTF-8 bytes of the text and one more), text_crc32, shard
    and slot (gapless from 0 within a shard).  Input columns with these names are replaced."""
    made = ["size", "text_crc32", "shard", "slot"]
    body = F.coalesce(docs[text], F.lit(""))
    k1, k2 = order_keys(docs[text], docs[key])
    size = (F.octet_length(body) + 1).cast("bigint")
    keys = stored(docs.select(k1.alias("k1"), k2.alias("k2"), size.alias("size")), "sharding-keys")
    at = splitters(keys, shards, tolerance)
    cells = keys.groupBy(_bits(F.col("k1"), CELL_BITS).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
    usual = sum(r["n"] for r in cells) / (1 << CELL_BITS)
    hot = [r["cell"] for r in cells if r["n"] > max(1000, 4 * usual)]

    def placed(df: DataFrame) -> DataFrame:
        cell = _bits(F.col("__k1"), CELL_BITS)
        slice_ = F.when(cell.isin(hot), _bits(F.col("__k2"), SLICE_BITS)).otherwise(F.lit(0)) if hot else F.lit(0).cast("bigint")
        return df.withColumn("shard", shard_of(F.col("__k1"), F.col("__k2"), at)).withColumn("__cell", cell * (1 << SLICE_BITS) + slice_)

    counts = placed(keys.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))).groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    # at most (2**CELL_BITS + shards) cells, and 2**SLICE_BITS times the hot ones, which are under a quarter of all
    offsets = counts.select("shard", "__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    rows = docs.select(*[c for c in docs.columns if c not in made], size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), k1.alias("__k1"), k2.alias("__k2"))
    numbered = placed(rows).withColumn("__at", F.row_number().over(Window.partitionBy("shard", "__cell").orderBy("__k1", "__k2", key)) - 1)
    out = numbered.join(offsets, ["shard", "__cell"])
    return out.select(*rows.columns[:-2], F.col("shard").cast("int").alias("shard"), (F.col("__before") + F.col("__at")).cast("bigint").alias("slot"))
