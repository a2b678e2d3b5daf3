"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations.

Every document of a source is wanted target / source_size times: some whole copies and a
fractional one.  The fractional copies of a source are settled in blocks of at most BLOCK
documents.  A fold over a block keeps one fractional document, the carry; it meets the
next one, and mass moves between the two at random, by words, until one of them is whole,
so that both keep their chances and the block keeps its words.  What is left of each block
goes up to the next level, and the levels form a reduction tree.  The last carry of a source
is drawn by its chance.  Blocks begin with their largest documents, so that it is seldom one
of those, and the target is missed by little.

Shuffles move (key, source, size) rows only.  A large source is salted, so no task holds
more than about SALT documents of one source at a level.

Defined results: null texts have size 0.  A null source is a source of its own, the last
one.  A document without words gets the whole copies alone.  Rows that agree in key,
source and size are settled together.  If all sizes are 0 all targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscube.llm.ranges import running
from corpuscube.llm.tables import stored

BLOCK = 60
SALT = 4000
#: Source tables up to so many rows are broadcast; larger ones are joined by a shuffle.
FEW = 50_000
_WORD = r"[^\x20\x09-\x0D]+"

#: c: the state (m: bits of documents rounded up, k: position, i: the carry's position, p:
#: its chance, s: its words); x: the next document.  `up`: the carry gains.
_GAIN = "least(1D - c.p, x.p * x.s / c.s)"
_LOSS = "least(c.p, (1D - x.p) * x.s / c.s)"
_SET = "c.m | shiftleft(1L, {})"


def _state(m: str = "c.m", i: str = "-1", p: str = "0D", s: str = "1D") -> str:
    return f"named_struct('m', {m}, 'k', c.k + 1, 'i', {i}, 'p', {p}, 's', {s})"


def _carried(p: str, whole: str, gone: str, i: str, s: str, m: str) -> str:
    """The state in which document i goes on with chance p, if p is still fractional."""
    return f"CASE WHEN {p} > 1D - 1e-9 THEN {whole} WHEN {p} < 1e-9 THEN {gone} ELSE {_state(m, i, p, s)} END"


def _fold() -> Column:
    carry, this = _SET.format("c.i"), _SET.format("c.k")
    both = f"{carry} | shiftleft(1L, c.k)"
    gains_whole = _carried("(x.p - (1D - c.p) * c.s / x.s)", _state(both), _state(carry), "c.k", "x.s", carry)
    gains_part = _carried("(c.p + x.p * x.s / c.s)", _state(carry), _state(), "c.i", "c.s", "c.m")
    loses_whole = _carried("(x.p + c.p * c.s / x.s)", _state(this), _state(), "c.k", "x.s", "c.m")
    loses_part = _carried("(c.p - (1D - x.p) * x.s / c.s)", _state(both), _state(this), "c.i", "c.s", this)
    return F.expr(
        f"""aggregate(a, named_struct('m', 0L, 'k', 0, 'i', -1, 'p', 0D, 's', 1D), (c, x) -> CASE
        WHEN c.i < 0 THEN {_state('c.m', 'c.k', 'x.p', 'x.s')}
        WHEN x.u * ({_GAIN} + {_LOSS}) < {_LOSS} THEN CASE WHEN 1D - c.p <= x.p * x.s / c.s THEN {gains_whole} ELSE {gains_part} END
        WHEN c.p <= (1D - x.p) * x.s / c.s THEN {loses_whole}
        ELSE {loses_part} END)"""
    )


def word_count(text: Column) -> Column:
    """Words: runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def targets(totals: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """Of each (source, source_size): its target.  Sources by code point, null last, weigh
    `weights`, repeating; targets share `share` of all sizes and stop at `limit` times the
    source's own, the excess going to the others by weight.  So a target is the smaller of
    its bound and weight times one common level, which ordering the sources by bound per
    weight finds: the first level that stays below its own source's bound."""
    ranked = running(totals, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    by = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    row = ranked.withColumn("w", by).withColumn("cap", limit * F.col("source_size").cast("double")).withColumn("r", F.col("cap") / F.col("w"))
    row = running(row, [F.col("r"), F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "ws": F.col("w")})
    whole = row.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    level = (share * F.col("all_size").cast("double") - F.col("caps")) / (F.col("all_w") - F.col("ws"))
    row = row.crossJoin(F.broadcast(whole)).withColumn("level", level)
    common = row.where("level <= r").agg(F.min_by("level", F.struct("r", F.col("source").isNull(), "source")).alias("common"))
    row = row.crossJoin(F.broadcast(common))  # one row
    return row.select("source", "source_size", "n", F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("w"), F.col("cap"))).alias("target"))


def _level(items: DataFrame, level: int, seed: int) -> DataFrame:
    """Settle items (key, source, size, s, p, salts) within blocks; one row a block."""
    ident = [F.col("key").cast("string"), F.col("source"), F.col("size")]
    items = items.withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(f"pivot {seed} {level}"), *ident), 11) * 2.0**-53)
    items = items.withColumn("salt", F.pmod(F.xxhash64(F.lit(f"salt {seed} {level}"), *ident), F.col("salts")))
    part = Window.partitionBy("source", "salt")
    rank = F.row_number().over(part.orderBy(F.col("s").desc(), "u", "key", "size")) - 1
    block = rank % F.ceil(F.count(F.lit(1)).over(part) / BLOCK)
    one = F.struct((-F.col("s")).alias("o"), "u", "key", "size", "s", "p")
    blocks = items.withColumn("block", block).groupBy("source", "salt", "block").agg(F.array_sort(F.collect_list(one)).alias("a"))
    return blocks.select("source", "a", _fold().alias("c"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0, seed: int = 1, keep: Sequence[str] | None = None) -> DataFrame:
    """The rows of docs, with the columns `keep` (all if None), and size, source_size, target and
    copies: how often the mix takes each.  Kept columns with these names are replaced.  Where
    `keep` leaves the text out, texts are read once."""
    made = ["size", "source_size", "target", "copies"]
    others = [c for c in (docs.columns if keep is None else keep) if c not in made]
    plain = [docs[c] for c in dict.fromkeys([*others, key, source])]
    sized = docs.select(*plain, word_count(docs[text]).alias("size"))
    if text not in others:
        sized = stored(sized, "mixing-sized")
    items = stored(sized.groupBy(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), "size").agg(F.count(F.lit(1)).alias("c")), "mixing-sizes")
    totals = items.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = stored(targets(totals, weights, share, limit), "mixing-targets")
    most, sources = goal.agg(F.max("n"), F.count(F.lit(1))).first()
    near = F.broadcast(goal) if sources <= FEW else goal
    chance = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(chance + 1e-9)
    want = near.select(F.col("source").alias("of"), F.col("source_size"), "n", F.col("target"), whole.alias("whole"), (chance - whole).alias("p"))
    left = items.join(want, items["source"].eqNullSafe(want["of"])).where((F.col("size") > 0) & (F.col("p") > 1e-9))
    left = left.select("key", "source", "size", (F.col("size") * F.col("c")).cast("double").alias("s"), "p", F.ceil(F.col("n") / SALT).alias("salts"))
    up, level, most = [], 0, most or 0
    while True:
        done = stored(_level(left, level, seed), f"mixing-level{level}")
        each = done.select("source", "c", F.posexplode("a").alias("at", "x")).where(F.col("at") != F.col("c.i"))
        up.append(each.where(F.expr("shiftrightunsigned(c.m, at) & 1 = 1")).select(F.col("x.key").alias("key"), "source", F.col("x.size").alias("size")))
        carry = F.element_at("a", F.when(F.col("c.i") >= 0, F.col("c.i") + 1))
        rest = done.where(F.col("c.i") >= 0).select("source", carry.alias("x"), "c")
        left = rest.select(F.col("x.key").alias("key"), "source", F.col("x.size").alias("size"), F.col("x.s").alias("s"), F.col("c.p").alias("p"))
        if most <= BLOCK:
            drawn = F.shiftrightunsigned(F.xxhash64(F.lit(f"last {seed}"), F.col("key").cast("string"), "source", "size"), 11) * 2.0**-53
            up.append(left.where(drawn < F.col("p")).select("key", "source", "size"))
            break
        counts = left.groupBy("source").agg(F.count(F.lit(1)).alias("m"))
        most = counts.agg(F.max("m")).first()[0] or 0
        counts = F.broadcast(counts) if sources <= FEW else counts
        counts = counts.select(F.col("source").alias("of"), F.ceil(F.col("m") / SALT).alias("salts"))
        left = left.join(counts, left["source"].eqNullSafe(counts["of"])).drop("of")
        level += 1
    rounded = reduce(DataFrame.unionByName, up).select(F.col("key").alias("__key"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.lit(1).alias("__up"))
    told = near.select(F.col("source").alias("__of"), "source_size", "target", whole.alias("__whole"))
    out = sized.join(told, sized[source].cast("string").eqNullSafe(told["__of"]))
    at = out[key].eqNullSafe(rounded["__key"]) & out[source].cast("string").eqNullSafe(rounded["__source"]) & (out["size"] == rounded["__size"])
    out = out.join(rounded, at, "left")
    return out.select(*others, "size", "source_size", "target", (F.col("__whole") + F.coalesce("__up", F.lit(0))).cast("int").alias("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as its `copies` says."""
    return mixed.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
