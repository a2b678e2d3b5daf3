"""Exact top-k search by distributed histogram selection.

Vectors become integers, x to floor(256 x), so scores are exact.  Queries are taken in blocks
of a bounded size, which are sent to every task; candidates stay where they are read and are
scored by matrix products, a few rows at a time.  Each round sends the counts of scores in
bins of each query's open interval; the global histogram tells in which bin the kth score
lies, and that bin is the next interval, until it is one integer wide.  A last pass sends
the scores above the kth one and, of those equal to it, the smallest ids that still fit.

No vector is shuffled and no scores are kept; a task sends, of a query, the bins that its own
k best scores lie in and at last k rows at most, also where thousands of candidates tie.

Defined results: vectors that are null or hold a null or non-finite component, and rows
without an id, take no part.  A query meets candidates of its own length only, and none
that has its id.  Ids repeated among the queries ask once, with the smallest vector; an id
repeated among the candidates is found once for each row.  An input column named `id`, `v` or
`d` is no hindrance.  Scores are held within +-(2**62 - 1).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpuscube.llm.tables import stored

#: Of a block of queries: rows and numbers at most, about; candidates that are scored at a time.
QUERIES, NUMBERS, CANDIDATES = 4096, 1 << 22, 1024
MOST = (1 << 62) - 1


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, v in double."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("bigint").alias("id"), v.alias("v"))


def _integers(column: pa.Array) -> np.ndarray:
    """One row a vector, all of one length; int64 if 256 x fits, else Python's own integers."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False) * 256.0)
    x = x.astype(np.int64) if not len(x) or np.abs(x).max() < 2.0**62 else np.array([int(y) for y in x], object)
    return x.reshape(len(column), -1)


def score(q: np.ndarray, c: np.ndarray, small: bool) -> np.ndarray:
    """Exact inner products.  small: no sum of products reaches 2**53, so doubles are exact."""
    if small:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k best rows of df for each row of queries, or all if
    they are fewer; equal scores in order of id."""
    rows = usable(df, key, vector)
    asked = usable(queries, key, vector).groupBy(F.col("id"), F.size("v").alias("d")).agg(F.min("v").alias("v"))
    asked = stored(asked.groupBy("id").agg(F.min(F.struct("d", "v")).alias("x")).select("id", "x.d", "x.v"), "topk-queries")
    norm = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + F.floor(y * 256).cast("double") ** 2)
    longest = rows.agg(F.max(norm(F.col("v")))).first()[0]
    n_asked, longest_asked, widest = asked.agg(F.count(F.lit(1)), F.max(norm(F.col("v"))), F.max("d")).first()
    bound = min(MOST, math.ceil(math.sqrt((longest or 0.0) * (1 + 1e-6)) * math.sqrt((longest_asked or 0.0) * (1 + 1e-6))) + 1)
    blocks = max(1, -(-n_asked // max(1, min(QUERIES, NUMBERS // max(1, widest or 1)))))
    found = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)) == b)
        part = _of_block(rows, mine.orderBy("d", "id").toArrow(), k, bound)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _of_block(rows: DataFrame, block: pa.Table, k: int, bound: int) -> DataFrame:
    """(query_id, id, score) of each task's candidates that may be among the k best."""
    spark, small = rows.sparkSession, bound < 1 << 52
    block = block.combine_chunks()
    ids, width = block["id"].to_numpy(), block["d"].to_numpy()
    cuts = np.append(np.flatnonzero(np.diff(width, prepend=-1)), len(width)).tolist()
    groups = {int(width[i]): (i, _integers(block["v"].slice(i, j - i).combine_chunks())) for i, j in zip(cuts, cuts[1:])}
    queries = spark.sparkContext.broadcast(groups)
    bits = (2 * bound + 1).bit_length()
    rounds = max(1, -(-bits // 9))
    step = -(-bits // rounds)
    lo, need = np.full(len(ids), -bound, np.int64), np.full(len(ids), k, np.int64)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(the first query, the one after the last, candidates' ids, scores), a few at a time."""
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(at, CANDIDATES)
                sizes = part.column(1).value_lengths().to_numpy()
                for d in np.unique(sizes).tolist():
                    if d in queries.value:
                        some = part.filter(pa.array(sizes == d))
                        first, q = queries.value[d]
                        yield first, first + len(q), some.column(0).to_numpy(), score(q, _integers(some.column(1)), small)

    for r in range(rounds):
        # the interval [lo, lo + wide) of a query is cut into bins of `bin_` integers
        wide, bin_ = 1 << (step * (rounds - r)), 1 << (step * (rounds - r - 1))

        def count(batches: Iterator[pa.RecordBatch], lo=lo, need=need, wide=wide, bin_=bin_) -> Iterator[pa.RecordBatch]:
            bins = wide // bin_
            n = np.zeros((len(ids), bins), np.int64)
            for i, j, other, s in scored(batches):
                at = s - lo[i:j, None]
                fits = (ids[i:j, None] != other[None, :]) & (at >= 0) & (at < wide)
                flat = (at // bin_ + np.arange(j - i)[:, None] * bins)[fits]
                n[i:j] += np.bincount(flat, minlength=(j - i) * bins).reshape(j - i, bins)
            above = np.cumsum(n[:, ::-1], 1)[:, ::-1] - n  # in higher bins of this task
            q, b = np.nonzero((n > 0) & (above < need[:, None]))  # lower bins can't hold the kth
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(n[q, b])], names=["q", "bin", "n"])

        bins = rows.mapInArrow(count, "q bigint, bin bigint, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        ordered = bins.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("x"))
        # the first bin from above at which the count reaches what is needed: a row a query, at most
        needs = F.element_at(F.lit(need.tolist()), (F.col("q") + 1).cast("int"))
        so_far = lambda s, y: F.when(s["sum"] >= needs, s).otherwise(F.struct((s["sum"] + y["n"]).alias("sum"), y["bin"].alias("bin"), s["sum"].alias("above")))
        start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("above"))
        at = ordered.select("q", needs.alias("needs"), F.aggregate("x", start, so_far).alias("s")).where("s.sum >= needs").select("q", "s.bin", "s.above")
        told = at.toArrow()
        lo_, need_ = np.full(len(ids), -MOST - 1, np.int64), need.copy()  # with fewer than k candidates all are taken
        q = told["q"].to_numpy()
        lo_[q] = lo[q] + told["bin"].to_numpy() * bin_
        need_[q] = need[q] - told["above"].to_numpy()
        lo, need = lo_, need_

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lo: the kth score; need: how many scores equal to it belong to the k best."""
        parts = [[np.zeros(0, np.int64)] * 3]
        for i, j, other, s in scored(batches):
            fits = (ids[i:j, None] != other[None, :]) & (s >= lo[i:j, None])
            q, c = np.nonzero(fits)
            parts.append([q + i, other[c], s[q, c]])
            if sum(len(p[0]) for p in parts) > 16 * (k + 1) * len(ids):
                parts = [best(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
        q, c, s = best(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(c), pa.array(s)], names=["query_id", "id", "score"])

    def best(q: np.ndarray, c: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
        by = np.lexsort((c, -s, q))
        q, c, s = q[by], c[by], s[by]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return [q[first], c[first], s[first]]

    return rows.mapInArrow(keep, "query_id bigint, id bigint, score bigint")
