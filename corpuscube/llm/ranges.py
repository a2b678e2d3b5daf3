"""Ranges of an ordering key that hold about equal row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscube.llm.tables import stored


#: Bounds up to so many become nested comparisons; beyond, a search in an array of them.
NESTED = 512


def bisect(of: Column, bounds: list[int]) -> Column:
    """How many bounds lie at or below a number."""
    if len(bounds) > NESTED:
        listed = F.lit(bounds)
        half = lambda s: F.shiftright(s["lo"] + s["hi"] + 1, 1)
        step = lambda s, _: F.when(F.element_at(listed, F.greatest(half(s), F.lit(1))) <= of, F.struct(half(s).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), F.greatest(half(s) - 1, F.lit(0)).alias("hi")))
        start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, step, lambda s: s["lo"])
    return _nested(of, bounds, 0)


def _nested(of: Column, bounds: list[int], lo: int) -> Column:
    if not bounds:
        return F.lit(lo)
    at = len(bounds) // 2
    return F.when(of < bounds[at], _nested(of, bounds[:at], lo)).otherwise(_nested(of, bounds[at + 1 :], lo + at + 1))


def bounds(rows: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 bounds of ranges with about equally many rows."""
    if parts < 2:
        return []
    return sorted({int(x) for x in rows.approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts)})


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows and, for each name, the sum of that column over the rows before in this total
    order.  Rows are sorted within ranges; only one row a range is brought together."""
    at, before = Window.partitionBy("__p").orderBy(*order), Window.unboundedPreceding
    ranged = rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    ranged = stored(ranged.select("*", *[F.sum(c).over(at.rowsBetween(before, -1)).alias(f"__{n}") for n, c in sums.items()]), "running")
    parts = ranged.groupBy("__p").agg(*[F.sum(c).alias(f"__all_{n}") for n, c in sums.items()])
    far = Window.orderBy("__p").rowsBetween(before, -1)
    parts = parts.select("__p", *[F.coalesce(F.sum(f"__all_{n}").over(far), F.lit(0)).alias(f"__far_{n}") for n in sums])
    out = ranged.join(F.broadcast(parts), "__p")
    return out.select(*rows.columns, *[(F.col(f"__far_{n}") + F.coalesce(f"__{n}", F.lit(0))).alias(n) for n in sums])
