"""Connected components of a graph held in a table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuscube.llm.tables import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v) that is not its component's smallest.

    Every round links each node's larger neighbours, then its smaller ones, to the smallest
    node it sees; the number of rounds grows with the logarithm of a component's size.  A
    node's smallest neighbour comes from a partial aggregate and is joined back: what a node
    with very many neighbours brings to one partition of that join, adaptive execution splits
    (spark.sql.adaptive.skewJoin, on unless it is switched off)."""
    larger = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(larger(edges), "graph")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = stored(larger(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "graph-large")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(larger(linked.unionByName(least.select("u", F.col("m").alias("v")))), "graph-small")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
