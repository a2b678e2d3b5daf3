"""Relevance evaluation of rankings: (query_id, position, doc_id) against marks (query_id,
doc_id).  Every query is evaluated at once, by windows over its own ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

POINTS = 11


def ratio(a: Column, b: Column) -> Column:
    """A quotient that is 0 where the denominator is."""
    return F.when(b != 0, a.cast("double") / b).otherwise(0.0)


def judged(ranking: DataFrame, marks: DataFrame) -> DataFrame:
    """The ranking with relevant, and the number i of relevant ones so far."""
    flags = marks.select("query_id", "doc_id").distinct().withColumn("__r", F.lit(1))
    rows = ranking.join(flags, ["query_id", "doc_id"], "left").withColumn("relevant", F.coalesce("__r", F.lit(0))).drop("__r")
    so_far = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("i", F.sum("relevant").over(so_far))


def cuts(ranking: DataFrame, marks: DataFrame) -> DataFrame:
    """(query_id, position, recall, precision) at every relevant hit."""
    total = marks.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("total_relevant"))
    hits = judged(ranking, marks).where("relevant = 1").join(total, "query_id")
    return hits.select("query_id", "position", (F.col("i") / F.col("total_relevant")).alias("recall"), (F.col("i") / F.col("position")).alias("precision"))


def metrics(ranking: DataFrame, marks: DataFrame) -> DataFrame:
    """One row a query that has relevant documents."""
    total = marks.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("total_relevant"))
    hits = judged(ranking, marks).join(total, "query_id")
    at = lambda k: F.sum(F.when(F.col("position") <= k, F.col("relevant")).otherwise(0))
    row = hits.groupBy("query_id", "total_relevant").agg(
        F.count(F.lit(1)).alias("total_found"),
        F.sum("relevant").alias("found_relevant"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("relevant") == 1, F.col("position")))), lambda x: x.cast("int")).alias("relevant_positions"),
        (F.sum(F.when(F.col("relevant") == 1, F.col("i") / F.col("position")).otherwise(0.0)) / F.col("total_relevant")).alias("avg_prec"),
        (at(5) / 5).alias("p5"),
        (at(10) / 10).alias("p10"),
        (at(F.col("total_relevant")) / F.col("total_relevant")).alias("r_prec"),
    )
    row = total.join(row.drop("total_relevant"), "query_id", "left")
    row = row.fillna(0, ["total_found", "found_relevant"]).fillna(0.0, ["avg_prec", "p5", "p10", "r_prec"]).withColumn("relevant_positions", F.coalesce("relevant_positions", F.array().cast("array<int>")))
    recall, precision = ratio(F.col("found_relevant"), F.col("total_relevant")), ratio(F.col("found_relevant"), F.col("total_found"))
    row = row.withColumn("recall", recall).withColumn("precision", precision).withColumn("f_measure", ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))
    return row.join(curves(ranking, marks).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "precision"))), lambda x: x["precision"]).alias("pr_curve")), "query_id", "left")


def curves(ranking: DataFrame, marks: DataFrame) -> DataFrame:
    """(query_id, level, precision): the largest precision at a recall of level / 10 or more."""
    queries = marks.select("query_id").distinct()
    levels = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("level"))
    found = cuts(ranking, marks)
    # the highest level that a cut reaches; then the largest precision from a level on
    reached = found.withColumn("level", F.floor(F.col("recall") * (POINTS - 1) + 1e-9).cast("int")).groupBy("query_id", "level").agg(F.max("precision").alias("p"))
    on = Window.partitionBy("query_id").orderBy("level").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return levels.join(reached, ["query_id", "level"], "left").select("query_id", "level", F.coalesce(F.max("p").over(on), F.lit(0.0)).alias("precision"))


def macro(rows: DataFrame) -> DataFrame:
    """Means over queries, null if there are none."""
    names = ["recall", "precision", "f_measure", "avg_prec", "p5", "p10", "r_prec"]
    return rows.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(n).alias(n) for n in names])


def micro(rows: DataFrame) -> DataFrame:
    """A10: precision, recall and F of the sums over queries."""
    s = rows.agg(F.sum("found_relevant").alias("a"), F.sum("total_found").alias("ab"), F.sum("total_relevant").alias("ac"))
    s = s.select(ratio(F.col("a"), F.col("ab")).alias("micro_precision"), ratio(F.col("a"), F.col("ac")).alias("micro_recall"))
    return s.withColumn("micro_f", ratio(2 * F.col("micro_precision") * F.col("micro_recall"), F.col("micro_precision") + F.col("micro_recall")))


def mean_curve(rows: DataFrame) -> DataFrame:
    """Means of the curves of POINTS points, level by level; zeros if there is none."""
    each = rows.where(F.size("pr_curve") == POINTS).select(F.posexplode("pr_curve").alias("level", "p")).groupBy("level").agg(F.avg("p").alias("p"))
    levels = rows.sparkSession.range(POINTS).select(F.col("id").cast("int").alias("level"))
    return levels.join(each, "level", "left").select("level", F.coalesce("p", F.lit(0.0)).alias("precision"))
