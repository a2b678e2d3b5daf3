"""Incremental upkeep of an index and of a fact table.

The batch operators rebuild from scratch; here documents or facts come as a stream.  Term
counts are appended as they come, the dictionary is derived from them when read, and facts
are merged by key with the last one winning, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscube.operators import cube as cb, retrieval as rt


def index_stream(docs: DataFrame, path: str, checkpoint: str, stems: bool = False) -> StreamingQuery:
    """Append each micro-batch's term counts under `path`; a batch that is run again after a
    failure overwrites its own part."""

    def add(batch: DataFrame, number: int) -> None:
        rt.term_counts(batch, stems=stems).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}.docs/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """terms and postings of all that has come so far."""
    counts = spark.read.parquet(path).drop("batch")
    n = spark.read.parquet(f"{path}.docs").agg(F.sum("n").alias("n"))
    vocabulary = rt.terms(counts, n)
    return vocabulary, rt.postings(counts, vocabulary)


def latest_facts(facts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merge facts (with seq) into a table under `path`: the last of a key stays.  Each batch writes
    a whole new version beside the old one and the newest is read."""
    spark = facts.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = batch
        if number > 0:
            new = spark.read.parquet(f"{path}/version={number - 1}").unionByName(batch)
        cb.dedupe_last(new).write.mode("overwrite").parquet(f"{path}/version={number}")

    return facts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums by type in windows of event time; rows later than `late` are dropped and the
    state of older windows is freed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
