"""Adding columns computed from whole texts, one streaming pass without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpuscube.llm.spans import CHUNK, chunks, release
from corpuscube.llm.tables import stored

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def annotate(df: DataFrame, text: str, keep: Sequence[str] | None, fields: Sequence[tuple[str, str]], make: Callable, limit: int = CHUNK, most: int = 1 << 30) -> DataFrame:
    """The columns `keep` of df (all if None) and `fields` ((name, SQL type) pairs).

    make() runs once a task and returns f(data, off), which gives each field's values for
    a chunk of whole texts; a null text counts as empty.  A kept column that has a
    field's name is replaced by the field.
    """
    names = {n for n, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*kept, F.col(text).cast("string").alias("__text" + "_" * max([0, *map(len, kept)])))
    schema = T.StructType([*(source.schema[c] for c in kept), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])
    kinds = [ARROW[t] for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(len(kept)), limit, most):
                made = [pa.array(x, k) for x, k in zip(f(data, off), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(len(kept))] + made, names=[*kept, *(n for n, _ in fields)])
            del batch
            release()

    return source.mapInArrow(run, schema)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by: the folds that classifiers hold out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def bounded(labelled: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows of labelled at most, chosen by a hash of the key; all of them if
    they are fewer.  The choice depends on the keys alone."""
    n = labelled.count()
    if n <= most:
        return labelled
    share = int((1 << 40) * (most - 3 * most**0.5) / n)
    return labelled.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 40)) < share)


def lessons(docs: DataFrame, picked: DataFrame, text: str, key: str, most_bytes: int) -> DataFrame:
    """(o, x, y): what a classifier learns from: the texts of the picked keys (key, y), in the
    order o of their keys' hashes, up to `most_bytes` bytes in all; at least the first text.
    picked has a bounded number of rows, and is broadcast."""
    order = F.xxhash64(F.lit("order"), key)
    rows = docs.select(key, F.col(text).cast("string").alias("x")).join(F.broadcast(picked), key)
    rows = stored(rows.select(order.alias("o"), "x", "y"), "lessons")
    size = rows.groupBy("o").agg(F.sum(F.coalesce(F.octet_length("x"), F.lit(0))).alias("b"))
    upto = F.sum("b").over(Window.orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    size = size.withColumn("upto", upto)  # as many rows as were picked, at most
    last = size.where((F.col("upto") <= most_bytes) | (F.col("upto") == F.col("b"))).agg(F.max("o")).first()[0]
    return rows.where(F.col("o") <= F.lit(last))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
