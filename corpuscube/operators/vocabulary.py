"""Document frequencies and idf of words, brought to the documents without shuffling postings.

Words are counted where a text is read, in Python, a text at a time.  Document frequencies are
summed and written once.  The most frequent words, up to FREQUENT of them, go to every task;
nearly all of the postings are theirs.  Only the postings of rarer words are joined by a shuffle.

Rows that share an id are one document, whose words are counted together by a shuffle; documents
of one row, and those are known by a count of ids, need none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpuscube.session import scratch

#: Words that go to every task; words that are counted together in a task; rows that leave it at once.
FREQUENT, TOGETHER, ROWS = 1 << 18, 1 << 17, 1 << 15
#: Bytes of texts in a batch on its way to Python.
BATCH_BYTES = 8 << 20

#: The counts of one row's words, from its text and its language.
Count = Callable[[str | None, str | None], Mapping[str, int]]


def small_batches(spark) -> None:
    """Batches of whole texts on their way to Python hold BATCH_BYTES at most, so that a worker's
    memory does not depend on how long texts are.  Plans are run later, so the setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, str(2**31 - 1))
    if now.isdigit() and int(now) > BATCH_BYTES:  # "16m" and the like are a caller's choice
        spark.conf.set(name, str(BATCH_BYTES))


def apart(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id is theirs alone, and the others; None if there are no others."""
    ids = docs.groupBy(F.col(key).alias("__id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id")
    if ids.isEmpty():
        return docs, None
    same = F.col(key).eqNullSafe(F.col("__id"))
    return docs.join(ids, same, "left_anti"), docs.join(ids, same, "left_semi")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True)


def _typed(docs: DataFrame, key: str, fields: str) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema[key].dataType), *T._parse_datatype_string(fields).fields])


class Words:
    """The words of documents (key, text, lang): how many documents have each, and its idf, ln(n / df)."""

    def __init__(self, docs: DataFrame, count: Count, text: str = "text", key: str = "doc_id", lang: str | None = "lang"):
        self.spark, self.count, self.key = docs.sparkSession, count, key
        small_batches(self.spark)
        docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"))
        self.docs, self.kind = docs, docs.schema["doc_id"].dataType
        self.single, self.repeated = apart(docs)
        df = self.single.select("text", "lang").mapInArrow(self._frequencies(), "term string, df bigint")
        if self.repeated is not None:
            df = df.unionByName(self.counted().groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        at = scratch(self.spark, "words")
        df.groupBy("term").agg(F.sum("df").alias("df")).write.parquet(at)
        n = F.lit(docs.count()).cast("double")
        #: (term, df, idf)
        self.all = self.spark.read.schema("term string, df bigint").parquet(at).withColumn("idf", F.log(n / F.col("df").cast("double")))
        self._sent: Broadcast | None = None

    def _frequencies(self) -> Callable:
        count = self.count

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: Counter[str] = Counter()
            for text, lang in rows_of(batches):
                held.update(count(text, lang).keys())
                if len(held) >= TOGETHER:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "df"])
                    held = Counter()
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "df"])

        return run

    def counted(self) -> DataFrame:
        """(doc_id, term, tf) of the documents of several rows."""
        count = self.count

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from batched(((doc, term, n) for doc, text, lang in rows_of(batches) for term, n in count(text, lang).items()), schema)

        schema = _typed(self.repeated, "doc_id", "term string, tf bigint")
        return self.repeated.mapInArrow(run, schema).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))

    def sent(self) -> tuple[Broadcast, int]:
        """The idf of the frequent words, for every task; from which document frequency on they are."""
        if self._sent is None:
            # how many words have a frequency of so many binary digits
            digits = dict(self.all.groupBy(F.length(F.bin("df")).alias("d")).count().collect())
            total, self.least = 0, 1 << 62
            for d in sorted(digits, reverse=True):
                total += digits[d]
                if total > FREQUENT:
                    break
                self.least = 1 << (d - 1)
            some = self.all.where(F.col("df") >= self.least).select("term", "idf").toArrow()
            self._sent = self.spark.sparkContext.broadcast(dict(zip(some["term"].to_pylist(), some["idf"].to_pylist())))
        return self._sent, self.least

    def rest(self) -> DataFrame:
        """(term, df, idf) of the words that are not sent."""
        _, least = self.sent()
        return self.all.where(F.col("df") < least)

    def _postings(self, frequent: bool) -> DataFrame:
        """Of documents of one row: postings of frequent words with their idf, or of the others."""
        (sent, _), count = self.sent(), self.count

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                idf = sent.value
                for doc, text, lang in rows_of(batches):
                    words = count(text, lang)
                    most = max(words.values(), default=0)
                    if frequent:
                        for term, n in words.items():
                            if (x := idf.get(term)) is not None:
                                yield doc, term, n, most, x
                    else:
                        for term in words:
                            if term not in idf:
                                yield doc, term, words[term], most

            yield from batched(rows(), schema)

        schema = _typed(self.single, "doc_id", "term string, tf bigint, tf_max bigint" + ", idf double" * frequent)
        return self.single.mapInArrow(run, schema)

    def postings(self) -> DataFrame:
        """(doc_id, term, tf, tf_max, idf) of every word of every document."""
        rare = self._postings(False).join(self.rest().select("term", "idf"), "term")
        out = self._postings(True).unionByName(rare)
        if self.repeated is not None:
            rows = self.counted().withColumn("tf_max", F.max("tf").over(Window.partitionBy("doc_id")))
            out = out.unionByName(rows.join(self.all.select("term", "idf"), "term"))
        return out

    def rare(self) -> DataFrame:
        """(doc_id, term, tf, tf_max) of documents of one row and of words that are not sent."""
        return self._postings(False)

    def with_rare(self) -> DataFrame:
        """(doc_id, text, lang, rare) of documents of one row: rare are (term, idf) of the words
        that are not sent."""
        rare = self._postings(False).select("doc_id", "term").join(self.rest().select("term", "idf"), "term")
        return self.single.join(rare.groupBy("doc_id").agg(F.collect_list(F.struct("term", "idf")).alias("rare")), "doc_id", "left")


def batched(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds, held = to_arrow_schema(schema), []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)
