"""The corpus pipeline: five operators of corpuscube.llm in a row, over `documents`.

Each stage works on all that the stage before kept, written as Parquet and read again.  All
stages but the last return the columns of documents.  Rows repeated with one doc_id are one
document: they stay or go together.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscube.llm import mixing, packing, repeats, simhash, tables, toxicity
from corpuscube.session import reaching

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows that go to a Python worker, and come back, at once: with whole texts in them, Spark's own 10,000
#: are tens of megabytes, which the executor and its workers each hold in several copies.
ROWS = 2000


def lean(stage: Callable) -> Callable:
    """A stage in whose session Arrow batches have at most ROWS rows.  What it returns is
    computed later, so the setting stays."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name, "10000")) <= ROWS:  # 0 or less: no bound
            spark.conf.set(name, str(ROWS))
        return stage(spark, docs, sf_dir)

    return run


@reaching
@lean
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7 stay; the field learns from the labels of
    the documents that are here."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.transform(docs.select(*COLUMNS)).where("score < 0.7").select(*COLUMNS)


@reaching
@lean
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share four fifths of their five-word shingles, the one with the
    smallest doc_id stays."""
    groups = simhash.near_duplicates(docs, shingle=5, radius=14, similarity=0.8)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


@reaching
@lean
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out of the texts.  A
    character that is cut in part goes as a whole; a document of nothing else goes too."""
    cut = repeats.remove_repeats(docs.select(*COLUMNS), keep=["doc_id", "lang", "source"], as_text=True)
    stays = cut.where((F.col("kept") != "") | (F.size("span_starts") == 0))
    return stays.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("bigint").alias("n_chars"))


@reaching
@lean
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


@reaching
@lean
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    packed = packing.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the learned field nor the packing: a brute-force version in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what each returns is written and read again.  Once that is
    written, its input and what was stored on the way are deleted."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables.mark(spark)
    for name, stage in STAGES[:-1]:
        docs = tables.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        tables.clear(spark, mark, last=False)
    return STAGES[-1][1](spark, docs, sf_dir)
