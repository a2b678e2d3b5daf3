"""Readers of text collections, pages, dictionaries and cached answers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from corpuscube.functions import text as tx

#: The encodings that are tried, in order; utf-8 keeps a byte order mark.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1251", "latin-1")


@F.pandas_udf(T.StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """The first encoding that reads all bytes."""
    return content.map(lambda raw: tx.decoded(bytes(raw), ENCODINGS)[0], na_action="ignore")


_PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())])


@F.pandas_udf(_PAGE)
def decode_page(content: pd.Series) -> pd.DataFrame:
    """Visible text and encoding of HTML files."""
    read = [tx.read_page(bytes(raw)) for raw in content]
    return pd.DataFrame({"text": [tx.visible_text(t) for t, _ in read], "encoding": [e for _, e in read]})


@F.pandas_udf(T.StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    """S3: the text layer, pages joined by line breaks; empty where it cannot be read or no PDF
    library is installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return pd.Series([""] * len(content), dtype=object)
    import io

    def one(raw: bytes) -> str:
        try:
            return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(bytes(raw))).pages)
        except Exception:  # a broken file is an empty document, whatever is broken
            return ""

    return content.map(one)


def _binary(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def collection(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path, title, text, date, time) of the .txt and .pdf files under a folder, ids by
    path; blank ones are skipped."""
    files = _binary(spark, root, "*.{txt,pdf}")
    body = F.when(F.endswith(F.lower("path"), F.lit(".pdf")), pdf_text("content")).otherwise(decode_text("content"))
    rows = files.select("path", body.alias("text"), "modificationTime").where(F.col("text").rlike(r"\S"))
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)

    @F.pandas_udf(T.StringType())
    def title(text: pd.Series, stem: pd.Series) -> pd.Series:
        return pd.Series([tx.derive_title(t, s) for t, s in zip(text, stem)], dtype=object)

    rows = rows.withColumn("doc_id", F.row_number().over(Window.orderBy("path")).cast("bigint"))  # a folder's files
    return rows.select("doc_id", "path", title("text", name).alias("title"), "text", F.date_format("modificationTime", "yyyy-MM-dd").alias("date"), F.date_format("modificationTime", "HH:mm:ss").alias("time"))


def suites(spark: SparkSession, roots: Mapping[str, str], languages: Sequence[str]) -> DataFrame:
    """(suite, doc_id, lang_true, text, encoding) of the HTML files of suites (name to
    folder); a file's language is what its name begins with, others are skipped, and so is a
    folder that is not there."""
    out = None
    for name, root in roots.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            continue
        files = _binary(spark, root, "*.html").withColumn("doc_id", F.regexp_extract("path", r"([^/]+)\.html$", 1))
        files = files.withColumn("lang_true", F.split("doc_id", "_")[0]).where(F.col("lang_true").isin(*languages))
        one = files.select(F.lit(name).alias("suite"), "doc_id", "lang_true", decode_page("content").alias("p")).select("suite", "doc_id", "lang_true", "p.*")
        out = one if out is None else out.unionByName(one)
    return out


def training_texts(spark: SparkSession, root: str, languages: Sequence[str]) -> DataFrame:
    """(lang, text), a file a language; a missing one is an error."""
    rows = spark.read.text([f"{root}/{lang}.txt" for lang in languages], wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("lang"), F.col("value").alias("text"))
    return rows


def described_collection(spark: SparkSession, root: str, meta: str = "meta.json") -> DataFrame:
    """A collection's description (JSON) with texts, and reference summaries where they are."""
    rows = spark.read.json(f"{root}/{meta}", multiLine=True)
    whole = lambda name: _binary(spark, root, "*.txt").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("__f"), decode_text("content").alias(name))
    base = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    texts, references = whole("text"), whole("reference").withColumnRenamed("__f", "__r")
    return rows.join(texts, base("file") == F.col("__f")).join(references, base("reference_file") == F.col("__r"), "left").drop("__f", "__r")


def dictionary_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a tab-separated file: source, pos, target, gram, domain; # begins a comment,
    rows of fewer than three columns are skipped, unknown domains are general."""
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 3)
    cell = lambda i: F.trim(F.coalesce(F.get("c", F.lit(i)), F.lit("")))
    return rows.select(F.lower(cell(0)).alias("source"), F.upper(cell(1)).alias("pos"), cell(2).alias("target"), cell(3).alias("gram"), F.when(cell(4).isin("general", "med", "art"), cell(4)).otherwise("general").alias("domain"), F.lit(1).alias("verified"))


def dictionary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a CSV file with a header, separated by semicolons or else commas."""
    for sep in (";", ","):
        rows = spark.read.csv(path, header=True, sep=sep)
        if len(rows.columns) > 1:
            break
    return rows.toDF(*[c.strip().lstrip("﻿") for c in rows.columns])


def sdmx_csv(spark: SparkSession, path: str) -> DataFrame:
    """The wide rows of an answer: no byte order mark, no blank rows, the header first."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True)
    rows = rows.toDF(*[c.strip().lstrip("﻿") for c in rows.columns])
    some = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in rows.columns])
    return rows.where(some.isNotNull())


def cached_answers(spark: SparkSession, root: str) -> DataFrame:
    """(name, body) of answers that a client has kept as files, in place of calls."""
    return _binary(spark, root, "*").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), decode_text("content").alias("body"))


def cache_key(method: str, url: str, body: str = "", lang: str = "ru") -> str:
    """The name under which an answer is kept."""
    import hashlib

    return hashlib.sha1("|".join((method, url, body, lang)).encode()).hexdigest()


def answer_errors(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers that are tables, and those that are text with an error."""
    bad = ~F.startswith("body", F.lit("DATAFLOW")) & ~F.contains("body", F.lit(","))
    return answers.where(~bad), answers.where(bad)


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document, one row an element of its outer list."""
    return spark.read.json(path, multiLine=True)


def command_file(spark: SparkSession, path: str) -> DataFrame:
    """(lang, cmd_ord, action, title, kw_ord, keyword) of a file of commands by language."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("lang", "v"))
    listed = whole.where(F.startswith(F.ltrim("v"), F.lit("["))).select("lang", F.posexplode(F.from_json("v", "array<struct<action:string,title:string,keywords:array<string>>>")).alias("cmd_ord", "c"))
    return listed.select("lang", "cmd_ord", "c.action", "c.title", F.posexplode("c.keywords").alias("kw_ord", "keyword"))


def query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], **values) -> DataFrame:
    """SQL over named tables; what users type comes in as parameters (:name)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=values)


def samples(spark: SparkSession, root: str) -> DataFrame:
    """(name, title, size) of sample texts: the first line, 80 characters at most."""
    rows = _binary(spark, root, "*.txt").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), decode_text("content").alias("text"))
    return rows.select("name", F.substring(F.split(F.trim("text"), "\n")[0], 1, 80).alias("title"), F.length("text").alias("size"))


def lead_and_body(text: Column) -> Column:
    """struct(lead, body): what stands before and after the first section heading (== so ==)
    of an article, or else its first paragraph and the rest."""
    by_heading = F.split(text, r"(?m)^==\s.*\s==\s*$", 2)
    by_blank = F.split(text, "\n\n", 2)
    parts = F.when(F.size(by_heading) == 2, by_heading).otherwise(by_blank)
    return F.struct(parts[0].alias("lead"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("body"))


def kept_facts(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Facts that a run has left as one CSV file, for a report without another run; `columns`
    says what is read as what, so that territories' codes stay texts."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    kinds = T._parse_datatype_string(columns)
    return rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns]).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds.fields])


def cleaned_book(lines: Iterator[str]) -> str:
    """an e-book without licence head and foot, footnote marks and ragged blanks."""
    import re

    text = "\n".join(lines)
    text = re.split(r"\*{3}\s*START OF[^\n]*\n", text)[-1]
    text = re.split(r"\*{3}\s*END OF", text)[0]
    text = re.sub(r"\[\d+\]", "", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def prose_lines(text: str, least: int = 40, letters: float = 0.75) -> str:
    """the lines that are long enough and mostly letters."""
    kept = [x.strip() for x in text.splitlines() if len(x.strip()) >= least and sum(c.isalpha() for c in x) >= letters * len(x.strip())]
    return "\n".join(kept)


def chapters(text: str, size: int = 20_000, most: int = 50_000) -> list[str]:
    """a book's chapters by their headings; with fewer than three headings, and for a chapter
    that is too long, paragraphs gathered up to `size`."""
    import re

    def packed(body: str) -> list[str]:
        out, now = [], ""
        for p in re.split(r"\n\s*\n", body):
            if now and len(now) + len(p) > size:
                out.append(now.strip())
                now = ""
            now += p + "\n\n"
        return [*out, now.strip()] if now.strip() else out

    at = [m.start() for m in re.finditer(r"(?m)^\s*(?:CHAPTER|Chapter|BOOK|PART)\s+[\dIVXLC]+.*$", text)]
    if len(at) < 3:
        return packed(text)
    parts = [text[a:b].strip() for a, b in zip(at, [*at[1:], len(text)])]
    return [x for p in parts for x in (packed(p) if len(p) > most else [p])]


def windows(text: str, size: int) -> list[str]:
    """stretches of about `size` characters that begin and end at words, end to end."""
    out, at = [], 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            back = text.rfind(" ", at, stop + 1)
            stop = back if back > at else stop
        piece = text[at:stop].strip()
        if piece:
            out.append(piece)
        at = stop + (1 if stop < len(text) and text[stop] == " " else 0)
    return out


def stressed(text: str, kind: str, seed: int, other: str = "") -> str:
    """a text made harder: typos in a quarter of the longer words, three tenths of another
    language, or accents stripped and all in capitals.  The same seed gives the same text."""
    import random
    import unicodedata

    rng = random.Random(seed)
    words = text.split(" ")
    if kind == "typos":
        for i, w in enumerate(words):
            if len(w) > 4 and rng.random() < 0.25:
                k = rng.randrange(len(w) - 1)
                words[i] = w[:k] + w[k + 1] + w[k] + w[k + 2 :]
        return " ".join(words)
    if kind == "mixed":
        return text[: int(len(text) * 0.7)] + " " + other[: int(len(text) * 0.3)]
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return plain.upper()
