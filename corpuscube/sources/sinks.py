"""Writers: whole tables swapped in, tables merged by key, partitions replaced, files for people."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def swap_in(tables: Mapping[str, DataFrame], path: str) -> None:
    """K1: write all tables to a folder beside `path`, then rename it to `path`."""
    spark = next(iter(tables.values())).sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{staged}/{name}")
    fs, at = _files(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(staged + ".old")
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), at)
    fs.delete(old, True)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The old rows whose keys are not in new, and the new ones; the last of equal keys
    wins by the column `seq` where new has one."""
    if "seq" in new.columns:
        last = Window.partitionBy(*keys).orderBy(F.desc("seq"))
        new = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "seq")
    else:
        new = new.dropDuplicates(list(keys))
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def marked(marks: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """K3: relevance marks with pairs put in once and others taken out."""
    if add is not None:
        marks = marks.unionByName(add)
    marks = marks.dropDuplicates(["query_id", "doc_id"])
    return marks if remove is None else marks.join(remove, ["query_id", "doc_id"], "left_anti")


def write_csv(df: DataFrame, path: str, sep: str = ",", bom: bool = False, order: Sequence[str] = ()) -> None:
    """K4, K7: one CSV file with a header, written beside and renamed; bom: a byte order mark
    before the first column's name, for spreadsheet programs."""
    spark = df.sparkSession
    if order:
        df = df.orderBy(*order)
    if bom:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    staged = f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.csv(staged, header=True, sep=sep, emptyValue="", nullValue="")
    fs, at = _files(spark, path)
    part = next(s.getPath() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(staged)) if s.getPath().getName().startswith("part-"))
    fs.delete(at, True)
    fs.rename(part, at)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """K5: only the partitions that df has are replaced; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def suite_table(results: DataFrame, methods: Sequence[str]) -> DataFrame:
    """K6: one row a document, a prediction, a distance and milliseconds for each method."""
    wide = results.groupBy("suite", "doc_id", "lang_true").pivot("method", list(methods)).agg(F.first("lang").alias("lang"), F.round(F.first("distance"), 6).alias("distance"), F.round(F.first("elapsed_ms"), 3).alias("ms"))
    return wide.orderBy("suite", "doc_id")


def text_table(rows: DataFrame, columns: Sequence[str], most: int = 60) -> str:
    """A Markdown table of the first `most` rows; numbers get a space between
    thousands."""

    def cell(x) -> str:
        if x is None:
            return ""
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, int):
            return f"{x:,}".replace(",", " ") if abs(x) >= 10_000 else str(x)
        if isinstance(x, float):
            return f"{x:,.0f}".replace(",", " ") if x.is_integer() else f"{x:,.2f}".replace(",", " ")
        return str(x).replace("|", "\\|")

    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    got = rows.select(*columns).limit(most + 1).collect()
    lines += ["| " + " | ".join(cell(x) for x in r) + " |" for r in got[:most]]
    return "\n".join(lines + ([f"... more than {most} rows"] if len(got) > most else []))


def summary_text(title: str, lines: Sequence[str], tree: Sequence[Mapping]) -> str:
    """K9: a summary as numbered sentences and an indented tree of keywords."""
    out = [title, "=" * len(title), ""] + [f"{i}. {s}" for i, s in enumerate(lines, 1)] + [""]
    for node in tree:
        out.append(f"- {node['term']} ({node['count']})")
        out += [f"    - {c['term']} ({c['count']})" for c in node["children"]]
    return "\n".join(out)


def summary_html(title: str, lines: Sequence[str], tree: Sequence[Mapping]) -> str:
    """K9: the same as a page."""
    import html

    e = html.escape
    items = "".join(f"<li>{e(s)}</li>" for s in lines)
    branch = "".join(f"<li>{e(n['term'])}<ul>{''.join(f'<li>{e(c["term"])}</li>' for c in n['children'])}</ul></li>" for n in tree)
    return f"<!doctype html><meta charset=utf-8><title>{e(title)}</title><h1>{e(title)}</h1><ol>{items}</ol><ul>{branch}</ul>"


def saved_session(rows: DataFrame, spark: SparkSession, session_id: int, name: str, result: Mapping) -> DataFrame:
    """Sessions (id, name, payload), one put in or replaced, newest first."""
    new = spark.createDataFrame([(session_id, name, json.dumps(result, ensure_ascii=False))], "id bigint, name string, payload string")
    return upserted(rows, new, ["id"]).orderBy(F.desc("id"))


def session_stats(rows: DataFrame, schema: str = "struct<words:bigint,translated:bigint,coverage:double>") -> DataFrame:
    """Sessions with their statistics, empty where the payload is no valid JSON."""
    return rows.select("id", "name", F.from_json("payload", schema, {"mode": "PERMISSIVE"}).alias("stats")).orderBy(F.desc("id"))
