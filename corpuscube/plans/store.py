"""Readers and writers, there and back: tables are written to a new folder in each format and read
again; the SQL is what must come back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpuscube.operators import cube as cb, lexicon as lc, retrieval as rt
from corpuscube.operators.retrieval import SearchParams
from corpuscube.plans import cube as pc, ir, lex
from corpuscube.plans.api import api_deselect_all, api_relevance, api_select_all, ensure_query
from corpuscube.session import scratch
from corpuscube.sources import files as fl, sinks as sk


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _put(spark, folder: str, files: dict[str, bytes]) -> str:
    """A few small files in a folder, where every task can read them."""
    jvm = spark._jvm
    for name, body in files.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(body), 0, len(body))
        out.close()
    return folder


def data_indexed_search(spark, d):
    """The whole index is written; a query reads its own terms' postings from it."""
    docs, at = ir._docs(spark, d), scratch(spark, "index")
    words = rt.words_of(docs)
    rt.write_index(words.all, rt.postings_of(words), at)
    params = SearchParams("shed heat ingtion")
    wanted, _ = rt.tx.parse_query(params.q, False)
    hits = rt.select(rt.read_index(spark, at, list(wanted)), params)
    return rt.page(hits, 0, 10).select("rank", "doc_id", "matched", F.round("score", 6).alias("score"), "fallback")


def data_csv(spark, d):
    """Suppliers as one file with semicolons and a byte order mark."""
    at = scratch(spark, "csv") + "/supplier.csv"
    rows = _table(spark, d, "supplier")
    sk.write_csv(rows, at, sep=";", bom=True, order=["s_suppkey"])
    back = fl.dictionary_csv(spark, at)
    return back.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])


def data_partitions(spark, d):
    """K5: orders by year, then the years from 1995 on replaced by half of their rows."""
    at = scratch(spark, "orders")
    rows = _table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    sk.replace_partitions(rows, at, "year")
    sk.replace_partitions(rows.where("year >= 1995 AND o_orderkey % 2 = 0"), at, "year")
    return spark.read.parquet(at).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("price"))


def data_sql(spark, d):
    """SQL over a table with what a user typed as a parameter."""
    rows = _table(spark, d, "nation")
    return fl.query(spark, "SELECT n_nationkey, n_name FROM places WHERE n_name >= :least AND n_regionkey = :region", {"places": rows}, least="B", region=1)


def data_sdmx(spark, d):
    """An answer with a byte order mark, padded cells and a blank row."""
    rows = _table(spark, d, "nation").orderBy("n_nationkey").collect()
    text = "\ufeffDATAFLOW,geo,OBS_VALUE\n" + "".join(f"flow, {r['n_name']},{r['n_nationkey']}\n" for r in rows) + " , ,\n"
    back = fl.sdmx_csv(spark, _put(spark, scratch(spark, "sdmx"), {"answer.csv": text.encode()}) + "/answer.csv")
    return back.select("DATAFLOW", "geo", F.col("OBS_VALUE").cast("int").alias("value"))


def data_json(spark, d):
    """Samples as a list of objects, and a file of commands by language."""
    rows = _table(spark, d, "region").orderBy("r_regionkey").collect()
    body = {"en": [{"action": r["r_name"], "title": "t", "keywords": [r["r_name"].lower(), str(r["r_regionkey"])]} for r in rows], "note": "x"}
    at = _put(spark, scratch(spark, "json"), {"commands.json": json.dumps(body).encode()})
    return fl.command_file(spark, f"{at}/commands.json").select("lang", "cmd_ord", "action", "kw_ord", "keyword")


def data_texts(spark, d):
    """regions' names as text files in three encodings; a blank one is skipped, a
    byte order mark stays and is taken off here."""
    rows = _table(spark, d, "region").orderBy("r_regionkey").collect()
    codes = ["utf-8", "utf-8-sig", "cp1251", "utf-8", "cp1251"]
    made = {f"sub{r['r_regionkey'] % 2}/{r['r_regionkey']}.txt": f"Регион {r['r_name']}".encode(c) for r, c in zip(rows, codes)}
    at = _put(spark, scratch(spark, "texts"), {**made, "blank.txt": b" \n", "other.md": b"no"})
    return fl.collection(spark, at).select("doc_id", F.regexp_replace("title", "^\ufeff", "").alias("title"), F.regexp_replace("text", "^\ufeff", "").alias("text"), F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"))


def data_suites(spark, d):
    """Pages of two suites, one of which is not there, and a file a language."""
    page = lambda text, code: f'<html><head><meta charset="{code}"><title>x</title></head><body><p>{text}</p></body></html>'.encode(code)
    at = _put(spark, scratch(spark, "suites"), {"a/fr_1.html": page("été à la", "cp1252"), "a/en_2.html": page("the sea", "utf-8"), "a/de_3.html": page("das", "utf-8"), "fr.txt": "le la".encode(), "en.txt": b"the of"})
    pages = fl.suites(spark, {"plain": f"{at}/a", "gone": f"{at}/b"}, ["fr", "en"]).select("suite", "doc_id", "lang_true", "text", "encoding")
    return pages.unionByName(fl.training_texts(spark, at, ["fr", "en"]).select(F.lit("training").alias("suite"), F.col("lang").alias("doc_id"), F.col("lang").alias("lang_true"), "text", F.lit("utf-8").alias("encoding")))


def data_described(spark, d):
    """A collection with its description; one text has a reference summary."""
    meta = json.dumps([{"id": 1, "file": "texts/1.txt", "reference_file": "refs/r1.txt"}, {"id": 2, "file": "texts/2.txt", "reference_file": None}])
    at = _put(spark, scratch(spark, "described"), {"meta.json": meta.encode(), "texts/1.txt": b"one", "texts/2.txt": b"two", "refs/r1.txt": b"short"})
    return fl.described_collection(spark, at).select("id", "text", "reference")


def data_answers(spark, d):
    """Kept answers by their keys, tables and errors apart."""
    keys = [fl.cache_key("GET", f"http://x/{i}") for i in range(3)]
    at = _put(spark, scratch(spark, "answers"), dict(zip(keys, (b"DATAFLOW\nx", b"a,b", b"try again later"))))
    good, bad = fl.answer_errors(fl.cached_answers(spark, at))
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))


def data_tsv(spark, d):
    """A seed file, merged into the dictionary without a change of what is there."""
    text = "# seed\nShed \tnoun\tnew\tm\tgeneral\nfish\tnoun\tрыба\tf\tzoo\nshort\trow\n"
    rows = fl.dictionary_tsv(spark, _put(spark, scratch(spark, "tsv"), {"seed.tsv": text.encode()}))
    merged, counts = lc.merged_entries(lex._entries(spark), rows, update=False)
    return merged.crossJoin(counts).select("source", "pos", "target", "domain", "verified", "added", "updated")


def data_sessions(spark, d):
    """Conversations as saved sessions; one is replaced; statistics of those whose
    payload is valid, the newest first."""
    c = _table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    rows = c.select(F.col("conv_id").alias("id"), F.concat(F.lit("c"), "conv_id").alias("name"), F.when(F.col("conv_id") % 3 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("n").alias("words")))).alias("payload"))
    saved = sk.saved_session(rows, spark, 1, "again", {"words": 7, "translated": 5, "coverage": 0.5})
    return sk.session_stats(saved).select("id", "name", "stats.words", "stats.translated")


def data_marks(spark, d):
    """Marks put in, one by one and for a whole ranking, and taken out."""
    ranking = ir._ranking(spark, d)
    marks = ir._marks(spark, d)
    marks = api_select_all(marks, ranking.where("query_id = 1"))
    marks = api_relevance(marks, spark, 2, [1, 2, 2, 3], True)
    marks = api_relevance(marks, spark, 1, [1, 2], False)
    return api_deselect_all(marks, 3)


def data_queries(spark, d):
    """A query is kept once, under the next number."""
    rows = spark.createDataFrame([], "query_id bigint, params_json string")
    for q in ("heat", "shed", "heat"):
        rows = ensure_query(rows, SearchParams(q, all_words=True, date_from="2024-01-01"))
    return rows


def data_upserts(spark, d):
    """customers' balances, those of every third put in again, the last of equal keys."""
    c = _table(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit(-1.0).alias("b")), F.struct(F.lit(2).alias("seq"), F.lit(-2.0).alias("b")))).alias("x"))
    return sk.upserted(c, new.select("c_custkey", F.col("x.b").alias("c_acctbal"), F.col("x.seq").alias("seq")), ["c_custkey"])


def data_report(spark, d):
    """The report's counters from facts that were kept as CSV."""
    facts = pc._facts(spark, d).select("fact_id", "indicator_code", "geo_code", "year", "value")
    at = scratch(spark, "facts") + "/facts.csv"
    sk.write_csv(facts, at, bom=True)
    return cb.dataset_stats(fl.kept_facts(spark, at, "fact_id string, indicator_code string, geo_code string, year int, value double"))


def data_table_text(spark, d):
    """The first regions as Markdown."""
    rows = _table(spark, d, "region").orderBy("r_regionkey").select("r_regionkey", "r_name", (F.col("r_regionkey") * 12345.5).alias("x"))
    return spark.createDataFrame([(line,) for line in sk.text_table(rows, ["r_regionkey", "r_name", "x"], most=3).split("\n")], "line string")


def data_summary_text(spark, d):
    """K9"""
    tree = [{"term": "heat", "count": 3, "children": [{"term": "heat wave", "count": 2}]}]
    both = [sk.summary_text("T", ["One.", "Two."], tree), sk.summary_html("T<", ["One."], tree)]
    return spark.createDataFrame([(i, x) for i, x in enumerate(both)], "i int, body string")


QUERIES = [data_indexed_search, data_csv, data_partitions, data_sql, data_sdmx, data_json, data_texts, data_suites, data_described, data_answers, data_tsv, data_sessions, data_marks, data_queries, data_upserts, data_report, data_table_text, data_summary_text]

_REGION = "(SELECT r_regionkey AS k, r_name AS n FROM region)"
_KEYS = [fl.cache_key("GET", f"http://x/{i}") for i in range(3)]
_ENTRY = ", ".join(f"('{r[0]}', '{r[1]}', '{r[2]}', '{r[4]}', {r[5]})" for r in lex.ENTRIES)
SQL = {
    "data_indexed_search": ir.SQL["ir_search_or"],
    "data_csv": "SELECT * FROM supplier",
    "data_partitions": "SELECT year(o_orderdate)::INT AS year, count(*) AS n, round(sum(o_totalprice::DECIMAL(18,2)), 2)::DOUBLE AS price FROM orders WHERE year(o_orderdate) < 1995 OR o_orderkey % 2 = 0 GROUP BY 1",
    "data_sql": "SELECT n_nationkey, n_name FROM nation WHERE n_name >= 'B' AND n_regionkey = 1",
    "data_sdmx": "SELECT 'flow' AS \"DATAFLOW\", n_name AS geo, n_nationkey::INT AS value FROM nation",
    "data_json": f"SELECT 'en' AS lang, k::INT AS cmd_ord, n AS action, i::INT AS kw_ord, CASE i WHEN 0 THEN lower(n) ELSE k::VARCHAR END AS keyword FROM {_REGION}, (SELECT unnest([0, 1]) AS i)",
    "data_texts": f"SELECT row_number() OVER (ORDER BY k % 2, k) AS doc_id, 'Регион ' || n AS title, 'Регион ' || n AS text, 'sub' || (k % 2) || '/' || k || '.txt' AS path FROM {_REGION}",
    "data_suites": "SELECT * FROM (VALUES ('plain', 'fr_1', 'fr', 'été à la', 'cp1252'), ('plain', 'en_2', 'en', 'the sea', 'utf-8'), ('training', 'fr', 'fr', 'le la', 'utf-8'), ('training', 'en', 'en', 'the of', 'utf-8')) t(suite, doc_id, lang_true, text, encoding)",
    "data_described": "SELECT * FROM (VALUES (1, 'one', 'short'), (2, 'two', NULL)) t(id, text, reference)",
    "data_answers": f"SELECT * FROM (VALUES ('{_KEYS[0]}', 'DATAFLOW' || chr(10) || 'x', true), ('{_KEYS[1]}', 'a,b', true), ('{_KEYS[2]}', 'try again later', false)) t(name, body, ok)",
    "data_tsv": f"SELECT *, 1 AS added, 0 AS updated FROM (VALUES {_ENTRY}, ('fish', 'NOUN', 'рыба', 'general', 1)) t(source, pos, target, domain, verified)",
    "data_sessions": "SELECT conv_id AS id, 'c' || conv_id AS name, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE count(*) END AS words, NULL::BIGINT AS translated FROM conversations WHERE conv_id <> 1 GROUP BY conv_id UNION ALL SELECT 1, 'again', 7, 5",
    "data_marks": f"WITH {ir._rank_sql()} SELECT query_id, doc_id FROM marks WHERE query_id = 2 UNION SELECT 2, unnest([1, 2, 3]) UNION (SELECT query_id, doc_id FROM marks WHERE query_id = 1 AND doc_id NOT IN (1, 2)) UNION (SELECT query_id, doc_id FROM ranking WHERE query_id = 1 AND doc_id NOT IN (1, 2))",
    "data_queries": """SELECT * FROM (VALUES (1, '{"q":"heat","all_words":true,"date_from":"2024-01-01"}'), (2, '{"q":"shed","all_words":true,"date_from":"2024-01-01"}')) t(query_id, params_json)""",
    "data_upserts": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -2.0 ELSE c_acctbal END AS c_acctbal FROM customer",
    "data_report": pc.SQL["cube_dataset_stats"],
    "data_table_text": "WITH r AS (SELECT *, r_regionkey * 12345.5 AS x FROM region ORDER BY r_regionkey LIMIT 3) SELECT '| r_regionkey | r_name | x |' AS line UNION ALL SELECT '| --- | --- | --- |' UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' | ' || CASE r_regionkey WHEN 0 THEN '0' WHEN 1 THEN '12 345.50' ELSE '24 691' END || ' |' FROM r UNION ALL SELECT '... more than 3 rows'",
    "data_summary_text": "SELECT 0 AS i, array_to_string(['T', '=', '', '1. One.', '2. Two.', '', '- heat (3)', '    - heat wave (2)'], chr(10)) AS body UNION ALL SELECT 1, '<!doctype html><meta charset=utf-8><title>T&lt;</title><h1>T&lt;</h1><ol><li>One.</li></ol><ul><li>heat<ul><li>heat wave</li></ul></li></ul>'",
}
