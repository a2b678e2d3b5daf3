"""One function an endpoint: the same answers as tables.

A: retrieval; B: language identification; C: summaries; D: translation; E: the cube; F, G:
speech and commands.  Requests come as arguments, tables as DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscube.functions import values as vl
from corpuscube.operators import commands as cm, cube as cb, evaluation as ev, langid as li, lexicon as lc, retrieval as rt, summary as sm, transfer as tr
from corpuscube.operators.retrieval import SearchParams
from corpuscube.sources.sinks import marked

# --- A -------------------------------------------------------------------------------


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", stems: bool = True) -> dict[str, DataFrame]:
    """/reindex: terms, postings, keywords and display forms of a collection."""
    counts = rt.term_counts(docs, text, key, stems)
    terms = rt.terms(counts, docs.agg(F.count(F.lit(1)).alias("n")))
    weighted = rt.postings(counts, terms)
    return {"terms": terms.join(rt.display_forms(counts), "term"), "postings": weighted, "keywords": rt.keywords(weighted)}


def api_search(index: dict[str, DataFrame], docs: DataFrame, params: SearchParams, stems: bool = True) -> tuple[DataFrame, DataFrame]:
    """/api/search: a page of hits with titles, keywords and snippets; one row about the query."""
    hits = rt.select(index["postings"], params, docs if "date" in docs.columns else None, stems)
    page = rt.page(hits, params.offset, params.limit)
    about = rt.known_words(index["postings"], params, stems).crossJoin(hits.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.max("fallback"), F.lit(False)).alias("fallback")))
    about = about.withColumn("pages", rt.page_count(F.col("total"), F.lit(params.limit)))
    return rt.with_snippets(page.join(index["keywords"], "doc_id", "left"), docs, params, stems=stems), about


def api_document(docs: DataFrame, doc_id: int) -> DataFrame:
    """/documents/{id}"""
    return docs.where(F.col("doc_id") == doc_id)


def api_relevance(marks: DataFrame, spark: SparkSession, query_id: int, doc_ids: Sequence[int], relevant: bool) -> DataFrame:
    """/api/relevance and its batch: marks put in or taken out; repeats count once."""
    rows = spark.createDataFrame([(query_id, i) for i in dict.fromkeys(doc_ids)], "query_id bigint, doc_id bigint")
    return marked(marks, rows, None) if relevant else marked(marks, None, rows)


def api_select_all(marks: DataFrame, ranking: DataFrame) -> DataFrame:
    """T11, /api/select-all: every hit of a ranking is relevant."""
    return marked(marks, ranking.select("query_id", "doc_id"))


def api_deselect_all(marks: DataFrame, query_id: int) -> DataFrame:
    """T11, /api/deselect-all"""
    return marks.where(F.col("query_id") != query_id)


def ensure_query(queries: DataFrame, params: SearchParams) -> DataFrame:
    """The queries (query_id, params_json) with this one, numbered next, if it is new."""
    spark = queries.sparkSession
    fields = ("q", "all_words", "date_from", "date_to")
    row = spark.createDataFrame([tuple(getattr(params, f) for f in fields)], "q string, all_words boolean, date_from string, date_to string")
    key = row.select(F.to_json(F.struct(*fields)).alias("params_json")).join(queries.select("params_json"), "params_json", "left_anti")
    last = queries.agg((F.coalesce(F.max("query_id"), F.lit(0)) + 1).cast("bigint").alias("query_id"))
    return queries.unionByName(key.crossJoin(last))


def api_metrics(ranking: DataFrame, marks: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """T6, /api/metrics: rows of queries, the newest first."""
    return ev.metrics(ranking, marks).orderBy(F.desc("query_id")).offset(offset).limit(limit)


def api_metrics_summary(ranking: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """/api/metrics/summary: macro and micro averages; the mean curve."""
    rows = ev.metrics(ranking, marks)
    return ev.macro(rows).crossJoin(ev.micro(rows)), ev.mean_curve(rows)


def api_pr_curve(ranking: DataFrame, marks: DataFrame, query_id: int) -> tuple[DataFrame, DataFrame]:
    """/api/pr-curve/{id}: the interpolated curve and the actual cuts."""
    one, its = ranking.where(F.col("query_id") == query_id), marks.where(F.col("query_id") == query_id)
    return ev.curves(one, its), ev.cuts(one, its)


def api_status(docs: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """/api/status"""
    return docs.agg(F.count(F.lit(1)).alias("documents")).crossJoin(index["terms"].agg(F.count(F.lit(1)).alias("terms"))).crossJoin(index["postings"].agg(F.count(F.lit(1)).alias("postings")))


# --- B -------------------------------------------------------------------------------


def api_recognize(docs: DataFrame, training: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """/recognize, /text: all methods' answers; training: (lang, text)."""
    return li.detect(docs, li.language_profiles(training), li.letter_frequencies(li.letters(training, keep=["lang"])), text, key)


def api_results(results: DataFrame) -> dict[str, DataFrame]:
    """/api/results: the reports of a suite."""
    return {"methods": li.method_report(results), "languages": li.per_language(results), "confusion": li.confusion(results), "pairs": li.pair_agreement(results)}


# --- C -------------------------------------------------------------------------------


def api_summarize(docs: DataFrame, n: int = sm.SENTENCES, diverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """/summarize: sentences and keyword trees of every document (doc_id, text, lang); n from 1 to 50."""
    n = min(50, max(1, n))
    parsed, counts = sm.sentences(docs), sm.term_counts(docs)
    weights = sm.word_weights(counts, sm.document_frequencies(counts, docs.agg(F.count(F.lit(1)).alias("n"))))
    weighted = sm.sentence_weights(parsed, weights)
    chosen = sm.diverse_sentences(weighted, n) if diverse else sm.top_sentences(weighted, n)
    return chosen, sm.keyword_trees(parsed, weights)


# --- D -------------------------------------------------------------------------------


def api_translate(tokens: DataFrame, entries: DataFrame, domain: str = "general", mode: str = "transfer") -> tuple[DataFrame, DataFrame]:
    """/api/translate: sentences, by transfer or word by word (mode literal), and statistics."""
    told = lc.with_fallback(tokens, entries, domain).withColumn("text_id", F.lit(0))
    said = lc.literal(tokens, entries, domain) if mode == "literal" else tr.translate(tokens, entries, domain)
    return said, lc.coverage(told)


def api_dictionary(entries: DataFrame, needle: str = "", **filters) -> DataFrame:
    """/api/dictionary"""
    return lc.listed(entries, needle, **filters)


# --- E -------------------------------------------------------------------------------


def api_stats_summary(facts: DataFrame, indicators: DataFrame, territories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """/api/stats/summary: counts and years; the five indicators with the most facts.  Empty
    tables give empty answers, never made-up ones."""
    return cb.api_summary(facts, indicators, territories), cb.top_indicators(indicators)


def api_territories(territories: DataFrame, level: int | None = None) -> DataFrame:
    """P6, /api/territories"""
    return territories if level is None else territories.where(F.col("level") == level)


def api_facts(facts: DataFrame, indicator_code: str | None = None, geo_code: str | None = None, year: int | None = None, limit: int = 200) -> DataFrame:
    """/api/facts"""
    return cb.facts_page(facts, indicator_code, geo_code, year, limit)


def api_search_names(indicators: DataFrame, territories: DataFrame, q: str) -> tuple[DataFrame, DataFrame]:
    """/api/search of the cube"""
    return cb.name_search(indicators, "indicator_code", "name_ru", q), cb.name_search(territories, "geo_code", "name_ru", q)


def select_years(years: Sequence[int | str], first: int | None = None, last: int | None = None) -> list[int]:
    """Distinct years within bounds, in order; what is no number is left out."""
    numbers = {int(y) for y in years if str(y).strip().lstrip("-").isdigit()}
    return sorted(y for y in numbers if (first is None or y >= first) and (last is None or y <= last))


def parse_years(text: str) -> tuple[int | None, int | None]:
    """`A-B`, `A-`, `-B` or `A`."""
    a, dash, b = text.strip().partition("-")
    return (int(a) if a.strip() else None, (int(b) if b.strip() else None) if dash else (int(a) if a.strip() else None))


def values_filter(dims: DataFrame, years: Sequence[int], geo: Sequence[str] | None = None, chosen: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """what a request asks of each dimension (dim_id, is_time, is_geo): the years, the
    territories, the codes chosen; an empty list is all of them.  A structure has a few
    dimensions; over a thousand are an error."""
    out: dict[str, list[str]] = {}
    rows = dims.select("dim_id", "is_time", "is_geo").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a structure of over 1,000 dimensions")
    for r in rows:
        picked = (chosen or {}).get(r["dim_id"])
        out[r["dim_id"]] = [str(y) for y in years] if r["is_time"] else list(geo) if r["is_geo"] and geo is not None else list(picked or [])
    return out


# --- F, G ----------------------------------------------------------------------------

# The synthesiser's voices.
VOICES = "de de+f1 de+f2 de+f3 de+f4 de+m1 de+m3 de+m5 de+whisper de+croak".split()


def api_tts(requests: DataFrame) -> DataFrame:
    """/api/tts: a synthesiser's parameters of requests (text, voice, rate, pitch): texts of 20,000
    characters at most; unknown voices become the first."""
    text = F.substring(F.trim("text"), 1, 20_000)
    return requests.select(text.alias("text"), F.when(F.col("voice").isin(VOICES), F.col("voice")).otherwise(VOICES[0]).alias("voice"), vl.speech_rate(F.col("rate")).alias("rate"), vl.speech_pitch(F.col("pitch")).alias("pitch")).where("text <> ''")


def api_match(utterances: DataFrame, language: str = "de") -> DataFrame:
    """/api/match"""
    return cm.match(utterances, language=language)


def api_commands(spark: SparkSession, language: str = "de") -> DataFrame:
    """/api/commands"""
    rows = [(i, a, k, w) for i, (a, ws) in enumerate(cm.COMMANDS.get(language, {}).items()) for k, w in enumerate(ws)]
    return spark.createDataFrame(rows, "cmd_ord int, action string, kw_ord int, keyword string")
