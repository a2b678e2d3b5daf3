"""Retrieval and evaluation queries.  The collection is `documents`; relevance marks of a
query are the documents that `labels` gives quality 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscube.functions.stopwords import RETRIEVAL
from corpuscube.operators import evaluation as ev, retrieval as rt
from corpuscube.operators.retrieval import SearchParams

SPREAD = {1: "shed ingtion", 2: "that thereon", 3: "heat edly"}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")


def _count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"))


def _words(spark: SparkSession, d: str) -> rt.Words:
    return rt.words_of(_docs(spark, d))


def _asked(spark: SparkSession, d: str, q: str) -> DataFrame:
    """Postings of a query's terms only: the text scan keeps just these words, so the weights
    cost one small aggregate."""
    docs = _docs(spark, d)
    wanted, banned = rt.tx.parse_query(q, stems=False)
    each = docs.select("doc_id", F.explode(rt.tx.tokens(F.col("text"))).alias("term")).where(F.col("term").isin(*wanted, *banned))
    counts = each.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return rt.postings(counts, rt.terms(counts, _count(docs)))


def _search(spark: SparkSession, d: str, params: SearchParams) -> DataFrame:
    hits = rt.select(_asked(spark, d, params.q), params)
    return rt.page(hits, params.offset, params.limit).select("rank", "doc_id", "matched", F.round("score", 6).alias("score"), "fallback")


def ir_postings(spark, d):
    return rt.postings_of(_words(spark, d)).select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


def ir_terms_idf(spark, d):
    return _words(spark, d).all.select("term", "df", F.round("idf", 9).alias("idf"))


def ir_term_ids(spark, d):
    return rt.term_ids(_words(spark, d).all.select("term", "df"))


def ir_keywords_top5(spark, d):
    return rt.keywords_of(_words(spark, d))


def ir_search_or(spark, d):
    return _search(spark, d, SearchParams("shed heat ingtion"))


def ir_search_and(spark, d):
    return _search(spark, d, SearchParams("heat edly", all_words=True))


def ir_search_not(spark, d):
    return _search(spark, d, SearchParams("shed heat -edly"))


def ir_search_fallback(spark, d):
    return _search(spark, d, SearchParams("shed xylophone", all_words=True))


def ir_search_page2(spark, d):
    return _search(spark, d, SearchParams("shed heat ingtion", offset=10, limit=10))


def ir_search_words(spark, d):
    return rt.known_words(_asked(spark, d, "shed xylophone"), SearchParams("shed xylophone", all_words=True))


def ir_index_info(spark, d):
    docs = _docs(spark, d)
    return rt.index_info(docs, rt.term_counts(docs))


def ir_search_stemmed(spark, d):
    docs = _docs(spark, d)
    params = SearchParams("shed heating")
    hits = rt.select(rt.stemmed_postings(docs, params), params, stems=True)
    return rt.page(hits, 0, 10).select("rank", "doc_id", "matched", F.round("score", 6).alias("score"))


def ir_snippets(spark, d):
    params = SearchParams("shed heat ingtion")
    top = rt.page(rt.select(_asked(spark, d, params.q), params), 0, 10)
    return rt.with_snippets(top, _docs(spark, d), params).select("rank", "doc_id", "snippet")


def ir_titles(spark, d):
    return rt.titles(_docs(spark, d), "source")


def _ranking(spark, d):
    """The full rankings of the fixed queries: all their hits."""
    rows = None
    for i, q in SPREAD.items():
        one = rt.ranking_of(rt.select(_asked(spark, d, q), SearchParams(q), most=None), i)
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _marks(spark, d):
    good = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    return good.crossJoin(spark.createDataFrame([(i,) for i in SPREAD], "query_id bigint")).select("query_id", "doc_id")


def _rounded(df, names):
    return df.withColumns({n: F.round(n, 9) for n in names})


_NAMES = ["recall", "precision", "f_measure", "avg_prec", "p5", "p10", "r_prec"]


def ir_metrics(spark, d):
    rows = ev.metrics(_ranking(spark, d), _marks(spark, d))
    return _rounded(rows, _NAMES).select("query_id", "total_found", "total_relevant", "found_relevant", *_NAMES)


def ir_pr_curve(spark, d):
    return _rounded(ev.curves(_ranking(spark, d), _marks(spark, d)), ["precision"])


def ir_pr_cuts(spark, d):
    return _rounded(ev.cuts(_ranking(spark, d), _marks(spark, d)), ["recall", "precision"])


def ir_macro_micro(spark, d):
    rows = ev.metrics(_ranking(spark, d), _marks(spark, d))
    both = ev.macro(rows).crossJoin(ev.micro(rows))
    return _rounded(both, [*_NAMES, "micro_precision", "micro_recall", "micro_f"])


def ir_mean_curve(spark, d):
    return _rounded(ev.mean_curve(ev.metrics(_ranking(spark, d), _marks(spark, d))), ["precision"])


def ir_search_dates(spark, d):
    """Hits from the middle of a month; a document's date is as many days into 2024 as its id."""
    params = SearchParams("shed heat", date_from="2024-03-10", date_to="2024-03-20")
    dates = _docs(spark, d).select("doc_id", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")), "yyyy-MM-dd").alias("date"))
    return rt.page(rt.select(_asked(spark, d, params.q), params, dates), 0, 10).select("rank", "doc_id", "matched", F.round("score", 6).alias("score"), "fallback")


def ir_pages(spark, d):
    """Hits and pages of ten of each fixed query."""
    total = _ranking(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("pages", rt.page_count(F.col("total"), F.lit(10)))


def ir_displays(spark, d):
    """A4: the spelling first seen of each term, where terms are lower-cased first letters and lengths."""
    docs = _docs(spark, d)
    each = docs.select("doc_id", F.posexplode(rt.tx.tokens(F.col("text"))).alias("first_at", "token"))
    return rt.display_forms(each.withColumn("term", F.concat(F.substring("token", 1, 1), F.length("token").cast("string"))))


def txt_paragraphs(spark, d):
    """F13"""
    return _docs(spark, d).select("doc_id", F.posexplode(rt.tx.paragraphs(F.col("text"))).alias("at", "paragraph")).withColumn("paragraph", F.md5("paragraph"))


def txt_normalized(spark, d):
    """F9"""
    return _docs(spark, d).select("doc_id", F.md5(rt.tx.nfkc_lower("text")).alias("hash"))


def txt_safe_names(spark, d):
    """F57"""
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", rt.tx.safe_name(F.col("url")).alias("name"))


def txt_leads(spark, d):
    """Documents as articles whose first section follows their first paragraph."""
    from corpuscube.sources.files import lead_and_body

    docs = _docs(spark, d).select("doc_id", F.concat(F.lit("lead "), "source", F.when(F.col("doc_id") % 3 == 0, "\n== One ==\n").when(F.col("doc_id") % 3 == 1, "\n\n").otherwise(" "), "text").alias("t"))
    return docs.select("doc_id", lead_and_body(F.col("t")).alias("x")).select("doc_id", "x.lead", F.md5("x.body").alias("body")).where("doc_id % 3 = 0")


QUERIES = [ir_search_dates, ir_pages, ir_displays, txt_paragraphs, txt_normalized, txt_safe_names, txt_leads, ir_postings, ir_terms_idf, ir_term_ids, ir_keywords_top5, ir_search_or, ir_search_and, ir_search_not, ir_search_fallback, ir_search_page2, ir_search_words, ir_index_info, ir_search_stemmed, ir_snippets, ir_titles, ir_metrics, ir_pr_curve, ir_pr_cuts, ir_macro_micro, ir_mean_curve]

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in RETRIEVAL)
_COUNTS = f"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term NOT IN ({_STOP}) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)::DOUBLE) AS idf FROM counts GROUP BY term),
weighted AS (SELECT doc_id, term, tf, tf * idf AS weight FROM counts JOIN terms USING (term))"""


def _hits(wanted, banned=(), all_words=False):
    listed = ", ".join(f"'{w}'" for w in wanted)
    sql = f"""hits AS (SELECT doc_id, count(*) AS matched, sum(weight::DECIMAL(28,9))::DOUBLE AS score FROM weighted WHERE term IN ({listed}) GROUP BY doc_id)"""
    n = len(wanted)
    if all_words:
        sql += f""", mode AS (SELECT coalesce(max(matched), 0) < {n} AS fallback FROM hits),
kept AS (SELECT h.*, m.fallback FROM hits h, mode m WHERE m.fallback OR matched = {n})"""
    else:
        sql += ", kept AS (SELECT *, false AS fallback FROM hits)"
    if banned:
        sql += f", rest AS (SELECT * FROM kept WHERE doc_id NOT IN (SELECT doc_id FROM weighted WHERE term IN ({', '.join(repr(b) for b in banned)})))"
    else:
        sql += ", rest AS (SELECT * FROM kept)"
    return sql + ", ranked AS (SELECT *, row_number() OVER (ORDER BY matched DESC, score DESC, doc_id) AS rank FROM rest QUALIFY rank <= 10000)"


def _search_sql(wanted, banned=(), all_words=False, offset=0, limit=10):
    return f"WITH {_COUNTS}, {_hits(wanted, banned, all_words)} SELECT rank, doc_id, matched, round(score, 6) AS score, fallback FROM ranked WHERE rank > {offset} AND rank <= {offset + limit}"


def _rank_sql():
    parts = []
    for i, q in SPREAD.items():
        words = [w for w in q.split() if w not in RETRIEVAL]
        listed = ", ".join(f"'{w}'" for w in words)
        parts.append(f"SELECT {i}::BIGINT AS query_id, doc_id, row_number() OVER (ORDER BY count(*) DESC, sum(weight::DECIMAL(28,9)) DESC, doc_id) AS position FROM weighted WHERE term IN ({listed}) GROUP BY doc_id")
    return f"""{_COUNTS}, ranking AS ({' UNION ALL '.join(parts)}),
marks AS (SELECT q.query_id, l.doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l, (SELECT unnest([{', '.join(map(str, SPREAD))}])::BIGINT AS query_id) q),
total AS (SELECT query_id, count(*) AS total_relevant FROM marks GROUP BY 1),
judged AS (SELECT r.query_id, r.position, (m.doc_id IS NOT NULL)::INT AS relevant, sum((m.doc_id IS NOT NULL)::INT) OVER (PARTITION BY r.query_id ORDER BY position) AS i FROM ranking r LEFT JOIN marks m USING (query_id, doc_id)),
cuts AS (SELECT query_id, position, i / total_relevant AS recall, i / position AS precision FROM judged JOIN total USING (query_id) WHERE relevant = 1),
curve AS (SELECT query_id, level, coalesce((SELECT max(precision) FROM cuts c WHERE c.query_id = t.query_id AND c.recall >= level / 10.0 - 1e-10), 0) AS precision FROM total t, (SELECT unnest(range(11))::INT AS level)),
m0 AS (SELECT query_id, total_relevant, count(position) AS total_found, coalesce(sum(relevant), 0) AS found_relevant,
  coalesce(sum(CASE WHEN relevant = 1 THEN i / position END), 0) / total_relevant AS avg_prec,
  coalesce(sum(CASE WHEN position <= 5 THEN relevant END), 0) / 5 AS p5, coalesce(sum(CASE WHEN position <= 10 THEN relevant END), 0) / 10 AS p10,
  coalesce(sum(CASE WHEN position <= total_relevant THEN relevant END), 0) / total_relevant AS r_prec FROM total LEFT JOIN judged USING (query_id) GROUP BY query_id, total_relevant),
m1 AS (SELECT *, found_relevant / total_relevant AS recall, CASE WHEN total_found > 0 THEN found_relevant / total_found ELSE 0 END AS precision FROM m0),
metrics AS (SELECT *, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END AS f_measure FROM m1)"""


_MEANS = ", ".join(f"round(avg({n}), 9) AS {n}" for n in _NAMES)
SQL = {
    "ir_postings": f"WITH {_COUNTS} SELECT doc_id, term, tf, round(weight, 6) AS weight FROM weighted",
    "ir_terms_idf": f"WITH {_COUNTS} SELECT term, df, round(idf, 9) AS idf FROM terms",
    "ir_term_ids": f"WITH {_COUNTS} SELECT row_number() OVER (ORDER BY term) AS term_id, term, df FROM terms",
    "ir_keywords_top5": f"WITH {_COUNTS}, top AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term DESC) AS rank FROM weighted QUALIFY rank <= 5) SELECT doc_id, string_agg(term, ', ' ORDER BY rank) AS keywords FROM top GROUP BY doc_id",
    "ir_search_or": _search_sql(["shed", "heat", "ingtion"]),
    "ir_search_and": _search_sql(["heat", "edly"], all_words=True),
    "ir_search_not": _search_sql(["shed", "heat"], ["edly"]),
    "ir_search_fallback": _search_sql(["shed", "xylophone"], all_words=True),
    "ir_search_page2": _search_sql(["shed", "heat", "ingtion"], offset=10),
    "ir_search_dates": f"WITH {_COUNTS}, {_hits(['shed', 'heat'])}, dated AS (SELECT doc_id FROM documents WHERE DATE '2024-01-01' + (doc_id % 366)::INT BETWEEN DATE '2024-03-10' AND DATE '2024-03-20'), again AS (SELECT * EXCLUDE (rank), row_number() OVER (ORDER BY matched DESC, score DESC, doc_id) AS rank FROM ranked JOIN dated USING (doc_id)) SELECT rank, doc_id, matched, round(score, 6) AS score, fallback FROM again WHERE rank <= 10",
    "ir_pages": f"WITH {_rank_sql()} SELECT query_id, count(*) AS total, ceil(count(*) / 10)::BIGINT AS pages FROM ranking GROUP BY 1",
    "ir_displays": "WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents), e AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM t) SELECT w[1] || length(w) AS term, min_by(w, doc_id * 1000000000 + i) AS display FROM e GROUP BY 1",
    "txt_paragraphs": r"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents) SELECT doc_id, unnest(range(len(ps)))::INT AS at, md5(unnest(ps)) AS paragraph FROM p",
    "txt_normalized": "SELECT doc_id, md5(lower(nfc_normalize(text))) AS hash FROM documents",
    "txt_safe_names": r"""SELECT page_id, regexp_replace(trim(url), '[\\/:*?"<>|\s]+', '_', 'g') AS name FROM pages""",
    "txt_leads": "SELECT doc_id, 'lead ' || source || chr(10) AS lead, md5(chr(10) || text) AS body FROM documents WHERE doc_id % 3 = 0 AND source IS NOT NULL AND text IS NOT NULL",
    "ir_search_words": f"WITH {_COUNTS}, q AS (SELECT unnest(['shed', 'xylophone']) AS w), k AS (SELECT w, w IN (SELECT term FROM terms) AS known FROM q) SELECT coalesce(list(w ORDER BY w) FILTER (WHERE known), []) AS known, coalesce(list(w ORDER BY w) FILTER (WHERE NOT known), []) AS unknown, 'and' AS mode FROM k",
    "ir_index_info": f"WITH {_COUNTS} SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT term) AS terms, count(*) AS postings, sum(tf)::BIGINT AS words FROM counts",
    "ir_metrics": f"WITH {_rank_sql()} SELECT query_id, total_found, total_relevant, found_relevant::BIGINT AS found_relevant, {', '.join(f'round({n}, 9) AS {n}' for n in _NAMES)} FROM metrics",
    "ir_pr_curve": f"WITH {_rank_sql()} SELECT query_id, level, round(precision, 9) AS precision FROM curve",
    "ir_pr_cuts": f"WITH {_rank_sql()} SELECT query_id, position, round(recall, 9) AS recall, round(precision, 9) AS precision FROM cuts",
    "ir_macro_micro": f"WITH {_rank_sql()}, s AS (SELECT sum(found_relevant) / sum(total_found) AS mp, sum(found_relevant) / sum(total_relevant) AS mr FROM metrics) SELECT count(*) AS queries, {_MEANS}, round(any_value(mp), 9) AS micro_precision, round(any_value(mr), 9) AS micro_recall, round(2 * any_value(mp) * any_value(mr) / (any_value(mp) + any_value(mr)), 9) AS micro_f FROM metrics, s",
    "ir_mean_curve": f"WITH {_rank_sql()} SELECT level, round(avg(precision), 9) AS precision FROM curve GROUP BY level",
}
# the first line, or, where it says too little, the first line and the body after it
SQL["ir_titles"] = r"""WITH l AS (SELECT doc_id, source, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]|\x{85}|\x{2028}|\x{2029}'), lambda x: trim(x, E' \t')), lambda x: x <> '') AS ls FROM documents),
h AS (SELECT *, coalesce(nullif(trim(trim(ls[1], '[]{}*#='), E' \t'), ''), ls[1]) AS head, array_to_string(ls[2:], ' ') AS body FROM l)
SELECT doc_id, CASE WHEN len(ls) = 0 THEN substr(coalesce(source, ''), 1, 100) WHEN len(regexp_extract_all(head, '\p{L}')) >= 4 THEN substr(head, 1, 100) ELSE rtrim(substr(CASE WHEN body <> '' THEN head || ' — ' || body ELSE coalesce(source, '') || ': ' || head END, 1, 100), ' ,;—-') END AS title FROM h"""
# a hit's words with their places, the words that fit into 300 characters from each one on, and
# the first of those stretches with the most words asked for
_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"
SQL["ir_snippets"] = f"""WITH {_COUNTS}, {_hits(['shed', 'heat', 'ingtion'])}, page AS (SELECT rank, doc_id, text FROM ranked JOIN documents USING (doc_id) WHERE rank <= 10),
p AS (SELECT rank, unnest(regexp_extract_all(text, '[^a-zA-Z0-9]*[a-zA-Z0-9]+')) AS piece, generate_subscripts(regexp_extract_all(text, '[^a-zA-Z0-9]*[a-zA-Z0-9]+'), 1) AS i FROM page),
w AS (SELECT rank, i, piece, regexp_extract(piece, '[a-zA-Z0-9]+$') AS word, sum(length(piece)) OVER (PARTITION BY rank ORDER BY i) AS stop FROM p),
h AS (SELECT *, stop - length(word) AS begin, lower(word) IN ('shed', 'heat', 'ingtion') AS hit FROM w),
f AS (SELECT a.rank, a.i, max(b.i) AS last, sum(b.hit::INT) AS n FROM h a JOIN h b ON b.rank = a.rank AND b.i >= a.i AND b.stop - a.begin <= 300 GROUP BY ALL),
c AS (SELECT rank, i AS first, last FROM f QUALIFY row_number() OVER (PARTITION BY rank ORDER BY n DESC, i) = 1),
s AS (SELECT rank, min(begin) AS a, max(stop) AS b, string_agg(CASE WHEN i = first THEN '' ELSE {_ESCAPED.format("substr(piece, 1, length(piece) - length(word))")} END || CASE WHEN hit THEN '<mark>' || word || '</mark>' ELSE word END, '' ORDER BY i) AS body FROM h JOIN c USING (rank) WHERE i BETWEEN first AND last GROUP BY rank)
SELECT rank, doc_id, CASE WHEN regexp_matches(substr(text, 1, a::BIGINT), '\\S') THEN '… ' ELSE '' END || body || CASE WHEN regexp_matches(substr(text, b::BIGINT + 1), '\\S') THEN ' …' ELSE '' END AS snippet FROM s JOIN page USING (rank)"""
