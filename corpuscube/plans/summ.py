"""Summary queries over the English and French documents; turns of conversations stand for
summaries with a reference, embeddings for sentence vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscube.functions import values as vl
from corpuscube.functions.stopwords import SUMMARY
from corpuscube.operators import summary as sm


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").where(F.col("lang").isin("en", "fr")).select("doc_id", "text", "lang")


def _words(spark, d):
    return sm.words_of(_docs(spark, d))


def sum_df_idf(spark, d):
    return _words(spark, d).all.select("term", "df", F.round("idf", 9).alias("idf"))


def sum_word_weights(spark, d):
    return sm.word_weights_of(_words(spark, d)).select("doc_id", "term", "tf", F.round("base", 6).alias("base"), F.round("weight", 6).alias("weight"))


def _shown(rows):
    return rows.select("doc_id", "index", F.md5("text").alias("text"), *[F.round(c, 6).alias(c) for c in ("posd", "posp", "score", "weight")])


def sum_sentence_weights(spark, d):
    return _shown(sm.sentences_of(_words(spark, d)))


def sum_topn(spark, d):
    """The heaviest sentences, by weights of nine places."""
    return _shown(sm.top_sentences_of(_words(spark, d)))


def sum_mmr(spark, d):
    return sm.diverse_sentences_of(_words(spark, d))


def sum_keywords(spark, d):
    return sm.keyword_trees_of(_words(spark, d))


def _pairs(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("hypothesis"))
    b = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return a.join(b, ["conv_id", "turn"]).withColumn("id", F.concat_ws("/", "conv_id", "turn"))


def sum_rouge1(spark, d):
    return sm.rouge(_pairs(spark, d), 1).withColumn("rouge", F.round("rouge", 6))


def sum_rouge2(spark, d):
    return sm.rouge(_pairs(spark, d), 2).withColumn("rouge", F.round("rouge", 6))


def sum_coverage(spark, d):
    return sm.coverage_of(_words(spark, d)).withColumn("coverage", F.round("coverage", 4))


def sum_scores(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "turn", "role")
    rows = sm.rouge(_pairs(spark, d), 1).withColumn("rouge", F.round("rouge", 6)).join(c, "id").withColumn("turn", F.col("turn").cast("string"))
    return sm.mean_scores(rows, ["role", "turn"], ["rouge"])


def sum_cosine_centroid(spark, d):
    """each vector's cosine to the mean of its label's vectors."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda v: v["m"]).alias("centre"))
    return e.join(F.broadcast(centre), "label").select("vec_id", F.round(vl.cosine(F.col("embedding"), F.col("centre")), 5).alias("cosine"))


def sum_compression(spark, d):
    p = _pairs(spark, d)
    return p.select("id", F.round(vl.compression(F.col("reference"), F.col("hypothesis")), 6).alias("compression"))


def sum_cosine_topk(spark, d):
    """The three vectors nearest to each whose id 50 divides, of cosine 0.45 or more."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    return sm.nearest(e, e.where("vec_id % 50 = 0"), k=3, least=0.45)


QUERIES = [sum_cosine_topk, sum_df_idf, sum_word_weights, sum_sentence_weights, sum_topn, sum_mmr, sum_keywords, sum_rouge1, sum_rouge2, sum_coverage, sum_scores, sum_cosine_centroid, sum_compression]

_WORD = sm.tx.SUMMARY_WORD


def _list(lang: str) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in SUMMARY[lang]) + ")"


_COUNTS = f"""w AS (SELECT doc_id, lang, lower(unnest(regexp_extract_all(text, '{_WORD}'))) AS term FROM documents WHERE lang IN ('en', 'fr')),
counts AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE length(term) >= 2 AND NOT (lang = 'en' AND term IN {_list('en')}) AND NOT (lang = 'fr' AND term IN {_list('fr')}) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents WHERE lang IN ('en', 'fr'))::DOUBLE / count(*)::DOUBLE) AS idf FROM counts GROUP BY term)"""
_PAIRS = "pairs AS (SELECT a.conv_id || '/' || a.turn AS id, a.turn, a.text AS hypothesis, b.text AS reference FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn WHERE a.role = 'assistant')"


def _rouge(n: int) -> str:
    def grams(column: str, name: str) -> str:
        words = f"SELECT id, list_transform(regexp_extract_all({column}, '{_WORD}'), lambda x: lower(x)) AS ws FROM pairs"
        each = f"SELECT id, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS gram FROM ({words})"
        return f"{name} AS (SELECT id, gram, count(*) AS n FROM ({each}) GROUP BY ALL)"

    return f"""{_PAIRS}, {grams('hypothesis', 'h')}, {grams('reference', 'r')},
s AS (SELECT coalesce(h.id, r.id) AS id, sum(least(coalesce(h.n, 0), coalesce(r.n, 0))) AS common, sum(coalesce(h.n, 0)) AS hn, sum(coalesce(r.n, 0)) AS rn FROM h FULL JOIN r ON h.id = r.id AND h.gram = r.gram GROUP BY ALL),
scored AS (SELECT p.id, p.turn, round(CASE WHEN common > 0 THEN 2 * common / (hn + rn) ELSE 0 END, 6) AS rouge FROM pairs p LEFT JOIN s USING (id))"""


SQL = {
    "sum_df_idf": f"WITH {_COUNTS} SELECT term, df, round(idf, 9) AS idf FROM freq",
    "sum_word_weights": f"WITH {_COUNTS} SELECT doc_id, term, tf, round(tf * idf, 6) AS base, round(0.5 * (1 + tf / max(tf) OVER (PARTITION BY doc_id)) * idf, 6) AS weight FROM counts JOIN freq USING (term)",
    "sum_rouge1": f"WITH {_rouge(1)} SELECT id, rouge FROM scored",
    "sum_rouge2": f"WITH {_rouge(2)} SELECT id, rouge FROM scored",
    "sum_scores": f"WITH {_rouge(1)} SELECT 'assistant' AS role, turn::VARCHAR AS turn, round(avg(rouge), 4) AS rouge FROM scored GROUP BY turn UNION ALL SELECT 'all', 'all', round(avg(rouge), 4) FROM scored",
    "sum_cosine_centroid": "WITH e AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL) SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 5) AS cosine FROM e JOIN m USING (label, i) GROUP BY vec_id",
    "sum_compression": f"WITH {_PAIRS} SELECT id, round(length(reference) / length(hypothesis), 6) AS compression FROM pairs",
}

# sentences: a mark in place of the full stops that end none, one between sentences; then each
# sentence's place is looked for from the end of the one before.  Marks are put in twice, since
# a pattern without look-ahead takes what the next one begins with.
_ABBREVIATED = "(^|[^\\p{L}\\p{N}_])(" + "|".join(a.replace(".", "\\.") for a in sorted(sm.tx.ABBREVIATIONS, key=len, reverse=True)) + ")\\.(\\s)"
_INITIAL = "(^|[^\\p{L}\\p{N}_])([A-Za-zÀ-Ý])\\.(\\s?[A-ZÀ-Ý])"
_HELD = "block"
for _pattern, _flags in ((_ABBREVIATED, "gi"), (_ABBREVIATED, "gi"), (_INITIAL, "g"), (_INITIAL, "g")):
    _HELD = f"regexp_replace({_HELD}, '{_pattern}', '\\1\\2' || chr(1) || '\\3', '{_flags}')"
_SENTENCES = f"""RECURSIVE {_COUNTS},
b0 AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS block, generate_subscripts(list_filter(list_transform(string_split_regex(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), 1) AS k FROM documents WHERE lang IN ('en', 'fr')),
blocks AS (SELECT *, (sum(length(block) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(block) - 1)::BIGINT AS base, (sum(length(block) + 1) OVER (PARTITION BY doc_id) - 1)::BIGINT AS doc_length FROM b0),
cut AS (SELECT *, list_filter(list_transform(string_split(regexp_replace({_HELD}, '([.!?…]+["'')\\]»”]*\\s+)(["''«(\\[]?[A-ZÀ-ÖØ-Þ0-9])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda x: regexp_replace(regexp_replace(replace(x, chr(1), '.'), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')), lambda x: length(x) >= 2) AS ss FROM blocks),
walk AS (SELECT doc_id, k, 0 AS i, 0::BIGINT AS pos, 0::BIGINT AS free FROM cut UNION ALL SELECT w.doc_id, w.k, w.i + 1, pos2, pos2 + length(s) FROM (SELECT w.*, c.ss[w.i + 1] AS s, w.free + greatest(instr(substr(c.block, w.free + 1), c.ss[w.i + 1]) - 1, 0) AS pos2 FROM walk w JOIN cut c ON c.doc_id = w.doc_id AND c.k = w.k AND w.i < len(c.ss)) w),
sent AS (SELECT w.doc_id, (row_number() OVER (PARTITION BY w.doc_id ORDER BY w.k, w.i) - 1)::INT AS index, ss[w.i] AS text, base + pos AS in_doc, pos AS in_par, length(block) AS par_length, doc_length FROM walk w JOIN cut c ON c.doc_id = w.doc_id AND c.k = w.k WHERE w.i > 0),
weights AS (SELECT doc_id, term, tf * idf AS base, 0.5 * (1 + tf / max(tf) OVER (PARTITION BY doc_id)) * idf AS weight FROM counts JOIN freq USING (term)),
sw AS (SELECT doc_id, index, lower(unnest(regexp_extract_all(text, '{_WORD}'))) AS term FROM sent),
sc AS (SELECT sw.doc_id, index, sum(weight) AS score FROM sw JOIN weights USING (doc_id, term) GROUP BY ALL),
scored AS (SELECT s.doc_id, s.index, s.text, 1 - in_doc / greatest(doc_length, 1) AS posd, 1 - in_par / greatest(par_length, 1) AS posp, coalesce(score, 0) AS score, (1 - in_doc / greatest(doc_length, 1)) * (1 - in_par / greatest(par_length, 1)) * coalesce(score, 0) AS weight FROM sent s LEFT JOIN sc USING (doc_id, index)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, index) AS rank, max(round(weight, 9) > 0) OVER (PARTITION BY doc_id) AS held FROM scored) WHERE CASE WHEN held THEN round(weight, 9) > 0 AND rank <= 10 ELSE index < 10 END)"""
_ROUNDED = "doc_id, index, md5(text) AS text, round(posd, 6) AS posd, round(posp, 6) AS posp, round(score, 6) AS score, round(weight, 6) AS weight"
SQL |= {
    "sum_sentence_weights": f"WITH {_SENTENCES} SELECT {_ROUNDED} FROM scored",
    "sum_topn": f"WITH {_SENTENCES} SELECT {_ROUNDED.replace('round(weight, 6)', 'round(round(weight, 9), 6)')} FROM top",
    "sum_coverage": f"WITH {_SENTENCES}, k AS (SELECT doc_id, term FROM weights QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(base, 9) DESC, term) <= 20), said AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{_WORD}'))) AS term FROM top) SELECT doc_id, round(count(*) / 20, 4) AS coverage FROM k JOIN said USING (doc_id, term) GROUP BY 1",
    "sum_cosine_topk": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(q.v, c.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(c.v, c.v))), 5) AS cosine FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM p WHERE cosine >= 0.45 QUALIFY rank <= 3",
}
