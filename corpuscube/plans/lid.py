"""Language identification queries.  Profiles and letter frequencies are learned from documents
of odd id, of every language; those of even id are told and judged."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscube.operators import langid as li


def _docs(spark, d, half: int):
    return spark.read.parquet(f"{d}/documents.parquet").where(F.col("doc_id") % 2 == half).select("doc_id", "text", "lang")


def _frequencies(spark, d):
    return li.letter_frequencies(li.letters(_docs(spark, d, 1), keep=["lang"]))


def lid_ngram_profile(spark, d):
    return li.language_profiles(spark.read.parquet(f"{d}/documents.parquet"))


def lid_document_profile(spark, d):
    return li.document_profiles(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


def lid_letter_freq(spark, d):
    return li.letter_frequencies(li.letters(spark.read.parquet(f"{d}/documents.parquet"), keep=["lang"])).withColumn("freq", F.round("freq", 9))


def lid_diacritics(spark, d):
    return li.diacritic_share(li.letters(spark.read.parquet(f"{d}/documents.parquet"), keep=["lang"]), ["lang"]).withColumn("share", F.round("share", 9))


def lid_out_of_place(spark, d):
    docs = _docs(spark, d, 0)
    return li.out_of_place(li.document_profiles(docs), li.language_profiles(_docs(spark, d, 1)), docs)


def lid_alphabet(spark, d):
    docs = _docs(spark, d, 0)
    return li.alphabet_distance(li.letters(docs), _frequencies(spark, d), docs).withColumn("distance", F.round("distance", 6))


def _results(spark, d):
    docs = _docs(spark, d, 0)
    found = li.detect(docs, li.language_profiles(_docs(spark, d, 1)), _frequencies(spark, d))
    return found.join(docs.select("doc_id", F.col("lang").alias("lang_true")), "doc_id")


def lid_accuracy(spark, d):
    return li.method_report(_results(spark, d)).withColumn("accuracy", F.round("accuracy", 9)).drop("time_median_ms", "time_total_ms")


def lid_per_language(spark, d):
    return li.per_language(_results(spark, d))


def lid_confusion(spark, d):
    return li.confusion(_results(spark, d))


def lid_pair_agreement(spark, d):
    return li.pair_agreement(_results(spark, d)).withColumn("agreement", F.round("agreement", 9))


def lid_suite_table(spark, d):
    from corpuscube.sources.sinks import suite_table

    table = suite_table(_results(spark, d).withColumn("suite", F.lit("documents")), li.METHODS)
    return table.drop("ngram_ms", "alphabet_ms", "neural_ms", "neural_distance")


def lid_html_text(spark, d):
    return li.pages_text(spark.read.parquet(f"{d}/pages.parquet")).select("page_id", "text", "chars")


def lid_suite_summary(spark, d):
    """What the methods got right and how often each two of them agree, in one table."""
    found = _results(spark, d)
    methods = li.method_report(found).select(F.lit("method").alias("kind"), F.col("method").alias("name"), F.col("correct").alias("n"), F.round("accuracy", 9).alias("share"))
    pairs = li.pair_agreement(found).select(F.lit("pair"), F.concat_ws(" ", "first", "second"), "compared", F.round("agreement", 9))
    return methods.union(pairs)


QUERIES = [lid_suite_summary, lid_ngram_profile, lid_document_profile, lid_letter_freq, lid_diacritics, lid_out_of_place, lid_alphabet, lid_accuracy, lid_per_language, lid_confusion, lid_pair_agreement, lid_suite_table, lid_html_text]


def _grams(key: str, where: str = "") -> str:
    return f"""words AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '\\p{{L}}+(?:''\\p{{L}}+)*')) AS w FROM documents {where}),
counted AS (SELECT {key}, '_' || w || '_' AS w, count(*) AS n FROM words GROUP BY ALL),
pieces AS (SELECT {key}, unnest(list_transform(range(1, length(w) - k + 2), lambda i: substr(w, i, k))) AS gram, n FROM counted, (SELECT unnest(range(1, 6))::INT AS k) WHERE length(w) >= k),
grams AS (SELECT {key}, gram, sum(n)::BIGINT AS n FROM pieces GROUP BY ALL),
profile AS (SELECT {key}, gram, n, (row_number() OVER (PARTITION BY {key} ORDER BY n DESC, gram) - 1)::INT AS rank FROM grams QUALIFY rank < 300)"""


_ODD, _EVEN = "WHERE doc_id % 2 = 1", "WHERE doc_id % 2 = 0"
_TIES = "CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 3 END, lang"
_PLACE = f"""WITH {_grams('lang', _ODD)}, lp AS (SELECT * FROM profile),
{_grams('doc_id', _EVEN).replace('words', 'words2').replace('counted', 'counted2').replace('pieces', 'pieces2').replace('grams AS', 'grams2 AS').replace('FROM grams', 'FROM grams2').replace('profile AS', 'dp AS')},
size AS (SELECT lang, count(*) AS length FROM lp GROUP BY 1),
gain AS (SELECT doc_id, lp.lang, sum(abs(dp.rank - lp.rank) - length) AS gain FROM dp JOIN lp USING (gram) JOIN size ON size.lang = lp.lang GROUP BY ALL),
many AS (SELECT doc_id, count(*) AS grams FROM dp GROUP BY 1),
oop AS (SELECT d.doc_id, s.lang, (coalesce(grams, 0) * length + coalesce(gain, 0))::DOUBLE AS distance FROM (SELECT doc_id FROM documents {_EVEN}) d CROSS JOIN size s LEFT JOIN many USING (doc_id) LEFT JOIN gain g ON g.doc_id = d.doc_id AND g.lang = s.lang)"""
_ABC = ", ".join(f"'{k}': '{v}'" for k, v in li.ALPHABETS.items())
_LETTERS = f"""lt AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}')) AS letter FROM documents),
dl AS (SELECT doc_id, letter, count(*) AS n FROM lt {_EVEN} GROUP BY ALL),
ll AS (SELECT lang, letter, count(*) AS n FROM lt {_ODD} GROUP BY ALL),
freq AS (SELECT lang, letter, n / sum(n) OVER (PARTITION BY lang) AS freq FROM ll),
share AS (SELECT doc_id, letter, n / sum(n) OVER (PARTITION BY doc_id) AS share FROM dl),
langs AS (SELECT DISTINCT lang FROM freq),
alpha AS (SELECT d.doc_id, g.lang, CASE WHEN count(s.letter) = 0 THEN 1 ELSE sum(abs(s.share - coalesce(f.freq, 0))) + 1 - sum(coalesce(f.freq, 0))
  + sum(CASE WHEN coalesce(contains(MAP {{{_ABC}}}[g.lang], s.letter), f.freq IS NOT NULL) THEN 0 ELSE s.share END) END AS distance
  FROM (SELECT doc_id FROM documents {_EVEN}) d CROSS JOIN langs g LEFT JOIN share s USING (doc_id) LEFT JOIN freq f ON f.lang = g.lang AND f.letter = s.letter GROUP BY ALL)"""
_RESULTS = f"""{_PLACE}, {_LETTERS},
results AS (
 SELECT doc_id, 'ngram' AS method, lang, distance, NULL AS error FROM oop QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, {_TIES}) = 1
 UNION ALL SELECT doc_id, 'alphabet', lang, distance, NULL FROM alpha QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(distance, 12), {_TIES}) = 1
 UNION ALL SELECT doc_id, 'neural', NULL, NULL, 'missing' FROM documents {_EVEN}),
judged AS (SELECT r.*, d.lang AS lang_true FROM results r JOIN documents d USING (doc_id))"""
SQL = {
    "lid_ngram_profile": f"WITH {_grams('lang')} SELECT * FROM profile",
    "lid_document_profile": f"WITH {_grams('doc_id')} SELECT * FROM profile",
    "lid_letter_freq": f"WITH l AS (SELECT lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}')) AS letter FROM documents), c AS (SELECT lang, letter, count(*) AS n FROM l GROUP BY ALL) SELECT lang, letter, n, round(n / sum(n) OVER (PARTITION BY lang), 9) AS freq, coalesce(contains(MAP {{{_ABC}}}[lang], letter), false) AS in_alphabet FROM c",
    "lid_diacritics": "WITH l AS (SELECT lang, unnest(regexp_extract_all(lower(text), '\\p{L}')) AS letter FROM documents) SELECT lang, round(avg(CASE WHEN unicode(letter) > 127 THEN 1.0 ELSE 0.0 END), 9) AS share FROM l GROUP BY lang",
    "lid_out_of_place": f"{_PLACE} SELECT * FROM oop",
    "lid_alphabet": f"WITH {_LETTERS} SELECT doc_id, lang, round(distance, 6) AS distance FROM alpha",
    "lid_accuracy": f"{_RESULTS} SELECT method, count(*) AS total, count_if(error IS NULL AND lang = lang_true)::BIGINT AS correct, count_if(error IS NOT NULL)::BIGINT AS errors, round(correct / total, 9) AS accuracy FROM judged GROUP BY method",
    "lid_suite_table": f"{_RESULTS} SELECT 'documents' AS suite, doc_id, lang_true, max(lang) FILTER (WHERE method = 'ngram') AS ngram_lang, max(round(distance, 6)) FILTER (WHERE method = 'ngram') AS ngram_distance, max(lang) FILTER (WHERE method = 'alphabet') AS alphabet_lang, max(round(distance, 6)) FILTER (WHERE method = 'alphabet') AS alphabet_distance, max(lang) FILTER (WHERE method = 'neural') AS neural_lang FROM judged GROUP BY ALL",
    "lid_per_language": f"{_RESULTS} SELECT method, lang_true, count_if(error IS NULL AND lang = lang_true)::BIGINT AS correct, count(*) AS total FROM judged GROUP BY ALL",
    "lid_confusion": f"{_RESULTS} SELECT method, lang_true, CASE WHEN error IS NOT NULL THEN '—' ELSE coalesce(lang, '—') END AS predicted, count(*) AS n FROM judged GROUP BY ALL",
    "lid_pair_agreement": f"{_RESULTS}, pairs AS (SELECT * FROM (VALUES ('ngram', 'alphabet'), ('ngram', 'neural'), ('alphabet', 'neural')) t(first, second)) SELECT p.first, p.second, count(b.doc_id) AS compared, coalesce(round(avg(CASE WHEN b.doc_id IS NULL THEN NULL WHEN a.lang = b.lang THEN 1.0 ELSE 0.0 END), 9), 0) AS agreement FROM pairs p LEFT JOIN judged a ON a.method = p.first AND a.error IS NULL LEFT JOIN judged b ON b.method = p.second AND b.doc_id = a.doc_id AND b.error IS NULL GROUP BY ALL",
}
SQL["lid_suite_summary"] = SQL["lid_pair_agreement"].replace("SELECT p.first, p.second,", "SELECT 'pair' AS kind, p.first || ' ' || p.second AS name,").replace("AS compared", "AS n").replace("AS agreement", "AS share").replace("GROUP BY ALL", "GROUP BY ALL", 1) + " UNION ALL SELECT 'method', method, count_if(error IS NULL AND lang = lang_true)::BIGINT, round(count_if(error IS NULL AND lang = lang_true) / count(*), 9) FROM judged GROUP BY method"
# shown text: what is in no hidden element, piece by piece between tags
_SHOWN = "html"
for _name in ("script", "style", "nav", "header", "footer", "head"):
    _SHOWN = f"regexp_replace({_SHOWN}, '(?is)<{_name}(\\s[^>]*)?>.*?</{_name}\\s*>', chr(1), 'g')"
_SHOWN = f"regexp_replace({_SHOWN}, '(?s)<!--.*?-->|<[!/a-zA-Z][^>]*>', chr(1), 'g')"
for _entity, _text in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", "\u00a0"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
    _SHOWN = f"replace({_SHOWN}, '&{_entity};', '{_text}')"
SQL["lid_html_text"] = f"WITH t AS (SELECT page_id, regexp_replace(array_to_string(list_filter(list_transform(string_split({_SHOWN}, chr(1)), lambda x: regexp_replace(x, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')), lambda x: x <> ''), ' '), '[\\s\u00a0]+', ' ', 'g') AS text FROM pages) SELECT page_id, text, length(text)::INT AS chars FROM t"
