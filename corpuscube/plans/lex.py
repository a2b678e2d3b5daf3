"""Dictionary, command and speech queries.  A small dictionary over the words of the English
documents stands for the seed dictionary; words' parts of speech come from their endings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscube.functions import lexical as lx, text as tx
from corpuscube.operators import commands as cm, lexicon as lc
from corpuscube.session import near

ENTRIES = [
    ("shed", "NOUN", "сарай", "m", "general", 1),
    ("shed", "VERB", "ронять", "", "art", 1),
    ("heat", "NOUN", "тепло", "n", "general", 1),
    ("heat", "NOUN", "жар", "m", "med", 1),
    ("thing", "", "вещь", "f", "general", 1),
    ("edly", "ADV", "едко", "", "art", 0),
    ("ingtion", "PROPN", "инкция", "", "general", 1),
    ("hand", "AUX", "подавать", "", "general", 1),
    ("of the", "PHRASE", "из", "", "general", 1),
    ("of the thing", "PHRASE", "из вещи", "", "art", 1),
    ("and the", "PHRASE", "и", "", "general", 1),
]
COLUMNS = "source string, pos string, target string, gram string, domain string, verified int"


def _entries(spark):
    return spark.createDataFrame(ENTRIES, COLUMNS)


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").where("lang = 'en'").select("doc_id", "text")


def _pos(word):
    return F.when(word.isin(lx.ARTICLES), "DET").when(F.endswith(word, F.lit("ly")), "ADV").when(F.endswith(word, F.lit("tion")), "NOUN").when(F.endswith(word, F.lit("ed")), "VERB").otherwise("NOUN")


def _tokens(spark, d):
    each = _docs(spark, d).select(F.col("doc_id").alias("text_id"), F.posexplode(tx.tokens(F.col("text"))).alias("at", "word"))
    return each.select("text_id", "at", "word", F.col("word").alias("lemma"), _pos(F.col("word")).alias("pos"), F.when(F.col("word").rlike("^[0-9]+$"), "digit").otherwise("word").alias("kind"))


def _vocabulary(spark, d):
    return _tokens(spark, d).where("kind = 'word'").select("lemma", "pos").distinct()


def lex_lookup(spark, d):
    return lc.lookup(_vocabulary(spark, d), _entries(spark), "art").where("target IS NOT NULL").select("lemma", "pos", "target", "entry_domain")


def lex_phrase(spark, d):
    words = _docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("lemmas"))
    return lc.phrase_hits(words, _entries(spark)).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def lex_phrase_cover(spark, d):
    words = _docs(spark, d).select("doc_id", tx.tokens(F.col("text")).alias("lemmas"))
    return lc.greedy_cover(words, _entries(spark))


def _translated(spark, d):
    """Tokens with their targets.  A common word's tokens would all be one task's in a shuffle by
    word, so the words with a target go to the tokens, if they are few."""
    tokens = _tokens(spark, d)
    best = lc.lookup(_vocabulary(spark, d), _entries(spark), "general").where("target IS NOT NULL")
    return tokens.join(near(best.select("lemma", "pos", "target")), ["lemma", "pos"], "left")


def lex_coverage(spark, d):
    return lc.coverage(_translated(spark, d)).withColumn("coverage", F.round("coverage", 9))


def lex_unknown(spark, d):
    rows = _translated(spark, d).withColumn("at", F.struct("text_id", "at"))
    return lc.unknown(rows).select("lemma", "pos", "first_at.text_id", "first_at.at")


def lex_freq_list(spark, d):
    rows = _tokens(spark, d).withColumn("at", F.struct("text_id", "at")).withColumn("tag", F.substring("pos", 1, 2)).withColumn("dep", F.lit("dep"))
    return lc.frequency_list(rows).select("lemma", "freq", "pos", "tag", F.col("forms")[0].alias("form"))


def lex_domain(spark, d):
    return _docs(spark, d).select("doc_id", lc.domain_of(F.col("text")).alias("domain"))


def lex_replenish(spark, d):
    return lc.replenished(_entries(spark), _vocabulary(spark, d), "general")


def cmd_match(spark, d):
    return cm.match(spark.read.parquet(f"{d}/conversations.parquet")).select("conv_id", "turn", "action")


def tts_stats(spark, d):
    return cm.text_statistics(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "chars", "words", F.round("seconds", 6).alias("seconds"))


def tts_sentences(spark, d):
    return cm.sentence_spans(spark.read.parquet(f"{d}/documents.parquet"))


def lex_listed(spark, d):
    """A page of the dictionary: a text in any column, unverified entries first."""
    both = [lc.listed(_entries(spark), "HE", limit=3).withColumn("page", F.lit("he")), lc.listed(_entries(spark), "", domain="art").withColumn("page", F.lit("art"))]
    return both[0].unionByName(both[1]).select("page", "source", "pos", "target", "verified")


def lex_entries(spark, d):
    """One entry by its key, and those of the documents' words."""
    words = _vocabulary(spark, d).select(F.col("lemma").alias("source"))
    one = lc.entry_by_key(_entries(spark), "heat", "NOUN", "med").withColumn("by", F.lit("key"))
    return one.unionByName(lc.entries_by_sources(_entries(spark), words).withColumn("by", F.lit("words"))).select("by", "source", "pos", "target", "domain")


def lex_merged(spark, d):
    """Nations as entries, put into the dictionary twice; keys are trimmed and folded."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    rows = n.select(F.concat(F.lit(" "), "n_name").alias("source"), F.lit("propn ").alias("pos"), F.concat(F.lit("t"), "n_nationkey").alias("target"), F.lit("").alias("gram"), F.when(F.col("n_nationkey") % 2 == 0, "art").otherwise("geo").alias("domain"), F.lit(0).alias("verified"))
    once, added = lc.merged_entries(_entries(spark), rows)
    twice, updated = lc.merged_entries(once, rows.where("target < 't2'").withColumn("target", F.lit("again")))
    counts = added.select("added").crossJoin(updated.select("updated"))
    return twice.crossJoin(counts).select("source", "pos", "target", "domain", "added", "updated")


def cmd_neighbours(spark, d):
    """The nation before and after each one, round the ends."""
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("id"))
    return cm.neighbours(n)


QUERIES = [lex_listed, lex_entries, lex_merged, cmd_neighbours, lex_lookup, lex_phrase, lex_phrase_cover, lex_coverage, lex_unknown, lex_freq_list, lex_domain, lex_replenish, cmd_match, tts_stats, tts_sentences]

_TOK = """tok AS (SELECT doc_id AS text_id, unnest(list_zip(range(len(ws)), ws)) AS z FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents WHERE lang = 'en')),
t AS (SELECT text_id, z[1]::BIGINT AS "at", z[2] AS lemma, CASE WHEN z[2] IN ('a', 'an', 'the') THEN 'DET' WHEN z[2] LIKE '%ly' THEN 'ADV' WHEN z[2] LIKE '%tion' THEN 'NOUN' WHEN z[2] LIKE '%ed' THEN 'VERB' ELSE 'NOUN' END AS pos, CASE WHEN regexp_full_match(z[2], '[0-9]+') THEN 'digit' ELSE 'word' END AS kind FROM tok)"""
_ENTRIES = "e AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r[:3]) + f", '{r[4]}')" for r in ENTRIES) + ") v(source, epos, target, domain))"
_FALL = "fall AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{q}', {i})" for p, qs in lx.POS_FALLBACKS.items() for i, q in enumerate(qs, 1)) + ", ('DET', 'DET', 1), ('DET', '', 2)) v(pos, epos, p))"


def _best(domain):
    near = [domain, "general"] if domain != "general" else ["general"]
    order = near + [x for x in lx.DOMAINS if x not in near]
    d = "CASE domain " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(order, 1)) + " END"
    return f"""{_ENTRIES}, {_FALL}, v AS (SELECT DISTINCT lemma, pos FROM t WHERE kind = 'word'),
found AS (SELECT lemma, v.pos, target, domain, CASE WHEN p IS NOT NULL THEN CASE WHEN {d} <= {len(near)} THEN 0 ELSE 100000 END + p * 100 + {d} WHEN e.epos = '' THEN 200000 + {d} END AS pr FROM v JOIN e ON source = lemma LEFT JOIN fall f ON f.pos = v.pos AND f.epos = e.epos),
best AS (SELECT lemma, pos, min_by(target, pr) AS target, min_by(domain, pr) AS entry_domain FROM found WHERE pr IS NOT NULL GROUP BY ALL)"""


def _hit_sql(keyword: str) -> str:
    n, f = cm._plain(keyword, False), cm._plain(keyword, True)
    out = f"contains(n, '{n}') OR contains(f, '{f}')"
    if len(n) >= 4:
        out += f" OR len(list_filter(string_split(n, ' '), lambda w: length(w) >= 4 AND levenshtein(w, '{n}') <= 1)) > 0 OR len(list_filter(string_split(f, ' '), lambda w: length(w) >= 4 AND levenshtein(w, '{f}') <= 1)) > 0"
    return out


_FOLD = "lower(trim(text))"
for _a, _b in tx.UMLAUTS.items():
    _FOLD = f"replace({_FOLD}, '{_a}', '{_b}')"
_SPACED = "trim(regexp_replace(regexp_replace({}, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
SQL = {
    "lex_lookup": f"WITH {_TOK}, {_best('art')} SELECT * FROM best",
    "lex_phrase": f"WITH {_TOK}, {_ENTRIES}, n AS (SELECT text_id, lemma || ' ' || lead(lemma) OVER w AS p2, lemma || ' ' || lead(lemma) OVER w || ' ' || lead(lemma, 2) OVER w AS p3 FROM t WINDOW w AS (PARTITION BY text_id ORDER BY \"at\")), a AS (SELECT text_id, p2 AS phrase FROM n UNION ALL SELECT text_id, p3 FROM n) SELECT phrase, count(*) AS n, count(DISTINCT text_id) AS docs FROM a WHERE phrase IN (SELECT source FROM e) GROUP BY phrase",
    "lex_coverage": f"WITH {_TOK}, {_best('general')} SELECT text_id, count_if(kind = 'word')::BIGINT AS words, count_if(kind = 'word' AND t.pos = 'DET')::BIGINT AS articles, count_if(kind = 'digit' OR (kind = 'word' AND t.pos <> 'DET' AND target IS NOT NULL))::BIGINT AS translated, round(translated / greatest(1, words - articles), 9) AS coverage FROM t LEFT JOIN best USING (lemma, pos) GROUP BY text_id",
    "lex_unknown": f"WITH {_TOK}, {_best('general')} SELECT lemma, min_by(t.pos, (text_id, \"at\")) AS pos, min((text_id, \"at\"))[1] AS text_id, min((text_id, \"at\"))[2]::INT AS \"at\" FROM t LEFT JOIN best USING (lemma, pos) WHERE kind = 'word' AND target IS NULL GROUP BY lemma",
    "lex_freq_list": f"WITH {_TOK} SELECT lemma, count(*) AS freq, any_value(pos) AS pos, substr(any_value(pos), 1, 2) AS tag, lemma AS form FROM t GROUP BY lemma",
    "lex_domain": "WITH w AS (SELECT doc_id, list_distinct(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda x: regexp_replace(x, '^[.,;:!?()\"'']+|[.,;:!?()\"'']+$', '', 'g'))) AS ws FROM documents WHERE lang = 'en'), s AS (SELECT doc_id, "
    + ", ".join(f"len(list_intersect(ws, [{', '.join(repr(x) for x in v)}])) AS {k}" for k, v in lx.DOMAIN_WORDS.items())
    + " FROM w) SELECT doc_id, CASE WHEN med >= art AND med > 0 THEN 'med' WHEN art > 0 THEN 'art' ELSE 'general' END AS domain FROM s",
    "cmd_match": f"WITH u AS (SELECT conv_id, turn, {_SPACED.format('lower(trim(text))')} AS n, {_SPACED.format(_FOLD)} AS f FROM conversations) SELECT conv_id, turn, CASE WHEN n = '' THEN NULL "
    + " ".join(f"WHEN {_hit_sql(k)} THEN '{a}'" for a, ks in cm.COMMANDS["en"].items() for k in ks)
    + " END AS action FROM u",
    "tts_sentences": "WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?…]*[.!?…][”’\"»‹)\\]]*\\s*|[^.!?…]+$') AS x FROM documents), u AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS t FROM s) SELECT doc_id, (sum(length(t)) OVER w - length(t))::INT AS start, (sum(length(t)) OVER w)::INT AS \"end\" FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)",
    "tts_stats": "SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '\\S+')) AS words, round(words / 150 * 60, 6) AS seconds FROM documents",
}
_ALL = "e AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{x}', {v})" for a, b, c, _, x, v in ENTRIES) + ") t(source, pos, target, domain, verified))"
SQL |= {
    "lex_listed": f"WITH {_ALL}, a AS (SELECT 'he' AS page, * FROM e WHERE source LIKE '%he%' OR target LIKE '%he%' ORDER BY verified, source, pos, domain LIMIT 3) SELECT page, source, pos, target, verified FROM a UNION ALL SELECT 'art', source, pos, target, verified FROM e WHERE domain = 'art'",
    "lex_entries": f"WITH {_ALL}, {_TOK} SELECT 'key' AS by, source, pos, target, domain FROM e WHERE (source, pos, domain) = ('heat', 'NOUN', 'med') UNION ALL SELECT 'words', source, pos, target, domain FROM e WHERE source IN (SELECT lemma FROM t WHERE kind = 'word')",
    "lex_merged": f"WITH {_ALL}, n AS (SELECT lower(n_name) AS source, 'PROPN' AS pos, 't' || n_nationkey AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'art' ELSE 'general' END AS domain FROM nation), u AS (SELECT source, pos, CASE WHEN target < 't2' THEN 'again' ELSE target END AS target, domain FROM n) SELECT *, (SELECT count(*) FROM n) AS added, (SELECT count(*) FROM n WHERE target < 't2') AS updated FROM (SELECT source, pos, target, domain FROM e UNION ALL SELECT * FROM u)",
    "cmd_neighbours": "SELECT n_nationkey AS ord, n_name AS id, coalesce(lag(n_name) OVER w, (SELECT max_by(n_name, n_nationkey) FROM nation)) AS previous, coalesce(lead(n_name) OVER w, (SELECT min_by(n_name, n_nationkey) FROM nation)) AS next FROM nation WINDOW w AS (ORDER BY n_nationkey)",
    "lex_phrase_cover": f"""WITH RECURSIVE {_TOK}, {_ENTRIES}, n AS (SELECT text_id, "at", lemma || ' ' || lead(lemma) OVER w AS p2, lemma || ' ' || lead(lemma) OVER w || ' ' || lead(lemma, 2) OVER w AS p3 FROM t WINDOW w AS (PARTITION BY text_id ORDER BY "at")),
h AS (SELECT text_id, "at", CASE WHEN p3 IN (SELECT source FROM e) THEN 3 ELSE 2 END AS size, CASE WHEN p3 IN (SELECT source FROM e) THEN p3 ELSE p2 END AS phrase FROM n WHERE p2 IN (SELECT source FROM e) OR p3 IN (SELECT source FROM e)),
r AS (SELECT text_id, min("at") AS "at" FROM h GROUP BY text_id UNION ALL SELECT r.text_id, (SELECT min(x."at") FROM h x WHERE x.text_id = r.text_id AND x."at" >= r."at" + h.size) FROM r JOIN h ON h.text_id = r.text_id AND h."at" = r."at" WHERE r."at" IS NOT NULL)
SELECT h.text_id AS doc_id, h."at"::INT AS start, size, phrase FROM r JOIN h USING (text_id, "at")""",
}
# a word in pieces, the longest groups of letters first; c is soft before e, i and y
_GROUPS = "|".join(sorted(lx.GROUPS, key=len, reverse=True))
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in {**lx.LETTERS, **lx.GROUPS}.items()) + "}"
SQL["lex_replenish"] = f"""WITH {_TOK}, {_best('general')}, m AS (SELECT DISTINCT lower(v.lemma) AS source, v.pos FROM v LEFT JOIN best b ON b.lemma = v.lemma AND b.pos = v.pos WHERE b.lemma IS NULL),
p AS (SELECT *, regexp_extract_all(source, '{_GROUPS}|.') AS ps FROM m),
w AS (SELECT source, pos, array_to_string(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN ps[i] = 'c' THEN CASE WHEN substr(coalesce(ps[i + 1], ''), 1, 1) IN ('e', 'i', 'y') THEN 'ц' ELSE 'к' END ELSE coalesce({_MAP}[ps[i]], '') END), '') || CASE WHEN length(source) > 3 AND regexp_matches(source, '[aeiouy][^aeiouy]y$') THEN 'я' ELSE '' END AS t FROM p)
SELECT source, pos, CASE WHEN pos IN ('PROPN', 'NOUN', 'X') THEN t ELSE '' END AS target, '' AS gram, 'general' AS domain, 0 AS verified FROM w"""
