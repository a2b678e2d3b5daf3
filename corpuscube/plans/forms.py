"""Word forms, notes, numbers and sentences with their known answers: the SQL states the right
forms; the queries get them from the rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T

from corpuscube.functions import lexical as lx, morphology as mo, text as tx, values as vl
from corpuscube.operators import lexicon as lc, transfer as tr
from corpuscube.plans import api


def _answers(rule):
    """A UDF of one column of arrays of strings, the arguments; what fails is not hidden."""
    return F.pandas_udf(lambda args: pd.Series([rule(*[x or "" for x in a]) for a in args], dtype=object), T.StringType())


def _asked(spark, known: list[tuple], rule):
    """known: (arguments..., the right answer)."""
    rows = [(" ".join(map(str, k[:-1])), [str(x) for x in k[:-1]]) for k in known]
    return spark.createDataFrame(rows, "asked string, args array<string>").select("asked", _answers(rule)("args").alias("form"))


def _sql(known: list[tuple]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quoted(' '.join(map(str, k[:-1])))}, {quoted(k[-1])})" for k in known) + ") t(asked, form)"


# Right forms.
PRONOUNS = [("я", "dat", "", "мне"), ("ты", "inst", "", "тобой"), ("он", "gen", "", "его"), ("он", "gen", "after", "него"), ("она", "inst", "after", "нею"), ("они", "inst", "after", "ними"), ("они", "nom", "after", "они"), ("что", "prep", "", "чём"), ("кто", "acc", "after", "кого"), ("себя", "dat", "after", "себе"), ("дом", "gen", "", "дом")]
POSSESSIVES = [("мой", "f", "sing", "acc", "мою"), ("наш", "n", "sing", "gen", "нашего"), ("ваш", "m", "plur", "inst", "вашими"), ("твой", "m", "sing", "prep", "твоём"), ("их", "f", "sing", "gen", "их"), ("его", "m", "plur", "dat", "его")]
DEMONSTRATIVES = [("этот", "f", "sing", "gen", "этой"), ("тот", "m", "plur", "nom", "те"), ("весь", "n", "sing", "inst", "всем"), ("чей", "f", "sing", "acc", "чью")]
ADJECTIVES = [("красивый", "f", "sing", "nom", "красивая"), ("синий", "f", "sing", "gen", "синей"), ("широкий", "m", "sing", "inst", "широким"), ("большой", "f", "sing", "acc", "большую"), ("новый", "m", "plur", "gen", "новых"), ("русский", "n", "sing", "dat", "русскому"), ("общий", "f", "sing", "nom", "общая")]
NOUNS = [("стол", "m", "gen", "sing", "стола"), ("книга", "f", "gen", "sing", "книги"), ("болезнь", "f", "inst", "sing", "болезнью"), ("терапия", "f", "prep", "sing", "терапии"), ("окно", "n", "inst", "sing", "окном"), ("здание", "n", "prep", "sing", "здании"), ("рисунок", "m", "gen", "plur", "рисунков"), ("статья", "f", "gen", "plur", "статей"), ("армия", "f", "gen", "plur", "армий"), ("герой", "m", "gen", "sing", "героя"), ("неделя", "f", "inst", "plur", "неделями"), ("врач", "m", "nom", "plur", "врачи"), ("море", "n", "gen", "sing", "моря"), ("кусок", "m", "gen", "sing", "куска")]
PLURALS = [("рука", "руки", "рук"), ("поле", "поля", "полей"), ("музей", "музеи", "музеев"), ("здание", "здания", "зданий")]
VERBS = [("читать", 1, "sing", "читаю"), ("рисовать", 3, "plur", "рисуют"), ("находить", 1, "sing", "нахожу"), ("купить", 1, "sing", "куплю"), ("мочь", 2, "plur", "можете"), ("идти", 3, "sing", "идёт"), ("показать", 1, "plur", "покажем"), ("бояться", 2, "plur", "боитесь"), ("произвести", 3, "plur", "произведут"), ("пить", 1, "sing", "пью"), ("беречь", 2, "sing", "бережёшь"), ("видеть", 1, "sing", "вижу"), ("слышать", 3, "plur", "слышат"), ("дать", 3, "sing", "даст"), ("развиваться", 3, "sing", "развивается"), ("начать", 3, "plur", "начнут"), ("возвратить", 1, "sing", "возвращу")]
PASTS = [("идти", "f", "sing", "шла"), ("помочь", "m", "sing", "помог"), ("помочь", "f", "sing", "помогла"), ("вести", "m", "sing", "вёл"), ("нести", "n", "sing", "несло"), ("расти", "m", "sing", "рос"), ("сесть", "m", "sing", "сел"), ("начаться", "f", "sing", "началась"), ("мочь", "m", "plur", "могли"), ("выйти", "m", "sing", "вышел"), ("прийти", "m", "plur", "пришли")]
PARTICIPLES = [("обследовать", "f", "обследована"), ("открыть", "m", "открыт"), ("выставить", "m", "выставлен"), ("принести", "f", "принесена"), ("найти", "m", "найден"), ("принять", "f", "принята"), ("создать", "m", "создан"), ("привлечь", "m", "привлечён")]
GERUNDS = [("развиваться", "развиваясь"), ("говорить", "говоря"), ("читать", "читая"), ("рисовать", "рисуя")]
WRITTEN = [("nation", "PROPN", "нация"), ("Cubism", "NOUN", "Кубисм"), ("happy", "NOUN", "хаппи"), ("run", "VERB", ""), ("Paris", "VERB", "Парис"), ("therapy", "X", "терапия")]
NOTES = [("m,anim,pf,pair:осмотреть,gpl:врачей,forms:pastm=шёл;pastf=шла", "m,anim,pf,pair:осмотреть,gpl:врачей,forms:pastm=шёл;pastf=шла"), ("f, inv", "f,inv"), ("gov:gen,impf", "impf,gov:gen"), ("forms:;x", ""), ("", "")]
NUMBERS = [("one", "один"), ("forty", "сорок"), ("third", "третий"), ("billion", "миллиард")]


def mor_pronouns(spark, d):
    return _asked(spark, PRONOUNS, lambda w, c, after: mo.pronoun_form(w, c, bool(after)))


def mor_possessives(spark, d):
    return _asked(spark, POSSESSIVES, mo.possessive_form)


def mor_demonstratives(spark, d):
    return _asked(spark, DEMONSTRATIVES, mo.demonstrative_form)


def mor_adjectives(spark, d):
    return _asked(spark, ADJECTIVES, mo.agree_adjective)


def mor_nouns(spark, d):
    """M3, M5"""
    return _asked(spark, NOUNS, mo.decline_noun)


def mor_plurals(spark, d):
    rows = spark.createDataFrame([(w,) for w, _, _ in PLURALS], "word string")
    both = [F.pandas_udf(lambda s, f=f: s.map(f), T.StringType())("word") for f in (mo.plural_nominative, mo.plural_genitive)]
    return rows.select("word", both[0].alias("nominative"), both[1].alias("genitive"))


def mor_verbs(spark, d):
    return _asked(spark, VERBS, lambda v, p, n: mo.conjugate(v, int(p), n))


def mor_past(spark, d):
    return _asked(spark, PASTS, mo.past)


def mor_participles(spark, d):
    return _asked(spark, PARTICIPLES, mo.short_participle)


def mor_gerunds(spark, d):
    return _asked(spark, GERUNDS, mo.gerund)


def mor_numbers(spark, d):
    """M9: number words."""
    return _asked(spark, NUMBERS, mo.NUMBERS.get)


def mor_numeral_case(spark, d):
    """The noun after each order's number."""
    rows = spark.read.parquet(f"{d}/orders.parquet")
    return rows.select("o_orderkey", vl.numeral_case(F.col("o_orderkey")).alias("form"))


def lex_transliterated(spark, d):
    """F23"""
    return _asked(spark, WRITTEN, lx.suggest)


def lex_notes(spark, d):
    """notes read and written again."""
    return _asked(spark, NOTES, lambda text: lx.serialize_gram(lx.parse_gram(text)))


def tts_parameters(spark, d):
    """rate and pitch of each part's size and price as a request."""
    p = spark.read.parquet(f"{d}/part.parquet")
    asked = p.select("p_partkey", F.col("p_name").alias("text"), F.col("p_brand").alias("voice"), (F.col("p_size") / 16).alias("rate"), (F.col("p_size") / 32).alias("pitch"))
    made = api.api_tts(asked.drop("p_partkey")).groupBy("text", "voice", "rate", "pitch").agg(F.count(F.lit(1)).alias("n"))
    return made


def api_years(spark, d):
    """Years within what a request says, out of those of the orders."""
    years = [r["y"] for r in spark.read.parquet(f"{d}/orders.parquet").select(F.year("o_orderdate").alias("y")).distinct().collect()]
    rows = [(text, y) for text in ("1994-1996", "1997-", "-1993", "1995") for y in api.select_years([*years, "n/a"], *api.parse_years(text))]
    return spark.createDataFrame(rows, "asked string, year int")


def api_values_filter(spark, d):
    """F53"""
    dims = spark.createDataFrame([("geo", False, True), ("TIME_PERIOD", True, False), ("kind", False, False), ("sex", False, False)], "dim_id string, is_time boolean, is_geo boolean")
    made = api.values_filter(dims, [2020, 2021], ["W", "R1"], {"kind": ["a"], "other": ["b"]})
    return spark.createDataFrame([(k, ",".join(v)) for k, v in made.items()], "dim_id string, codes string")


# Parsed sentences (word, lemma, part of speech, tag, role, head, features), the
# dictionary that they need, and how they read in Russian.
DICTIONARY = [("doctor", "NOUN", "врач", "m,anim", "med"), ("painting", "NOUN", "картина", "f", "general"), ("exhibit", "VERB", "выставлять", "impf,pair:выставить", "general"), ("gallery", "NOUN", "галерея", "f", "general"), ("decision", "NOUN", "решение", "n", "general"), ("patient", "NOUN", "пациент", "m,anim", "med"), ("avoid", "VERB", "избегать", "impf,gov:gen", "general"), ("stress", "NOUN", "стресс", "m", "general"), ("result", "NOUN", "результат", "m", "general"), ("study", "NOUN", "исследование", "n", "general")]
PAST, PLURAL = '{"Tense": "Past", "VerbForm": "Fin"}', '{"Number": "Plur"}'
SENTENCES = [
    ("Картина была выставлена в галерее.", [("The", "the", "DET", "DT", "det", 1, ""), ("painting", "painting", "NOUN", "NN", "nsubjpass", 3, ""), ("was", "be", "AUX", "VBD", "auxpass", 3, PAST), ("exhibited", "exhibit", "VERB", "VBN", "ROOT", -1, '{"VerbForm": "Part", "Tense": "Past"}'), ("at", "at", "ADP", "IN", "prep", 3, ""), ("the", "the", "DET", "DT", "det", 6, ""), ("gallery", "gallery", "NOUN", "NN", "pobj", 4, ""), (".", ".", "PUNCT", ".", "punct", 3, "")]),
    ("Решение врача", [("the", "the", "DET", "DT", "det", 1, ""), ("doctor", "doctor", "NOUN", "NN", "poss", 3, ""), ("'s", "'s", "PART", "POS", "case", 1, ""), ("decision", "decision", "NOUN", "NN", "ROOT", -1, "")]),
    ("Пациенты должны избегать стресса.", [("Patients", "patient", "NOUN", "NNS", "nsubj", 2, PLURAL), ("should", "should", "AUX", "MD", "aux", 2, ""), ("avoid", "avoid", "VERB", "VB", "ROOT", -1, '{"VerbForm": "Inf"}'), ("stress", "stress", "NOUN", "NN", "dobj", 2, ""), (".", ".", "PUNCT", ".", "punct", 2, "")]),
    ("Результаты исследования", [("results", "result", "NOUN", "NNS", "ROOT", -1, PLURAL), ("of", "of", "ADP", "IN", "prep", 0, ""), ("the", "the", "DET", "DT", "det", 3, ""), ("study", "study", "NOUN", "NN", "pobj", 1, "")]),
]


def _parsed(spark):
    rows = [(s, i, *t[:6], t[6] or "{}", "punct" if t[2] == "PUNCT" else "word") for s, (_, ts) in enumerate(SENTENCES) for i, t in enumerate(ts)]
    made = spark.createDataFrame(rows, "sent_id int, id int, word string, lemma string, pos string, tag string, dep string, head_id int, f string, kind string")
    return made.withColumn("feats", F.from_json("f", "map<string,string>")).drop("f")


def _dictionary(spark):
    return spark.createDataFrame([(*e, 1) for e in DICTIONARY], "source string, pos string, target string, gram string, domain string, verified int")


def lex_transfer(spark, d):
    """X9"""
    return tr.translate(_parsed(spark), _dictionary(spark), "med").select("sent_id", "translation")


def lex_literal(spark, d):
    """Word by word."""
    return lc.literal(_parsed(spark), _dictionary(spark), "med").select("sent_id", "translation")


LITERAL = ["Картина [was] выставлять [at] галерея.", "Врач решение", "Пациент [should] избегать стресс.", "Результат [of] исследование"]


def lex_tree(spark, d):
    """A tree over every conversation: turn i hangs on turn i // 2."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    tokens = c.select(F.col("conv_id").alias("sent_id"), F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.floor(F.col("turn") / 2)).otherwise(-1).cast(c.schema["turn"].dataType).alias("head_id"), F.col("turn").cast("string").alias("word"), F.lit("word").alias("kind"))
    return lc.tree(tokens).select("sent_id", "id", "depth", "path")


def txt_language(spark, d):
    """F17"""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", tx.marker_language(F.col("text")).alias("told"))


QUERIES = [mor_pronouns, mor_possessives, mor_demonstratives, mor_adjectives, mor_nouns, mor_plurals, mor_verbs, mor_past, mor_participles, mor_gerunds, mor_numbers, mor_numeral_case, lex_transliterated, lex_notes, tts_parameters, api_years, api_values_filter, lex_transfer, lex_literal, lex_tree, txt_language]


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words))) + "]"


def _translations(texts: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts)) + ") t(sent_id, translation)"


SQL = {
    "mor_pronouns": _sql(PRONOUNS),
    "mor_possessives": _sql(POSSESSIVES),
    "mor_demonstratives": _sql(DEMONSTRATIVES),
    "mor_adjectives": _sql(ADJECTIVES),
    "mor_nouns": _sql(NOUNS),
    "mor_plurals": "SELECT * FROM (VALUES " + ", ".join(str(p) for p in PLURALS) + ") t(word, nominative, genitive)",
    "mor_verbs": _sql(VERBS),
    "mor_past": _sql(PASTS),
    "mor_participles": _sql(PARTICIPLES),
    "mor_gerunds": _sql(GERUNDS),
    "mor_numbers": _sql(NUMBERS),
    "mor_numeral_case": "SELECT o_orderkey, CASE WHEN o_orderkey % 100 BETWEEN 11 AND 14 THEN 'gen_plur' WHEN o_orderkey % 10 = 1 THEN 'nom_sing' WHEN o_orderkey % 10 BETWEEN 2 AND 4 THEN 'gen_sing' ELSE 'gen_plur' END AS form FROM orders",
    "lex_transliterated": _sql(WRITTEN),
    "lex_notes": _sql(NOTES),
    "tts_parameters": "SELECT trim(p_name) AS text, 'de' AS voice, greatest(80, least(400, round_even(p_size / 16 * 175, 0)::INT)) AS rate, greatest(0, least(99, round_even(p_size / 32 * 50, 0)::INT)) AS pitch, count(*) AS n FROM part WHERE trim(p_name) <> '' GROUP BY ALL",
    "api_years": "WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders), a AS (SELECT * FROM (VALUES ('1994-1996', 1994, 1996), ('1997-', 1997, 9999), ('-1993', 0, 1993), ('1995', 1995, 1995)) t(asked, lo, hi)) SELECT asked, year FROM a JOIN y ON year BETWEEN lo AND hi",
    "api_values_filter": "SELECT * FROM (VALUES ('geo', 'W,R1'), ('TIME_PERIOD', '2020,2021'), ('kind', 'a'), ('sex', '')) t(dim_id, codes)",
    "lex_transfer": _translations([t for t, _ in SENTENCES]),
    "lex_literal": _translations(LITERAL),
    "lex_tree": "WITH RECURSIVE t AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn // 2 ELSE -1 END AS head FROM conversations), r AS (SELECT t.conv_id, t.turn, 0 AS depth, t.turn::VARCHAR AS path FROM t WHERE NOT EXISTS (SELECT 1 FROM t h WHERE h.conv_id = t.conv_id AND h.turn = t.head) OR t.head = t.turn UNION ALL SELECT t.conv_id, t.turn, depth + 1, path || ' > ' || t.turn FROM r JOIN t ON t.conv_id = r.conv_id AND t.head = r.turn AND t.head <> t.turn) SELECT conv_id AS sent_id, turn AS id, depth, path FROM r",
    "txt_language": f"WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Zà-ÿÀ-ÿ'']+')) AS ws FROM documents), s AS (SELECT doc_id, len(list_intersect(ws, {_list(tx.FRENCH_MARKERS)})) - len(list_intersect(ws, {_list(tx.ENGLISH_MARKERS)})) AS a, len(list_intersect(ws, {_list(tx.SUMMARY['fr'])})) - len(list_intersect(ws, {_list(tx.SUMMARY['en'])})) AS b FROM w) SELECT doc_id, CASE WHEN (CASE WHEN a <> 0 THEN a ELSE b END) >= 0 THEN 'fr' ELSE 'en' END AS told FROM s",
}
