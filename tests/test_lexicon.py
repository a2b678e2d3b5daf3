"""Dictionary, translation, commands, speech, word forms."""

import pytest
from pyspark.sql import functions as F

from corpuscube.functions import lexical as lx, morphology as m, text as tx
from corpuscube.operators import commands as cm, lexicon as lc
from corpuscube.plans import api, lex, registry

ENTRIES = [
    ("cell", "NOUN", "клетка", "f", "med", 1), ("cell", "NOUN", "ячейка", "f", "general", 1), ("be", "AUX", "быть", "", "general", 1),
    ("painter", "NOUN", "художник", "m,anim", "art", 1), ("europe", "PROPN", "европа", "f", "art", 1), ("clinical trial", "NOUN", "клиническое исследование", "n", "med", 1),
    ("trial", "NOUN", "испытание", "n", "general", 1), ("begin", "VERB", "начинать", "", "general", 1), ("dog", "NOUN", "собака", "f", "general", 1),
]


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "source string, pos string, target string, gram string, domain string, verified int")


def test_lookup(spark, entries):
    asked = spark.createDataFrame([("cell", "NOUN"), ("BE ", "VERB"), ("painter", "NOUN"), ("europe", "NOUN"), ("none", "NOUN"), ("cell", "X")], "lemma string, pos string")
    got = {(r["lemma"], r["pos"]): r["target"] for r in lc.lookup(asked, entries, "med").collect()}
    assert got == {("cell", "NOUN"): "клетка", ("BE ", "VERB"): "быть", ("painter", "NOUN"): "художник", ("europe", "NOUN"): "европа", ("none", "NOUN"): None, ("cell", "X"): None}
    assert {r["lemma"]: r["target"] for r in lc.lookup(asked, entries, "general").collect()}["cell"] in ("ячейка", None)


def sentence(spark, words):
    rows = [(0, i, w, lemma, pos, tag, kind) for i, (w, lemma, pos, tag, kind) in enumerate(words)]
    return spark.createDataFrame(rows, "sent_id int, id int, word string, lemma string, pos string, tag string, kind string")


WORDS = [("The", "the", "DET", "DT", "word"), ("clinical", "clinical", "ADJ", "JJ", "word"), ("trial", "trial", "NOUN", "NN", "word"), ("began", "begin", "VERB", "VBD", "word"), ("in", "in", "ADP", "IN", "word"), ("Europe", "europe", "PROPN", "NNP", "word"), ("2020", "2020", "NUM", "CD", "digit"), (".", ".", "PUNCT", ".", "punct")]


def test_literal(spark, entries):
    got = lc.literal(sentence(spark, WORDS), entries, "med").first()
    assert got["translation"] == "Клиническое исследование начинать [in] Европа 2020."


def test_phrases_take_the_longest(spark, entries):
    more = entries.unionByName(spark.createDataFrame([("clinical trial of", "PHRASE", "x", "", "general", 1), ("trial of", "PHRASE", "y", "", "general", 1)], entries.schema))
    words = spark.createDataFrame([(1, "a clinical trial of a clinical trial".split())], "doc_id int, lemmas array<string>")
    assert [(r["start"], r["size"]) for r in lc.greedy_cover(words, more).orderBy("start").collect()] == [(1, 3), (5, 2)]


def test_coverage_counts_digits(spark, entries):
    told = lc.with_fallback(sentence(spark, WORDS), entries, "med").selectExpr("0 AS text_id", "*")
    row = lc.coverage(told).first()
    assert (row["words"], row["articles"]) == (6, 1) and row["translated"] == 4 and row["coverage"] == pytest.approx(0.8)
    plural = sentence(spark, [("Dogs", "dogs", "NOUN", "NNS", "word")])
    assert lc.with_fallback(plural, entries).first()["target"] == "собака"


def test_replenish(spark, entries):
    words = spark.createDataFrame([("Therapy", "NOUN"), ("therapy", "NOUN"), ("cell", "NOUN"), ("happy", "ADJ")], "lemma string, pos string")
    got = {r["source"]: (r["target"], r["verified"]) for r in lc.replenished(entries, words).collect()}
    assert got == {"therapy": ("Терапия", 0), "happy": ("", 0)}


def test_merge(spark, entries):
    rows = spark.createDataFrame([("Cell ", "noun", "new", "", "med", 1), ("fish", "noun", "рыба", "f", "zoo", 1)], entries.schema)
    merged, counts = lc.merged_entries(entries, rows)
    assert tuple(counts.first()) == (1, 1) and merged.where("source = 'cell' AND domain = 'med'").first()["target"] == "new"
    assert merged.where("source = 'fish'").first()["domain"] == "general"
    kept, counts = lc.merged_entries(entries, rows, update=False)
    assert tuple(counts.first()) == (1, 0) and kept.where("source = 'cell' AND domain = 'med'").first()["target"] == "клетка"


def test_grammar_notes_round_trip():
    text = "m,anim,pf,pair:осмотреть,gpl:врачей,forms:pastm=шёл;pastf=шла"
    gram = lx.parse_gram(text)
    assert gram == {"gender": "m", "anim": True, "aspect": "pf", "pair": "осмотреть", "gpl": "врачей", "forms": {"pastm": "шёл", "pastf": "шла"}}
    assert lx.parse_gram(lx.serialize_gram(gram)) == gram and lx.parse_gram("") == {}


def test_transliteration():
    for word, want in [("therapy", "терапия"), ("biology", "биология"), ("Cubism", "Кубисм"), ("cell", "целл"), ("nation", "нация"), ("co-op", "ко-оп"), ("happy", "хаппи")]:
        assert lx.transliterate(word) == want


def test_domain(spark):
    texts = spark.createDataFrame([(1, "The patient, after surgery."), (2, "A museum and a painting."), (3, "A patient painter."), (4, "nothing"), (5, None)], "i int, text string")
    assert [r[0] for r in texts.orderBy("i").select(lc.domain_of(texts["text"])).collect()] == ["med", "art", "med", "general", "general"]


def test_frequency_list(spark):
    rows = [(0, "Dogs", "dog", "NOUN", "NNS", "subj"), (1, "dog", "dog", "NOUN", "NN", "obj"), (2, "dogs", "dog", "NOUN", "NNS", "obj"), (3, "cat", "cat", "NOUN", "NN", "obj")]
    got = lc.frequency_list(spark.createDataFrame(rows, "at int, word string, lemma string, pos string, tag string, dep string")).where("lemma = 'dog'").first()
    assert (got["freq"], got["forms"], got["tag"], got["dep"]) == (3, ["dogs", "dog"], "NNS", "obj")


def test_tree(spark):
    rows = [(0, 0, 1, "a", "word"), (0, 1, 1, "b", "word"), (0, 2, 0, "c", "word"), (0, 3, 9, "d", "word"), (0, 4, 1, ".", "punct")]
    got = {r["id"]: (r["depth"], r["path"]) for r in lc.tree(spark.createDataFrame(rows, "sent_id int, id int, head_id int, word string, kind string")).collect()}
    assert got == {1: (0, "b"), 0: (1, "b > a"), 2: (2, "b > a > c"), 3: (0, "d")}


def test_commands(spark):
    said = [(0, "öffne Faust"), (1, "Hilfe"), (2, "bitte weitr"), (3, ""), (4, "naechstes bitte"), (5, "hal"), (6, None)]
    u = spark.createDataFrame(said, "i int, text string")
    got = {r["i"]: (r["action"], r["essay"]) for r in cm.match(u, language="de", essays=[("faust", ["Faust", "Goethe"])]).collect()}
    assert got == {0: ("open", "faust"), 1: ("help", None), 2: ("next", None), 3: (None, None), 4: ("next", None), 5: (None, None), 6: (None, None)}


def test_speech(spark):
    t = spark.createDataFrame([(1, 'One two. "Three!" four'), (2, "")], "doc_id int, text string")
    got = cm.text_statistics(t).orderBy("doc_id").collect()
    assert (got[0]["chars"], got[0]["words"], got[0]["sentences"], got[0]["seconds"]) == (22, 4, 3, pytest.approx(1.6)) and got[1]["sentences"] == 0
    assert [(r["start"], r["end"]) for r in cm.sentence_spans(t).orderBy("start").collect()] == [(0, 9), (9, 18), (18, 22)]
    row = api.api_tts(spark.createDataFrame([("hi", "zz", 9.0, None)], "text string, voice string, rate double, pitch double")).first()
    assert (row["voice"], row["rate"], row["pitch"]) == ("de", 400, 50)


def test_neighbours(spark):
    e = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ord int, id string")
    assert [(r["previous"], r["next"]) for r in cm.neighbours(e).orderBy("ord").collect()] == [("c", "b"), ("a", "c"), ("b", "a")]


# Word forms that the rules must give.
NOUNS = """стол m gen sing стола; стол m inst sing столом; книга f gen sing книги; рука f gen sing руки; болезнь f inst sing болезнью;
терапия f prep sing терапии; окно n inst sing окном; море n gen sing моря; здание n prep sing здании; лёгкое n prep sing лёгком;
стол m nom plur столы; врач m nom plur врачи; болезнь f gen plur болезней; рисунок m nom plur рисунки; рисунок m gen plur рисунков;
испытание n gen plur испытаний; поле n gen plur полей; стол m dat plur столам; неделя f inst plur неделями; кусок m gen sing куска;
статья f gen plur статей; армия f gen plur армий; герой m gen sing героя"""
VERBS = """читать 1 sing читаю; читать 3 plur читают; рисовать 1 sing рисую; находить 1 sing нахожу; платить 1 sing плачу; купить 1 sing куплю;
пустить 1 sing пущу; назначить 1 sing назначу; развиваться 3 sing развивается; находиться 1 sing нахожусь; затмевать 3 plur затмевают;
мочь 2 plur можете; идти 3 sing идёт; показать 1 plur покажем; изучить 3 plur изучат; бояться 2 plur боитесь"""


def test_word_forms():
    for line in NOUNS.replace("\n", " ").split(";"):
        word, gender, case, number, want = line.split()
        assert m.decline_noun(word, gender, case, number) == want, line
    for line in VERBS.replace("\n", " ").split(";"):
        verb, person, number, want = line.split()
        assert m.conjugate(verb, int(person), number) == want, line


def test_more_word_forms():
    assert m.decline_noun("пациент", "m", "acc", anim=True) == "пациента" and m.decline_noun("врач", "m", "acc", "plur", anim=True) == "врачей"
    assert m.decline_noun("головная боль", "f", "acc") == "головную боль" and m.decline_noun("анализ крови", "m", "gen") == "анализа крови"
    assert m.decline_noun("ДНК", "f", "gen", gram={"inv": True}) == "ДНК" and m.decline_noun("учёный", "m", "gen", gram={"adjdecl": True}) == "учёного"
    assert m.decline_noun("человек", "m", "nom", "plur", gram={"forms": {"nompl": "люди"}}) == "люди"
    assert [m.agree_adjective(*x) for x in [("красивый", "f"), ("синий", "f"), ("широкий", "m", "sing", "inst"), ("висящий", "f"), ("клинический", "m", "plur", "gen")]] == ["красивая", "синяя", "широким", "висящая", "клинических"]
    assert [m.past(*x) for x in [("идти", "f"), ("помочь", "f"), ("сесть", "m"), ("начаться", "f"), ("мочь", "m", "plur")]] == ["шла", "помогла", "сел", "началась", "могли"]
    assert [m.short_participle(*x) for x in [("обследовать", "f"), ("открыть", "m"), ("выставить", "m"), ("принести", "f")]] == ["обследована", "открыт", "выставлен", "принесена"]
    assert (m.full_participle("написать"), m.gerund("развиваться"), m.gerund("говорить")) == ("написанный", "развиваясь", "говоря")
    assert (m.pronoun_form("он", "gen", True), m.pronoun_form("я", "acc"), m.possessive_form("наш", "f", "sing", "acc"), m.possessive_form("их", "f", "sing", "gen")) == ("него", "меня", "нашу", "их")
    assert [m.numeral_case(n) for n in (1, 2, 5, 21, 11, 102)] == ["nom_sing", "gen_sing", "gen_plur", "nom_sing", "gen_plur", "gen_sing"]
    assert m.demonstrative_form("тот", "m", "plur", "nom") == "те"


def test_normalising_columns(spark):
    t = spark.createDataFrame([("Öffne, bitte!",)], "text string")
    row = t.select(tx.spoken(t["text"]).alias("n"), tx.folded(t["text"]).alias("f")).first()
    assert tuple(row) == ("öffne bitte", "oeffne bitte")


def test_both_ways_to_find_phrases(spark, monkeypatch):
    """Phrases that go to the tasks and phrases that are joined give the same hits and cover."""
    entries = spark.createDataFrame([("a b", "x"), ("b c", "x"), ("a b c d", "x"), ("c d", ""), ("d a", "x"), ("a b c d e f", "x")], "source string, target string")
    words = spark.createDataFrame([(1, "a b c d a b".split()), (2, "b c d a".split()), (3, ["a"]), (4, [])], "doc_id int, lemmas array<string>")
    few = [sorted(map(tuple, f(words, entries).collect())) for f in (lc.phrase_hits, lc.greedy_cover)]
    monkeypatch.setattr(lc, "FEW", 1)
    assert [sorted(map(tuple, f(words, entries).collect())) for f in (lc.phrase_hits, lc.greedy_cover)] == few and few[0]


def test_lead_and_body(spark):
    from corpuscube.sources.files import lead_and_body

    texts = ["lead\n== A ==\nbody\n== B ==\nmore", "one\n\ntwo\n\nthree", "one only", "=== no ===\nx"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(lead_and_body(F.col("t"))).collect()]
    assert [(x["lead"], x["body"].strip()) for x in got] == [("lead\n", "body\n== B ==\nmore"), ("one", "two\n\nthree"), ("one only", ""), ("=== no ===\nx", "")]


def test_marker_language(spark):
    from corpuscube.functions import text as tx

    texts = ["le chat et la souris", "the cat and the mouse", "", "xyz", "je suis ici", "they were here", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tx.marker_language(F.col("t"))).collect()]
    assert got == [tx.french_or_english(t) for t in texts]


def test_common_words_are_not_dealt_by_word(spark, tiny):
    """A join by word would bring every token of a common word to one task."""
    plan = lex.lex_coverage(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("query", ["lex_phrase_cover", "lid_alphabet", "lid_per_language", "lid_document_profile"])
def test_batches_of_texts_are_bounded_in_bytes(spark, tiny, query):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    registry.queries()[query](spark, tiny)
    assert int(spark.conf.get(name)) <= 8 << 20
