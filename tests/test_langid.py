"""Language identification: the published distance example, n-grams, alphabets, pages."""

import pytest

from corpuscube.functions import text as tx
from corpuscube.operators import langid as li

TRAIN = [("en", "the quick brown fox jumps over the lazy dog and runs away. " * 40), ("fr", "le renard brun rapide saute par-dessus le chien paresseux et s'enfuit, été où ça. " * 40)]


def test_ngrams(spark):
    docs = spark.createDataFrame([(1, "chat"), (2, "chat, 42! dog"), (3, "")], "doc_id long, text string")
    got = {}
    for r in li.document_profiles(docs, n_max=2).collect():
        got.setdefault(r["doc_id"], {})[r["gram"]] = r["n"]
    assert got[1] == {"_": 2, "c": 1, "h": 1, "a": 1, "t": 1, "_c": 1, "ch": 1, "ha": 1, "at": 1, "t_": 1}
    assert got[2]["_"] == 4 and "4" not in got[2] and 3 not in got


def test_out_of_place_example(spark):
    """Category TH ER ON LE ING AND against document TH ING ON ER AND ED: 12."""
    profile = lambda words, name: [(name, w, i) for i, w in enumerate(words.split())]
    lang = spark.createDataFrame(profile("TH ER ON LE ING AND", "xx"), "lang string, gram string, rank int")
    doc = spark.createDataFrame([(1, g, r) for _, g, r in profile("TH ING ON ER AND ED", "")], "doc_id long, gram string, rank int")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = {r["doc_id"]: r["distance"] for r in li.out_of_place(doc, lang, docs).collect()}
    assert got == {1: 12.0, 2: 0.0}


def test_detect(spark):
    train = spark.createDataFrame(TRAIN, "lang string, text string")
    docs = spark.createDataFrame([(1, "the dog runs over the fox"), (2, "le chien saute et s'enfuit, été"), (3, "12 34")], "doc_id long, text string")
    rows = li.detect(docs, li.language_profiles(train), li.letter_frequencies(li.letters(train, keep=["lang"])), "text").collect()
    got = {(r["doc_id"], r["method"]): r for r in rows}
    for method in ("ngram", "alphabet"):
        assert got[1, method]["lang"] == "en" and got[2, method]["lang"] == "fr"
    assert got[3, "ngram"]["lang"] == "fr" and got[3, "ngram"]["distance"] == 0  # no grams: a tie, in the order of languages
    assert got[3, "alphabet"]["distance"] == 1
    assert got[1, "neural"]["error"] and got[1, "neural"]["lang"] is None


def test_reports(spark):
    rows = [(1, "ngram", "en", None, "en"), (2, "ngram", "en", None, "fr"), (1, "alphabet", "en", None, "en"), (2, "alphabet", "fr", None, "fr"), (1, "neural", None, "x", "en"), (2, "neural", None, "x", "fr")]
    r = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, method string, lang string, error string, lang_true string, elapsed_ms double")
    report = {x["method"]: (x["correct"], x["errors"], x["accuracy"]) for x in li.method_report(r).collect()}
    assert report == {"ngram": (1, 0, 0.5), "alphabet": (2, 0, 1.0), "neural": (0, 2, 0.0)}
    pairs = {(x["first"], x["second"]): (x["compared"], x["agreement"]) for x in li.pair_agreement(r).collect()}
    assert pairs == {("ngram", "alphabet"): (2, 0.5), ("ngram", "neural"): (0, 0.0), ("alphabet", "neural"): (0, 0.0)}
    assert {(x["lang_true"], x["predicted"]): x["n"] for x in li.confusion(r).where("method = 'neural'").collect()} == {("en", "—"): 1, ("fr", "—"): 1}


def test_diacritics(spark):
    docs = spark.createDataFrame(TRAIN, "lang string, text string")
    got = {r["lang"]: r["share"] for r in li.diacritic_share(li.letters(docs, keep=["lang"]), ["lang"]).collect()}
    assert got["en"] == 0 and got["fr"] > 0.03


@pytest.mark.parametrize("encoding", ["utf-8", "cp1252"])
def test_pages(encoding):
    page = f'<html><head><meta charset="{encoding}"><title>x</title></head><body><nav>menu</nav><p>Été &eacute; <b>bold</b></p><script>no()</script></body></html>'
    text, used = tx.read_page(page.encode(encoding))
    assert used == encoding and tx.visible_text(text) == "Été é bold"


def test_page_without_declaration():
    text, used = tx.read_page("<p>été</p>".encode("latin-1"))
    assert tx.visible_text(text) == "été" and used == "windows-1252"


def test_references_end_with_a_semicolon():
    page = "<title>a</title><p>a &amp;&amp&amp b &lt;i&gt; &#233; &am &quo</p><i>x & y &nosuch; &eacute;</i>"
    assert tx.visible_text(page) == "a &&amp&amp b <i> é &am &quo x & y &nosuch; é".replace("a &&amp", "a a &&amp", 1)
