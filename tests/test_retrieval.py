"""Retrieval and its evaluation on a hand-computed collection of five documents."""

import math

import pytest
from pyspark.sql import functions as F

from corpuscube.functions import text as tx
from corpuscube.functions.porter import stem
from corpuscube.operators import evaluation as ev, retrieval as rt, vocabulary
from corpuscube.operators.retrieval import SearchParams
from corpuscube.plans import ir

TEXTS = ["cat cat cat dog", "cat dog dog dog bird bird", "bird bird bird bird", "zebra elephant", "cat cat cat cat cat"]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(i, t, f"2020-01-0{i}") for i, t in enumerate(TEXTS, 1)], "doc_id long, text string, date string")
    counts = rt.term_counts(docs)
    terms = rt.terms(counts, docs.selectExpr("count(*) AS n")).cache()
    return docs, counts, terms, rt.postings(counts, terms).cache()


def found(index, q, **kw):
    fallback = kw.pop("fallback", True)
    rows = rt.select(index[3], SearchParams(q, **kw), index[0], fallback=fallback).collect()
    return [r["doc_id"] for r in rows], {r["fallback"] for r in rows}


def test_dictionary(index):
    got = {r["term"]: (r["df"], r["idf"]) for r in index[2].collect()}
    assert {t: n for t, (n, _) in got.items()} == {"cat": 3, "dog": 2, "bird": 2, "zebra": 1, "elephant": 1}
    assert got["cat"][1] == pytest.approx(math.log(5 / 3))


def test_or_and_fallback(index):
    assert found(index, "cat dog") == ([2, 1, 5], {False})
    assert found(index, "cat dog", all_words=True) == ([2, 1], {False})
    assert found(index, "cat xylophone", all_words=True) == ([5, 1, 2], {True})
    ids, relaxed = found(index, "cat zebra", all_words=True)
    assert set(ids) == {1, 2, 4, 5} and relaxed == {True}
    assert found(index, "cat xylophone", all_words=True, fallback=False)[0] == []


def test_not_and_dates_come_after_selection(index):
    assert found(index, "cat -dog")[0] == [5]
    assert found(index, "cat", date_from="2020-01-02", date_to="2020-01-05")[0] == [5, 2]
    assert found(index, "cat dog", all_words=True, date_from="2020-01-05")[0] == []


def test_conjunction_is_a_prefix(index):
    for q in ("cat dog", "bird dog", "cat bird"):
        both, either = found(index, q, all_words=True)[0], found(index, q)[0]
        assert either[: len(both)] == both


def test_words_pages_and_keywords(index):
    row = rt.known_words(index[3], SearchParams("cat xylophone", all_words=True)).first()
    assert (row["known"], row["unknown"], row["mode"]) == (["cat"], ["xylophone"], "and")
    hits = rt.select(index[3], SearchParams("cat"))
    assert [(r["rank"], r["doc_id"]) for r in rt.page(hits, 1, 1).collect()] == [(2, 1)]
    words = {r["doc_id"]: r["keywords"] for r in rt.keywords(index[3]).collect()}
    assert words[4] == "zebra, elephant" and words[2] == "dog, bird, cat"


def test_query_parsing():
    wanted, banned = tx.parse_query("Holmes running run -watson well-known the", stems=True)
    assert wanted == {"holm": ["holmes"], "run": ["running", "run"], "well": ["well"], "known": ["known"]} and banned == {"watson": ["watson"]}
    assert tx.parse_query("-cat") == ({}, {"cat": ["cat"]})


def test_stems():
    pairs = "caresses caress ponies poni ties tie cats cat agreed agre plastered plaster motoring motor hopping hop falling fall filing file happy happi sky sky relational relat conditional condit rational ration electriciti electr hopeful hope goodness good revival reviv adjustment adjust adoption adopt probate probat rate rate controll control roll roll dying die enjoy enjoy spied spi".split()
    for word, want in zip(pairs[::2], pairs[1::2]):
        assert stem(word) == want, word


def test_snippet():
    text = "One two three. The <cat> sat on a mat. " + "word " * 100 + "A cat and another cat met."
    s = tx.snippet(text, {"cat"}, 60)
    assert s.startswith("… ") and s.count("<mark>cat</mark>") == 2
    assert tx.snippet(text, {"cat"}, 12) == "… The &lt;<mark>cat</mark> …"
    assert tx.snippet("", {"cat"}) == "" and tx.snippet("...", {"cat"}) == ""


def test_titles():
    assert tx.derive_title("== Moby Dick ==\nCall me", "x") == "Moby Dick"
    assert tx.derive_title("I\nCall me Ishmael", "x") == "I — Call me Ishmael"
    assert tx.derive_title("", "file") == "file"


def romip(spark):
    ranking = spark.createDataFrame([(1, i, i) for i in range(1, 21)], "query_id long, position long, doc_id long")
    return ranking, spark.createDataFrame([(1, d) for d in (1, 2, 4, 15)], "query_id long, doc_id long")


def test_metrics(spark):
    row = ev.metrics(*romip(spark)).first()
    assert (row["recall"], row["precision"], row["p5"], row["p10"], row["r_prec"]) == (1, 0.2, 0.6, 0.3, 0.75)
    assert row["avg_prec"] == pytest.approx((1 + 1 + 3 / 4 + 4 / 15) / 4)
    assert row["pr_curve"] == pytest.approx([1.0] * 6 + [0.75] * 2 + [4 / 15] * 3)
    assert row["relevant_positions"] == [1, 2, 4, 15]


def test_cuts(spark):
    got = [(r["recall"], r["precision"]) for r in ev.cuts(*romip(spark)).orderBy("position").collect()]
    assert got == [(0.25, 1), (0.5, 1), (0.75, 0.75), (1, pytest.approx(4 / 15))]


def test_queries_without_relevant_documents(spark):
    ranking, marks = romip(spark)
    assert ev.metrics(ranking, marks.where("doc_id < 0")).count() == 0
    row = ev.macro(ev.metrics(ranking, marks.where("doc_id < 0"))).first()
    assert row["queries"] == 0 and row["recall"] is None
    missed = spark.createDataFrame([(1, 99)], "query_id long, doc_id long")
    row = ev.metrics(ranking, missed).first()
    assert (row["found_relevant"], row["avg_prec"], row["f_measure"]) == (0, 0, 0)


def test_micro(spark):
    row = ev.micro(ev.metrics(*romip(spark))).first()
    assert (row["micro_precision"], row["micro_recall"]) == (0.2, 1) and row["micro_f"] == pytest.approx(1 / 3)


def test_numbers_do_not_depend_on_how_ranges_are_read(spark):
    """Ranges that the reader puts together by size are numbered as a whole."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    docs = spark.range(0, 3000, 1, 8).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 200), i -> lower(hex(hash(id * 1000 + i * i)))), ' ') AS text")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        got = rt.term_ids(rt.term_counts(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"))).toPandas().sort_values("term_id").to_dict("records")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r["term_id"] for r in got] == list(range(1, len(got) + 1))
    assert [r["term"] for r in got] == sorted(r["term"] for r in got)


def test_one_pass_gives_what_the_steps_give(spark, monkeypatch):
    """Postings, keywords and stemmed hits, where words are sent or joined and rows share an id."""
    monkeypatch.setattr(vocabulary, "FREQUENT", 3)
    rows = [(i, t) for i, t in enumerate(TEXTS, 1)] + [(1, "dog heated sheds"), (6, "heating the shed, shed a heat"), (7, None), (None, "cat heat"), (None, "zebra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts, n = rt.term_counts(docs), docs.selectExpr("count(*) AS n")
    plain, words = rt.postings(counts, rt.terms(counts, n)), rt.words_of(docs)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))
    assert same(plain, rt.postings_of(words))
    assert same(rt.keywords(plain.withColumn("weight", F.round("weight", 9)), 2), rt.keywords_of(words, 2))
    stems, params = rt.term_counts(docs, stems=True), SearchParams("heating sheds -dogs")
    assert same(rt.postings(stems, rt.terms(stems, n)).where(F.col("term").isin("heat", "shed", "dog")), rt.stemmed_postings(docs, params))


def test_stems_begin_as_their_words_do():
    words = [a + b for a in ("dying lying skies sky news proceed happy conflated relational vietnamization hopping").split() for b in ("", "s", "ly", "ing", "ational", "ies")]
    assert all(stem(w)[0] == w[0] for w in words)


def test_postings_of_frequent_words_are_not_shuffled(spark, tiny):
    """Only the counts of ids and of words, and what is joined for rare words, which are none here."""
    plan = ir.ir_postings(spark, tiny)._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1
