"""Files in, files out, streams."""

import json

import pytest

from corpuscube.operators import retrieval as rt
from corpuscube.plans import api
from corpuscube.sources import files as fl, sinks as sk
from corpuscube.streaming import refresh


def test_collection(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "two.txt").write_bytes("Привет, мир дорогой".encode("cp1251"))
    (tmp_path / "a.txt").write_text("A title here\nbody", encoding="utf-8")
    (tmp_path / "blank.txt").write_text("  \n")
    (tmp_path / "skip.md").write_text("no")
    rows = fl.collection(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["title"]) for r in rows] == [(1, "A title here"), (2, "Привет, мир дорогой")]


def test_suites(spark, tmp_path):
    d = tmp_path / "test"
    d.mkdir()
    (d / "fr_1.html").write_bytes("<head><meta charset=cp1252></head><p>été".encode("cp1252"))
    (d / "de_1.html").write_text("<p>x")
    rows = fl.suites(spark, {"test": str(d), "gone": str(tmp_path / "gone")}, ["fr", "en"]).collect()
    assert [(r["suite"], r["doc_id"], r["lang_true"], r["text"], r["encoding"]) for r in rows] == [("test", "fr_1", "fr", "été", "cp1252")]


def test_described_collection(spark, tmp_path):
    (tmp_path / "x.txt").write_text("text")
    (tmp_path / "meta.json").write_text(json.dumps([{"id": "x", "file": "x.txt", "reference_file": "x_ref.txt", "lang": "en"}]))
    row = fl.described_collection(spark, str(tmp_path)).first()
    assert (row["text"], row["reference"]) == ("text", None)


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("# comment\nCell\tnoun\tклетка\tf\tmed\nshort\tx\ndog\tNOUN\tсобака\tf\tzoo\n", encoding="utf-8")
    got = [(r["source"], r["pos"], r["domain"]) for r in fl.dictionary_tsv(spark, str(tmp_path / "d.tsv")).collect()]
    assert got == [("cell", "NOUN", "med"), ("dog", "NOUN", "general")]
    for sep in ";,":
        (tmp_path / "d.csv").write_text(sep.join(["source", "pos"]) + "\n" + sep.join(["a", "NOUN"]) + "\n")
        assert fl.dictionary_csv(spark, str(tmp_path / "d.csv")).columns == ["source", "pos"]


def test_answers(spark, tmp_path):
    (tmp_path / "ok").write_text("DATAFLOW,a\n1,2\n")
    (tmp_path / "bad").write_text("no such indicator")
    good, bad = fl.answer_errors(fl.cached_answers(spark, str(tmp_path)))
    assert [r["name"] for r in good.collect()] == ["ok"] and [r["name"] for r in bad.collect()] == ["bad"]
    (tmp_path / "ok.csv").write_text("﻿DATAFLOW,OBS_VALUE\nD,1\n,\n", encoding="utf-8")
    table = fl.sdmx_csv(spark, str(tmp_path / "ok.csv"))
    assert table.columns == ["DATAFLOW", "OBS_VALUE"] and table.count() == 1


def test_command_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"de": [{"action": "help", "title": "H", "keywords": ["hilfe", "befehle"]}], "note": "x"}))
    assert [(r["lang"], r["action"], r["kw_ord"], r["keyword"]) for r in fl.command_file(spark, str(tmp_path / "c.json")).collect()] == [("de", "help", 0, "hilfe"), ("de", "help", 1, "befehle")]


def test_parameterised_sql(spark):
    t = spark.createDataFrame([("a'b", 1)], "k string, v int")
    assert fl.query(spark, "SELECT v FROM tt WHERE k = :k", {"tt": t}, k="a'b").first()["v"] == 1


def test_books():
    assert fl.cleaned_book(iter(["x", "*** START OF THE BOOK ***", "Text[1]  here", "*** END OF"])) == "Text here"
    text = "\n\n".join(f"CHAPTER {i}\n\nwords {i}" for i in range(1, 4))
    assert [c.split("\n")[0] for c in fl.chapters(text)] == ["CHAPTER 1", "CHAPTER 2", "CHAPTER 3"]
    assert fl.chapters("one\n\ntwo\n\nthree", size=5) == ["one", "two", "three"]
    assert fl.windows("aa bb cc dd", 5) == ["aa bb", "cc dd"]
    assert fl.stressed("été là", "ascii", 1) == "ETE LA" and fl.stressed("longer words", "typos", 3) == fl.stressed("longer words", "typos", 3)
    assert fl.prose_lines("short\n" + "a" * 50 + "\n" + "1" * 50) == "a" * 50


def test_swap_in(spark, tmp_path):
    path = str(tmp_path / "index")
    for n in (1, 2):
        sk.swap_in({"t": spark.range(n)}, path)
        assert spark.read.parquet(path + "/t").count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["index"]


def test_write_csv(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    sk.write_csv(spark.createDataFrame([(2, "b"), (1, None)], "i int, s string"), path, sep=";", bom=True, order=["i"])
    assert open(path, encoding="utf-8").read() == "﻿i;s\n1;\n2;b\n"


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "facts")
    for rows in ([("a", 1), ("b", 1)], [("a", 2)]):
        sk.replace_partitions(spark.createDataFrame(rows, "k string, v int"), path, "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1)}


def test_marks_and_upserts(spark):
    marks = spark.createDataFrame([(1, 1)], "query_id long, doc_id long")
    more = api.api_relevance(marks, spark, 1, [2, 2, 1], True)
    assert more.count() == 2 and api.api_relevance(more, spark, 1, [1], False).first()["doc_id"] == 2
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "id long, v string, seq int")
    old = spark.createDataFrame([(1, "o"), (3, "p")], "id long, v string")
    assert {(r["id"], r["v"]) for r in sk.upserted(old, new, ["id"]).collect()} == {(1, "y"), (2, "z"), (3, "p")}
    queries = spark.createDataFrame([], "query_id long, params_json string")
    once = api.ensure_query(queries, rt.SearchParams("cat"))
    assert once.count() == 1 and api.ensure_query(once, rt.SearchParams("cat")).count() == 1


def test_sessions(spark):
    s = sk.saved_session(spark.createDataFrame([(1, "a", "not json")], "id long, name string, payload string"), spark, 2, "b", {"words": 3})
    rows = sk.session_stats(s).collect()
    assert [r["id"] for r in rows] == [2, 1] and rows[0]["stats"]["words"] == 3


def test_reports(spark):
    table = sk.text_table(spark.createDataFrame([("a|b", 12345, 1.5, None)], "s string, n int, x double, z string"), ["s", "n", "x", "z"])
    assert table.splitlines()[2] == "| a\\|b | 12 345 | 1.50 |  |"
    tree = [{"term": "a", "count": 2, "children": [{"term": "b", "count": 1}]}]
    assert "    - b (1)" in sk.summary_text("T", ["One."], tree) and "<li>&lt;x&gt;</li>" in sk.summary_html("T", ["<x>"], tree)


def test_index_stream(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "counts")
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat")], "doc_id long, text string")
    docs.write.parquet(str(source))
    stream = spark.readStream.schema(docs.schema).parquet(str(source))
    refresh.index_stream(stream, path, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(3, "dog")], docs.schema).write.mode("append").parquet(str(source))
    refresh.index_stream(stream, path, str(tmp_path / "cp")).awaitTermination()
    terms, _ = refresh.current_index(spark, path)
    assert {r["term"]: r["df"] for r in terms.collect()} == {"cat": 2, "dog": 2}


def test_windowed_counts(spark, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet").selectExpr("cast(ts AS timestamp) AS ts", "event_type", "value")
    assert refresh.windowed_counts(events).agg({"n": "sum"}).first()[0] == events.count()


def test_term_ids_follow_code_points(spark):
    terms = spark.createDataFrame([(w,) for w in ["b", "a", "é", "Z"]], "term string")
    assert [r["term"] for r in rt.term_ids(terms).orderBy("term_id").collect()] == ["Z", "a", "b", "é"]


def test_api(spark):
    docs = spark.createDataFrame([(1, "cats run"), (2, "a cat ran"), (3, "dogs")], "doc_id long, text string")
    hits, about = api.api_search(api.build_index(docs), docs, rt.SearchParams("cat"))
    assert {r["doc_id"]: r["snippet"] for r in hits.collect()} == {1: "<mark>cats</mark> run", 2: "a <mark>cat</mark> ran"}
    row = about.first()
    assert (row["total"], row["pages"], row["fallback"]) == (2, 1, False)
    with pytest.raises(Exception):
        fl.training_texts(spark, "/nowhere", ["en"]).count()
