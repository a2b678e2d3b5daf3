"""The registered queries against brute force and held-out labels, on the small tables; each
with documents that are null, empty, alike or repeated."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from corpuscube.llm import queries as q

TABLE = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def odd(spark, tiny, tmp_path_factory):
    """The small documents and hard ones among them: null, empty, without a letter, one very long
    word, a null source; and labels."""
    root = tmp_path_factory.mktemp("odd")
    d = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = [(1000, None, None, None, None), (1001, "", "en", "src1", 0), (1002, " \t\n", "en", None, 3), (1003, "12 34 !!", "fr", "src1", 8), (1004, "x" * 40000, "en", "src2", 40000), (1005, "é ß \U0001f600", None, "src2", 5), (1006, "", "en", "src1", 0)]
    d.unionByName(spark.createDataFrame(more, TABLE)).write.parquet(f"{root}/documents.parquet")
    labels = spark.read.parquet(f"{tiny}/labels.parquet").select("doc_id", "quality", "toxic")
    labels.unionByName(spark.createDataFrame([(1000, 1, 0), (1001, 0, 1), (1001, 0, 0), (1003, None, None)], "doc_id long, quality int, toxic int")).write.parquet(f"{root}/labels.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], TABLE).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return str(root)


def read(spark, root):
    return spark.read.parquet(f"{root}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty_tables(spark, empty, name):
    assert q.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in sorted(q.queries()) if n != "op10_topk"])
def test_hard_documents_keep_their_rows(spark, odd, name):
    got = q.queries()[name](spark, odd).toPandas()
    assert set(got["doc_id"]) == set(read(spark, odd)["doc_id"])


def check_mix(got, docs):
    rows = got.merge(docs, on="doc_id")
    assert (rows["size"] == rows["text"].map(lambda t: len(WORD.findall(t or "")))).all()
    assert (rows["taken"] <= 2 * rows["size"]).all() and (rows["taken"] % rows["size"].clip(1) == 0).all()
    by = rows.assign(source=rows["source"].map(lambda s: "￿" if s is None else s)).groupby("source").agg(s=("size", "sum"), whole=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"), most=("size", "max")).sort_index()
    assert (by.s == by.whole).all() and ((by.taken - by.target).abs() <= by.most).all()
    weight, cap = np.resize([5.0, 2.0, 1.0], len(by)), 2.0 * by.s.values
    lo, hi = 0.0, cap.sum() + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.minimum(cap, mid * weight).sum() < 1.5 * by.s.sum() else (lo, mid)
    assert np.allclose(np.minimum(cap, hi * weight), by.target.values)


def test_mixing(spark, tiny, docs):
    got = q.op1_mixing(spark, tiny).toPandas()
    check_mix(got, docs)
    again = q.op1_mixing(spark, tiny).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_mixing_hard(spark, odd):
    check_mix(q.op1_mixing(spark, odd).toPandas(), read(spark, odd))


def test_quality_and_toxicity(spark):
    root = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{root}/labels.parquet").toPandas()
    for query, label, floor in ((q.op2_quality, "quality", 0.98), (q.op4_toxicity, "toxic", 0.93)):
        got = query(spark, root).toPandas().merge(labels, on="doc_id")
        assert got.score.between(0, 1).all()
        held = got[got.held_out]
        assert (held.predicted == held[label]).mean() >= floor
        fold = held.doc_id.map(lambda i: zlib.crc32(str(i).encode()))
        assert ((fold % 5 == 0) if label == "quality" else (fold % 3 == 1)).all()


def test_language(spark, odd):
    got = q.op7_language(spark, odd).toPandas().merge(read(spark, odd), on="doc_id")
    held = got[got.held_out & (got.doc_id < 1000)]
    assert (held.lang_pred == held.lang).mean() >= 0.97
    by = got.set_index("doc_id")
    assert all(by.lang_pred[i] == "und" for i in (1000, 1001, 1002, 1003)) and by.lang_pred[1005] != "und" and by.score.between(0, 1).all()


def edited(texts):
    for i, t in enumerate(texts):
        n = len(t)
        yield t[: n - n // 4] + texts[(i + 1) % len(texts)][: n // 4]


def test_fingerprints(spark, odd):
    docs, got = read(spark, odd), q.op3_fingerprints(spark, odd).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = docs.text.fillna("").tolist()
    assert got.n_chars.tolist() == [len(t) for t in texts]
    assert got.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited(texts)]
    assert got.assign(t=texts).groupby("t").fingerprint.nunique().max() == 1 and got.fingerprint.nunique() == len(set(texts))
    own = {t: f for t, f in zip(texts, got.fingerprint)}
    same = [(own[e], f) for e, f in zip(edited(texts), got.edited_fingerprint) if e in own]
    assert same and all(a == b for a, b in same)
    assert got.near_edited.between(0, 1).all() and (got.near_edited > got.near_next).mean() > 0.9


def simhash(text):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = WORD.findall(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, ids, radius=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(ids))]


def test_simhash(spark, odd):
    docs = read(spark, odd)
    got = q.op5_simhash(spark, odd).toPandas().sort_values("doc_id")
    want = [simhash(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in want]
    assert got.component_id.tolist() == components(np.array(want, np.uint64), docs.doc_id.tolist())


def test_sharding(spark, odd):
    got = q.op6_sharding(spark, odd).toPandas().merge(read(spark, odd), on="doc_id")
    body = got.text.map(lambda t: (t or "").encode())
    assert (got["size"] == body.map(len) + 1).all() and (got.text_crc32 == body.map(zlib.crc32)).all() and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for _, s in got.groupby("shard").slot:
        assert sorted(s) == list(range(len(s)))
    sums = got.groupby("shard")["size"].sum().reindex(range(16), fill_value=0)
    assert (sums - got["size"].sum() / 16).abs().max() <= got["size"].max()


def test_packing(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = q.op8_packing(spark, odd).toPandas().sort_values(["doc_id", "start"])
    texts = dict(zip(read(spark, odd).doc_id, read(spark, odd).text))
    for d, pieces in got.groupby("doc_id"):
        ids = np.array(t.encode(texts[d] or "", add_special_tokens=False).ids + [1], "<u4")
        assert pieces.start.tolist() == [0, *np.cumsum(pieces.length).tolist()[:-1]] and pieces.length.sum() == len(ids) and (pieces.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(pieces.start, pieces.length)] == pieces.ids_crc32.tolist()
    rows = got.sort_values(["sequence_id", "offset"])
    for _, s in rows.groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length).tolist()[:-1]] and s.length.sum() <= 2048
    assert got.length.sum() / (2048 * got.sequence_id.nunique()) > 0.95


def repeats(texts, length=50):
    """(kept, runs) of each text; texts in the order of their ids."""
    seen, out = {}, []
    for i, b in enumerate(texts):
        away = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen.get(b[k : k + length], i) < i:
                away[k : k + length] = True
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], i)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], away, [False]])))
        out.append((np.frombuffer(b, np.uint8)[~away].tobytes(), len(edge) // 2))
    return out


def test_repeats(spark, odd):
    docs = read(spark, odd)
    got = q.op9_repeats(spark, odd).toPandas().sort_values("doc_id")
    bodies = [(t or "").encode() for t in docs.text]
    want = repeats(bodies)
    assert got.kept_sha256.tolist() == [hashlib.sha256(k).hexdigest() for k, _ in want]
    assert got.n_spans.tolist() == [n for _, n in want] and got.n_removed.tolist() == [len(b) - len(k) for b, (k, _) in zip(bodies, want)]


def test_topk(spark, tiny):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tiny}/embeddings.parquet'")
    order = ["query_id", "rank"]
    want = con.sql(q.oracle_sql()["op10_topk"]).df().sort_values(order).reset_index(drop=True)
    got = q.op10_topk(spark, tiny).toPandas().sort_values(order).reset_index(drop=True)[want.columns.tolist()]
    pd.testing.assert_frame_equal(got.astype("int64"), want.astype("int64"))
