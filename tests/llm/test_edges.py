"""Every operator and every stage on hard tables: nulls in any column, empty and very long texts,
ties and repeated rows, equal ids, no rows, extra columns whose names an operator uses itself; and
the trained and greedy parts against plain versions."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from corpuscube.llm import fingerprints, language, mixing, packing, quality, repeats, sharding, simhash, topk, toxicity
from corpuscube.llm.spans import flat

#: Names that operators use inside or give to what they make.
CLASHES = "score span_starts span_ends lang_pred ambiguous fingerprint component_id fp node keys size source_size target copies __text __x __o __cell kept n_bytes key start length ids c0 o shard slot text_crc32 id v d rank copy".split()
LONG = ("word " * 250_000 + "end") * 1  # over CHUNK bytes
ROWS = [
    (1, "one two three four five six", "en", "a"),
    (1, "one two three four five six", "en", "a"),
    (1, "another text of the same id", "en", None),
    (2, None, None, None),
    (3, "", "fr", "a"),
    (4, LONG, "en", "b"),
    (5, LONG + " and more", "en", "b"),
    (6, "é ß \U0001f600 " + "x" * 40_000, None, "b"),
    (7, "le petit chat de la maison", "fr", "a"),
    (None, "a row without an id", "en", "a"),
    (None, None, None, None),
    (9, "one two three four five six", "en", "b"),
]


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("hard")
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    df.withColumn("n_chars", F.length("text").cast("bigint")).write.parquet(f"{root}/documents.parquet")
    labels = [(1, 1, 0), (1, 0, 0), (3, 0, 1), (4, None, None), (7, 1, 1), (None, 1, 1), (99, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


@pytest.fixture(scope="module")
def docs(spark, hard):
    return spark.read.parquet(f"{hard}/documents.parquet")


def crowded(docs, without=()):
    """With extra columns of every clashing name."""
    return docs.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES if c not in without and c not in docs.columns])


def plain(rows):
    return sorted(map(repr, rows))


def test_scorers(spark, docs, hard):
    labels = spark.read.parquet(f"{hard}/labels.parquet")
    for fit, made in ((quality.fit, ["score"]), (toxicity.fit, ["score", "span_starts", "span_ends"])):
        model = fit(docs, labels)
        again = fit(docs.repartition(5), labels)  # whatever order rows come in
        assert plain(again.transform(docs.coalesce(1)).collect()) == plain(model.transform(docs.coalesce(1)).collect())
        got = model.transform(crowded(docs)).toPandas()
        assert len(got) == len(ROWS) and got.score.between(0, 1).all()
        rest = [c for c in CLASHES if c not in made]
        assert all(got[c].str.startswith(c).all() for c in rest)
        assert got.score.round(9).groupby(got.text.fillna("")).nunique().max() == 1
        nothing = fit(docs, labels.limit(0)).transform(docs).toPandas()
        assert len(nothing) == len(ROWS) and nothing.score.nunique() == 1
        assert model.transform(docs.limit(0)).count() == 0
        short = fit(docs, labels, most_bytes=1).transform(docs).toPandas()  # the bound on bytes leaves one text at least
        assert len(short) == len(ROWS)


def test_languages(docs):
    model = language.fit(docs)
    got = model.transform(crowded(docs)).toPandas()
    assert len(got) == len(ROWS) and set(got.lang_pred) <= {"en", "fr", "und"}
    assert (got[got.text.isna() | (got.text == "")].lang_pred == "und").all() and all(got[c].str.startswith(c).all() for c in CLASHES if c not in ("score", "lang_pred", "ambiguous"))
    assert language.fit(docs.limit(0)).transform(docs).toPandas().lang_pred.eq("und").all()


def test_fingerprints(docs):
    got = fingerprints.fingerprints(crowded(docs)).toPandas()
    assert len(got) == len(ROWS) and got.groupby(got.text.fillna("")).fingerprint.nunique().max() == 1 and got.fingerprint.nunique() == got.text.fillna("").nunique()
    pairs = fingerprints.edited_neighbours(crowded(docs)).toPandas()
    texts = [t or "" for _, t in sorted(((1 << 63 if i is None else i), t or "") for i, t, *_ in ROWS)]
    want = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, texts[1:] + texts[:1])]
    assert sorted(pairs.edited_sha256) == sorted(hashlib.sha256(x.encode()).hexdigest() for x in want)


@pytest.mark.parametrize("how", [{}, {"shingle": 5, "radius": 14, "similarity": 0.8}])
def test_near_duplicates(docs, how):
    keep = [c for c in CLASHES if c not in ("fingerprint", "component_id", "fp", "node", "keys", "size")]
    got = simhash.near_duplicates(crowded(docs), keep=keep, **how).toPandas()
    assert len(got) == len(ROWS) and list(got.columns) == ["doc_id", *keep, "fingerprint", "component_id"]
    by = got.dropna(subset=["doc_id"]).set_index("doc_id").component_id
    assert by[9] == 1 and by[4] == 4 and by[3] == by[2] == 2  # empty and null are alike
    assert by[5] == (5 if how else 4)  # one fingerprint, but half of the distinct shingles
    assert simhash.near_duplicates(docs.limit(0), **how).count() == 0


def test_repeats(docs):
    got = repeats.remove_repeats(crowded(docs)).toPandas()
    made = ["n_bytes", "span_starts", "span_ends", "kept"]
    assert len(got) == len(ROWS) and all(got[c].str.startswith(c).all() for c in CLASHES if c not in made)
    by = {(i, n): bytes(k) for i, n, k in zip(got.doc_id.fillna(-1), got.n_bytes, got.kept)}
    assert by[4, len(LONG)] == LONG.encode() and len(by[5, len(LONG) + 9]) < 60 and by[2, 0] == by[3, 0] == b""


def test_too_large_a_cell(monkeypatch):
    """What does not fit into 32-bit places is an error, never a wrong result."""
    table = pa.table({"__o": [1], "__x": ["x" * 100]})
    monkeypatch.setattr(repeats, "flat", lambda col: (np.broadcast_to(np.uint8(0), 1 << 31), np.array([0, 1 << 31])))
    with pytest.raises(ValueError):
        repeats.Cell(table, 50, 4)


def test_mixing_and_sharding(docs):
    got = mixing.mix(crowded(docs)).toPandas()
    made = ["size", "source_size", "target", "copies"]
    assert len(got) == len(ROWS) and all(got[c].str.startswith(c).all() for c in CLASHES if c not in made) and got.copies.between(0, 2).all()
    again = mixing.mix(docs.repartition(7), keep=["doc_id"]).toPandas()
    assert sorted(map(str, zip(got.doc_id, got["size"], got.copies))) == sorted(map(str, zip(again.doc_id, again["size"], again.copies)))
    put = sharding.shard(crowded(docs, ["size", "text_crc32", "shard", "slot"]), shards=4).toPandas()
    assert len(put) == len(ROWS) and put.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()


def test_chances_are_kept(spark):
    """Rounding is unbiased: over many seeds each document is taken as often as its chance says."""
    rows = [(i, "w " * n, "s") for i, n in enumerate([3, 50, 7, 7, 120, 1, 33])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = pd.DataFrame([mixing.mix(df, seed=s, keep=["doc_id"], share=1.5).toPandas().set_index("doc_id").copies for s in range(60)])
    assert (abs(taken.mean() - 1.5) < 0.3).all()


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(crowded(docs, ["key"]), tokenizer=path).toPandas()
    words = packing.WordTokens(path)
    want = sum(len(words.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ROWS)
    assert got.length.sum() == want and list(got.columns) == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert packing.pack(docs.limit(0), tokenizer=path).count() == 0


def test_assignment_takes_the_cheapest_sequence():
    rng = np.random.default_rng(5)
    for _ in range(20):
        tokens, capacity = rng.integers(1, 300, 60), 100
        made = list(zip(*(x.tolist() for x in packing.assign(tokens, capacity))))
        rest = sorted((i for i in range(60) if tokens[i] % capacity), key=lambda i: (-(tokens[i] % capacity), i))
        first = int((tokens // capacity).sum())
        count = -(-int((tokens % capacity).sum()) // capacity)
        room, cost, want = [capacity] * count, [0.0] * count, []
        for d in rest:
            left, start = int(tokens[d] % capacity), int(tokens[d] // capacity * capacity)
            while left:
                fits = [s for s in range(count) if room[s] >= left] or [s for s in range(count) if room[s]]
                s = min(fits, key=lambda s: (cost[s], s))
                k = min(left, room[s])
                want.append((d, start, k, first + s, capacity - room[s]))
                room[s], cost[s], left, start = room[s] - k, cost[s] + k + k * k / capacity, left - k, start + k
        assert sorted(m for m in made if m[3] >= first) == sorted(want)


def test_vectors(spark):
    rows = [(0, [1.0, 2.0], 0), (0, [0.5, 2.0], 0), (1, [1.0, 2.0], 0), (2, [1.0, 2.0], 1), (3, None, 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, [1.0], 0), (None, [1.0, 1.0], 0), (50, [1.0, 2.0], 2), (50, [1.0, 2.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.select("*", *[F.lit(c).alias(c) for c in ("id", "v", "d", "rank", "query_id", "score")])
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()
    asked = {0: [128, 512], 50: [256, 512]}  # of repeated ids the smallest vector asks
    usable = [(i, [int(np.floor(256 * y)) for y in v]) for i, v, _ in rows if i is not None and v and all(y is not None and np.isfinite(y) for y in v) and len(v) == 2]
    want = []
    for q, x in asked.items():
        scores = sorted((-(x[0] * v[0] + x[1] * v[1]), i) for i, v in usable if i != q)[:3]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert [tuple(r) for r in got] == want


def test_blocks_of_queries(spark, monkeypatch):
    """Many small blocks give what one does."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in rng.integers(-3, 3, 4) / 4]) for i in range(300)], "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 10 = 0")
    one = topk.top_k(df, queries, k=4).collect()
    monkeypatch.setattr(topk, "QUERIES", 7)
    assert plain(topk.top_k(df, queries, k=4).collect()) == plain(one)


def test_leader_against_a_plain_version():
    """Follow-the-regularised-leader, coordinate by coordinate."""
    rng, leader = np.random.default_rng(4), quality.Leader()
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= leader.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * leader.l1) / ((leader.beta + np.sqrt(n[i])) / leader.alpha + leader.l2)

    for _ in range(200):
        at = np.sort(rng.choice(40, 6, replace=False))
        x, y = rng.normal(size=6), float(rng.random() < 0.5)
        p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in zip(at, x))))
        for i, w, v in [(i, weight(i), v) for i, v in zip(at, x)]:
            g = (p - y) * v
            z[i] = z.get(i, 0.0) + g - (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / leader.alpha * w
            n[i] = n.get(i, 0.0) + g * g
        leader.update(at, x, y)
    assert np.allclose([weight(i) for i in range(40)], leader.weights()[:40])


def test_margins_against_a_plain_version():
    model = quality.QualityModel(np.random.default_rng(1).normal(size=1 << quality.BITS), 0.25)
    for t in ("One two, two THREE 4.", "", "x"):
        data, off = flat(pa.array([t]))
        grams, _ = quality.ngrams(data, off)
        want = sum(model.weights[g] for g in grams.tolist()) * quality.SCALE / max(1, len(grams)) + 0.25
        assert np.isclose(model.margins(data, off)[0], want)


def test_decoding_against_a_plain_version():
    """The codeword of the least loss, the bits' losses weighted by how far each is trusted."""
    rng = np.random.default_rng(9)
    code = language.codewords(4)
    model = language.LanguageModel(["a", "b", "c", "d"], code, rng.normal(size=(language.DIM, code.shape[1])), rng.normal(size=code.shape[1]), rng.random(code.shape[1]))
    x = language.features(*flat(pa.array(["some text", "другой текст", "zz"])))
    for row, got in zip(x, model.losses(x)):
        want = [sum(np.log1p(np.exp(-(row @ model.weights[:, b] + model.bias[b]) * word[b])) * model.trust[b] for b in range(len(word))) for word in code]
        assert np.allclose(got, want) and np.argmin(got) == np.argmin(want)


def test_toxicity_query_against_a_plain_version(spark, docs, hard):
    """Scores and spans by enumeration of all labellings of short texts."""
    rng = np.random.default_rng(6)
    model = toxicity.ToxicityModel(rng.normal(size=1 << toxicity.BITS), -0.5, 0.4, rng.normal(size=(2, 2)), np.array([-1.0, 3.0, 0.5]))
    texts = ["ab cde f ab", "Ünder one", "", None, "x1y2z3 w"]
    got = model.transform(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        data, off = flat(pa.array([t]))
        starts, ends, _, found = toxicity.tokens(data, off)
        e = model.weights[found].sum(1) + model.bias if len(found) else np.zeros(0)
        total, bad = 0.0, np.zeros(len(e))
        for labels in np.ndindex(*(2,) * len(e)):
            s = sum(x * y for x, y in zip(e, labels)) + (model.start * labels[0] if labels else 0) + sum(model.move[a, b] for a, b in zip(labels, labels[1:]))
            total += np.exp(s)
            bad += np.exp(s) * np.array(labels)
        p = bad / total
        want = 1 / (1 + np.exp(-(model.final @ [1, p.max(initial=0), np.log1p(p.sum())])))
        assert np.isclose(r["score"], want)
        chars = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))
        marked = [(int(chars[a]), int(chars[b])) for a, b, x in zip(starts, ends, p) if x >= 0.5]
        covered = [any(a <= s and b <= e_ for s, e_ in zip(r["span_starts"], r["span_ends"]) for a in [s]) for _, b in marked]
        assert all(covered) and bool(marked) == bool(r["span_starts"])


def test_recall_of_toxicity(spark):
    """Toxic documents that are held out are found, clean ones left alone."""
    from corpuscube.llm import queries as q

    root = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{root}/labels.parquet").toPandas()
    held = q.op4_toxicity(spark, root).toPandas().merge(labels, on="doc_id").query("held_out")
    assert held[held.toxic == 1].predicted.mean() >= 0.7 and held[held.toxic == 0].predicted.mean() <= 0.02


@pytest.mark.parametrize("name, stage", pipe.STAGES)
def test_stages(spark, docs, hard, name, stage):
    got = stage(spark, crowded(docs), hard).toPandas()
    assert len(got) and (list(got.columns) == pipe.COLUMNS or name == "packing")
    assert len(stage(spark, docs.limit(0), hard).toPandas()) == 0
    if name == "simhash":
        assert sorted(got.doc_id.fillna(-1).astype(int).tolist()) == sorted([1, 1, 1, 2, 4, 5, 6, 7, -1, -1])
    if name == "repeats":
        assert (got.n_chars == got.text.str.len()).all()
