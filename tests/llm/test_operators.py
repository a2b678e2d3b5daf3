"""The operators' parts: ties, hot groups, vectors and strings of every kind."""

import pickle

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpuscube.llm import graph, language, mixing, packing, quality, repeats, sharding, simhash, topk, toxicity
from corpuscube.llm.fingerprints import Paragraphs
from corpuscube.llm.rindex import RunLengthIndex, suffix_order
from corpuscube.llm.spans import Prefix, chunks, flat, runs


def text(*xs):
    return flat(pa.array(xs, pa.string()))


def test_chunks_and_runs():
    col = pa.array(["abc", None, "", "de f"])
    parts = [(lo, hi, d.tobytes()) for lo, hi, d, _ in chunks(col, 4)]
    assert parts == [(0, 3, b"abc"), (3, 4, b"de f")]
    d, o = text("ab c", "", "d")
    s, e, at = runs(d != 32, o)
    assert list(zip(s, e)) == [(0, 2), (3, 4), (4, 5)] and at.tolist() == [0, 2, 2, 3]


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.data())
def test_span_hashes_depend_on_bytes_alone(body, data):
    n = data.draw(st.integers(0, len(body)))
    both = np.frombuffer(b"xyz" + body[:n] + b"--" + body[:n], np.uint8)
    h = Prefix(both).of(np.array([3, 5 + n]), np.array([3 + n, 5 + 2 * n]))
    assert h[0] == h[1]


@pytest.mark.parametrize("seed", range(6))
def test_index(seed):
    rng = np.random.default_rng(seed)
    strings = [bytes(rng.integers(97, 97 + rng.integers(2, 4), rng.integers(1, 30)).astype(np.uint8)) for _ in range(6)]
    strings += strings[:2]
    body = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int16) + 1, 0) for s in strings])
    order, classes = suffix_order(body, 10)
    t = body.tolist()
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    first = {}
    for i in range(len(t)):
        assert classes[first.setdefault(tuple(t[i : i + 10]), i)] == classes[i]
    patterns = [*strings[:3], strings[0][1:] + strings[-1], b"zzz"]
    grid = np.zeros((len(patterns), max(map(len, patterns))), np.int16)
    for i, p in enumerate(patterns):
        grid[i, : len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) + 1
    lengths, where = RunLengthIndex(body).matching_statistics(grid)
    for i, p in enumerate(patterns):
        for k in range(len(p)):
            best = max(n for n in range(len(p) - k + 1) if n == 0 or any(p[k : k + n] in s for s in strings))
            assert lengths[i, k] == best and (not best or t[where[i, k] : where[i, k] + best] == [c + 1 for c in p[k : k + best]])


def test_repeats_over_cells(spark):
    """Copies over many cells, windows that only some copies share, equal ids, null ids."""
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 4)) for _ in range(400)]
    passage = " ".join(words[:20])
    rows = [(i, " ".join(rng.choice(words, 30)) + " " + passage[: 45 + i % 20] + (passage[10:] if i % 7 == 0 else "")) for i in range(120)]
    rows += [(500, passage), (500, passage), (None, passage + "!"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in repeats.remove_repeats(df).collect():
        got.setdefault(r["doc_id"], []).append((bytes(r["kept"]), list(zip(r["span_starts"], r["span_ends"]))))
    seen = {}
    for key in [*range(120), 500, None]:
        mine = [t for i, t in rows if i == key]
        want = []
        for t in mine:
            b = (t or "").encode()
            away = np.zeros(len(b), bool)
            for k in range(len(b) - 49):
                if b[k : k + 50] in seen:
                    away[k : k + 50] = True
            want.append(np.frombuffer(b, np.uint8)[~away].tobytes())
        for t in mine:
            b = (t or "").encode()
            seen |= {b[k : k + 50]: 1 for k in range(len(b) - 49)}
        assert sorted(x for x, _ in got[key]) == sorted(want), key


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab\n ", max_size=30), min_size=1, max_size=6))
def test_fingerprints_are_homomorphic(texts):
    one = Paragraphs(*text("\n".join(texts))).sums()
    parts = [p for t in texts for p in t.split("\n")]
    each = Paragraphs(*text(*parts)).sums()
    assert (one.lanes[0] == each.lanes.sum(0, dtype=np.uint64)).all() and (one.counters[0] == each.counters.sum(0, dtype=np.uint16)).all()
    again = Paragraphs(*text("\n".join(reversed(parts)))).sums()
    assert again.text() == one.text()


def test_links_and_forest():
    rng = np.random.default_rng(0)
    prints, group = [], []
    for k, size in enumerate((1, 2, 5, 64, 65, 200)):
        centre = int(rng.integers(0, 1 << 62))
        for _ in range(size):
            x = centre
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            prints.append(x)
            group.append(k)
    prints, group = np.array(prints, np.uint64), np.array(group)
    for radius in (0, 1, 2, 3, 6):
        a, b = simhash.links(prints, group, radius)
        want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if group[i] == group[j] and np.bitwise_count(prints[i] ^ prints[j]) <= radius}
        assert set(zip(a.tolist(), b.tolist())) == want
    used = simhash.forest(len(prints), a, b, np.bitwise_count(prints[a] ^ prints[b]))
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in zip(a[used].tolist(), b[used].tolist()):
        assert find(x) != find(y)  # no cycle
        root[find(x)] = find(y)
    assert all(find(x) == find(y) for x, y in zip(a.tolist(), b.tolist()))


def test_near_duplicates_by_similarity(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(2000)]
    base = rng.choice(words, 200).tolist()
    near, far = base[:], base[:]
    near[100] = "changed"
    for i in range(0, 200, 10):
        far[i] = f"other{i}"
    rows = [(5, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(rng.choice(words, 200))), (6, None), (7, ""), (8, "one"), (9, "ONE")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, shingle=5, radius=14, similarity=0.8).collect()}
    assert got == {5: 2, 2: 2, 3: 3, 4: 4, 6: 6, 7: 6, 8: 8, 9: 8}


def by_similarity(texts, size=5, least=0.8):
    """Of each text, the position of the first text of its component, all pairs compared."""
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in words]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def found_similar(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, shingle=5, radius=14, similarity=0.8).collect()}
    return [got[i] for i in range(len(texts))]


def test_similar_texts_between_others_are_found(spark):
    """A template's edited copies: most pairs are near in bits and not alike by 0.8, some are."""
    rng = np.random.default_rng(1)
    base, texts = [f"w{i}" for i in rng.integers(0, 5000, 280)], []
    for k in range(100):
        t = base[:]
        for i in rng.choice(280, 4, replace=False):
            t[i] = f"e{k}x{i}"
        texts.append(" ".join(t))
    prints = simhash.simhashes(*text(*texts), 5)
    texts = [t for i, t in enumerate(texts) if not any(np.bitwise_count(prints[i] ^ prints[j]) > 14 and by_similarity([t, texts[j]]) == [0, 0] for j in range(i))]
    want = by_similarity(texts)
    assert 20 < len(set(want)) < len(texts) - 20
    assert found_similar(spark, texts) == want


def test_similar_texts_beyond_the_radius_are_found(spark):
    """One line, repeated in one of two copies only, moves the fingerprint and few distinct shingles."""
    rng = np.random.default_rng(2)
    texts = []
    for k in range(4):
        base = " ".join(f"w{i}" for i in rng.integers(0, 5000, 200))
        texts += [base, base + 100 * f" one line{k} that page{k} says again{k} and again{k}"]
    prints = simhash.simhashes(*text(*texts), 5)
    assert (np.bitwise_count(prints[::2] ^ prints[1::2]) > 14).all()
    assert found_similar(spark, texts) == by_similarity(texts) == [0, 0, 2, 2, 4, 4, 6, 6]


def test_texts_of_one_fingerprint_are_told_apart(spark):
    """One line outweighs all else: fingerprints are equal, the texts are not, and each has a near copy."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(3):
        own = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        for last in ("here", "there"):
            texts.append(" ".join([*own, last]) + 200 * " one line of nine words that says little again")
    assert len(np.unique(simhash.simhashes(*text(*texts), 5))) == 1
    assert found_similar(spark, texts) == by_similarity(texts) == [0, 0, 2, 2, 4, 4]


def test_rows_without_an_id_share_their_component(spark):
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (5, "A b c"), (None, "other")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(df).where("fingerprint <> ''").collect() if r["component_id"])
    assert got == [(0, 5), (5, 5), (7, 5)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200)] + [(300, j) for j in range(301, 360)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and got[101] == 100 and {got[j] for j in range(301, 360)} == {300} and 200 not in got


def test_field_messages():
    rng = np.random.default_rng(1)
    bounds, move, start = np.array([0, 5, 5, 300, 301]), rng.normal(size=(2, 2)), 0.3
    e = rng.normal(size=301) * 3
    a, b = toxicity.forward_backward(e, bounds, start, move)
    p = a * b / (1 + a * b)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        n = hi - lo
        if not n:
            continue
        f, g = np.ones((n, 2)), np.ones((n, 2))
        f[0] = [1, np.exp(start + e[lo])]
        for t in range(1, n):
            f[t] = [sum(f[t - 1, i] * np.exp(move[i, j] + j * e[lo + t]) for i in (0, 1)) for j in (0, 1)]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            g[t] = [sum(np.exp(move[i, j] + j * e[lo + t + 1]) * g[t + 1, j] for j in (0, 1)) for i in (0, 1)]
            g[t] /= g[t].sum()
        want = f * g
        assert np.allclose(want[:, 1] / want.sum(1), p[lo:hi])


def test_the_field_learns_from_every_labelled_row():
    """Each clean text has a word of its own; before, 2 * toxic + 50 clean rows taught the field."""
    clean = [f"{''.join(chr(97 + i // 26**k % 26) for k in range(3))}plain words of common speech" for i in range(300)]
    _, _, bounds, found = toxicity.tokens(*text(*clean, *["vile words of common speech"] * 4))
    rows = [found[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    model = toxicity._learn(rows, np.array([0.0] * 300 + [1.0] * 4), 1)
    assert all(model.weights[x[0, 0]] != 0 for x in rows[:300])


def test_toxic_spans(spark):
    clean = [(i, f"plain words number {i} and more of them", 0) for i in range(200)]
    bad = [(i, f"plain words with n{chr(97 + i % 26)} badword{'x' if i % 2 else ''} and more {i}", 1) for i in range(200, 260)]
    docs = spark.createDataFrame([r[:2] for r in clean + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in clean + bad], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    new = spark.createDataFrame([(1, "éé BADWORD here"), (2, "fine words"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in model.transform(new).collect()}
    assert got[1]["score"] > 0.7 and (got[1]["span_starts"], got[1]["span_ends"]) == ([3], [10])
    assert got[2]["score"] < 0.5 and got[2]["span_starts"] == [] and got[3]["score"] < 0.5


def test_codewords():
    for n in (2, 3, 4, 6, 30):
        code = language.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= max(1, code.shape[1] // 4)


def test_one_language(spark):
    docs = spark.createDataFrame([(i, "some text here", "en") for i in range(5)], "doc_id long, text string, lang string")
    row = language.fit(docs).transform(docs).first()
    assert row["lang_pred"] == "en" and row["score"] == 1.0
    none = language.fit(docs.where("lang = 'xx'")).transform(docs).first()
    assert none["lang_pred"] == "und"


def test_clashing_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 9)], "doc_id long, text string, score string, size int")
    out = quality.QualityModel(np.zeros(1 << quality.BITS), 0.0).transform(docs)
    assert dict(out.dtypes)["score"] == "double" and out.first()["score"] == 0.5
    assert dict(sharding.shard(docs).dtypes)["size"] == "bigint"
    mixed = mixing.mix(docs.withColumn("source", F.lit("s")))
    assert dict(mixed.dtypes)["size"] == "bigint" and mixed.first()["size"] == 2


def test_scores_do_not_depend_on_the_batch(spark):
    rng = np.random.default_rng(0)
    model = quality.QualityModel(rng.normal(size=1 << quality.BITS), 0.1)
    texts = ["one two two, three!", "", "ONE|two 3", "ÉÉ é"]
    alone = [model.margins(*text(t))[0] for t in texts]
    assert np.allclose(model.margins(*text(*texts)), alone)
    assert pickle.loads(pickle.dumps(model)).bias == 0.1


def test_mixing_repeated_rows(spark):
    rows = [(1, "a b c", "s")] * 3 + [(i, "w " * (i % 5), None) for i in range(2, 200)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = mixed.where("doc_id = 1").collect()
    assert len(got) == 3 and len({r["copies"] for r in got}) == 1
    assert mixing.repeated(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_mixing_is_unbiased(spark):
    rows = [(i, "w " * (1 + i % 9), "s" if i % 2 else "t") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    takes = [mixing.mix(df, seed=s).agg(F.avg("copies")).first()[0] for s in range(3)]
    want = mixing.mix(df).agg(F.avg(F.col("target") / F.col("source_size"))).first()[0]
    assert abs(np.mean(takes) - want) < 0.1


def test_sharding_cuts_a_group_only_if_it_must(spark):
    rows = [(i, "same text") for i in range(300)] + [(1000 + i, f"text {i} " * 3) for i in range(300)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 4 and sums.max() - sums.min() <= 2 * got["size"].max() + 0.01 * sums.sum()
    one = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 1).toPandas()
    assert set(one.shard) == {0} and sorted(one.slot) == list(range(600))


def test_topk_ties_and_odd_vectors(spark):
    same = [(i, [1.0, 0.5]) for i in range(1, 200)]
    odd = [(0, [1.0, 1.0]), (500, [2.0, -1.0]), (501, [3.0]), (502, None), (503, [float("nan"), 1.0]), (504, [None, 1.0]), (505, []), (None, [1.0, 1.0]), (507, [1e30, 0.0])]
    df = spark.createDataFrame(same + odd, "vec_id long, embedding array<double>")
    got = topk.top_k(df.where("vec_id <> 507"), df.where("vec_id IN (0, 500, 501, 505)"), 5).orderBy("query_id", "rank").collect()
    rows = {}
    for r in got:
        rows.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert rows[0] == [(i, 256 * 256 + 256 * 128) for i in range(1, 6)] and 501 not in rows and 505 not in rows
    assert rows[500][0][0] == 1 and len(rows[500]) == 5
    huge = topk.top_k(df, df.where("vec_id = 507"), 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in huge] == [(0, topk.MOST), (1, topk.MOST)]  # all are held at the bound, so ids decide


def test_assign_covers_every_token():
    rng = np.random.default_rng(0)
    for tokens in (rng.integers(1, 6000, 300), np.array([2048, 1]), np.array([1]), np.zeros(0, np.int64)):
        doc, start, length, sequence, offset = packing.assign(tokens.astype(np.int64), 2048)
        for d in range(len(tokens)):
            at = np.argsort(start[doc == d])
            s, n = start[doc == d][at], length[doc == d][at]
            assert s.tolist() == [0, *np.cumsum(n)[:-1].tolist()] and n.sum() == tokens[d]
        for k in np.unique(sequence):
            at = np.argsort(offset[sequence == k])
            o, n = offset[sequence == k][at], length[sequence == k][at]
            assert o.tolist() == [0, *np.cumsum(n)[:-1].tolist()] and n.sum() <= 2048


def test_word_tokens():
    import public_tokenizers

    words = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    texts = ["", " \n", "don't won't, it's;", "<|endoftext|>A<|startoftext|> x", "J̌ Á. 3rd 123abc", "你好,世界. İ ΣΑΣ"]
    texts += ["".join(rng.choice(list("aB'sSt.,;<|>é ÉßΣ́ \n19½… "), 50)) for _ in range(300)]
    ids, at = words.encode(*text(*texts), 1)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*words.tokenizer.encode(t, add_special_tokens=False).ids, 1], t


def test_words_of_one_hash():
    """Words are what their bytes say, even where hashes say nothing."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["one two three", "", "two one-two 123456789 123456780", "x" * 5000 + " y"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    right = packing.WordTokens(path).encode(data, off, 1)
    for bits in (0, 1, 2):
        weak = packing.WordTokens(path)
        weak.hashed = lambda body, a, b, bits=bits: packing.Prefix(body).of(a, b) & np.uint64((1 << bits) - 1)
        for _ in range(2):
            got = weak.encode(data, off, 1)
            assert (got[0] == right[0]).all() and (got[1] == right[1]).all()


def test_bisect_beyond_nesting(spark, monkeypatch):
    from corpuscube.llm import ranges

    rng = np.random.default_rng(3)
    bounds = sorted({int(x) for x in rng.integers(-1000, 1000, 300)})
    rows = spark.range(-1100, 1100)
    plain = rows.select("id", ranges.bisect(F.col("id"), bounds).alias("b")).toPandas()
    monkeypatch.setattr(ranges, "NESTED", 0)
    for some in (bounds, bounds[:1], bounds[:2], bounds[:3]):
        got = rows.select("id", ranges.bisect(F.col("id"), some).alias("b")).toPandas()
        assert (got.b.values == np.searchsorted(some, got.id.values, "right")).all()
    assert (plain.b.values == np.searchsorted(bounds, plain.id.values, "right")).all()


def test_running_sums(spark):
    from corpuscube.llm import ranges

    rows = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("k"), "id")
    got = ranges.running(rows, [F.col("k").asc(), F.col("id").asc()], {"n": F.lit(1), "s": F.col("id")}).toPandas().sort_values(["k", "id"])
    assert (got.n.values == np.arange(500)).all() and (got.s.values == np.cumsum(got.id.values) - got.id.values).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([60, 300, 10**6]))
def test_contexts_of_common_anchors(seed, most):
    """Windows that an earlier context holds, however small the indexes have to be."""
    rng, length = np.random.default_rng(seed), 50
    anchor = rng.integers(97, 99, repeats.GRAM, dtype=np.uint8)
    bodies, at, h, order = [], [], [], []
    for _ in range(40):
        before, after = rng.integers(0, 27), rng.integers(0, 27)
        if before + after < length - repeats.GRAM:
            continue
        sides = [rng.choice([97, 97, 97, 98], n).astype(np.uint8) for n in (before, after)]
        which = rng.integers(0, 2)
        bodies.append(np.concatenate([sides[0], anchor ^ np.uint8(which), sides[1]]))
        at.append(before)
        h.append(which)
        order.append(rng.integers(0, 12))
    if not bodies:
        return
    size = np.array([len(b) for b in bodies])
    got = repeats.judged(np.array(h), np.array(order), np.array(at), np.concatenate(bodies), np.cumsum(size) - size, size, length, most)
    windows = [(o, k, a - j, b[j : j + length].tobytes()) for o, k, a, b in zip(order, h, at, bodies) for j in range(len(b) - length + 1)]
    for i, b in enumerate(bodies):
        for j in range(len(b) - length + 1):
            w = b[j : j + length].tobytes()
            held = any(o < order[i] and x == w for o, _, _, x in windows)
            sure = any(o < order[i] and (k, r, x) == (h[i], at[i] - j, w) for o, k, r, x in windows)
            told = bool(int(got[i]) >> j & 1)
            assert told <= held and sure <= told


def test_lines_of_many_texts_are_indexed_once(monkeypatch):
    """A line that texts of all kinds share: its contexts differ, their shared parts do not."""
    rng, n, length = np.random.default_rng(3), 4000, 50
    line = rng.integers(97, 123, length, dtype=np.uint8)
    bodies = [np.concatenate([rng.integers(97, 123, 26, dtype=np.uint8), line]) for _ in range(n)]
    asked, index = [], repeats.earlier
    monkeypatch.setattr(repeats, "earlier", lambda h, order, body, start, size, length: asked.append(int(size.sum())) or index(h, order, body, start, size, length))
    size = np.full(n, 76)
    got = repeats.judged(np.zeros(n, np.int64), np.arange(n), np.full(n, 26), np.concatenate(bodies), np.cumsum(size) - size, size, length)
    assert got[0] == 0 and (got[1:] >> np.uint64(26) & np.uint64(1) == 1).all()
    assert sum(asked) < size.sum() / 4


def test_strings_that_end_with_a_chunk(spark):
    """What was cut to the end of one chunk takes nothing from the next one's cuts."""
    rng = np.random.default_rng(5)
    one, two, *fill = (rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode() for n in (50, 50, 600_000, 600_000))
    rows = [(1, f"{one} {two}"), (2, fill[0] + one), (2, fill[1] + two)]  # rows of one id are in one cell
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).where("doc_id = 2").collect()
    assert sorted(bytes(r.kept).decode() for r in got) == sorted(fill)
