"""The pipeline against what each stage must do, each stage on its own input."""

import re

import pytest

import corpus_pipeline as pipe

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, sf = tmp_path_factory.mktemp("pipe"), "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"": docs.toPandas()}
    for name, stage in pipe.STAGES:
        stage(spark, docs, sf).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out[name] = docs.toPandas()
    out["labels"] = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    return out


def test_columns(stages):
    for name, _ in pipe.STAGES[:-1]:
        assert list(stages[name].columns) == pipe.COLUMNS


def test_toxicity_takes_toxic_documents(stages):
    kept = set(stages["toxicity"].doc_id)
    labels = stages["labels"]
    gone = labels.assign(gone=~labels.doc_id.isin(kept))
    assert gone[gone.toxic == 1].gone.mean() > 0.6 and gone[gone.toxic == 0].gone.mean() < 0.02


def shingles(t):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = stages["toxicity"], stages["simhash"]
    kept = set(after.doc_id)
    assert after.text.nunique() == len(after)
    sets = {d: shingles(t) for d, t in zip(before.doc_id, before.text)}
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)

    def close(d):
        counts = {}
        for x in sets[d]:
            for o in where[x]:
                counts[o] = counts.get(o, 0) + 1
        return {o for o, n in counts.items() if o != d and n / (len(sets[d]) + len(sets[o]) - n) >= 0.8}

    assert all(close(d) for d in set(sets) - kept)  # nothing else went
    left = sum(len([o for o in close(d) if o in kept]) for d in kept)
    assert left == 0


def test_repeats_are_cut(stages):
    before, after = stages["simhash"], stages["repeats"].set_index("doc_id")
    seen = set()
    for d, t in sorted(zip(before.doc_id, before.text)):
        b = t.encode()
        mine = {b[k : k + 50] for k in range(len(b) - 49)}
        if not mine & seen:
            assert after.text[d] == t
        elif d in after.index:
            assert len(after.text[d]) < len(t)
        seen |= mine
    assert (stages["repeats"].n_chars == stages["repeats"].text.map(len)).all()


def test_mix_and_packing(stages):
    before, mixed, packed = stages["repeats"], stages["mixing"], stages["packing"]
    words = lambda df: df.text.map(lambda t: len(WORD.findall(t))).sum()
    assert abs(words(mixed) / words(before) - 1.5) < 0.1 and mixed.groupby("doc_id").size().max() <= 2
    assert set(packed.doc_id) == set(mixed.doc_id) and packed.groupby("sequence_id").length.sum().max() <= 2048
    copies = packed[packed.start == 0].groupby("doc_id").size()
    assert (copies == mixed.groupby("doc_id").size()).all()


def test_run_and_empty_input(spark, tmp_path):
    assert [f.__name__ for _, f in pipe.STAGES][0] == "drop_toxic" and pipe.ORACLE_SQL is None
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipe.run(spark, str(tmp_path)).count() == 0


def test_batches_are_bounded(spark):
    """No stage sends Spark's 10,000 whole texts to a worker at once."""
    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a text", "en", "web", 6)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    try:
        for stage in (pipe.drop_near_copies, pipe.cut_repeats, pipe.mix_sources, pipe.pack_sequences):
            spark.conf.set(name, "10000")
            stage(spark, docs, "")
            told = [r.n for r in spark.range(0, 9000, 1, 1).mapInArrow(sizes, "n bigint").collect()]
            assert sum(told) == 9000 and max(told) <= pipe.ROWS
    finally:
        spark.conf.set(name, before)
