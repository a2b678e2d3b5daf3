"""Language identification: rank order of character n-grams, letter frequencies, reports.

A document's n-gram profile and letter counts are worked out where the document is read, one
Arrow batch at a time: expanding every n-gram to a row would shuffle hundreds of times the
text.  All texts of a batch are counted together, in numpy.  Languages' profiles come from word
counts, so n-grams are expanded for distinct words only.  Language profiles are languages x 300
rows: broadcast where a count says that they are few, else joined by a shuffle.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpuscube.functions import text as tx
from corpuscube.operators.vocabulary import small_batches
from corpuscube.session import near

LANGUAGES = ("fr", "en")  # in the order that settles ties
METHODS = ("ngram", "alphabet", "neural")
NO_ANSWER = "—"
SIZE, N_MAX = 300, 5
#: Characters of texts that are worked on at a time.
TOGETHER = 1 << 19

# The alphabets, and the letters that only one of the two has.
ALPHABETS = {"fr": "abcdefghijklmnopqrstuvwxyzàâæçéèêëîïôœùûüÿ", "en": "abcdefghijklmnopqrstuvwxyz"}
UNIQUE = {"fr": "àâæçéèêëîïôœùûüÿ", "en": ""}

_WORD = regex.compile(tx.LETTERS)


def padded_grams(word: Column, n_max: int = N_MAX) -> Column:
    """all n-grams of a word between underscores, of 1 to n_max characters."""
    w = F.concat(F.lit("_"), word, F.lit("_"))
    of = lambda n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[of(n) for n in range(1, n_max + 1)]))


def language_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE, n_max: int = N_MAX) -> DataFrame:
    """(lang, gram, n, rank) of the `size` most frequent n-grams, ties by the gram."""
    words = docs.select(F.col(lang).alias("lang"), F.explode(tx.letter_tokens(F.col(text))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    grams = words.select("lang", F.explode(padded_grams(F.col("word"), n_max)).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return grams.withColumn("rank", rank - 1).where(F.col("rank") < size)


def _characters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of texts end to end, which text each is of, and which of them are letters."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    kinds, which = np.unique(points, return_inverse=True)
    return points, owner, np.fromiter((chr(c).isalpha() for c in kinds.tolist()), bool, len(kinds))[which]


def _counted(owner: np.ndarray, code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct codes in order, and how often it has them."""
    key, n = np.unique(owner.astype(np.int64) << bits | code, return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), n


def _top_grams(texts: Sequence[str], size: int, n_max: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of each text, its `size` most frequent n-grams: text, gram, n and rank, in order.

    Characters are numbered in order of code point, and a gram is its characters' numbers from
    the top of one integer down, so integers are in the order of grams; None if that has no
    room for these texts."""
    points, owner, letter = _characters(texts)
    inner = letter.copy()  # letters, and apostrophes between two of one text
    mark = np.flatnonzero(points[1:-1] == ord("'")) + 1
    inner[mark[letter[mark - 1] & letter[mark + 1] & (owner[mark - 1] == owner[mark + 1])]] = True
    # each word between underscores: one before a word's first character, one after its last
    first, last = inner.copy(), inner.copy()
    joined = inner[1:] & inner[:-1] & (owner[1:] == owner[:-1])
    first[1:] &= ~joined
    last[:-1] &= ~joined
    at = np.flatnonzero(inner)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, "U1", np.int64, np.int32))
    width = 1 + first[at].astype(np.int64) + last[at]
    end = np.cumsum(width)
    line, who = np.full(int(end[-1]), ord("_"), np.uint32), np.repeat(owner[at], width)
    line[end - 1 - last[at]] = points[at]
    word = np.cumsum(np.bincount(end[first[at]] - width[first[at]], minlength=len(line))[: len(line)])
    alphabet, code = np.unique(line, return_inverse=True)
    bits = len(alphabet).bit_length()
    room = bits * n_max
    if room + len(texts).bit_length() > 62:
        return None
    code = code.astype(np.int64) + 1  # 0 is no character: shorter grams come first
    keys, gram = [], np.zeros(len(line), np.int64)
    for n in range(1, n_max + 1):
        if len(line) < n:
            break
        gram = gram[: len(line) - n + 1] | code[n - 1 :] << (room - n * bits)
        one = word[: len(gram)] == word[n - 1 :]
        keys.append(who[: len(gram)][one] << room | gram[one])
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    doc = key >> room
    best = np.argsort((doc << 40) - times, kind="stable")  # by text, then by count, then by gram
    rank = np.arange(len(best)) - np.searchsorted(doc, doc)
    keep = rank < size
    doc, key, times, rank = doc[keep], key[best[keep]], times[best[keep]], rank[keep]
    shifts = room - bits * np.arange(1, n_max + 1)
    place = key[:, None] >> shifts & ((1 << bits) - 1)
    letters_ = np.concatenate([np.zeros(1, np.uint32), alphabet])[place].astype("<u4")
    return doc, np.ascontiguousarray(letters_).view(f"<U{n_max}").reshape(-1), times, rank.astype(np.int32)


def _top_grams_of_one(text: str, size: int, n_max: int) -> tuple[list, list, list]:
    """The same for one text, whatever its alphabet."""
    counts: Counter[str] = Counter()
    for word, times in Counter(_WORD.findall(text)).items():
        w = f"_{word}_"
        for n in range(1, n_max + 1):
            for i in range(len(w) - n + 1):
                counts[w[i : i + n]] += times
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]
    return [g for g, _ in top], [c for _, c in top], list(range(len(top)))


def _per_document(docs: DataFrame, text: str, keep: Sequence[str], fields: str, of) -> DataFrame:
    """Rows of(texts) -> (text's place, columns) beside the columns `keep`, some texts at a time."""
    small_batches(docs.sparkSession)
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*(source.schema[c] for c in keep), *T._parse_datatype_string(fields).fields])
    kinds = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.dataType.simpleString()] for f in schema.fields[len(keep) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo = [(t or "").lower() for t in batch.column(len(keep)).to_pylist()], 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or (held + len(texts[hi]) <= TOGETHER and hi - lo < 500)):
                    held, hi = held + len(texts[hi]), hi + 1
                at, *columns = of(texts[lo:hi])
                made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(np.asarray(at, np.int64) + lo)) for i in range(len(keep))), *made], names=schema.names)
                lo = hi

    return source.mapInArrow(run, schema)


def document_profiles(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), size: int = SIZE, n_max: int = N_MAX) -> DataFrame:
    """A12, W6 for each document: the columns keep, gram, n and rank."""

    def of(texts: Sequence[str]) -> tuple:
        made = _top_grams(texts, size, n_max)
        if made is None:
            each = [_top_grams_of_one(t, size, n_max) for t in texts]
            made = [i for i, x in enumerate(each) for _ in x[0]], *([v for x in each for v in x[k]] for k in range(3))
        return made

    return _per_document(docs, text, keep, "gram string, n bigint, rank int", of)


def letters(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), compatible: bool = False) -> DataFrame:
    """The columns keep, letter and n of each document.  compatible: NFKC first."""

    def of(texts: Sequence[str]) -> tuple:
        if compatible:
            texts = [unicodedata.normalize("NFKC", t).lower() for t in texts]
        points, owner, letter = _characters(texts)
        doc, point, n = _counted(owner[letter], points[letter].astype(np.int64), 21)
        return doc, point.astype("<u4").view("<U1"), n

    return _per_document(docs, text, keep, "letter string, n bigint", of)


def letter_frequencies(counted: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang, letter, n, freq, in_alphabet) of each language, from letters() rows."""
    each = counted.groupBy(F.col(lang).alias("lang"), "letter").agg(F.sum("n").alias("n"))
    total = each.groupBy("lang").agg(F.sum("n").alias("total"))
    known = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    inside = F.coalesce(F.contains(F.element_at(known, F.col("lang")), F.col("letter")), F.lit(False))
    return each.join(total, "lang").select("lang", "letter", "n", (F.col("n") / F.col("total")).alias("freq"), inside.alias("in_alphabet"))


def diacritic_share(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """The share of letters outside ASCII."""
    return counted.groupBy(*by).agg((F.sum(F.when(F.ascii("letter") > 127, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))


def out_of_place(documents: DataFrame, profiles: DataFrame, all_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, lang, distance): the sum of rank differences, the language profile's
    length where it has no such gram.  Grams that it lacks need no row: they are counted by
    what is matched.  A document without grams is at distance 0 from all."""
    learned = near(profiles.select("lang", "gram", F.col("rank").alias("there")))  # made once
    size = near(learned.groupBy("lang").agg(F.count(F.lit(1)).alias("length")))
    known = near(learned.join(size, "lang"))
    # one row a document, of which both sides below are made: the texts are read once
    each = documents.groupBy(key).agg(F.collect_list(F.struct("gram", "rank")).alias("g"))
    listed = each.select(key, F.inline("g")).join(known, "gram")
    gain = listed.groupBy(key, "lang").agg(F.sum(F.abs(F.col("rank") - F.col("there")) - F.col("length")).alias("gain"))
    grams = each.select(key, F.size("g").alias("grams"))
    pairs = all_docs.select(key).join(grams, key, "left").crossJoin(size)
    out = pairs.join(gain, [key, "lang"], "left")
    return out.select(key, "lang", (F.coalesce("grams", F.lit(0)) * F.col("length") + F.coalesce("gain", F.lit(0))).cast("double").alias("distance"))


def alphabet_distance(counted: DataFrame, frequencies: DataFrame, all_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, lang, distance): the total difference of letter shares and the share of
    letters outside the alphabet, 12 places; 1 for a document without letters.  The full outer
    comparison is 2 plus what shared letters take away.  A language without an alphabet here has
    the letters that it was seen with."""
    each = counted.groupBy(key).agg(F.sum("n").alias("total"), F.collect_list(F.struct("letter", "n")).alias("l"))
    total = each.select(key, "total")
    shares = each.select(key, "total", F.inline("l")).select(key, "letter", (F.col("n") / F.col("total")).alias("share"))
    spark, frequencies = counted.sparkSession, near(frequencies)
    langs = near(frequencies.select("lang").distinct())
    fixed = spark.createDataFrame([(k, c) for k, v in ALPHABETS.items() for c in v], "lang string, letter string").join(langs, "lang")
    seen = frequencies.select("lang", "letter", "freq", ~F.col("lang").isin(*ALPHABETS) | F.col("in_alphabet"))
    unseen = fixed.join(frequencies, ["lang", "letter"], "left_anti").select("lang", "letter", F.lit(0.0), F.lit(True))
    table = near(seen.union(unseen).toDF("lang", "letter", "freq", "home"))
    change = F.abs(F.col("share") - F.col("freq")) - F.col("share") - F.col("freq") - F.when(F.col("home"), F.col("share")).otherwise(0.0)
    shared = shares.join(table, "letter").groupBy(key, "lang").agg(F.sum(change).alias("shared"))
    pairs = all_docs.select(key).join(total, key, "left").crossJoin(langs).join(shared, [key, "lang"], "left")
    return pairs.select(key, "lang", F.when(F.col("total").isNull(), 1.0).otherwise(F.round(3 + F.coalesce("shared", F.lit(0.0)), 12)).alias("distance"))


def diacritic_distance(counted: DataFrame, frequencies: DataFrame, key: str = "doc_id") -> DataFrame:
    """the difference of diacritic shares and the share of letters outside the alphabet."""
    mine = diacritic_share(counted, [key])
    theirs = diacritic_share(frequencies, ["lang"]).withColumnRenamed("share", "expected")
    alphabet = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    pairs = counted.crossJoin(near(frequencies.select("lang").distinct()))
    known = F.coalesce(F.contains(F.element_at(alphabet, F.col("lang")), F.col("letter")), F.lit(False))
    alien = pairs.groupBy(key, "lang").agg((F.sum(F.when(known, 0).otherwise(F.col("n"))) / F.sum("n")).alias("alien"))
    return alien.join(mine, key).join(theirs, "lang").select(key, "lang", (F.abs(F.col("share") - F.col("expected")) + F.col("alien")).alias("distance"))


def unique_letters(text: Column, lang: str) -> Column:
    """how many letters only this language has."""
    return F.length(F.regexp_replace(F.lower(text), f"[^{UNIQUE[lang]}]", "")) if UNIQUE[lang] else F.lit(0)


def decide(distances: DataFrame, method: str, key: str = "doc_id", languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """One row a document: the nearest language, ties in the order of `languages`, then
    by name, and all of them ranked."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")), F.lit(0)), F.lit(len(languages) + 1))
    ranked = F.array_sort(F.collect_list(F.struct("distance", place.alias("place"), "lang")))
    rows = distances.groupBy(key).agg(ranked.alias("r"))
    return rows.select(key, F.lit(method).alias("method"), F.col("r")[0]["lang"].alias("lang"), F.col("r")[0]["distance"].alias("distance"), F.transform("r", lambda x: F.struct(x["lang"].alias("lang"), x["distance"].alias("distance"))).alias("ranked"), F.lit(0.0).alias("elapsed_ms"), F.lit(None).cast("string").alias("error"))


def unavailable(docs: DataFrame, method: str = "neural", error: str = "model file is missing", key: str = "doc_id") -> DataFrame:
    """The rows of a method whose model is missing; the other methods go on."""
    none = F.array().cast("array<struct<lang:string,distance:double>>")
    return docs.select(key, F.lit(method).alias("method"), F.lit(None).cast("string").alias("lang"), F.lit(float("inf")).alias("distance"), none.alias("ranked"), F.lit(0.0).alias("elapsed_ms"), F.lit(error).alias("error"))


def detect(docs: DataFrame, profiles: DataFrame, frequencies: DataFrame, text: str = "text", key: str = "doc_id", languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """All methods' rows for every document."""
    ngram = decide(out_of_place(document_profiles(docs, text, [key]), profiles, docs, key), "ngram", key, languages)
    alphabet = decide(alphabet_distance(letters(docs, text, [key]), frequencies, docs, key), "alphabet", key, languages)
    return ngram.unionByName(alphabet).unionByName(unavailable(docs, key=key))


def method_report(results: DataFrame) -> DataFrame:
    """(method, total, correct, errors, accuracy, time_median_ms, time_total_ms) of results
    with lang_true; rows with an error stay in the denominator."""
    right = F.count_if(F.col("error").isNull() & (F.col("lang") == F.col("lang_true")))
    row = results.groupBy("method").agg(F.count(F.lit(1)).alias("total"), right.alias("correct"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.median("elapsed_ms").alias("time_median_ms"), F.sum("elapsed_ms").alias("time_total_ms"))
    return row.withColumn("accuracy", F.col("correct") / F.col("total"))


def per_language(results: DataFrame) -> DataFrame:
    """Correct and total of each method and true language."""
    right = F.count_if(F.col("error").isNull() & (F.col("lang") == F.col("lang_true")))
    return results.groupBy("method", "lang_true").agg(right.alias("correct"), F.count(F.lit(1)).alias("total"))


def confusion(results: DataFrame) -> DataFrame:
    """(method, lang_true, predicted, n); an error or no answer is predicted as a dash."""
    told = F.when(F.col("error").isNotNull(), F.lit(NO_ANSWER)).otherwise(F.coalesce("lang", F.lit(NO_ANSWER)))
    return results.groupBy("method", "lang_true", told.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def pair_agreement(results: DataFrame, key: str = "doc_id", methods: Sequence[str] = METHODS) -> DataFrame:
    """Of each pair of methods, in their order, how often both answer alike; rows
    with an error are left out; 0 if nothing is left."""
    place = F.array_position(F.array(*[F.lit(m) for m in methods]), F.col("method"))
    fine = results.where("error IS NULL").select(key, "method", place.alias("place"), "lang")
    a, b = fine.alias("a"), fine.alias("b")
    same = a.join(b, key).where(F.col("a.place") < F.col("b.place")).groupBy(F.col("a.method").alias("first"), F.col("b.method").alias("second")).agg(F.count(F.lit(1)).alias("compared"), F.avg((F.col("a.lang").eqNullSafe(F.col("b.lang"))).cast("double")).alias("agreement"))
    pairs = [(x, y) for i, x in enumerate(methods) for y in methods[i + 1 :]]
    all_pairs = results.sparkSession.createDataFrame(pairs, "first string, second string")
    return all_pairs.join(F.broadcast(same), ["first", "second"], "left").fillna({"compared": 0, "agreement": 0.0})


def pages_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with visible text and its length in place of the markup."""
    @F.pandas_udf(T.StringType())
    def visible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield part.map(lambda x: tx.visible_text(x if isinstance(x, str) else tx.read_page(bytes(x))[0]), na_action="ignore")

    return pages.withColumn("text", visible(F.col(html))).withColumn("chars", F.length("text")).drop(html)


def languages_known(known: Mapping[str, str] = ALPHABETS) -> list[str]:
    return list(known)
