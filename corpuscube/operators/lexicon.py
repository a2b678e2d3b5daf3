"""A bilingual dictionary: look-up by priority, phrases, literal translation, statistics,
replenishment.

Entries are (source, pos, target, gram, domain, verified).  A look-up joins distinct lemmas
to the entries and picks the best by one aggregate, so a frequent lemma costs no more than
a rare one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpuscube.functions import lexical as lx
from corpuscube.operators.vocabulary import small_batches

LONGEST = 5
FEW = 100_000


def priority(pos: Column, entry_pos: Column, entry_domain: Column, domain: str) -> Column:
    """The place of an entry among those for a lemma: the parts of speech in their order,
    in the text's domain and the general one; then the same in the other domains; then
    entries without a part of speech.  Null if it does not fit at all."""
    near = [domain, "general"] if domain != "general" else ["general"]
    order = near + [d for d in lx.DOMAINS if d not in near]
    lists = F.create_map(*[x for k, v in lx.POS_FALLBACKS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    tried = F.coalesce(F.element_at(lists, F.upper(pos)), F.array(F.coalesce(pos, F.lit("")), F.lit("")))
    p = F.array_position(tried, entry_pos)
    d = F.array_position(F.array(*[F.lit(x) for x in order]), entry_domain)
    fits = F.when(d > 0, F.when(p > 0, F.when(d <= len(near), 0).otherwise(100_000) + p * 100 + d).when(entry_pos == "", 200_000 + d))
    return fits


def lookup(tokens: DataFrame, entries: DataFrame, domain: str = "general") -> DataFrame:
    """Tokens (lemma, pos) with target, gram and entry_domain of the best entry,
    null where there is none.  A lemma is compared without regard to case and outer blanks."""
    asked = tokens.select("lemma", "pos").distinct().withColumn("source", F.lower(F.trim("lemma")))
    found = asked.join(entries.withColumnRenamed("pos", "entry_pos"), "source").withColumn("p", priority(F.col("pos"), F.col("entry_pos"), F.col("domain"), domain)).where("p IS NOT NULL")
    best = found.groupBy("lemma", "pos").agg(F.min_by(F.struct("target", "gram", F.col("domain").alias("entry_domain")), "p").alias("e"))
    joined = tokens.join(best.withColumnRenamed("pos", "__pos").withColumnRenamed("lemma", "__lemma"), (F.col("lemma") == F.col("__lemma")) & F.col("pos").eqNullSafe(F.col("__pos")), "left")
    return joined.select(*tokens.columns, F.col("e.target").alias("target"), F.col("e.gram").alias("gram"), F.col("e.entry_domain").alias("entry_domain"))


def phrase_hits(words: DataFrame, entries: DataFrame, longest: int = LONGEST) -> DataFrame:
    """J12 before the greedy choice: (doc_id, start, size, phrase) of every run of 2 to `longest`
    lemmas (doc_id, lemmas) that is an entry with a target.  Up to FEW phrases go to the tasks;
    more are joined to all runs."""
    known = entries.where(F.contains("source", F.lit(" ")) & (F.col("target") != "")).select(F.col("source").alias("phrase")).distinct()
    some = [r["phrase"] for r in known.limit(FEW + 1).collect()]
    if len(some) > FEW:
        return _runs(words, longest).join(known, "phrase", "left_semi").select("doc_id", "start", "size", "phrase")
    small_batches(entries.sparkSession)
    listed = set(some)
    sizes = sorted({len(p.split()) for p in some if 1 < len(p.split()) <= longest})
    heads = {p.split()[0] for p in some}
    kind = words.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, lemmas in zip(part["doc_id"], part["lemmas"]):
                lemmas = list(lemmas)
                for i, w in enumerate(lemmas):
                    if w in heads:
                        rows += [(doc, i, n, p) for n in sizes if i + n <= len(lemmas) and (p := " ".join(lemmas[i : i + n])) in listed]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "size", "phrase"])

    return words.select("doc_id", "lemmas").mapInPandas(run, f"doc_id {kind}, start int, size int, phrase string")


def _runs(words: DataFrame, longest: int) -> DataFrame:
    """Every run of 2 to `longest` lemmas, a row each."""

    def of(n: int) -> Column:
        one = lambda i: F.struct(i.alias("start"), F.lit(n).alias("size"), F.array_join(F.slice(F.col("lemmas"), i + 1, n), " ").alias("phrase"))
        return F.when(F.size("lemmas") >= n, F.transform(F.sequence(F.lit(0), F.size("lemmas") - n), one))

    return words.select("doc_id", F.explode(F.flatten(F.array_compact(F.array(*[of(n) for n in range(2, longest + 1)])))).alias("x")).select("doc_id", "x.*")


def greedy_cover(words: DataFrame, entries: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The runs that a pass from the left takes, the longest at each place: every document's
    hits in one array, so the choice sees one document at a time."""
    hits = phrase_hits(words, entries, longest).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("size")).alias("o"), "size", "phrase"))).alias("h"))
    kind = words.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, hs in zip(part["doc_id"], part["h"]):
                free = 0
                for h in hs:
                    if h["start"] >= free:
                        rows.append((doc, h["start"], h["size"], h["phrase"]))
                        free = h["start"] + h["size"]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "size", "phrase"])

    return hits.mapInPandas(run, f"doc_id {kind}, start int, size int, phrase string")


def literal(tokens: DataFrame, entries: DataFrame, domain: str = "general") -> DataFrame:
    """(sent_id, translation) of tokens (sent_id, id, word, lemma, pos, tag, kind), word by
    word: phrases as a whole, articles and possessive marks dropped, marks and digits kept,
    unknown words in brackets, names capitalised, blanks before marks removed."""
    order = Window.partitionBy("sent_id").orderBy("id")
    words = tokens.where("kind = 'word'").withColumn("at", F.row_number().over(order) - 1)
    lemmas = words.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "lemma"))), lambda x: x["lemma"]).alias("lemmas")).withColumnRenamed("sent_id", "doc_id")
    cover = greedy_cover(lemmas, entries).withColumnRenamed("doc_id", "sent_id")
    span = cover.select("sent_id", "start", "phrase", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at"))
    near = F.when(F.col("domain") == domain, 0).when(F.col("domain") == "general", 1).otherwise(2)
    place = F.array_position(F.array(*[F.lit(p) for p in lx.PHRASE_POS]), F.col("pos"))
    targets = entries.where("target <> ''").groupBy(F.col("source").alias("phrase")).agg(F.min_by("target", F.struct(near, place)).alias("phrase_target"))
    spans = span.join(targets, "phrase").select("sent_id", "at", "start", "phrase_target")
    placed = tokens.join(words.select("sent_id", "id", "at"), ["sent_id", "id"], "left").join(spans, ["sent_id", "at"], "left")
    told = with_fallback(placed, entries, domain)
    article = F.col("lemma").isin(lx.ARTICLES) & (F.col("pos") == "DET")
    word = F.when(F.col("phrase_target").isNotNull(), F.when(F.col("at") == F.col("start"), F.col("phrase_target")))
    word = word.when(F.col("phrase_target").isNull(), F.when(F.col("kind").isin("punct", "digit"), F.col("word")).when(article | (F.col("tag") == "POS"), F.lit(None)).when(F.col("target").isNull(), F.concat(F.lit("["), "word", F.lit("]"))).otherwise(F.when(F.col("pos") == "PROPN", F.initcap("target")).otherwise(F.col("target"))))
    made = told.select("sent_id", "id", word.alias("out")).where("out IS NOT NULL").groupBy("sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "out"))), lambda x: x["out"]), " ").alias("t"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("t", r"\s+([,.;:!?…)\]»])", "$1"), r",\s*,", ","), r"\s{2,}", " "))
    return made.select("sent_id", F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1 << 30)).alias("translation"))


def with_fallback(tokens: DataFrame, entries: DataFrame, domain: str = "general") -> DataFrame:
    """Tokens with target: of the lemma, else of the word as written, else, of a noun, of its
    lemma without a final s; an empty target is none."""
    tries = [F.struct(F.lower("lemma").alias("lemma"), "pos"), F.struct(F.lower("word").alias("lemma"), "pos"), F.struct(F.when(F.endswith("lemma", F.lit("s")) & F.col("pos").isin("NOUN", "PROPN"), F.expr("lower(substring(lemma, 1, length(lemma) - 1))")).alias("lemma"), "pos")]
    asked = tokens.select(F.explode(F.array(*tries)).alias("x")).select("x.*").where("lemma IS NOT NULL").distinct()
    known = lookup(asked, entries, domain).where("target <> ''").select("lemma", "pos", "target")
    out = tokens
    for i, t in enumerate(tries):
        one = known.select(F.col("lemma").alias(f"__l{i}"), F.col("pos").alias(f"__p{i}"), F.col("target").alias(f"__t{i}"))
        out = out.join(one, (t["lemma"] == F.col(f"__l{i}")) & F.col("pos").eqNullSafe(F.col(f"__p{i}")), "left").drop(f"__l{i}", f"__p{i}")
    return out.withColumn("target", F.coalesce("__t0", "__t1", "__t2")).drop("__t0", "__t1", "__t2")


def coverage(tokens: DataFrame) -> DataFrame:
    """Words, articles, translated and coverage of each text, from tokens (text_id, kind,
    lemma, pos, target); digits count as translated but not as words, so it can pass 1."""
    article = F.col("lemma").isin(lx.ARTICLES) & (F.col("pos") == "DET")
    row = tokens.groupBy("text_id").agg(
        F.count_if(F.col("kind") == "word").alias("words"),
        F.count_if((F.col("kind") == "word") & article).alias("articles"),
        F.count_if((F.col("kind") == "digit") | ((F.col("kind") == "word") & ~article & F.col("target").isNotNull())).alias("translated"),
    )
    return row.withColumn("coverage", F.col("translated") / F.greatest(F.lit(1), F.col("words") - F.col("articles")))


def unknown(tokens: DataFrame) -> DataFrame:
    """Distinct lemmas without a target and their first part of speech, with the place
    where each came first."""
    rows = tokens.where((F.col("kind") == "word") & F.col("target").isNull())
    return rows.groupBy("lemma").agg(F.min("at").alias("first_at"), F.min_by("pos", "at").alias("pos"))


def frequency_list(tokens: DataFrame) -> DataFrame:
    """(lemma, freq, forms, pos, tag, dep) of tokens (at, word, lemma, pos, tag, dep): forms
    by frequency; the most common tag and role, the first of equals; the first part of speech."""
    counted = lambda c: tokens.groupBy("lemma", c.alias("x")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    top = lambda name: counted(F.col(name)).groupBy("lemma").agg(F.min_by("x", F.struct(-F.col("n"), F.col("at"))).alias(name))
    forms = counted(F.lower("word")).groupBy("lemma").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "at", "x"))), lambda v: v["x"]).alias("forms"))
    base = tokens.groupBy("lemma").agg(F.count(F.lit(1)).alias("freq"), F.min_by("pos", "at").alias("pos"))
    return base.join(forms, "lemma").join(top("tag"), "lemma").join(top("dep"), "lemma")


def domain_of(text: Column) -> Column:
    """The domain with more of its words in the text, `med` if equal, else general."""
    words = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?()\"']+|[.,;:!?()\"']+$", ""))
    score = {k: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in v]))) for k, v in lx.DOMAIN_WORDS.items()}
    return F.when((score["med"] >= score["art"]) & (score["med"] > 0), "med").when(score["art"] > 0, "art").otherwise("general")


def replenished(entries: DataFrame, words: DataFrame, domain: str = "general") -> DataFrame:
    """X11, U8: new unverified entries for words (lemma, pos) that no look-up finds, with a
    transliteration where one makes sense."""
    asked = words.select(F.lower(F.trim("lemma")).alias("lemma"), F.upper(F.coalesce("pos", F.lit(""))).alias("pos"), F.col("lemma").alias("word")).where("lemma <> ''").groupBy("lemma", "pos").agg(F.min("word").alias("word"))
    missing = lookup(asked, entries, domain).where(F.col("entry_domain").isNull())

    @F.pandas_udf(T.StringType())
    def proposed(word: pd.Series, pos: pd.Series) -> pd.Series:
        return pd.Series([lx.suggest(w, p) for w, p in zip(word, pos)], dtype=object)

    at = domain if domain in lx.DOMAINS else "general"
    return missing.select(F.col("lemma").alias("source"), "pos", proposed("word", "pos").alias("target"), F.lit("").alias("gram"), F.lit(at).alias("domain"), F.lit(0).alias("verified"))


def merged_entries(entries: DataFrame, rows: DataFrame, update: bool = True) -> tuple[DataFrame, DataFrame]:
    """Entries with rows put in by (source, pos, domain), and counts (added, updated).
    update false: keys that are there stay as they are."""
    keys = ["source", "pos", "domain"]
    new = rows.withColumn("source", F.lower(F.trim("source"))).withColumn("pos", F.upper(F.trim(F.coalesce("pos", F.lit(""))))).withColumn("domain", F.when(F.col("domain").isin(lx.DOMAINS), F.col("domain")).otherwise("general")).dropDuplicates(keys)
    there = entries.select(*keys, F.lit(1).alias("__there"))
    counts = new.join(there, keys, "left").agg(F.count_if(F.col("__there").isNull()).alias("added"), (F.count_if(F.col("__there").isNotNull()) if update else F.lit(0).cast("bigint")).alias("updated"))
    if update:
        return entries.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True), counts
    return entries.unionByName(new.join(entries.select(*keys), keys, "left_anti"), allowMissingColumns=True), counts


def listed(entries: DataFrame, needle: str = "", pos: str | None = None, domain: str | None = None, verified: int | None = None, limit: int = 200) -> DataFrame:
    """A page of entries: a text in source, target or note, other filters equal;
    unverified ones first."""
    from corpuscube.functions.text import ascii_like

    if needle:
        columns = [c for c in ("source", "target", "note") if c in entries.columns]
        hit = ascii_like(F.col(columns[0]), needle)
        for c in columns[1:]:
            hit = hit | ascii_like(F.col(c), needle)
        entries = entries.where(hit)
    for column, wanted in (("pos", pos), ("domain", domain), ("verified", verified)):
        if wanted is not None:
            entries = entries.where(F.col(column) == wanted)
    return entries.orderBy("verified", "source", "pos", "domain").limit(limit)


def tree(tokens: DataFrame, depth: int = 64) -> DataFrame:
    """(sent_id, id, head_id, depth, path) of tokens that are no punctuation; one whose
    head is not there is a root.  One join a level; `depth` guards against cycles."""
    rows = tokens.where("kind <> 'punct'").select("sent_id", "id", "head_id", "word")
    heads = rows.select("sent_id", F.col("id").alias("head_id"))
    here = rows.join(heads, ["sent_id", "head_id"], "left_anti").unionByName(rows.where("head_id = id")).dropDuplicates(["sent_id", "id"]).select("sent_id", "id", "head_id", F.lit(0).alias("depth"), F.col("word").alias("path"))
    out = here
    for level in range(1, depth + 1):
        up = here.select("sent_id", F.col("id").alias("head_id"), F.col("path").alias("__up"))
        here = rows.where("head_id <> id").join(up, ["sent_id", "head_id"]).select("sent_id", "id", "head_id", F.lit(level).alias("depth"), F.concat_ws(" > ", "__up", "word").alias("path"))
        if here.isEmpty():
            break
        out = out.unionByName(here)
    return out


def entry_by_key(entries: DataFrame, source: str, pos: str, domain: str) -> DataFrame:
    """P2"""
    return entries.where((F.col("source") == source) & (F.col("pos") == pos) & (F.col("domain") == domain))


def entries_by_sources(entries: DataFrame, wanted: DataFrame | Sequence[str]) -> DataFrame:
    """Entries of many sources: a semi-join instead of a long list."""
    if not isinstance(wanted, DataFrame):
        wanted = entries.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "source string")
    return entries.join(wanted.select("source").distinct(), "source", "left_semi")
