"""Spoken commands: the first command whose keyword a noisy utterance holds; and the figures
a speech synthesiser shows.

Commands are a short list, so each keyword is an expression over the utterance and the
match is one CASE in the scan: no join, no UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpuscube.functions import text as tx

WPM = 150

# The English and German commands in their order, with their keywords.
COMMANDS = {
    "en": {
        "help": ["help", "commands", "list commands"],
        "read": ["read aloud", "read", "speak"],
        "stop": ["stop", "halt", "quiet", "silence"],
        "next": ["next", "forward", "following"],
        "prev": ["previous", "back", "prior"],
        "first": ["first", "start", "begin"],
        "list": ["list", "all", "show all", "essays"],
    },
    "de": {
        "help": ["hilfe", "befehle", "kommandos", "befehlsliste"],
        "read": ["lies vor", "vorlesen", "lies", "lesen", "sprich", "rede"],
        "stop": ["stopp", "stop", "halt", "halte an", "schweig", "ruhe"],
        "next": ["weiter", "nächstes", "nächste", "naechstes", "vorwärts"],
        "prev": ["zurück", "zurueck", "vorheriges", "rückwärts"],
        "first": ["anfang", "start", "erstes", "erste", "beginne"],
        "list": ["liste", "alle", "zeig alle", "aufsätze", "werke"],
    },
}


def _plain(keyword: str, fold: bool) -> str:
    import re

    k = keyword.lower().strip()
    if fold:
        for a, b in tx.UMLAUTS.items():
            k = k.replace(a, b)
    return re.sub(r"\s+", " ", "".join(c if c.isalnum() or c.isspace() else " " for c in k)).strip()


def hit(keyword: str, spoken: Column, folded: Column) -> Column:
    """the keyword is in the text, or a word of four letters or more is within one edit of it
    (F20), with or without umlauts written out."""
    n, f = _plain(keyword, False), _plain(keyword, True)
    if not n:
        return F.lit(False)
    out = F.contains(spoken, F.lit(n)) | F.contains(folded, F.lit(f))
    if len(n) >= 4:
        near = lambda text, k: F.exists(F.split(text, " "), lambda w: (F.length(w) >= 4) & (F.levenshtein(w, F.lit(k), 1) >= 0))
        out = out | near(spoken, n) | near(folded, f)
    return out


def match(utterances: DataFrame, text: str = "text", language: str = "en", commands: Mapping[str, Sequence[str]] | None = None, essays: Sequence[tuple[str, Sequence[str]]] = ()) -> DataFrame:
    """The utterances with action (null if nothing fits) and essay (of `open`): the
    commands in their order, then the essays (id, keywords)."""
    commands = COMMANDS[language] if commands is None else commands
    heard = utterances.withColumn("__n", tx.spoken(F.col(text))).withColumn("__f", tx.folded(F.col(text)))
    action, essay = F.when(F.col("__n") == "", F.lit(None).cast("string")), F.lit(None).cast("string")
    rules = [(k, name, None) for name, ks in commands.items() for k in ks] + [(k, "open", i) for i, ks in essays for k in ks]
    conditions = [hit(k, F.col("__n"), F.col("__f")) for k, _, _ in rules]
    for c, (_, name, _) in zip(conditions, rules):
        action = action.when(c, name)
    if essays:
        essay = F.when(F.col("__n") == "", F.lit(None).cast("string"))
        for c, (_, _, i) in zip(conditions, rules):
            essay = essay.when(c, F.lit(i))
    return heard.withColumn("action", action).withColumn("essay", essay).drop("__n", "__f")


def text_statistics(texts: DataFrame, text: str = "text", rate: float = 1.0) -> DataFrame:
    """Chars, words, sentences and seconds of each text."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_count(body, F.lit(r"\S+")).cast("bigint")
    return texts.withColumn("chars", F.length(body).cast("bigint")).withColumn("words", words).withColumn("sentences", F.size(tx.spoken_sentences(F.col(text))).cast("bigint")).withColumn("seconds", words / (WPM * rate) * 60)


def sentence_spans(texts: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, end) of every sentence, end to end."""
    sizes = F.transform(tx.spoken_sentences(F.col(text)), F.length)
    each = texts.select(F.col(key).alias("doc_id"), sizes.alias("__s")).select("doc_id", "__s", F.posexplode("__s").alias("i", "n"))
    before = F.aggregate(F.slice("__s", 1, F.col("i")), F.lit(0), lambda a, x: a + x)
    return each.select("doc_id", before.alias("start"), (before + F.col("n")).alias("end"))


def neighbours(essays: DataFrame, order: str = "ord") -> DataFrame:
    """The essay before and after each one, round the ends."""
    from pyspark.sql import Window

    w = Window.orderBy(order)  # a menu's rows
    ends = essays.agg(F.min_by("id", order).alias("__first"), F.max_by("id", order).alias("__last"))
    return essays.crossJoin(F.broadcast(ends)).withColumn("previous", F.coalesce(F.lag("id").over(w), F.col("__last"))).withColumn("next", F.coalesce(F.lead("id").over(w), F.col("__first"))).drop("__first", "__last")
