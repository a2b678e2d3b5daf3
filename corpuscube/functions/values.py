"""Values, periods, keys and numbers, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# What a source writes for "no data".
MISSING = ["", "-", "–", "—", "…", "...", "x", "X", "н/д", "нд", "null", "None", "nan"]
# Names of the levels of territories.
LEVELS = {0: "Республика Беларусь", 1: "Область / г. Минск", 2: "Район / город областного подчинения", 3: "Посёлок городского типа / сельсовет"}
OTHER_LEVEL = "прочее"


def parse_value(raw: Column) -> Column:
    """struct(value, raw): blanks of any width out, comma to point, "no data" to null with
    the text kept, else the number, else the first number in the text."""
    token = F.replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "[\\s   ]+", ""), F.lit(","), F.lit("."))
    kept = F.trim(F.coalesce(raw, F.lit("")))
    number = F.regexp_extract(token, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", 0)
    inside = F.regexp_extract(token, r"-?\d+(?:\.\d+)?", 0)
    text = F.when(token.isin(MISSING), F.lit(None)).when(number != "", number).when(inside != "", inside)
    return F.struct(text.try_cast("double").alias("value"), F.coalesce(text, kept).alias("raw"))


def year_of(period: Column) -> Column:
    """the year that a period begins with, null if it is no number."""
    return F.split(F.split(F.trim(period), "-")[0], "/")[0].try_cast("int")


def breakdown_key(dims: Column) -> Column:
    """the dimensions as k=v in order of k, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(dims)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")


def natural_key(indicator: Column, period: Column, geo: Column, key: Column) -> Column:
    """what identifies a fact; a dash stands for no territory."""
    return F.concat_ws("|", indicator, period, F.when(F.coalesce(geo, F.lit("")) == "", "-").otherwise(geo), key)


def fact_id(natural: Column) -> Column:
    """the first 32 digits of the key's SHA-1."""
    return F.substring(F.sha1(natural.cast("binary")), 1, 32)


def level_name(level: Column) -> Column:
    """F60 for territories."""
    return reduce(lambda other, kv: F.when(level == kv[0], kv[1]).otherwise(other), LEVELS.items(), F.lit(OTHER_LEVEL))


def plain_name(name: Column) -> Column:
    """single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))


def clean_place(name: Column) -> Column:
    """a place's name without what says that it is a town."""
    return F.trim(F.regexp_replace(name, r"^\s*(г\.|город|г\.п\.|гп|пгт|аг\.|д\.)\s*", ""))


def year_windows(years: Sequence[int], most: int = 10) -> list[list[int]]:
    """distinct years in order, in windows of `most`."""
    ordered = sorted(set(map(int, years)))
    return [ordered[i : i + max(1, most)] for i in range(0, len(ordered), max(1, most))]


def batches(codes: Sequence[str], size: int) -> list[list[str] | None]:
    """codes in batches; [None], no restriction, if they fit into one or size is 0."""
    return [None] if not size or size <= 0 or len(codes) <= size else [list(codes[i : i + size]) for i in range(0, len(codes), size)]


def speech_rate(rate: Column) -> Column:
    """words a minute of a relative rate."""
    return F.least(F.greatest(F.bround(F.coalesce(rate, F.lit(1.0)) * 175).cast("int"), F.lit(80)), F.lit(400))


def speech_pitch(pitch: Column) -> Column:
    """the synthesiser's pitch of a relative one."""
    return F.least(F.greatest(F.bround(F.coalesce(pitch, F.lit(1.0)) * 50).cast("int"), F.lit(0)), F.lit(99))


def numeral_case(n: Column) -> Column:
    """The form of a noun after a number."""
    tens, ones = F.abs(n) % 100, F.abs(n) % 10
    return F.when(tens.between(11, 14), "gen_plur").when(ones == 1, "nom_sing").when(ones.between(2, 4), "gen_sing").otherwise("gen_plur")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def compression(summary: Column, text: Column) -> Column:
    """the summary's length over the text's, 0 for an empty text."""
    return F.when(F.length(text) > 0, F.length(summary) / F.length(text)).otherwise(0.0)
