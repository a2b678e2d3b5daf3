"""A statistical cube: observations with dimensions, territories in a hierarchy, fact tables,
quality reports.

Dictionaries (territories, indicators, codelists) are joined by key; the optimizer
broadcasts them where their size allows.  Facts are keyed by hash, so loads that overlap
are merged by one aggregate.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpuscube.functions import values as vl

TOTAL = "517667"
GUARD = 32

FACT_COLUMNS = ["fact_id", "indicator_code", "indicator_name_ru", "time_period", "year", "geo_code", "geo_name_ru", "geo_level", "geo_level_name", "region_code", "region_name_ru", "district_code", "district_name_ru", "breakdown_key", "breakdown_value_ru", "unit_code", "unit_name_ru", "value", "value_raw", "obs_attribute", "source_window", "retrieved_at"]
NULLABLE = ["geo_code", "geo_name_ru", "breakdown_key", "breakdown_value_ru", "obs_attribute", "region_name_ru", "district_name_ru"]


_HIERARCHY = """
WITH RECURSIVE t(code, level, region_code, region_name, district_code, district_name) MAX RECURSION LEVEL {limit} AS (
  SELECT n.code, 0, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)
  FROM {nodes} n LEFT ANTI JOIN {nodes} p ON p.code = n.parent
  UNION ALL
  SELECT n.code, t.level + 1,
    CASE WHEN t.level = 0 THEN n.code ELSE t.region_code END, CASE WHEN t.level = 0 THEN n.name ELSE t.region_name END,
    CASE WHEN t.level = 1 THEN n.code ELSE t.district_code END, CASE WHEN t.level = 1 THEN n.name ELSE t.district_name END
  FROM {nodes} n JOIN t ON n.parent = t.code
)
SELECT n.code, n.name, n.parent, coalesce(t.level, {guard}) AS level, t.region_code, t.region_name, t.district_code, t.district_name
FROM {nodes} n LEFT JOIN t ON t.code = n.code
"""


def hierarchy(nodes: DataFrame, guard: int = GUARD) -> DataFrame:
    """(code, name, parent) with level, and the ancestor of level 1 and of level 2 (the
    node itself counts).  A recursive query from the roots down, one join a level; a parent that
    is not there makes a root; nodes that no root leads to (a cycle) have level `guard` and no
    ancestors.  Codes are unique."""
    return nodes.sparkSession.sql(_HIERARCHY, nodes=nodes.select("code", "name", "parent"), guard=guard, limit=100)


def nested_nodes(spark: SparkSession, tree: Mapping | Sequence, code: str = "code", name: str = "name", children: str = "children") -> DataFrame:
    """(code, name, parent) of a tree of nested objects, as a portal's page holds it, for
    hierarchy().  One page's tree is small, so it is walked on the driver."""
    rows, todo = [], [(x, None) for x in ([tree] if isinstance(tree, Mapping) else tree)]
    while todo:
        node, parent = todo.pop()
        rows.append((str(node[code]), " ".join(str(node.get(name) or "").split()), parent))
        todo += [(x, str(node[code])) for x in node.get(children) or []]
    return spark.createDataFrame(rows, "code string, name string, parent string")


def codes_of_levels(territories: DataFrame, levels: Sequence[int]) -> DataFrame:
    """P11"""
    return territories.where(F.col("level").isin(*levels))


def parse_structure(spark: SparkSession, structure: Mapping | str) -> tuple[DataFrame, DataFrame]:
    """Dimensions (dim_id, position, name, codelist_id, is_time, is_geo, is_unit,
    n_codes) and codelist entries (codelist_id, codelist_name, code, name_ru, name_be, name_en,
    parent_code) of an SDMX-JSON structure message."""
    data = (json.loads(structure) if isinstance(structure, str) else structure).get("data") or {}

    def names(x: Mapping) -> dict[str, str]:
        found = {k: " ".join(v.split()) for k, v in (x.get("names") or {}).items() if isinstance(v, str)}
        if x.get("name"):
            found.setdefault("ru", " ".join(str(x["name"]).split()))
        return found

    entries, lists = [], {}
    for cl in data.get("codelists") or []:
        lists[cl["id"]] = {c["id"] for c in cl.get("codes") or []}
        for c in cl.get("codes") or []:
            n = names(c)
            entries.append((cl["id"], names(cl).get("ru", ""), str(c["id"]), n.get("ru", ""), n.get("be", ""), n.get("en", ""), c.get("parent")))
    concepts = {c["id"]: names(c) for s in data.get("conceptSchemes") or [] for c in s.get("concepts") or []}
    rows = []
    for ds in data.get("dataStructures") or []:
        listed = (ds.get("dataStructureComponents") or {}).get("dimensionList") or {}
        dims = [(d, False) for d in listed.get("dimensions") or []] + [(d, True) for d in listed.get("timeDimensions") or []]
        for d, is_time in sorted(dims, key=lambda x: x[0].get("position") or 0):
            urn = (d.get("localRepresentation") or {}).get("enumeration") or ""
            at = urn.split("Codelist=")[-1].split("(")[0].split(":")[-1] if "Codelist=" in urn else f"CL_{d['id']}"
            at = at if at in lists or "Codelist=" in urn else None
            concept = concepts.get(d["id"], {})
            said = " ".join([d["id"], *concept.values()]).lower()
            geo = "699961" in lists.get(at, ()) or "территор" in said or "territory" in said
            rows.append((d["id"], int(d.get("position") or 0), concept.get("ru", ""), at, is_time or d["id"].upper() == "TIME_PERIOD", geo, d["id"].startswith("unit_") or (at or "").startswith("CL_unit"), len(lists.get(at, ()))))
    dims = spark.createDataFrame(rows, "dim_id string, position int, name string, codelist_id string, is_time boolean, is_geo boolean, is_unit boolean, n_codes int")
    return dims, spark.createDataFrame(entries, "codelist_id string, codelist_name string, code string, name_ru string, name_be string, name_en string, parent_code string")


def rows_to_facts(rows: DataFrame, indicator: str, dims: Sequence[str], geo: str | None, unit: str | None, value: str = "OBS_VALUE", window: str = "") -> DataFrame:
    """Wide rows as facts (indicator_code, time_period, geo_code, unit_code, dims,
    breakdown_key, value, value_raw, obs_attribute, source_window); blank dimensions are left out."""
    have = rows.columns
    cell = lambda n: F.trim(F.coalesce(F.col(n), F.lit(""))) if n in have else F.lit("")
    parts = [x for d in dims if d in have and d not in (geo, unit) for x in (F.lit(d), cell(d))]
    kept = F.map_filter(F.create_map(*parts), lambda k, v: v != "") if parts else F.create_map().cast("map<string,string>")
    got = vl.parse_value(cell(value))
    out = rows.select(F.lit(indicator).alias("indicator_code"), cell("TIME_PERIOD").alias("time_period"), (cell(geo) if geo else F.lit("")).alias("geo_code"), F.nullif(cell(unit), F.lit("")).alias("unit_code") if unit else F.lit(None).cast("string").alias("unit_code"), kept.alias("dims"), got.alias("__v"), cell(value).alias("__raw"), cell("OBS_ATTRIBUTE").alias("obs_attribute"), F.lit(window).alias("source_window"))
    return out.select("indicator_code", "time_period", "geo_code", "unit_code", "dims", vl.breakdown_key(F.col("dims")).alias("breakdown_key"), F.col("__v.value").alias("value"), F.when(F.col("__v.raw") != "", F.col("__v.raw")).otherwise(F.col("__raw")).alias("value_raw"), "obs_attribute", "source_window")


def with_ids(facts: DataFrame) -> DataFrame:
    """natural_key and fact_id."""
    key = vl.natural_key(F.col("indicator_code"), F.col("time_period"), F.col("geo_code"), F.col("breakdown_key"))
    return facts.withColumn("natural_key", key).withColumn("fact_id", vl.fact_id(F.col("natural_key")))


def dedupe_last(facts: DataFrame, seq: str = "seq") -> DataFrame:
    """Of facts with one natural key, the one that came last.  An aggregate, not a window:
    partial results shrink before the shuffle."""
    rest = [c for c in facts.columns if c != "natural_key"]
    return facts.groupBy("natural_key").agg(F.max_by(F.struct(*rest), seq).alias("x")).select("x.*", "natural_key")


def breakdown_labels(facts: DataFrame, entries: DataFrame) -> DataFrame:
    """full and short labels of each distinct breakdown; a code without a label stands for
    itself.  Codelist CL_x belongs to dimension x."""
    distinct = facts.select("breakdown_key", "dims").groupBy("breakdown_key").agg(F.first("dims").alias("dims"))
    each = distinct.select("breakdown_key", F.explode("dims").alias("dim", "code"))
    named = entries.select(F.expr("substring(codelist_id, 4)").alias("dim"), F.col("codelist_name").alias("dim_name"), "code", F.col("name_ru").alias("code_name"))
    lists = named.groupBy("dim").agg(F.first("dim_name").alias("dim_name"))
    each = each.join(named.drop("dim_name"), ["dim", "code"], "left").join(lists, "dim", "left")
    one = F.struct("dim", F.coalesce("code_name", "code").alias("short"), F.concat_ws(": ", F.nullif(F.coalesce("dim_name", "dim"), F.lit("")), F.coalesce("code_name", "code")).alias("full"))
    made = each.groupBy("breakdown_key").agg(F.array_sort(F.collect_list(one)).alias("x"))
    join = lambda part, by: F.array_join(F.transform("x", lambda e: e[part]), by)
    return made.select("breakdown_key", join("full", " | ").alias("breakdown_full_ru"), join("short", " / ").alias("breakdown_value_ru"))


def fact_table(facts: DataFrame, indicators: DataFrame, territories: DataFrame, units: DataFrame, labels: DataFrame, retrieved_at: str) -> DataFrame:
    """The 22 columns of FACT_COLUMNS; dictionaries by left joins, the first label of a
    unit, empty strings null in NULLABLE columns."""
    first = units.groupBy("unit_code").agg(F.min_by("unit_name_ru", "seq").alias("unit_name_ru"))
    names = indicators.select("indicator_code", F.col("name_ru").alias("indicator_name_ru"))
    places = territories.select(F.col("code").alias("geo_code"), F.col("name").alias("geo_name_ru"), F.col("level").alias("geo_level"), "region_code", F.col("region_name").alias("region_name_ru"), "district_code", F.col("district_name").alias("district_name_ru"))
    out = with_ids(facts).join(names, "indicator_code", "left").join(places, "geo_code", "left").join(first, "unit_code", "left").join(labels.select("breakdown_key", "breakdown_value_ru"), "breakdown_key", "left")
    out = out.withColumn("year", vl.year_of(F.col("time_period"))).withColumn("geo_level_name", F.when(F.col("geo_level").isNotNull(), vl.level_name(F.col("geo_level")))).withColumn("retrieved_at", F.lit(retrieved_at))
    for c in NULLABLE:
        out = out.withColumn(c, F.when(F.col(c) != "", F.col(c)))
    return out.select(*FACT_COLUMNS)


def ordered_facts(facts: DataFrame) -> DataFrame:
    """The table's order, nulls last."""
    return facts.orderBy(*[F.col(c).asc_nulls_last() for c in ("indicator_code", "geo_level", "geo_code", "breakdown_key", "time_period")])


def indicator_table(indicators: DataFrame, facts: DataFrame) -> DataFrame:
    """Years and units of each indicator, and how many facts it has."""
    n = facts.groupBy("indicator_code").agg(F.count(F.lit(1)).alias("n_facts"))
    out = indicators.join(n, "indicator_code", "left")
    return out.select("indicator_code", "name_ru", F.array_min("years").alias("year_min"), F.array_max("years").alias("year_max"), F.size("years").alias("n_years_available"), F.array_join("units", ", ").alias("unit_codes"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"))


def territory_table(territories: DataFrame, facts: DataFrame) -> DataFrame:
    """Territories with level names and how many facts each has."""
    n = facts.groupBy("geo_code").agg(F.count(F.lit(1)).alias("n_facts"))
    out = territories.withColumnRenamed("code", "geo_code").join(n, "geo_code", "left")
    return out.withColumn("level_name", vl.level_name(F.col("level"))).withColumn("n_facts", F.coalesce("n_facts", F.lit(0)))


def located(territories: DataFrame, places: DataFrame) -> DataFrame:
    """Territories with lat and lon of a geocode table by cleaned name; none where it has none."""
    known = places.groupBy("place").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    return territories.withColumn("place", vl.clean_place(F.col("name"))).join(known, "place", "left").drop("place")


def coverage(facts: DataFrame) -> DataFrame:
    """What each indicator's facts cover."""
    return facts.groupBy("indicator_code", "indicator_name_ru").agg(F.count("fact_id").alias("n_facts"), F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.countDistinct("year").alias("n_years"), F.countDistinct("geo_code").alias("n_geo"), F.countDistinct("breakdown_key").alias("n_breakdowns"), F.count_if(F.col("value").isNull()).alias("n_missing_values"))


def is_total(code: str = TOTAL) -> Column:
    """P10: the breakdown that holds all kinds; no breakdown is none."""
    return F.coalesce(F.contains("breakdown_key", F.lit(code)), F.lit(False))


def consistency(facts: DataFrame, indicator: str, tolerance: float = 0.02) -> DataFrame:
    """Each year's country total against the sum of its regions; ok if they differ by
    `tolerance` at most; not ok where a side is missing or the total is 0."""
    rows = facts.where((F.col("indicator_code") == indicator) & is_total())
    side = lambda level, name: rows.where(F.col("geo_level") == level).groupBy("year").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias(name))
    both = side(0, "country_value").join(side(1, "regions_sum"), "year", "full")
    both = both.withColumn("diff", F.col("regions_sum") - F.col("country_value")).withColumn("diff_pct", F.try_divide("diff", F.nullif("country_value", F.lit(0.0))) * 100)
    return both.withColumn("ok", F.coalesce(F.abs("diff_pct") <= tolerance * 100, F.lit(False)))


def top_territories(facts: DataFrame, indicator: str, year: int | None = None, n: int = 15, level: int = 2) -> DataFrame:
    """The n largest territories of a level in a year (the last one if none is
    given), by the total breakdown where there is one, else by all; ties by code."""
    rows = facts.where((F.col("indicator_code") == indicator) & (F.col("geo_level") == level))
    last = rows.agg(F.max("year").alias("__y")) if year is None else facts.sparkSession.createDataFrame([(year,)], "__y int")
    rows = rows.join(F.broadcast(last), F.col("year") == F.col("__y"))
    some = rows.agg(F.coalesce(F.max(is_total()), F.lit(False)).alias("__any"))
    rows = rows.crossJoin(F.broadcast(some)).where(~F.col("__any") | is_total())
    sums = rows.groupBy("year", "geo_code", "geo_name_ru", "region_name_ru").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    return sums.orderBy(F.desc("value"), "geo_code").limit(n)


def national_series(facts: DataFrame, indicator: str) -> DataFrame:
    """The country's totals by year."""
    rows = facts.where((F.col("indicator_code") == indicator) & (F.col("geo_level") == 0) & is_total())
    return rows.select("year", "value").dropna()


def growth(series: DataFrame, digits: int = 2) -> DataFrame:
    """Per cent from the year before; null at the first, and after a 0."""
    before = F.lag("value").over(Window.orderBy("year"))  # a series has a row a year
    return series.withColumn("pct", F.round(F.try_divide(100.0 * (F.col("value") - before), before), digits))


def long_table(facts: DataFrame, indicator: str) -> DataFrame:
    """One row a year, territory and kind."""
    names = ["year", "time_period", "geo_code", "geo_name_ru", "geo_level", "region_code", "region_name_ru", "district_code", "district_name_ru", "crime_type", "breakdown_key", "unit_name_ru", "value", "retrieved_at"]
    rows = facts.where(F.col("indicator_code") == indicator).withColumnRenamed("breakdown_value_ru", "crime_type")
    return rows.select(*[c for c in names if c in rows.columns])


def wide_table(rows: DataFrame, kinds: Sequence[str], keys: Sequence[str] = ("year", "geo_code", "geo_name_ru", "geo_level", "region_name_ru")) -> DataFrame:
    """A column a kind; rows with a null among the keys, and those without any value, go."""
    whole = rows.where(F.col("value").isNotNull())
    for k in keys:
        whole = whole.where(F.col(k).isNotNull())
    return whole.groupBy(*keys).pivot("crime_type", list(kinds)).agg(F.first("value", ignorenulls=True))


def coverage_matrix(facts: DataFrame, years: Sequence[int]) -> DataFrame:
    """Facts by indicator and year, 0 where there is none."""
    rows = facts.where(F.col("year").isNotNull() & F.col("indicator_name_ru").isNotNull())
    return rows.groupBy("indicator_code", "indicator_name_ru").pivot("year", list(years)).agg(F.count("fact_id")).na.fill(0)


def kind_shares(facts: DataFrame, indicator: str, total: str, skip: str = "из них") -> DataFrame:
    """Each year's kinds at country level as shares of the total, in per cent; parts of
    another kind (labels that begin with `skip`) are left out."""
    rows = facts.where((F.col("indicator_code") == indicator) & (F.col("geo_level") == 0))
    sums = rows.groupBy("year", "breakdown_value_ru").agg(F.sum("value").alias("value"))
    whole = sums.where(F.col("breakdown_value_ru") == total).select("year", F.col("value").alias("__t"))
    kinds = sums.where((F.col("breakdown_value_ru") != total) & ~F.startswith("breakdown_value_ru", F.lit(skip)))
    return kinds.join(whole, "year").select("year", "breakdown_value_ru", "value", F.round(F.try_divide("value", F.nullif("__t", F.lit(0.0))) * 100, 2).alias("share"))


def region_totals(facts: DataFrame, indicator: str) -> DataFrame:
    """regions' totals by year."""
    return facts.where((F.col("indicator_code") == indicator) & (F.col("geo_level") == 1) & is_total()).groupBy("year", "geo_name_ru").agg(F.sum("value").alias("value"))


def data_flags(territory_rows: DataFrame) -> DataFrame:
    """Territories of each level, and those with facts."""
    return territory_rows.groupBy("level_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_facts") > 0).alias("with_data"))


def dataset_stats(facts: DataFrame) -> DataFrame:
    """One row of counters for a report's head."""
    return facts.agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("indicator_code").alias("indicators"), F.countDistinct("geo_code").alias("territories"), F.countDistinct("year").alias("years"), F.count_if(F.col("value").isNull()).alias("missing"))


def level_counts(facts: DataFrame) -> DataFrame:
    """Facts by level of territory."""
    return facts.groupBy("geo_level").agg(F.count(F.lit(1)).alias("n"))


def accumulate(windows: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All windows' rows, numbered by arrival, and the error rows apart: a window
    failed if its answer is text without a header.  Rows: (seq, body)."""
    rows = windows[0].withColumn("window", F.lit(0))
    for i, w in enumerate(windows[1:], 1):
        rows = rows.unionByName(w.withColumn("window", F.lit(i)), allowMissingColumns=True)
    bad = ~F.startswith("body", F.lit("DATAFLOW")) & ~F.contains("body", F.lit(","))
    return rows.where(~bad), rows.where(bad)


def merged_dictionaries(parts: Sequence[DataFrame], keys: Sequence[str], keep: str = "first") -> DataFrame:
    """Entries of several indicators, the first or the last of a key."""
    rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("__i", F.lit(i))
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in rows.columns if c not in (*keys, "__i")]
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), F.col("__i")).alias("x")).select(*keys, "x.*")


def request_plan(years: DataFrame, dims: DataFrame, most_years: int = 10, most_codes: int = 50) -> DataFrame:
    """Windows of years x batches of codes, a row a planned request."""
    at = F.floor((F.row_number().over(Window.orderBy("year")) - 1) / most_years)
    windows = years.distinct().withColumn("window", at).groupBy("window").agg(F.min("year").alias("year_from"), F.max("year").alias("year_to"))
    batch = F.floor((F.row_number().over(Window.partitionBy("dim").orderBy("code")) - 1) / most_codes)
    parts = dims.withColumn("batch", batch).groupBy("dim", "batch").agg(F.count(F.lit(1)).alias("codes"))
    return windows.crossJoin(parts)


def facts_page(facts: DataFrame, indicator: str | None = None, geo: str | None = None, year: int | None = None, limit: int = 200) -> DataFrame:
    """Filters that are given, in a fixed order; a year of 0 is none."""
    for column, wanted in (("indicator_code", indicator), ("geo_code", geo), ("year", year)):
        if wanted:
            facts = facts.where(F.col(column) == wanted)
    return facts.orderBy("indicator_code", "geo_code", "year", "breakdown_key").limit(limit)


def name_search(table: DataFrame, code: str, name: str, needle: str, limit: int = 10) -> DataFrame:
    """Rows whose name or code has the needle, ASCII letters folded."""
    from corpuscube.functions.text import ascii_like

    return table.where(ascii_like(F.col(name), needle) | ascii_like(F.col(code), needle)).orderBy(code).limit(limit)


def dashboard(facts: DataFrame, first: int, last: int, needle: str = "", region: str | None = None) -> DataFrame:
    """A range of years, a text in the indicator's name, a region; by year."""
    rows = facts.where(F.col("year").between(first, last))
    if needle:
        rows = rows.where(F.coalesce(F.contains(F.lower("indicator_name_ru"), F.lit(needle.lower())), F.lit(False)))
    if region:
        rows = rows.where(F.col("region_name_ru") == region)
    return rows


def regions(facts: DataFrame) -> DataFrame:
    """The distinct regions' names."""
    return facts.select("region_name_ru").where("region_name_ru <> ''").distinct()


def api_summary(facts: DataFrame, indicators: DataFrame, territories: DataFrame) -> DataFrame:
    """One row of counts and the first and last year."""
    row = facts.agg(F.count(F.lit(1)).alias("total_observations"), F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    return row.crossJoin(indicators.agg(F.count(F.lit(1)).alias("indicators_count"))).crossJoin(territories.agg(F.count(F.lit(1)).alias("territories_count")))


def top_indicators(indicator_rows: DataFrame, n: int = 5) -> DataFrame:
    """The indicators with the most facts."""
    return indicator_rows.orderBy(F.desc("n_facts"), "indicator_code").limit(n)


def decode_breakdowns(dims: DataFrame, entries: DataFrame, facts: DataFrame) -> DataFrame:
    """What the codes in breakdown keys mean: (breakdown_key, dim_id, code, name_ru)."""
    each = facts.select("breakdown_key").distinct().withColumn("kv", F.explode(F.split("breakdown_key", ","))).select("breakdown_key", F.split("kv", "=")[0].alias("dim_id"), F.split("kv", "=")[1].alias("code"))
    return each.join(dims.select("dim_id", "codelist_id"), "dim_id").join(entries.select("codelist_id", "code", "name_ru"), ["codelist_id", "code"]).select("breakdown_key", "dim_id", "code", "name_ru")
