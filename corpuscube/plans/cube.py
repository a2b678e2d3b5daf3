"""Cube queries over the star schema: regions, nations and customers are the territories;
orders by year and priority are the facts, at three levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscube.functions import values as vl
from corpuscube.operators import cube as cb

ORDERS, COUNTS = "10108000001", "10108000002"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ALL = "Всего"


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _nodes(spark, d):
    region = _table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("code"), F.col("r_name").alias("name"), F.lit("W").alias("parent"))
    nation = _table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    customer = _table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("code"), F.col("c_name").alias("name"), F.concat(F.lit("N"), "c_nationkey").alias("parent"))
    root = spark.createDataFrame([("W", "World", None)], "code string, name string, parent string")
    return root.unionByName(region).unionByName(nation).unionByName(customer)


def _observations(spark, d):
    """(indicator, year, geo, priority or the total's code, amount) at levels 0 to 2: nations'
    orders are summed first, higher levels and totals by grouping sets over those few rows."""
    o = _table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    base = o.join(c, "o_custkey").groupBy("c_nationkey", "o_orderpriority", "year").agg(F.sum("price").alias("amount"), F.count(F.lit(1)).alias("n"))
    n = _table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rolled = spark.sql(
        """SELECT year, n_regionkey, c_nationkey, o_orderpriority, sum(amount) AS amount, sum(n) AS n,
        grouping(n_regionkey) AS gr, grouping(c_nationkey) AS gn, grouping(o_orderpriority) AS gp FROM {base}
        GROUP BY year, n_regionkey, c_nationkey, o_orderpriority GROUPING SETS (
          (year, n_regionkey, c_nationkey, o_orderpriority), (year, n_regionkey, c_nationkey), (year, n_regionkey, o_orderpriority), (year, n_regionkey), (year, o_orderpriority), (year))""",
        base=base.join(n, "c_nationkey"),
    )
    geo = F.when(F.col("gr") == 1, "W").when(F.col("gn") == 1, F.concat(F.lit("R"), "n_regionkey")).otherwise(F.concat(F.lit("N"), "c_nationkey"))
    kind = F.when(F.col("gp") == 1, cb.TOTAL).otherwise(F.col("o_orderpriority"))
    both = rolled.select(F.col("year").cast("string").alias("TIME_PERIOD"), geo.alias("geo"), kind.alias("priority"), F.lit("206").alias("unit_1"), F.explode(F.array(F.struct(F.lit(ORDERS).alias("i"), F.col("amount").cast("string").alias("v")), F.struct(F.lit(COUNTS).alias("i"), F.col("n").cast("string").alias("v")))).alias("x"))
    return both.select("TIME_PERIOD", "geo", "priority", "unit_1", F.col("x.i").alias("indicator"), F.col("x.v").alias("OBS_VALUE"))


def _entries(spark):
    rows = [("CL_priority", "Priority", p, p, "", "", None) for p in PRIORITIES] + [("CL_priority", "Priority", cb.TOTAL, ALL, "", "", None)]
    return spark.createDataFrame(rows, "codelist_id string, codelist_name string, code string, name_ru string, name_be string, name_en string, parent_code string")


def _raw(spark, d):
    rows = _observations(spark, d)
    made = None
    for i in (ORDERS, COUNTS):
        one = cb.rows_to_facts(rows.where(F.col("indicator") == i), i, ["geo", "priority", "unit_1"], "geo", "unit_1", window="all")
        made = one if made is None else made.unionByName(one)
    return made


def _indicators(spark):
    return spark.createDataFrame([(ORDERS, "Order value", [1992, 1998], ["206"]), (COUNTS, "Order count", [1992], ["206"])], "indicator_code string, name_ru string, years array<int>, units array<string>")


def _units(spark):
    return spark.createDataFrame([("206", "unit", 0), ("206", "piece", 1)], "unit_code string, unit_name_ru string, seq int")


def _geo(spark, d):
    return cb.hierarchy(_nodes(spark, d).where(~F.startswith("code", F.lit("C"))))


def _facts(spark, d):
    raw = _raw(spark, d)
    return cb.fact_table(raw, _indicators(spark), _geo(spark, d), _units(spark), cb.breakdown_labels(raw, _entries(spark)), "2025-01-01T00:00:00+00:00")


def cube_hierarchy(spark, d):
    return cb.hierarchy(_nodes(spark, d))


def cube_facts(spark, d):
    return _facts(spark, d).withColumn("value", F.round("value", 2))


def cube_fact_id_sha1(spark, d):
    return cb.with_ids(_raw(spark, d)).select("fact_id", "natural_key")


def cube_dedupe_last(spark, d):
    """Orders as versions of their customer's yearly fact: the order with the largest key came last."""
    o = _table(spark, d, "orders").select(F.concat_ws("|", F.lit(ORDERS), F.year("o_orderdate").cast("string"), F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("priority="), "o_orderpriority")).alias("natural_key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return cb.dedupe_last(o)


def cube_rollup_levels(spark, d):
    return cb.level_counts(_facts(spark, d))


def cube_coverage(spark, d):
    return cb.coverage(_facts(spark, d))


def cube_consistency(spark, d):
    out = cb.consistency(_facts(spark, d), ORDERS)
    return out.select("year", F.round("country_value", 2).alias("country_value"), F.round("regions_sum", 2).alias("regions_sum"), "ok")


def cube_top_units(spark, d):
    return cb.top_territories(_facts(spark, d), ORDERS).withColumn("value", F.round("value", 2))


def cube_national_series(spark, d):
    return cb.national_series(_facts(spark, d), ORDERS).withColumn("value", F.round("value", 2))


def cube_growth_lag(spark, d):
    return cb.growth(cb.national_series(_facts(spark, d), ORDERS)).select("year", "pct")


def cube_long_table(spark, d):
    return cb.long_table(_facts(spark, d), ORDERS).withColumn("value", F.round("value", 2)).drop("retrieved_at")


def cube_wide_pivot(spark, d):
    wide = cb.wide_table(cb.long_table(_facts(spark, d), ORDERS), [*PRIORITIES, ALL])
    return wide.select(*wide.columns[:5], *[F.round(F.col(f"`{p}`"), 2).alias(f"p{i}") for i, p in enumerate([*PRIORITIES, ALL])])


def cube_coverage_matrix(spark, d):
    years = range(1992, 2002)
    m = cb.coverage_matrix(_facts(spark, d), list(years))
    return m.select("indicator_code", "indicator_name_ru", *[F.col(str(y)).alias(f"y{y}") for y in years])


def cube_type_share(spark, d):
    return cb.kind_shares(_facts(spark, d), ORDERS, ALL).select("year", "breakdown_value_ru", "share")


def cube_region_totals(spark, d):
    return cb.region_totals(_facts(spark, d), ORDERS).withColumn("value", F.round("value", 2))


def cube_parse_value(spark, d):
    """Line prices as a source may write them: with blanks and a comma, missing, in a text."""
    line = _table(spark, d, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    raw = F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit(" "), F.replace(price, F.lit("."), F.lit(",")))).when(F.col("l_linenumber") % 5 == 1, "н/д").when(F.col("l_linenumber") % 5 == 2, F.concat(F.lit("около "), price, F.lit(" руб"))).when(F.col("l_linenumber") % 5 == 3, "нет").otherwise(price)
    return line.select("l_orderkey", "l_linenumber", vl.parse_value(raw).alias("v")).select("l_orderkey", "l_linenumber", F.col("v.value").alias("value"), F.col("v.raw").alias("raw"))


def cube_territories(spark, d):
    return cb.territory_table(cb.hierarchy(_nodes(spark, d)), _facts(spark, d)).select("geo_code", "name", "level", "parent", "n_facts")


def cube_indicators(spark, d):
    return cb.indicator_table(_indicators(spark), _facts(spark, d))


def cube_data_flag(spark, d):
    return cb.data_flags(cb.territory_table(cb.hierarchy(_nodes(spark, d)), _facts(spark, d)))


def cube_api_summary(spark, d):
    return cb.api_summary(_facts(spark, d), _indicators(spark), _nodes(spark, d))


def cube_name_search(spark, d):
    return cb.name_search(_nodes(spark, d), "code", "name", "nation_1").select("code", "name")


def cube_facts_page(spark, d):
    return cb.facts_page(_facts(spark, d), indicator=COUNTS, year=1995, limit=50).select("fact_id", "geo_code", "breakdown_key", "value")


def cube_decoded(spark, d):
    dims = spark.createDataFrame([("priority", "CL_priority")], "dim_id string, codelist_id string")
    return cb.decode_breakdowns(dims, _entries(spark), _facts(spark, d))


def cube_dataset_stats(spark, d):
    return cb.dataset_stats(_facts(spark, d))


def cube_request_plan(spark, d):
    years = _table(spark, d, "orders").select(F.year("o_orderdate").alias("year"))
    dims = _table(spark, d, "part").select(F.lit("brand").alias("dim"), F.col("p_brand").alias("code")).distinct()
    return cb.request_plan(years, dims, most_codes=10).select(F.col("window").cast("bigint").alias("window"), "year_from", "year_to", "dim", F.col("batch").cast("bigint").alias("batch"), "codes")


def cube_levels(spark, d):
    """Territories of one level, and of chosen ones."""
    from corpuscube.plans.api import api_territories

    t = cb.hierarchy(_nodes(spark, d))
    one = api_territories(t, 2).withColumn("asked", F.lit("2"))
    return one.unionByName(cb.codes_of_levels(t, [0, 1]).withColumn("asked", F.lit("0,1"))).select("asked", "code", "level")


def cube_dashboard(spark, d):
    """Years, a text in the indicator's name, a region."""
    rows = cb.dashboard(_facts(spark, d), 1994, 1996, needle="ORDER V", region="ASIA")
    return rows.select("year", "geo_code", "breakdown_key", F.round("value", 2).alias("value"))


def cube_regions(spark, d):
    """P9"""
    return cb.regions(_facts(spark, d))


def cube_order(spark, d):
    """The first hundred totals in the table's order; those of the world, which have no level
    here, come last."""
    f = _facts(spark, d).withColumn("geo_level", F.when(F.length("geo_code") > 1, F.col("geo_level")))
    first = cb.ordered_facts(f.where((F.col("indicator_code") == COUNTS) & cb.is_total())).limit(100)
    return first.select("fact_id", "geo_level")


def cube_merged_lists(spark, d):
    """Entries of three indicators under one key: territories keep the first, codes the last."""
    n = _table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))
    parts = [n.where("code <> 'N1'"), n.withColumn("name", F.lower("name")), n.where("code < 'N2'").withColumn("name", F.lit("last"))]
    both = [cb.merged_dictionaries(parts, ["code"], keep=k).withColumn("keep", F.lit(k)) for k in ("first", "last")]
    return both[0].unionByName(both[1]).select("keep", "code", "name")


def cube_accumulated(spark, d):
    """Answers of two windows, and those that are errors apart."""
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 7 == 0, "try later").when(F.col("o_orderkey") % 7 == 1, "DATAFLOW only").otherwise(F.concat(F.lit("a,"), "o_orderpriority")).alias("body"))
    good, bad = cb.accumulate([o.where("seq % 2 = 0"), o.where("seq % 2 = 1")])
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False))).groupBy("window", "ok", "body").agg(F.count(F.lit(1)).alias("n"))


def cube_located(spark, d):
    """Nations, named as towns, at the places of a geocode table that has some of them."""
    n = _table(spark, d, "nation")
    t = n.select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.concat(F.element_at(F.array(*[F.lit(x) for x in ("г. ", "город ", "гп ", "")]), (F.col("n_nationkey") % 4 + 1).cast("int")), "n_name").alias("name"))
    places = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("place"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(1.5).alias("lon"))
    return cb.located(t, places).select("code", "lat", "lon")


def cube_nested(spark, d):
    """Regions and nations as a page's nested objects."""
    nations = _table(spark, d, "nation").orderBy("n_nationkey").collect()
    regions_ = _table(spark, d, "region").orderBy("r_regionkey").collect()
    tree = {"code": "W", "name": " The  World ", "children": [{"code": f"R{r['r_regionkey']}", "name": r["r_name"], "children": [{"code": f"N{n['n_nationkey']}", "name": n["n_name"]} for n in nations if n["n_regionkey"] == r["r_regionkey"]]} for r in regions_]}
    return cb.hierarchy(cb.nested_nodes(spark, tree)).select("code", "name", "level", "region_name")


def cube_structure(spark, d):
    """The dimensions of a structure message whose territories are the regions."""
    regions_ = [r["r_name"] for r in _table(spark, d, "region").collect()]
    urn = "urn:sdmx:org.sdmx.infomodel.codelist.Codelist=X:CL_{}(1.0)"
    message = {"data": {
        "codelists": [{"id": "CL_geo", "name": "Places", "codes": [{"id": n, "names": {"ru": f" {n}  x", "en": n}} for n in regions_]}, {"id": "CL_kind", "codes": [{"id": "a", "name": "A"}]}],
        "conceptSchemes": [{"concepts": [{"id": "geo", "names": {"en": "Territory"}}, {"id": "kind", "name": "Kind"}]}],
        "dataStructures": [{"dataStructureComponents": {"dimensionList": {"dimensions": [{"id": "kind", "position": 2, "localRepresentation": {"enumeration": urn.format("kind")}}, {"id": "geo", "position": 1, "localRepresentation": {"enumeration": urn.format("geo")}}, {"id": "unit_1", "position": 3}], "timeDimensions": [{"id": "TIME_PERIOD", "position": 4}]}}}],
    }}
    dims, entries = cb.parse_structure(spark, message)
    n = entries.groupBy("codelist_id").agg(F.count(F.lit(1)).alias("n"), F.max("name_ru").alias("last_name"))
    return dims.join(n, "codelist_id", "left").select("dim_id", "position", "name", "is_time", "is_geo", "is_unit", "n_codes", "n", "last_name")


def cube_plain_names(spark, d):
    """F54"""
    c = _table(spark, d, "customer")
    return c.select("c_custkey", vl.plain_name(F.concat(F.lit("  "), "c_name", F.lit(" \t\n x "))).alias("name"))


def cube_top_indicators(spark, d):
    """The indicators with the most facts."""
    return cb.top_indicators(cb.indicator_table(_indicators(spark), _facts(spark, d)), 1).select("indicator_code", "n_facts")


def cube_totals(spark, d):
    """P10: facts that are totals of all kinds."""
    return _facts(spark, d).groupBy(cb.is_total().alias("total")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = [cube_levels, cube_dashboard, cube_regions, cube_order, cube_merged_lists, cube_accumulated, cube_located, cube_nested, cube_structure, cube_plain_names, cube_top_indicators, cube_totals, cube_hierarchy, cube_facts, cube_fact_id_sha1, cube_dedupe_last, cube_rollup_levels, cube_coverage, cube_consistency, cube_top_units, cube_national_series, cube_growth_lag, cube_long_table, cube_wide_pivot, cube_coverage_matrix, cube_type_share, cube_region_totals, cube_parse_value, cube_territories, cube_indicators, cube_data_flag, cube_api_summary, cube_name_search, cube_facts_page, cube_decoded, cube_dataset_stats, cube_request_plan]

_NODES = "nodes AS (SELECT 'W' AS code, 'World' AS name, NULL::VARCHAR AS parent UNION ALL SELECT 'R' || r_regionkey, r_name, 'W' FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, c_name, 'N' || c_nationkey FROM customer)"
_LEVELS = """levels AS (
 SELECT code, name, parent, 0 AS level, NULL::VARCHAR AS region_code, NULL::VARCHAR AS region_name, NULL::VARCHAR AS district_code, NULL::VARCHAR AS district_name FROM nodes WHERE parent IS NULL
 UNION ALL SELECT n.code, n.name, n.parent, l.level + 1, CASE WHEN l.level = 0 THEN n.code ELSE l.region_code END, CASE WHEN l.level = 0 THEN n.name ELSE l.region_name END,
  CASE WHEN l.level = 1 THEN n.code ELSE l.district_code END, CASE WHEN l.level = 1 THEN n.name ELSE l.district_name END FROM nodes n JOIN levels l ON n.parent = l.code)"""
_LEVEL_NAMES = "CASE level " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in vl.LEVELS.items()) + f" ELSE '{vl.OTHER_LEVEL}' END"
_FACTS = f"""WITH RECURSIVE {_NODES}, {_LEVELS},
base AS (SELECT year(o_orderdate) AS year, n_regionkey, n_nationkey, o_orderpriority, sum(o_totalprice::DECIMAL(18,2)) AS amount, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
rolled AS (SELECT year::VARCHAR AS time_period, CASE WHEN grouping(n_regionkey) = 1 THEN 'W' WHEN grouping(n_nationkey) = 1 THEN 'R' || n_regionkey ELSE 'N' || n_nationkey END AS geo_code,
 CASE WHEN grouping(o_orderpriority) = 1 THEN '{cb.TOTAL}' ELSE o_orderpriority END AS priority, sum(amount) AS amount, sum(n) AS n FROM base
 GROUP BY GROUPING SETS ((year, n_regionkey, n_nationkey, o_orderpriority), (year, n_regionkey, n_nationkey), (year, n_regionkey, o_orderpriority), (year, n_regionkey), (year, o_orderpriority), (year))),
obs AS (SELECT '{ORDERS}' AS indicator_code, time_period, geo_code, priority, amount::DOUBLE AS value, amount::VARCHAR AS value_raw FROM rolled UNION ALL SELECT '{COUNTS}', time_period, geo_code, priority, n::DOUBLE, n::BIGINT::VARCHAR FROM rolled),
facts AS (SELECT substr(sha1(concat_ws('|', indicator_code, time_period, geo_code, 'priority=' || priority)), 1, 32) AS fact_id, indicator_code, CASE indicator_code WHEN '{ORDERS}' THEN 'Order value' ELSE 'Order count' END AS indicator_name_ru,
 time_period, time_period::INT AS year, geo_code, l.name AS geo_name_ru, l.level AS geo_level, {_LEVEL_NAMES} AS geo_level_name, region_code, region_name AS region_name_ru, district_code, district_name AS district_name_ru,
 'priority=' || priority AS breakdown_key, CASE priority WHEN '{cb.TOTAL}' THEN '{ALL}' ELSE priority END AS breakdown_value_ru, '206' AS unit_code, 'unit' AS unit_name_ru, value, value_raw, NULL::VARCHAR AS obs_attribute, 'all' AS source_window, '2025-01-01T00:00:00+00:00' AS retrieved_at
 FROM obs JOIN levels l ON l.code = obs.geo_code)"""
_SUM = f"SELECT * FROM facts WHERE indicator_code = '{ORDERS}' AND breakdown_key LIKE '%{cb.TOTAL}%'"
_TERRITORIES = f"territories AS (SELECT l.code AS geo_code, l.name, l.level, {_LEVEL_NAMES} AS level_name, l.parent, coalesce(n, 0) AS n_facts FROM levels l LEFT JOIN (SELECT geo_code, count(*) AS n FROM facts GROUP BY 1) f ON f.geo_code = l.code)"
SQL = {
    "cube_hierarchy": f"WITH RECURSIVE {_NODES}, {_LEVELS} SELECT * FROM levels",
    "cube_facts": f"{_FACTS} SELECT * REPLACE (round(value, 2) AS value) FROM facts",
    "cube_fact_id_sha1": f"{_FACTS} SELECT fact_id, concat_ws('|', indicator_code, time_period, geo_code, breakdown_key) AS natural_key FROM facts",
    "cube_dedupe_last": f"SELECT max(o_orderkey) AS seq, max_by(o_totalprice, o_orderkey) AS value, concat_ws('|', '{ORDERS}', year(o_orderdate), 'C' || o_custkey, 'priority=' || o_orderpriority) AS natural_key FROM orders GROUP BY natural_key",
    "cube_rollup_levels": f"{_FACTS} SELECT geo_level, count(*) AS n FROM facts GROUP BY 1",
    "cube_coverage": f"{_FACTS} SELECT indicator_code, indicator_name_ru, count(fact_id) AS n_facts, min(year) AS year_min, max(year) AS year_max, count(DISTINCT year) AS n_years, count(DISTINCT geo_code) AS n_geo, count(DISTINCT breakdown_key) AS n_breakdowns, count_if(value IS NULL)::BIGINT AS n_missing_values FROM facts GROUP BY ALL",
    "cube_consistency": f"{_FACTS}, t AS ({_SUM}), a AS (SELECT year, sum(value) AS country_value FROM t WHERE geo_level = 0 GROUP BY 1), b AS (SELECT year, sum(value) AS regions_sum FROM t WHERE geo_level = 1 GROUP BY 1) SELECT year, round(country_value, 2) AS country_value, round(regions_sum, 2) AS regions_sum, coalesce(abs((regions_sum - country_value) / nullif(country_value, 0)) <= 0.02, false) AS ok FROM a FULL JOIN b USING (year)",
    "cube_top_units": f"{_FACTS}, t AS ({_SUM} AND geo_level = 2) SELECT year, geo_code, geo_name_ru, region_name_ru, round(sum(value), 2) AS value FROM t WHERE year = (SELECT max(year) FROM t) GROUP BY ALL ORDER BY sum(value) DESC, geo_code LIMIT 15",
    "cube_national_series": f"{_FACTS} SELECT year, round(value, 2) AS value FROM ({_SUM}) WHERE geo_level = 0",
    "cube_growth_lag": f"{_FACTS} SELECT year, round(100.0 * (value - lag(value) OVER (ORDER BY year)) / lag(value) OVER (ORDER BY year), 2) AS pct FROM ({_SUM}) WHERE geo_level = 0",
    "cube_long_table": f"{_FACTS} SELECT year, time_period, geo_code, geo_name_ru, geo_level, region_code, region_name_ru, district_code, district_name_ru, breakdown_value_ru AS crime_type, breakdown_key, unit_name_ru, round(value, 2) AS value FROM facts WHERE indicator_code = '{ORDERS}'",
    "cube_wide_pivot": f"{_FACTS} SELECT year, geo_code, geo_name_ru, geo_level, region_name_ru, " + ", ".join(f"round(max(CASE WHEN breakdown_value_ru = '{p}' THEN value END), 2) AS p{i}" for i, p in enumerate([*PRIORITIES, ALL])) + f" FROM facts WHERE indicator_code = '{ORDERS}' AND region_name_ru IS NOT NULL GROUP BY ALL",
    "cube_coverage_matrix": f"{_FACTS} SELECT indicator_code, indicator_name_ru, " + ", ".join(f"count_if(year = {y})::BIGINT AS y{y}" for y in range(1992, 2002)) + " FROM facts GROUP BY ALL",
    "cube_type_share": f"{_FACTS}, t AS (SELECT year, breakdown_value_ru, sum(value) AS value FROM facts WHERE indicator_code = '{ORDERS}' AND geo_level = 0 GROUP BY ALL) SELECT a.year, a.breakdown_value_ru, round(a.value / b.value * 100, 2) AS share FROM t a JOIN t b ON b.year = a.year AND b.breakdown_value_ru = '{ALL}' WHERE a.breakdown_value_ru <> '{ALL}'",
    "cube_region_totals": f"{_FACTS} SELECT year, geo_name_ru, round(sum(value), 2) AS value FROM ({_SUM}) WHERE geo_level = 1 GROUP BY ALL",
    "cube_parse_value": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 IN (1, 3) THEN NULL ELSE l_extendedprice::DECIMAL(18,2)::DOUBLE END AS value, CASE l_linenumber % 5 WHEN 1 THEN 'н/д' WHEN 3 THEN 'нет' ELSE l_extendedprice::DECIMAL(18,2)::VARCHAR END AS raw FROM lineitem",
    "cube_territories": f"{_FACTS}, {_TERRITORIES} SELECT geo_code, name, level, parent, n_facts FROM territories",
    "cube_indicators": f"{_FACTS} SELECT indicator_code, any_value(indicator_name_ru) AS name_ru, 1992 AS year_min, CASE indicator_code WHEN '{ORDERS}' THEN 1998 ELSE 1992 END AS year_max, CASE indicator_code WHEN '{ORDERS}' THEN 2 ELSE 1 END AS n_years_available, '206' AS unit_codes, count(*) AS n_facts FROM facts GROUP BY indicator_code",
    "cube_data_flag": f"{_FACTS}, {_TERRITORIES} SELECT level_name, count(*) AS total, count_if(n_facts > 0)::BIGINT AS with_data FROM territories GROUP BY 1",
    "cube_api_summary": f"{_FACTS} SELECT count(*) AS total_observations, min(year) AS year_min, max(year) AS year_max, 2::BIGINT AS indicators_count, (SELECT count(*) FROM nodes) AS territories_count FROM facts",
    "cube_name_search": f"WITH {_NODES} SELECT code, name FROM nodes WHERE lower(name) LIKE '%nation_1%' OR lower(code) LIKE '%nation_1%' ORDER BY code LIMIT 10",
    "cube_facts_page": f"{_FACTS} SELECT fact_id, geo_code, breakdown_key, value FROM facts WHERE indicator_code = '{COUNTS}' AND year = 1995 ORDER BY indicator_code, geo_code, year, breakdown_key LIMIT 50",
    "cube_decoded": f"{_FACTS} SELECT DISTINCT breakdown_key, 'priority' AS dim_id, substr(breakdown_key, 10) AS code, breakdown_value_ru AS name_ru FROM facts",
    "cube_dataset_stats": f"{_FACTS} SELECT count(*) AS facts, count(DISTINCT indicator_code) AS indicators, count(DISTINCT geo_code) AS territories, count(DISTINCT year) AS years, count_if(value IS NULL)::BIGINT AS missing FROM facts",
    "cube_request_plan": "WITH y AS (SELECT year, (row_number() OVER (ORDER BY year) - 1) // 10 AS w FROM (SELECT DISTINCT year(o_orderdate) AS year FROM orders)), w AS (SELECT w::BIGINT AS \"window\", min(year)::INT AS year_from, max(year)::INT AS year_to FROM y GROUP BY w), b AS (SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1) // 10 AS batch FROM (SELECT DISTINCT p_brand FROM part)), c AS (SELECT 'brand' AS dim, batch::BIGINT AS batch, count(*) AS codes FROM b GROUP BY batch) SELECT * FROM w, c",
}
SQL |= {
    "cube_levels": f"WITH RECURSIVE {_NODES}, {_LEVELS} SELECT CASE level WHEN 2 THEN '2' ELSE '0,1' END AS asked, code, level FROM levels WHERE level <= 2",
    "cube_dashboard": f"{_FACTS} SELECT year, geo_code, breakdown_key, round(value, 2) AS value FROM facts WHERE year BETWEEN 1994 AND 1996 AND contains(lower(indicator_name_ru), 'order v') AND region_name_ru = 'ASIA'",
    "cube_regions": "SELECT DISTINCT r_name AS region_name_ru FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey",
    "cube_order": f"{_FACTS} SELECT fact_id, CASE WHEN length(geo_code) > 1 THEN geo_level END AS geo_level FROM facts WHERE indicator_code = '{COUNTS}' AND breakdown_key LIKE '%{cb.TOTAL}%' ORDER BY CASE WHEN length(geo_code) > 1 THEN geo_level END NULLS LAST, geo_code, breakdown_key, time_period LIMIT 100",
    "cube_merged_lists": "WITH n AS (SELECT 'N' || n_nationkey AS code, n_name AS name FROM nation) SELECT 'first' AS keep, code, CASE code WHEN 'N1' THEN lower(name) ELSE name END AS name FROM n UNION ALL SELECT 'last', code, CASE WHEN code < 'N2' THEN 'last' ELSE lower(name) END FROM n",
    "cube_accumulated": "SELECT (o_orderkey % 2)::INT AS \"window\", o_orderkey % 7 > 0 AS ok, CASE o_orderkey % 7 WHEN 0 THEN 'try later' WHEN 1 THEN 'DATAFLOW only' ELSE 'a,' || o_orderpriority END AS body, count(*) AS n FROM orders GROUP BY ALL",
    "cube_located": "SELECT 'N' || n_nationkey AS code, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey::DOUBLE END AS lat, CASE WHEN n_nationkey % 3 = 0 THEN 1.5::DOUBLE END AS lon FROM nation",
    "cube_nested": f"WITH RECURSIVE {_NODES}, {_LEVELS} SELECT code, CASE code WHEN 'W' THEN 'The World' ELSE name END AS name, level, region_name FROM levels WHERE level <= 2",
    "cube_structure": "SELECT * FROM (VALUES ('geo', 1, '', false, true, false), ('kind', 2, 'Kind', false, false, false), ('unit_1', 3, '', false, false, true), ('TIME_PERIOD', 4, '', true, false, false)) t(dim_id, position, name, is_time, is_geo, is_unit) LEFT JOIN (SELECT 'geo' AS d, count(*) AS n, max(r_name) || ' x' AS last_name FROM region UNION ALL SELECT 'kind', 1, 'A') ON d = dim_id JOIN (SELECT unnest(['geo', 'kind', 'unit_1', 'TIME_PERIOD']) AS e, unnest([(SELECT count(*)::INT FROM region), 1, 0, 0]) AS n_codes) ON e = dim_id",
    "cube_plain_names": "SELECT c_custkey, c_name || ' x' AS name FROM customer",
    "cube_top_indicators": f"{_FACTS} SELECT indicator_code, count(*) AS n_facts FROM facts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "cube_totals": f"{_FACTS} SELECT breakdown_key LIKE '%{cb.TOTAL}%' AS total, count(*) AS n FROM facts GROUP BY 1",
}
SQL["cube_structure"] = SQL["cube_structure"].replace("SELECT * FROM", "SELECT dim_id, position, name, is_time, is_geo, is_unit, n_codes, n, last_name FROM", 1)
