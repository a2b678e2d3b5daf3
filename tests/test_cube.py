"""The cube on a small structure with hand-checked results."""

import pytest
from pyspark.sql import functions as F

from corpuscube.functions import values as vl
from corpuscube.operators import cube as cb
from corpuscube.plans import api

IND = "10108000001"
NODES = [("699961", "Republic", None), ("919067", "Brest region", "699961"), ("919075", "Brest district", "919067"), ("984146", "Village", "919075"), ("919071", "Minsk", "699961")]


@pytest.fixture(scope="module")
def geo(spark):
    return cb.hierarchy(spark.createDataFrame(NODES, "code string, name string, parent string")).cache()


def test_hierarchy(geo, spark):
    rows = {r["code"]: r for r in geo.collect()}
    assert {k: r["level"] for k, r in rows.items()} == {"699961": 0, "919067": 1, "919075": 2, "984146": 3, "919071": 1}
    assert (rows["984146"]["region_code"], rows["984146"]["district_code"], rows["699961"]["region_code"]) == ("919067", "919075", None)
    assert {r["code"] for r in cb.codes_of_levels(geo, [0, 1]).collect()} == {"699961", "919067", "919071"}
    loop = cb.hierarchy(spark.createDataFrame([("a", "a", "b"), ("b", "b", "a"), ("c", "c", "zz")], "code string, name string, parent string"))
    assert {r["code"]: r["level"] for r in loop.collect()} == {"a": 32, "b": 32, "c": 0}


def test_parse_value(spark):
    raws = ["85 374.0", "1 234,5", "-", "…", "", None, "около 12,5 тыс", "нет"]
    got = [(r["v"]["value"], r["v"]["raw"]) for r in spark.createDataFrame([(x,) for x in raws], "x string").select(vl.parse_value(F.col("x")).alias("v")).collect()]
    assert got == [(85374.0, "85374.0"), (1234.5, "1234.5"), (None, "-"), (None, "…"), (None, ""), (None, ""), (12.5, "12.5"), (None, "нет")]


def rows(spark):
    data = [("D", "919067", "517667", "206", "2023", "10", ""), ("D", "699961", "517667", "206", "2023", "85 374.0", ""), ("D", "919071", "", "206", "2023", "-", "a"), ("D", "919075", "517692", "206", "2023-Q1", "7", "")]
    return spark.createDataFrame(data, "DATAFLOW string, razrez string, priznak_460 string, unit_1 string, TIME_PERIOD string, OBS_VALUE string, OBS_ATTRIBUTE string")


def facts(spark):
    return cb.with_ids(cb.rows_to_facts(rows(spark), IND, ["razrez", "priznak_460", "unit_1"], "razrez", "unit_1"))


def test_facts(spark):
    got = {r["natural_key"]: r for r in facts(spark).collect()}
    assert len(got) == 4
    total = got[f"{IND}|2023|699961|priznak_460=517667"]
    assert total["value"] == 85374.0 and total["unit_code"] == "206" and len(total["fact_id"]) == 32
    assert got[f"{IND}|2023|919071|"]["value"] is None and got[f"{IND}|2023|919071|"]["value_raw"] == "-"


def test_dedupe_keeps_the_last(spark):
    three = facts(spark).withColumn("seq", F.lit(0)).unionByName(facts(spark).withColumn("seq", F.lit(2)).withColumn("value", F.lit(5.0))).unionByName(facts(spark).withColumn("seq", F.lit(1)))
    got = cb.dedupe_last(three)
    assert got.count() == 4 and {r["value"] for r in got.collect()} == {5.0}


def test_fact_table(spark, geo):
    indicators = spark.createDataFrame([(IND, "Crimes")], "indicator_code string, name_ru string")
    units = spark.createDataFrame([("206", "second", 1), ("206", "first", 0)], "unit_code string, unit_name_ru string, seq int")
    entries = spark.createDataFrame([("CL_priznak_460", "Kinds", "517667", "All")], "codelist_id string, codelist_name string, code string, name_ru string")
    raw = facts(spark).drop("natural_key", "fact_id")
    labels = cb.breakdown_labels(raw, entries)
    assert {r["breakdown_key"]: r["breakdown_full_ru"] for r in labels.collect()}["priznak_460=517667"] == "Kinds: All"
    table = cb.fact_table(raw, indicators, geo, units, labels, "now")
    assert table.columns == cb.FACT_COLUMNS
    got = {r["geo_code"]: r for r in table.collect()}
    r = got["919067"]
    assert (r["geo_level"], r["region_name_ru"], r["unit_name_ru"], r["breakdown_value_ru"], r["year"]) == (1, "Brest region", "first", "All", 2023)
    assert got["919075"]["breakdown_value_ru"] == "517692" and got["919071"]["breakdown_key"] is None and got["919067"]["obs_attribute"] is None


def small(spark, rows):
    return spark.createDataFrame(rows, "indicator_code string, indicator_name_ru string, fact_id string, year int, geo_code string, geo_name_ru string, geo_level int, region_name_ru string, breakdown_key string, breakdown_value_ru string, value double")


def fact(year, geo, level, value, key="p=517667", kind="All", region="R"):
    return (IND, "Crimes", f"{year}{geo}{key}", year, geo, geo, level, region, key, kind, value)


def test_consistency(spark):
    f = small(spark, [fact(2020, "W", 0, 100.0), fact(2020, "A", 1, 60.0), fact(2020, "B", 1, 39.0), fact(2021, "W", 0, 100.0), fact(2022, "A", 1, None), fact(2022, "W", 0, 0.0)])
    got = {r["year"]: r for r in cb.consistency(f, IND).collect()}
    assert got[2020]["ok"] and not got[2021]["ok"] and got[2021]["regions_sum"] is None
    assert got[2022]["regions_sum"] == 0 and got[2022]["diff_pct"] is None and not got[2022]["ok"]


def test_top_and_ties(spark):
    f = small(spark, [fact(2020, "x", 2, 9.0), fact(2021, "b", 2, 5.0), fact(2021, "a", 2, 5.0), fact(2021, "c", 2, 7.0), fact(2021, "c", 2, 50.0, key="p=1")])
    assert [(r["geo_code"], r["value"]) for r in cb.top_territories(f, IND, n=2).collect()] == [("c", 7.0), ("a", 5.0)]
    assert cb.top_territories(f, IND, year=2020).first()["geo_code"] == "x"


def test_wide_drops_null_keys(spark):
    f = small(spark, [fact(2020, "W", 0, 1.0, region=None), fact(2020, "A", 1, 2.0), fact(2020, "A", 1, None, kind="Theft")])
    got = cb.wide_table(cb.long_table(f, IND), ["All", "Theft"]).collect()
    assert len(got) == 1 and got[0]["All"] == 2.0 and got[0]["Theft"] is None


def test_growth(spark):
    s = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 15.0)], "year int, value double")
    assert [r["pct"] for r in cb.growth(s).orderBy("year").collect()] == [None, None, 50.0]


def test_plans():
    assert [len(w) for w in vl.year_windows(range(1990, 2026))] == [10, 10, 10, 6]
    assert vl.batches(["a", "b"], 5) == [None] and vl.batches(["a", "b", "c"], 2) == [["a", "b"], ["c"]]
    assert api.parse_years("2000-2005") == (2000, 2005) and api.parse_years("2000-") == (2000, None) and api.parse_years("-5") == (None, 5) and api.parse_years("7") == (7, 7)
    assert api.select_years(["2001", "x", 2000, 2001], 2000) == [2000, 2001]


def test_name_search_folds_ascii_only(spark):
    t = spark.createDataFrame([("1", "Брест Alpha"), ("2", "брест beta"), ("3", "x")], "code string, name string")
    assert [r["code"] for r in cb.name_search(t, "code", "name", "ALPHA").collect()] == ["1"]
    assert [r["code"] for r in cb.name_search(t, "code", "name", "брест").collect()] == ["2"]


def test_structure(spark):
    names = lambda s: {"names": {"ru": s}}
    message = {"data": {
        "codelists": [{"id": "CL_geo", **names("Geo  list"), "codes": [{"id": "699961", **names("Root")}, {"id": "1", **names("One"), "parent": "699961"}]}, {"id": "CL_unit_1", **names("Units"), "codes": [{"id": "206", **names("unit")}]}],
        "conceptSchemes": [{"concepts": [{"id": "geo", **names("Территория")}, {"id": "unit_1", **names("Unit")}]}],
        "dataStructures": [{"dataStructureComponents": {"dimensionList": {"dimensions": [
            {"id": "unit_1", "position": 2, "localRepresentation": {"enumeration": "urn:x.Codelist=A:CL_unit_1(1.0)"}}, {"id": "geo", "position": 1, "localRepresentation": {"enumeration": "urn:x.Codelist=A:CL_geo(1.0)"}}],
            "timeDimensions": [{"id": "TIME_PERIOD", "position": 3}]}}}]}}
    dims, entries = cb.parse_structure(spark, message)
    got = [(r["dim_id"], r["is_geo"], r["is_unit"], r["is_time"], r["n_codes"]) for r in dims.collect()]
    assert got == [("geo", True, False, False, 2), ("unit_1", False, True, False, 1), ("TIME_PERIOD", False, False, True, 0)]
    assert entries.count() == 3 and entries.first()["codelist_name"] == "Geo list"
    f = api.values_filter(dims, [2020, 2021], ["1"], {"unit_1": []})
    assert f == {"geo": ["1"], "unit_1": [], "TIME_PERIOD": ["2020", "2021"]}


def test_nested_tree(spark):
    tree = {"code": "1", "name": "Root", "children": [{"code": 2, "name": "A  b", "children": [{"code": "3"}]}, {"code": "4", "name": "C"}]}
    got = {r["code"]: (r["name"], r["level"]) for r in cb.hierarchy(cb.nested_nodes(spark, tree)).collect()}
    assert got == {"1": ("Root", 0), "2": ("A b", 1), "3": ("", 2), "4": ("C", 1)}
