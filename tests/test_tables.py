"""Readers and sinks on files, names, years, hazards, freedom, energy."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from placewise import dims
from placewise.functions.grid import Grid
from placewise.operators import aggregate, climate, hazard, names, years
from placewise.plans import describe, energy, freedom, gdp
from placewise.sources import readers, sinks
from placewise.sources.records import json_records
from placewise.sources.store import LayerStore


def write(folder, name, text):
    path = Path(folder) / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_plants_csv(spark, tmp_path, rows):
    path = write(tmp_path, "plants.csv", "capacity_mw,name,country_long,primary_fuel,latitude,longitude\n10.5,a,Chile,Coal,-3.5,70\nx,b,Chile,Coal,1,2\n5,c,Peru,Gas,,2\n7,d,Peru,Gas,1,2\n")
    assert rows(readers.read_plants(spark, path), "country", "fuel", "lat", "lon", "capacity") == [("Chile", "Coal", -3.5, 70.0, 10.5), ("Peru", "Gas", 1.0, 2.0, 7.0)]
    first = aggregate.fuel_breakdown(readers.read_plants(spark, path)).orderBy("first").collect()
    assert [(r.country, r.fuel, r.capacity) for r in first] == [("Chile", "Coal", 10.5), ("Peru", "Gas", 7.0)]


def test_volcano_and_runup_files(spark, tmp_path, rows):
    volcanoes = write(tmp_path, "v.csv", "Latitude,Longitude,Last_Eruption_Year\n1,2,1950.0\n3,4,\n5,x,1900\n6,7,unknown\n")
    assert rows(readers.read_volcanoes(spark, volcanoes), "lat", "last_year") == [(1.0, 1950), (3.0, 0), (6.0, 0)]
    runup = write(tmp_path, "r.txt", "POINT_X;POINT_Y;ari500\n190;10;2.5\n-170;11;x\n")
    assert rows(readers.read_runup(spark, runup), "lon", "lat", "runup") == [(-170.0, 10.0, 2.5)]


def test_last_line_wins(spark, tmp_path, rows):
    deaths = write(tmp_path, "d.csv", "Entity,Code,Year,Earthquakes,Floods\nA,AAA,1990,5,1\nA,AAA,1990,,bad\nA,AAA,2000,7,2\nWorld,,2000,9,9\n")
    got = {(r["column"], r.year): r.deaths for r in readers.read_deaths(spark, deaths).collect()}
    assert got["Earthquakes", 1990] == 0.0 and got["Earthquakes", 2000] == 7.0 and got["Floods", 1990] == 0.0 and got["Storms", 2000] == 0.0
    people = write(tmp_path, "p.csv", "year,code,population_historical\n2020,AAA,5000\n2019,AAA,1\n2020,OWID_WRL,9\n2020,,9\n")
    assert rows(readers.read_population(spark, people)) == [("AAA", 5000.0)]
    rates = hazard.mortality_rates(readers.read_deaths(spark, deaths), readers.read_population(spark, people))
    assert {r.hazard: r.rate for r in rates.collect()} == pytest.approx({"earthquake": 7 / 50 / 5000 * 1e6, "flood": 2 / 50 / 5000 * 1e6})


def test_latest_index_record(spark, tmp_path):
    path = write(tmp_path, "s.csv", "level,GDLCODE,country,region,year,shdi,healthindex\nSubnat,R1,C,first,2010,.5,.\nSubnat,R1,C,later,2015,.6,.7\nSubnat,R1,C,same year,2015,.9,.1\nNational,R1,C,n,2020,.9,.9\nSubnat,R2,C,none,2020,.,.4\n")
    out = aggregate.latest_per_key(readers.read_shdi(spark, path), "code", "year", "line_no", "region", "shdi", "health").collect()
    assert [tuple(r) for r in out] == [("R1", 2015, "later", 0.6, 0.7)]


def test_indicator_json_and_xml(spark, tmp_path, rows):
    entries = [
        {"countryiso3code": "AAA", "country": {"value": "Aland"}, "date": "2000", "value": 1.5}, {"countryiso3code": "AAA", "country": {"value": "Aland"}, "date": "2001", "value": None},
        {"countryiso3code": "EU", "country": {"value": "Union"}, "date": "2000", "value": 9}, {"countryiso3code": "AAA", "country": {"value": "Aland"}, "date": "1999", "value": 2},
    ]
    path = write(tmp_path, "i.json", json.dumps([{"page": 1}, entries]))
    assert rows(readers.read_indicator(spark, path)) == [("AAA", 1999, 2.0), ("AAA", 2000, 1.5)]
    assert rows(readers.read_indicator_latest(spark, path)) == [("Aland", 2.0)]
    broken = write(tmp_path, "b.json", json.dumps({"message": "no data"}))
    assert rows(readers.read_indicator(spark, broken)) == []
    xml = write(tmp_path, "i.xml", '<?xml version="1.0"?>\n<wb:root xmlns:wb="http://example.org">\n<wb:data><wb:country id="A">Aland</wb:country><wb:value>3.5</wb:value></wb:data>\n<wb:data><wb:country id="B">Bland</wb:country><wb:value></wb:value></wb:data>\n</wb:root>')
    assert rows(readers.read_indicator_xml(spark, xml)) == [("Aland", 3.5)]


def test_freedom_sheets(spark, tmp_path, rows):
    path = write(tmp_path, "f.csv", "Survey Edition,Jan.-Feb. 1973,,,2022,,\n,PR,CL,Status,PR,CL,Status\nAland,1,1,F,7,7,NF\nBland,-,-,,2,3,F\n")
    assert rows(readers.read_fiw_wide(spark, path), "country", "year", "fiw") == [("Aland", 1972, 100.0), ("Aland", 2021, 0.0), ("Bland", 2021, 75.0)]
    cats = write(tmp_path, "c.csv", "Country/Territory,Edition,A,B,C,D,E,F,G,Total\nAland,2024,12,8,x,16,3,4,5,77\n")
    row = readers.read_fiw_cats(spark, cats).first()
    assert (row.year, row.cat_A, row.cat_B, row.cat_C, row.total) == (2023, 100.0, 50.0, None, 77.0)


def test_edition_label_with_a_comma(spark, tmp_path):
    path = write(tmp_path, "wide.csv", 'Survey edition,1972,,,"1973, 1974-1975",,,2022\nYear,PR,CL,S,PR,CL,S,PR,CL\nAland,1,1,F,7,7,NF,1,7\n')
    columns = readers.fiw_editions(dict(zip("abcdefgh", ["Survey edition", "1972", "", "", "1973, 1974-1975", "", "", "2022"])))
    assert sorted(columns) == [1971, 1974]
    assert ("Aland", 1974, 0.0) in rows_of(readers.read_fiw_wide(spark, path))


def rows_of(df):
    return [(r.country, r.year, r.fiw) for r in df.collect()]


def test_geojson_files_keep_apart(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [0, 1], [1, 1], [0, 0]]]}
    doc = json.dumps({"features": [{"properties": {"NAME": "x"}, "geometry": square}]})
    for name in ("a.geojson", "b.geojson"):
        (tmp_path / name).write_text(doc)
    assert len({r.ord for r in readers.read_zones(spark, str(tmp_path), ["NAME"]).collect()}) == 2


def test_fingerprint_knows_where_a_value_is_missing(spark):
    one, two = (sinks.layer_fingerprint(spark.createDataFrame([r], "a int, b int, c int"), ["a", "b", "c"]).first().version for r in [(1, None, 3), (1, 3, None)])
    assert one != two


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"NAME": "A", "x": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]}},
        {"type": "Feature", "properties": {"NAME": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},
        {"type": "Feature", "properties": {"NAME": "C"}, "geometry": None},
    ]}
    path = write(tmp_path, "z.geojson", json.dumps(doc))
    got = readers.read_zones(spark, path, ["NAME"]).collect()
    assert [(r.ord, r.NAME, len(r.rings), r.rings[0][1].x) for r in got] == [(0, "A", 2, 4.0), (1, "B", 2, 1.0)]


def test_records_of_one_file_read_by_many_tasks(spark, tmp_path):
    """Braces, quotes and escapes in strings, objects outside the list, nested ones, borders of splits anywhere."""
    nasty = ['plain', '{', '}}', '"', '\\', '\\"{', 'a "b": [{', ']', "line\nbreak", "Å{é", ""]
    features = [{"type": "Feature", "properties": {"NAME": f"{nasty[i % len(nasty)]}{i}", "more": {"deep": [{"x": [{}]}]}}, "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i + 1, 2], [i, 0]]]}} for i in range(400)]
    folder = tmp_path / "zones"
    folder.mkdir()
    for name, indent in (("b.geojson", 1), ("a.geojson", None)):
        write(folder, name, json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": features, "after": {"a": {"b": [{"c": {}}]}}}, indent=indent, ensure_ascii=indent is None))
    write(folder, "c.geojson", json.dumps({"message": "nothing"}))
    write(folder, "d.geojson", json.dumps({"features": []}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert spark.read.option("lineSep", "{").text(str(folder)).rdd.getNumPartitions() > 20
        found = readers.read_zones(spark, str(folder), ["NAME"]).orderBy("ord").collect()
        records = json_records(spark, str(folder), 1, 1).orderBy("file_no", "pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    names = [f["properties"]["NAME"] for f in features]
    assert [r.NAME for r in found] == names * 2
    assert [r.ord for r in found] == [*range(400), *((1 << 32) + i for i in range(400))]
    assert all(r.rings[0][0].x == r.ord % (1 << 32) for r in found)
    assert [json.JSONDecoder().raw_decode(r.doc)[0] for r in records] == features * 2


def test_speed_tests_need_wkt(spark):
    with pytest.raises(ValueError):
        readers.clean_speedtests(spark.createDataFrame([("0123", 5)], "quadkey string, avg_d_kbps bigint"))


LAYER = "axis string, scenario string, year int, row int, col int, byte int"


def layer_rows(spark, years, more=0):
    rows = [("temp", None if y == 2002 else "historical", y, r, 0, r + y % 7 + more) for y in years for r in range(5)]
    return spark.createDataFrame(rows, LAYER)


def test_layer_store_is_write_once(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path / "layers"))
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.write(layer_rows(spark, [2000])) == 1
    assert store.write(layer_rows(spark, [2000, 2001, 2002], 100)) == 2
    assert store.write(layer_rows(spark, [2000, 2001, 2002], 200)) == 0
    cells = store.read().collect()
    assert len(cells) == 15 and {r.year: r.byte >= 100 for r in cells} == {2000: False, 2001: True, 2002: True}
    assert {r.year: r.scenario for r in cells} == {2000: "historical", 2001: "historical", 2002: None}
    plan = store.read().where("year = 2000")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters: [(year" in plan
    assert store.write(spark.createDataFrame([], LAYER)) == 0
    with pytest.raises(ValueError):
        store.write(layer_rows(spark, [2005]).drop("byte"))


def test_layer_store_after_a_write_that_ended_half_way(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path / "layers"))
    store._stage(layer_rows(spark, [2000, 2001], 50), "lost")
    assert store.stored().isEmpty()
    assert store.write(layer_rows(spark, [2000])) == 1
    store._stage(layer_rows(spark, [2001], 70), "lost-too")
    assert sorted((r.year, r.byte) for r in store.read().collect()) == [(2000, 5 + r) for r in range(5)]
    assert store.sweep() == 3 and store.sweep() == 0
    assert store.write(layer_rows(spark, [2001])) == 1
    assert store.read().count() == 10


def test_of_two_writers_one_looks_again(spark, tmp_path, monkeypatch):
    one, two = (LayerStore(spark, str(tmp_path / "layers")) for _ in range(2))
    one.write(layer_rows(spark, [1999]))
    stage, first = one._stage, []

    def late(layer, commit):
        stage(layer, commit)
        if not first:
            first.append(two.write(layer_rows(spark, [2000, 2001], 100)))

    monkeypatch.setattr(one, "_stage", late)
    assert one.write(layer_rows(spark, [2001, 2002])) == 1 and first == [2]
    assert {r.year: r.byte >= 100 for r in one.read().collect()} == {1999: False, 2000: True, 2001: True, 2002: False}
    assert one.read().count() == 20


def test_lookup_sink(spark, tmp_path):
    df = spark.createDataFrame([(2000, "B", 2.5), (2000, "A", 3.5), (2001, "A", None)], "year int, name string, value double")
    sinks.write_lookup(df, str(tmp_path / "out"), "year", "name", "value")
    lines = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [(k, json.loads(v)) for k, v in lines] == [("2000", {"A": 4.0, "B": 2.0})]


def test_catalog(spark):
    paths = ["temp/temp_2001.pmtiles", "temp/temp_2000.pmtiles", "e_oil/e_oil.pmtiles", "agrip/agrip_1995.pmtiles", "agrip/agrip_ssp585_2055.pmtiles", "agrip/agrip_ssp585_2025.pmtiles"]
    got = {r.axis: r for r in sinks.build_catalog(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert (got["temp"].static, got["temp"].years) == (False, [2000, 2001])
    assert (got["e_oil"].static, got["e_oil"].file) == (True, "e_oil.pmtiles")
    assert (got["agrip"].years, got["agrip"].projections) == ([1995], {"ssp585": [2025, 2055]})


def test_fingerprint_ignores_row_order(spark):
    a = spark.createDataFrame([(i, i * 2) for i in range(50)], "row int, byte int")
    version = lambda df: sinks.layer_fingerprint(df, ["row", "byte"]).first().version
    assert version(a) == version(a.repartition(3).orderBy(F.desc("row"))) != version(a.withColumn("byte", F.when(F.col("row") == 7, 1).otherwise(F.col("byte"))))


# --- names and years ------------------------------------------------------------------------------


def test_whole_word_matches_in_key_order(spark, rows):
    polygons = spark.createDataFrame([("Somalia",), ("Guinea-Bissau",), ("NIGER",), ("Nigeria",), ("NATION_10",), ("Rep. of Mali (north)",)], "name string")
    keys = spark.createDataFrame([("Mali", 0), ("Guinea", 1), ("Guinea-Bissau", 2), ("Niger", 3), ("NATION_1", 4)], "key string, ordinal int")
    assert rows(names.harmonise(polygons, keys)) == [("Guinea-Bissau", "Guinea"), ("NIGER", "Niger"), ("Rep. of Mali (north)", "Mali")]
    assert ("Guinea-Bissau", "Guinea-Bissau") in rows(names.harmonise(polygons, keys, prefer_exact=True))


def test_later_spelling_groups_replace_earlier_ones(spark, rows):
    groups = dims.name_group_dim(spark)
    polygons = spark.createDataFrame([("Eswatini",), ("Ivory Coast",), ("United States of America",), ("Nowhere",)], "name string")
    keys = spark.createDataFrame([("Swaziland",), ("Côte d'Ivoire",), ("USA",), ("US",)], "key string")
    assert rows(names.apply_aliases(polygons, keys, groups)) == [("Eswatini", "Swaziland"), ("Ivory Coast", "Côte d'Ivoire"), ("United States of America", "US")]


def test_nearest_year_ties_go_to_the_first(spark):
    pick = lambda ys, y: spark.range(1).select(years.nearest_year(F.array(*[F.lit(v) for v in ys]), F.lit(y))).first()[0]
    assert pick([2000, 2010], 2005) == 2000 and pick([2010, 2000], 2005) == 2010 and pick([1995], 2050) == 1995


def test_resolve_layer(spark):
    catalog = spark.createDataFrame(
        [("elev", True, None, None, "elev.ab12.pmtiles"), ("temp", False, [2000, 2010], None, None), ("agrip", False, [1995], {"ssp585": [2025, 2055]}, None)],
        "axis string, static boolean, years array<int>, projections map<string,array<int>>, file string",
    )
    asked = [("elev", 1990, "historical"), ("temp", 2005, "historical"), ("temp", 2011, "historical"), ("agrip", 2030, "ssp585"), ("agrip", 2030, "historical"), ("none", 2000, "historical"), ("temp", None, "historical")]
    requests = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i int, axis string, year int, scenario string")
    got = {r.i: r.layer for r in years.resolve_layer(requests, catalog).collect()}
    assert got == {0: "elev/elev.ab12.pmtiles", 1: "temp/temp_2000.pmtiles", 2: None, 3: "agrip/agrip_ssp585_2025.pmtiles", 4: "agrip/agrip_1995.pmtiles", 5: None, 6: None}


# --- climate and hazards ---------------------------------------------------------------------------


def test_months_without_data(spark):
    cube = spark.createDataFrame([(0, 0, 2000, m, -327.68, -327.68, -32768.0) for m in range(1, 13)] + [(0, 1, 2000, 1, 2.0, 6.0, 10.0), (0, 1, 2000, 2, -327.68, 5.0, -32768.0)],
                                 "row int, col int, year int, month int, tmin double, tmax double, ppt double")
    by_col = lambda df: {r.col: r.value for r in df.collect()}
    assert by_col(climate.annual_mean(cube)) == {0: None, 1: 4.0}
    assert by_col(climate.annual_std(cube)) == {0: None, 1: 0.0}
    assert by_col(climate.annual_sum(cube)) == {0: 0.0, 1: 10.0}


def test_events_in_the_last_steps(spark):
    index = spark.createDataFrame([(0, 0, t, -2.0 if t % 2 else 0.0) for t in range(10)] + [(0, 1, 9, -2.0), (0, 1, 1, -2.0)], "row int, col int, t int, value double")
    got = {r.col: r.value for r in climate.event_frequency(index, last=4).collect()}
    assert got == {0: 0.5, 1: 0.25}


def test_calibration_cases(spark):
    zones = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 2), (1, 1, 2), (2, 0, 3)], "row int, col int, zone int")
    intensity = spark.createDataFrame([("flood", 0, 0, 4.0), ("flood", 0, 1, 0.0), ("flood", 2, 0, 2.0), ("flood", 9, 9, 3.0)], "hazard string, row int, col int, intensity double")
    rates = spark.createDataFrame([("flood", 1, 10.0), ("flood", 2, 6.0)], "hazard string, zone int, rate double")
    got = {(r.row, r.col): r.rate for r in hazard.calibrate(intensity, zones, rates).collect()}
    world, mean = (10.0 * 2 + 6.0 * 2) / 4, (4.0 + 2.0 + 3.0) / 3
    physical = lambda i: world * i / mean
    # zone 1 has a history, zone 2 a rate but no intensity, zone 3 no rate; (9, 9) lies in no zone
    assert got == pytest.approx({(0, 0): 0.5 * 20 + 0.5 * physical(4), (0, 1): 0.0, (1, 0): 3.0, (1, 1): 3.0, (2, 0): 0.5 * physical(2)})


def test_budget_is_spent_exactly(spark):
    df = spark.createDataFrame([(0, c, float(c)) for c in range(5)], "row int, col int, intensity double")
    total = hazard.distribute(df).agg(F.sum("rate")).first()[0]
    assert total == pytest.approx(dims.TSUNAMI_DEATHS_PER_YEAR / dims.PEOPLE_PER_CELL * 1e6)


def test_states_reconcile_with_their_country(spark):
    cells = [(r, c) for r in range(2) for c in range(3)]
    gdp_cells = spark.createDataFrame([(2000, r, c, 100.0 * (r + 1) + c) for r, c in cells], "year int, row int, col int, value double")
    pop = spark.createDataFrame([(2000, r, c, 1.0 + r * 3 + c) for r, c in cells], "year int, row int, col int, weight double")
    adm1_cells = spark.createDataFrame([(r, c, r) for r, c in cells], "row int, col int, zone int")
    adm0_cells = spark.createDataFrame([(r, c, 0) for r, c in cells], "row int, col int, zone int")
    adm1 = spark.createDataFrame([(0, "S0", "AAA", ""), (1, "S1", "", "Aland")], "ord int, name string, iso3 string, admin string")
    adm0 = spark.createDataFrame([(0, "Aland", "AAA")], "ord int, name string, iso3 string")
    indicator = spark.createDataFrame([("AAA", 2000, 5000.0)], "iso3 string, year int, value double")
    labels = spark.createDataFrame([("AAA", "Aland")], "iso3 string, name string")
    countries, states = gdp.gdp_tiers(gdp_cells, pop, adm1_cells, adm0_cells, adm1, adm0, indicator, labels)
    found = states.collect()
    assert len(found) == 2 and countries.first().anchor == 5000.0
    assert sum(r.value * r.weight for r in found) / sum(r.weight for r in found) == pytest.approx(5000.0)


def test_zone_without_cells(spark):
    none = spark.createDataFrame([(0, 0, None)], "row int, col int, value double")
    weights = spark.createDataFrame([(0, 0, 2.0)], "row int, col int, weight double")
    cell_zone = spark.createDataFrame([(0, 0, 1)], "row int, col int, zone int")
    out = aggregate.zonal_wmean(none, weights, cell_zone, spark.createDataFrame([(1,)], "zone int")).first()
    assert (out["mean"], out["weight"]) == (None, 0.0)


# --- countries -----------------------------------------------------------------------------------------


def test_freedom_composite(spark, rows):
    fiw = spark.createDataFrame([(2001, "A", 80.0), (2001, "B", 40.0), (1990, "A", 1.0)], "year int, country string, fiw double")
    cpi = spark.createDataFrame([(2001, "A", 61.0), (2001, "C", 30.0)], "year int, country string, score double")
    cats = spark.createDataFrame([(2001, "D", *[50.0] * 7)], "year int, country string, " + ", ".join(f"cat_{k} double" for k in "ABCDEFG"))
    assert rows(freedom.freedom_scores(fiw, cpi, cats), "country", "composite", "cat_A") == [("A", 70.5, None), ("B", 40.0, None), ("C", 30.0, None), ("D", None, 50.0)]


def test_balance_scores(spark):
    df = spark.createDataFrame([(0, -500.0), (1, 0.0), (2, 500.0), (3, 100.0)], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(energy.balance_score(F.col("v"))).collect()] == [100.0, 50.0, 0.0, 25.0]


def test_energy_without_capacity_has_no_boost(spark):
    plants = spark.createDataFrame([(0.0, 0.0, 0.0)], "lon double, lat double, capacity double")
    zone = spark.createDataFrame([(9, 18, 1)], "row int, col int, zone int")
    balance = spark.createDataFrame([(1, 55.0)], "zone int, score double")
    assert energy.energy_balance(plants, balance, zone, Grid.world(10.0)).first()["value"] == 55.0


def test_gdp_text(spark):
    df = spark.createDataFrame([("State", "Ohio", "USA", 2020, 12345.6), ("Country", "x", "USA", 2020, 70000.0), (None, "x", "USA", 2020, None)], "tier string, state string, country string, year int, gdp double").withColumn("district", F.lit("d"))
    assert [r[0] for r in df.select(describe.gdp_text()).collect()] == ["Ohio, USA (State, 2020) -- GDP/capita: $12,346", "USA (Country, 2020) -- GDP/capita: $70,000", None]
