"""Readers and sinks over the given tables (text forms are derived from them, dirt included)."""

from pyspark.sql import functions as F

from placewise import dims
from placewise.bind import ORDER_YEARS, point_lat, point_lon
from placewise.checks import check
from placewise.checks.sqlbind import lat, lon
from placewise.functions.encode import to_byte
from placewise.session import shared_path
from placewise.sources import readers, sinks
from placewise.sources.store import LayerStore


def text(column):
    return column.cast("string")


@check("s01_cell_scan", "SELECT year, CAST(count(*) AS BIGINT) AS cells, CAST(round(sum(value) / count(*), 4) AS DOUBLE) AS mean FROM b_gdp WHERE year IN (1996, 1999) GROUP BY year")
def s01(t):
    cells = t.layer_gdp().withColumn("layer", F.lit("gdp"))
    kept = readers.select_cells(cells, "gdp", [1996, 1999, 1950])
    return kept.groupBy("year").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("value"), 4).alias("mean"))


@check("s02_cube_paired_years", """
SELECT 'ppt' AS var, year, CAST(count(*) AS BIGINT) AS n, sum(ppt) AS total FROM b_cube WHERE year % 2 = 0 GROUP BY year
UNION ALL SELECT 'tmax', year, CAST(count(*) AS BIGINT), sum(tmax) FROM b_cube WHERE year % 2 = 0 GROUP BY year""")
def s02(t):
    long = t.cube().select("year", "month", "row", "col", "tmax", "ppt").unpivot(["year", "month", "row", "col"], ["tmax", "ppt"], "var", "value")
    cube = long.where((F.col("var") != "tmax") | (F.col("year") % 2 == 0))
    paired = readers.paired_cube(cube, ["tmax", "ppt"])
    return paired.groupBy("var", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@check("s03_plants", f"""
SELECT p_partkey AS id, p_type AS fuel, {lon('p_partkey')} AS lon, {lat('p_partkey')} AS lat, p_retailprice AS capacity
FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 23 <> 0""")
def s03(t):
    key = F.col("p_partkey")
    raw = t["part"].select(
        key.alias("id"), F.lit(None).cast("string").alias("country_long"), F.col("p_type").alias("primary_fuel"),
        F.when(key % 17 == 0, F.lit("n/a")).otherwise(text(point_lat(key))).alias("latitude"), text(point_lon(key)).alias("longitude"),
        F.when(key % 23 == 0, F.lit("")).otherwise(text(F.col("p_retailprice"))).alias("capacity_mw"),
    )
    return readers.clean_plants(raw).select("id", "fuel", "lon", "lat", "capacity")


@check("s04_volcanoes", f"""
SELECT s_suppkey AS id, {lon('s_suppkey')} AS lon, {lat('s_suppkey')} AS lat,
CAST(CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1800 + s_suppkey % 300 END AS INTEGER) AS last_year FROM supplier WHERE s_suppkey % 11 <> 0""")
def s04(t):
    key = F.col("s_suppkey")
    raw = t["supplier"].select(
        key.alias("id"), text(point_lat(key)).alias("Latitude"),
        F.when(key % 11 == 0, F.lit("unknown")).otherwise(text(point_lon(key))).alias("Longitude"),
        F.when(key % 5 == 0, F.lit("?")).otherwise(text((key % 300 + 1800).cast("double"))).alias("Last_Eruption_Year"),
    )
    return readers.clean_volcanoes(raw)


@check("s05_runup", f"""
SELECT id, CASE WHEN x > 180 THEN x - 360 ELSE x END AS lon, lat, runup FROM
(SELECT s_suppkey AS id, {lon('s_suppkey')} + 180 AS x, {lat('s_suppkey')} AS lat, s_acctbal AS runup FROM supplier WHERE s_suppkey % 7 <> 3)""")
def s05(t):
    key = F.col("s_suppkey")
    raw = t["supplier"].select(
        key.alias("id"), text(point_lon(key) + 180.0).alias("POINT_X"), text(point_lat(key)).alias("POINT_Y"),
        F.when(key % 7 == 3, F.lit("-")).otherwise(text(F.col("s_acctbal"))).alias("ari500"),
    )
    return readers.clean_runup(raw).select("id", "lon", "lat", "runup")


def deaths_raw(t):
    """One wide line per order, valued by the order's price; 'Code' repeats so later lines win."""
    key = F.col("o_orderkey")
    cols = [
        (F.when(key % (3 + i) == 0, F.lit("")).otherwise(text(F.floor(F.col("o_totalprice") / (i + 1))))).alias(c)
        for i, (c, _h) in enumerate(dims.DEATH_COLUMNS)
    ]
    code = F.when(key % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("C"), text(F.col("o_custkey") % 25)))
    return t["orders"].select(code.alias("Code"), text(F.lit(1970) + F.col("o_orderkey") % 6 * 10).alias("Year"), key.alias("line_no"), *cols)


DEATHS_SQL = "SELECT code, hazard, year, max_by(d, o_orderkey) AS deaths, col FROM (" + " UNION ALL ".join(
    f"SELECT 'C' || (o_custkey % 25) AS code, '{h}' AS hazard, '{c}' AS col, CAST(1970 + o_orderkey % 6 * 10 AS INTEGER) AS year, o_orderkey, "
    f"CASE WHEN o_orderkey % {3 + i} = 0 THEN 0 ELSE floor(o_totalprice / {i + 1}) END::DOUBLE AS d FROM orders WHERE o_orderkey % 13 <> 0"
    for i, (c, h) in enumerate(dims.DEATH_COLUMNS)
) + ") GROUP BY code, hazard, col, year"


@check("s06_deaths", f"SELECT code, hazard, year, col AS \"column\", deaths FROM ({DEATHS_SQL})")
def s06(t):
    return readers.clean_deaths(deaths_raw(t))


def population_raw(t):
    key = F.col("c_custkey")
    code = F.when(key % 4 == 0, F.concat(F.lit("OWID_"), text(key % 9))).otherwise(F.concat(F.lit("C"), text(key % 25)))
    return t["customer"].select(
        F.when(key % 3 == 0, F.lit("2019")).otherwise(F.lit("2020")).alias("year"), code.alias("code"),
        text(F.col("c_acctbal") + 500.0).alias("population_historical"), key.alias("line_no"),
    )


POPULATION_SQL = "SELECT 'C' || (c_custkey % 25) AS code, max_by(c_acctbal + 500::DOUBLE, c_custkey) AS population FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 GROUP BY 1"


@check("s07_population", POPULATION_SQL)
def s07(t):
    return readers.clean_population(population_raw(t))


def shdi_raw(t):
    key = F.col("o_orderkey")
    value = lambda d: text(F.col("o_totalprice") / d)
    return t["orders"].select(
        F.when(key % 10 == 0, F.lit("National")).otherwise(F.lit("Subnat")).alias("level"),
        F.concat(F.lit("R"), text(F.col("o_custkey") % 40)).alias("GDLCODE"),
        F.concat(F.lit("Country "), text(F.col("o_custkey") % 5)).alias("country"), F.concat(F.lit("Region "), text(F.col("o_custkey") % 40)).alias("region"),
        text(F.year("o_orderdate")).alias("year"),
        F.when(key % 6 == 0, F.lit(".")).otherwise(value(500000.0)).alias("shdi"),
        F.when(key % 7 == 0, F.lit(" ")).otherwise(value(600000.0)).alias("healthindex"), value(7e5).alias("edindex"), value(8e5).alias("incindex"),
        value(9e5).alias("lifexp"), F.when(key % 5 == 0, F.lit(".")).otherwise(value(1e6)).alias("esch"), value(1.1e6).alias("gnic"), key.alias("line_no"),
    )


SHDI_SQL = """SELECT 'R' || (o_custkey % 40) AS code, 'Country ' || (o_custkey % 5) AS country, 'Region ' || (o_custkey % 40) AS region,
CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice / 500000 AS shdi, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 600000 END AS health,
o_totalprice / 700000 AS education, o_totalprice / 800000 AS income, o_totalprice / 900000 AS lifexp,
CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1000000 END AS esch_yrs, o_totalprice / 1100000 AS gnic, o_orderkey AS line_no
FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 6 <> 0"""


@check("s08_shdi", SHDI_SQL)
def s08(t):
    return readers.clean_shdi(shdi_raw(t))


@check("s09_cpi", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, 'N' || (o_custkey % 30) AS country, max_by(round(o_totalprice / 5000, 1), o_orderkey) AS score
FROM orders WHERE o_orderkey % 8 <> 0 GROUP BY 1, 2""")
def s09(t):
    key = F.col("o_orderkey")
    raw = t["orders"].select(
        text(F.year("o_orderdate")).alias("year"), F.concat(F.lit(" N"), text(F.col("o_custkey") % 30), F.lit(" ")).alias("country"),
        F.when(key % 8 == 0, F.lit("none")).otherwise(text(F.round(F.col("o_totalprice") / 5000.0, 1))).alias("score"), key.alias("line_no"),
    )
    return readers.clean_cpi(raw)


def indicator_docs(t):
    """One '[meta, [entries]]' document per customer region; some codes are aggregates, some values null."""
    key = F.col("n_nationkey")
    rows = t.indicator().withColumn("_code", F.when(key % 7 == 6, F.lit("EU")).otherwise(F.col("iso3")))
    entry = F.struct(
        F.col("year").alias("_o"), key.alias("_k"), F.col("_code").alias("countryiso3code"), F.struct(F.col("name").alias("value")).alias("country"),
        text(F.col("year")).alias("date"), F.when(F.col("year") % 5 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"),
    )
    entries = rows.groupBy((key % 3).alias("file")).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    listed = F.to_json(F.transform("_e", lambda e: F.struct(e["countryiso3code"].alias("countryiso3code"), e["country"].alias("country"), e["date"].alias("date"), e["value"].alias("value"))))
    return entries.select(F.concat(F.lit('[{"page":1},'), listed, F.lit("]")).alias("doc"))


@check("s10_indicator", "SELECT iso3, year, round(value, 4) AS value FROM b_indicator WHERE n_nationkey % 7 <> 6 AND year % 5 <> 0")
def s10(t):
    return readers.indicator_by_year(readers.indicator_entries(indicator_docs(t))).withColumn("value", F.round("value", 4))


@check("s11_indicator_latest", "SELECT name, round(max_by(value, year), 4) AS value FROM b_indicator WHERE n_nationkey % 7 <> 6 AND year % 5 <> 0 GROUP BY name")
def s11(t):
    return readers.indicator_by_name(readers.indicator_entries(indicator_docs(t))).withColumn("value", F.round("value", 4))


@check("s12_indicator_xml", "SELECT 'NATION_' || (c_custkey % 25) AS name, max_by(c_acctbal, c_custkey) AS value FROM customer WHERE c_custkey % 9 <> 0 GROUP BY 1")
def s12(t):
    key = F.col("c_custkey")
    value = F.when(key % 9 == 0, F.lit("")).otherwise(text(F.col("c_acctbal")))
    doc = F.concat(F.lit("<data><country>NATION_"), text(key % 25), F.lit("</country><value>"), value, F.lit("</value></data>"))
    docs = t["customer"].select(doc.alias("doc"), key.alias("line_no"))
    return readers.clean_indicator_xml(readers.indicator_xml_records(docs))


@check("s13_speedtests", "SELECT id, kbps AS avg_d_kbps, round(west + 0.05, 6) AS lon, round(south + 0.05, 6) AS lat FROM b_speed")
def s13(t):
    raw = t.speedtests().select("id", "tile", F.col("kbps").alias("avg_d_kbps"))
    return readers.clean_speedtests(raw).select("id", "avg_d_kbps", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@check("s14_geojson_zones", """
SELECT n_name AS name, CAST(5 AS INTEGER) AS corners, west, north - h AS south, west + w AS east, north FROM b_adm1 JOIN nation ON n_nationkey = ord""")
def s14(t):
    ring = F.transform(F.col("rings")[0], lambda p: F.array(p["x"], p["y"]))
    feature = F.struct(
        F.struct(F.col("name").alias("NAME")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.col("ord").alias("_o"),
    )
    docs = t.zones_adm1().groupBy().agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("doc"))
    zones = readers.geojson_zones(docs, ["NAME"])
    xs, ys = F.transform(F.col("rings")[0], lambda p: p["x"]), F.transform(F.col("rings")[0], lambda p: p["y"])
    return zones.select(
        F.col("NAME").alias("name"), F.size(F.col("rings")[0]).alias("corners"), F.array_min(xs).alias("west"),
        F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"),
    )


FIW_LABELS = {"c0": "Survey Edition", "c1": "Jan.-Feb. 1973", "c2": "", "c3": "", "c4": "1973, 1974-1975", "c5": "", "c6": "", "c7": "2022", "c8": "", "c9": ""}


@check("s15_fiw_wide", " UNION ALL ".join(
    f"SELECT 'Land ' || c_custkey AS country, {year} AS year, round_even(100 - ((1 + (c_custkey + {s}) % 7) + (1 + (c_custkey * 3 + {s}) % 7) - 2)::DOUBLE / 12 * 100, 1) AS fiw FROM customer WHERE (c_custkey + {s}) % 6 <> 0"
    for year, s in ((1972, 1), (1974, 4), (2021, 7))))
def s15(t):
    key = F.col("c_custkey")
    rating = lambda k, s: F.when((key + s) % 6 == 0, F.lit("-")).otherwise(text(F.lit(1) + (key * k + s) % 7))
    blank = F.lit("F")
    raw = t["customer"].select(
        F.concat(F.lit("Land "), text(key)).alias("c0"),
        *[c.alias(f"c{s + i}") for s in (1, 4, 7) for i, c in enumerate((rating(1, s), text(F.lit(1) + (key * 3 + s) % 7), blank))],
    )
    return readers.clean_fiw_wide(raw, FIW_LABELS)


@check("s16_fiw_categories", "SELECT 'Land ' || c_custkey AS country, CAST(2005 + c_custkey % 18 AS INTEGER) AS year, " + ", ".join(
    f"round_even((c_custkey * {i + 3}) % {m + 1} / {m}::DOUBLE * 100, 1) AS cat_{k}" if k != "D" else
    f"CASE WHEN c_custkey % 4 <> 0 THEN round_even((c_custkey * {i + 3}) % {m + 1} / {m}::DOUBLE * 100, 1) END AS cat_{k}"
    for i, (k, m, _l) in enumerate(dims.FREEDOM_CATEGORIES)) + ", CAST(c_custkey % 101 AS DOUBLE) AS total FROM customer WHERE c_custkey % 14 <> 0")
def s16(t):
    key = F.col("c_custkey")
    value = lambda i, k, m: F.when((key % 4 == 0) & F.lit(k == "D"), F.lit("")).otherwise(text(key * (i + 3) % (m + 1)))
    raw = t["customer"].select(
        F.concat(F.lit("Land "), text(key), F.lit(" ")).alias("Country/Territory"),
        F.when(key % 14 == 0, F.lit("")).otherwise(text(F.lit(2006) + key % 18)).alias("Edition"),
        *[value(i, k, m).alias(k) for i, (k, m, _l) in enumerate(dims.FREEDOM_CATEGORIES)], text(key % 101).alias("Total"),
    )
    return readers.clean_fiw_cats(raw)


@check("s17_risk_index", "SELECT 'Land ' || (c_custkey % 200) AS country, max_by(round(abs(c_acctbal) / 1000, 1), c_custkey) AS risk FROM customer WHERE c_custkey % 6 <> 0 GROUP BY 1")
def s17(t):
    key = F.col("c_custkey")
    raw = t["customer"].select(
        F.when(key % 6 == 0, F.lit("(a-z)")).otherwise(F.concat(F.lit("Land "), text(key % 200))).alias("COUNTRY"),
        text(F.round(F.abs("c_acctbal") / 1000.0, 1)).alias("INFORM RISK"), key.alias("line_no"),
    )
    return readers.clean_risk_index(raw)


@check("s18_crop_scan", "SELECT crop, CAST(count(*) AS BIGINT) AS cells, sum(value) AS total FROM b_crops WHERE crop IN (0, 3, 7, 45) GROUP BY crop")
def s18(t):
    kept = readers.select_crops(t.crop_cells(), [0, 3, 7, 45, 99])
    return kept.groupBy("crop").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))


@check("s19_nested_lookup", """
SELECT CAST(year AS VARCHAR) AS year, '{' || string_agg('"' || name || '":' || CAST(round_even(value, 0) AS BIGINT) || '.0', ',' ORDER BY name) || '}' AS json FROM b_indicator GROUP BY year""")
def s19(t):
    return sinks.nested_lookup(t.indicator(), "year", "name", "value")


@check("s20_layer_write_once", """
SELECT 'gdp' AS axis, CAST(NULL AS VARCHAR) AS scenario, year, CAST(count(*) AS BIGINT) AS cells, round(sum(CASE WHEN year IN (1996, 1997) THEN value ELSE value + 1 END), 3) AS total FROM b_gdp GROUP BY year""")
def s20(t):
    """Two years are stored; a write of all years (with other values) ends half way, is done again, and the store is read."""
    layer = t.layer_gdp().select(F.lit("gdp").alias("axis"), F.lit(None).cast("string").alias("scenario"), "year", "row", "col", "value")
    store = LayerStore(layer.sparkSession, shared_path(layer.sparkSession, "store"))
    store.write(layer.where(F.col("year").isin(1996, 1997)))
    late = layer.withColumn("value", F.col("value") + 1)
    store._stage(late, "never-listed")
    store.write(late)
    return store.read().groupBy("axis", "scenario", "year").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("value"), 3).alias("total"))


@check("s21_catalog", """
SELECT axis, axis = 'p' AS static,
CASE axis WHEN 'o' THEN years ELSE '' END AS years, CASE axis WHEN 'f' THEN years ELSE '' END AS ssp585, CASE axis WHEN 'p' THEN 'p.pmtiles' END AS file
FROM (SELECT lower(o_orderstatus) AS axis, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS years FROM orders GROUP BY 1)""")
def s21(t):
    catalog = sinks.build_catalog(t.artefacts())
    listed = lambda c: F.coalesce(F.array_join(c.cast("array<string>"), ","), F.lit(""))
    return catalog.select("axis", "static", listed(F.col("years")).alias("years"), listed(F.try_element_at("projections", F.lit("ssp585"))).alias("ssp585"), "file")


@check("s22_layer_fingerprint", """
SELECT CAST(cells AS BIGINT) AS cells, substr(sha256(cells || ':' || CAST(a AS VARCHAR)), 1, 10) AS version FROM
(SELECT count(*) AS cells, sum(CAST(('0x' || substr(sha256(row || ',' || col || ',' || byte), 1, 12)) AS BIGINT)) AS a FROM
(SELECT row, col, CAST(trunc(least(greatest(least(greatest((value + 30) / 75::DOUBLE, 0), 1) * 254 + 1, 1), 255)) AS INTEGER) AS byte FROM b_temp))""")
def s22(t):
    layer = t.layer_temp().withColumn("byte", to_byte(F.col("value"), -30.0, 45.0))
    return sinks.layer_fingerprint(layer, ["row", "col", "byte"])


@check("s23_split_year_columns", "SELECT name AS key, year, round_even(value, 1) AS value FROM b_indicator")
def s23(t):
    """Every year of the indicator, through wide columns and back."""
    wide = sinks.year_columns(t.indicator().withColumnRenamed("name", "key"), ["key"], ORDER_YEARS)
    return sinks.split_year_columns(wide, "key")
