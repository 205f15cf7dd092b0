"""Masks, zones, names, years, tiers and point lookups."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise import dims
from placewise.bind import GRID
from placewise.checks import check
from placewise.checks.sources import SHDI_SQL, shdi_raw
from placewise.functions.grid import Grid, tile_pixel
from placewise.operators import lookup, masks, names, ranking, zones
from placewise.operators.aggregate import CELL, fuel_breakdown, latest_per_key
from placewise.operators.score import axes_at, encode_layers
from placewise.operators.years import nearest_weight_year, nearest_year, resolve_layer, scenario_for
from placewise.sources import readers
from placewise.sources.sinks import build_catalog

LAKE_KM2 = 10_000_000
LAKES = f"""(SELECT DISTINCT row, col FROM b_tri_cell JOIN (SELECT ord FROM (SELECT ord, abs(sum(ax * by2 - bx * ay)) / 2 AS area FROM
(SELECT ord, x1 * pi() / 180 * 6371.0072 AS ax, sin(y1 * pi() / 180) * 6371.0072 AS ay, x2 * pi() / 180 * 6371.0072 AS bx, sin(y2 * pi() / 180) * 6371.0072 AS by2 FROM b_tri_edge) GROUP BY ord) WHERE area >= {LAKE_KM2}) USING (ord))"""


def lakes(t):
    """Cells of the large triangles."""
    return zones.cells_by_centre(masks.large_lakes(t.triangles(), LAKE_KM2), GRID).select(*CELL)


@check("j01_ocean_mask", "SELECT w.row, w.col, CASE WHEN e.value <= 0 THEN NULL ELSE w.value END AS value FROM b_water w LEFT JOIN b_elev e ON e.row = w.row AND e.col = w.col")
def j01(t):
    return masks.ocean_mask(t.layer_water(), t.layer_elev())


@check("j02_water_mask", f"SELECT w.row, w.col, CASE WHEN e.value <= 0 OR l.row IS NOT NULL THEN NULL ELSE w.value END AS value FROM b_water w LEFT JOIN b_elev e ON e.row = w.row AND e.col = w.col LEFT JOIN {LAKES} l ON l.row = w.row AND l.col = w.col")
def j02(t):
    return masks.water_mask(t.layer_water(), t.layer_elev(), lakes(t))


@check("j03_lake_mask", f"SELECT w.row, w.col, CASE WHEN l.row IS NULL THEN w.value END AS value FROM b_water w LEFT JOIN {LAKES} l ON l.row = w.row AND l.col = w.col")
def j03(t):
    return masks.lake_mask(t.layer_water(), lakes(t))


@check("j04_assign_zones", "SELECT row, col, max(ord) AS zone FROM b_tri_cell GROUP BY row, col")
def j04(t):
    return zones.assign_zones(t.triangles(), GRID)


@check("j04_zone_rectangles", "SELECT row, col, zone FROM b_cell_adm1")
def j04r(t):
    return zones.assign_zones(t.zones_adm1(), GRID)


# an edge touches a cell when the part of it inside the cell's latitude band overlaps the cell's longitudes
TOUCHED = """SELECT ord, row, col FROM (SELECT ord, row, col, xc, least(xt, xb) AS xlo, greatest(xt, xb) AS xhi FROM
(SELECT ord, row, col, xc, x1 + (least(greatest(y1, y2), yc + 5) - y1) * (x2 - x1) / (y2 - y1) AS xt, x1 + (greatest(least(y1, y2), yc - 5) - y1) * (x2 - x1) / (y2 - y1) AS xb
FROM b_tri_edge, b_cells WHERE least(y1, y2) <= yc + 5 AND greatest(y1, y2) > yc - 5)) WHERE xlo < xc + 5 AND xhi >= xc - 5"""


@check("j05_assign_all_touched", f"SELECT row, col, max(ord) AS zone FROM (SELECT * FROM b_tri_cell UNION ALL {TOUCHED}) GROUP BY row, col")
def j05(t):
    return zones.assign_zones(t.triangles(), GRID, all_touched=True)


ISO_SQL = """SELECT ord, CASE WHEN ord % 3 = 0 THEN '-99' WHEN ord % 5 = 0 THEN '' ELSE 'A' || ord % 7 || 'X' END AS iso_a3, CASE WHEN ord % 15 = 0 THEN '-99' ELSE 'B' || ord % 4 || 'Y' END AS adm0_a3 FROM (SELECT s_suppkey AS ord FROM supplier)"""


@check("j06_zone_ids", f"""SELECT ord, iso3, CAST(dense_rank() OVER (ORDER BY f) AS INTEGER) AS zone FROM (SELECT *, min(ord) OVER (PARTITION BY iso3) AS f FROM
(SELECT ord, coalesce(nullif(nullif(iso_a3, ''), '-99'), nullif(adm0_a3, '-99')) AS iso3 FROM ({ISO_SQL})) WHERE iso3 IS NOT NULL)""")
def j06(t):
    key = F.col("ord")
    polygons = t["supplier"].select(F.col("s_suppkey").alias("ord")).withColumns({
        "iso_a3": F.when(key % 3 == 0, F.lit("-99")).when(key % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("A"), (key % 7).cast("string"), F.lit("X"))),
        "adm0_a3": F.when(key % 15 == 0, F.lit("-99")).otherwise(F.concat(F.lit("B"), (key % 4).cast("string"), F.lit("Y"))),
    })
    return zones.zone_ids(polygons)


def polygon_names(t):
    """Map spellings of nations and parts: exact, decorated, partial and unrelated."""
    key, name = F.col("n_nationkey"), F.col("n_name")
    spelled = F.when(key % 4 == 0, F.lower(name)).when(key % 4 == 1, F.concat(name, F.lit(" (Rep.)"))).when(
        key % 4 == 2, F.concat(F.lit("Outer-"), name)).otherwise(F.concat(name, F.lit("0")))
    extra = t["part"].select(F.concat(F.initcap("p_name"), F.lit(" Republic"))).distinct()
    return t["nation"].select(spelled.alias("name")).unionByName(extra.toDF("name")).distinct()


POLYGON_NAMES = """(SELECT DISTINCT CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN n_name || ' (Rep.)' WHEN 2 THEN 'Outer-' || n_name ELSE n_name || '0' END AS name FROM nation
UNION SELECT DISTINCT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' Republic' FROM part)"""


def score_keys(t):
    """Keys in ordinal order: nations backwards, then the colours of parts."""
    nations = t["nation"].select(F.col("n_name").alias("key"), (F.lit(25) - F.col("n_nationkey")).cast("int").alias("ordinal"))
    words = t["part"].select(F.explode(F.split("p_name", " ")).alias("key")).distinct()
    return nations.unionByName(words.withColumn("ordinal", F.ascii("key") + F.length("key") * 1000 + F.ascii(F.substring("key", 2, 1)) * 7))


SCORE_KEYS = """(SELECT n_name AS key, 25 - n_nationkey AS ordinal FROM nation UNION ALL SELECT key, ascii(key) + length(key) * 1000 + ascii(substr(key, 2, 1)) * 7 FROM
(SELECT DISTINCT unnest(string_split(p_name, ' ')) AS key FROM part))"""


@check("j07_harmonise_names", f"""SELECT name, min_by(key, ordinal) AS key FROM {POLYGON_NAMES} n JOIN {SCORE_KEYS} k
ON lower(key) = lower(name) OR regexp_matches(lower(name), '\\b' || lower(key) || '\\b') GROUP BY name""")
def j07(t):
    return names.harmonise(polygon_names(t), score_keys(t))


def alias_names(t):
    """Spellings from the fixed groups, one per nation, and the keys known for them."""
    pool = sorted({n for canonical, others in dims.NAME_GROUPS for n in [canonical, *others]})
    listed = F.array(*[F.lit(n) for n in pool])
    key = F.col("c_custkey")
    picked = t["customer"].select(F.element_at(listed, (key * 7 % len(pool) + 1).cast("int")).alias("name")).distinct()
    known = t["customer"].where(key % 3 == 0).select(F.element_at(listed, (key * 5 % len(pool) + 1).cast("int")).alias("key")).distinct()
    return picked, known


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


POOL = sorted({n for canonical, others in dims.NAME_GROUPS for n in [canonical, *others]})
POOL_SQL = "(VALUES " + ", ".join(f"({i}, {_quoted(n)})" for i, n in enumerate(POOL)) + ") pool(i, n)"
GROUPS_SQL = "(VALUES " + ", ".join(
    f"({g}, {p}, {_quoted(c)}, {_quoted(o)})" for g, (c, others) in enumerate(dims.NAME_GROUPS) for p, o in enumerate(others)) + ") g(grp, pos, canonical, other)"
PICKED_SQL = f"(SELECT DISTINCT n AS name FROM customer JOIN {POOL_SQL} ON i = c_custkey * 7 % {len(POOL)})"
KNOWN_SQL = f"(SELECT DISTINCT n AS key FROM customer JOIN {POOL_SQL} ON i = c_custkey * 5 % {len(POOL)} WHERE c_custkey % 3 = 0 AND n < 'L')"


@check("j08_name_aliases", f"""SELECT name, max_by(key, o) AS key FROM (SELECT name, min_by(key, pos) AS key, grp * 2 AS o FROM {PICKED_SQL} JOIN {GROUPS_SQL} ON name = canonical JOIN {KNOWN_SQL} k ON other = key GROUP BY name, grp
UNION ALL SELECT name, key, grp * 2 + 1 FROM {PICKED_SQL} JOIN {GROUPS_SQL} ON name = other JOIN {KNOWN_SQL} k ON canonical = key) GROUP BY name""")
def j08(t):
    picked, known = alias_names(t)
    return names.apply_aliases(picked, known.where(F.col("key") < "L"), dims.name_group_dim(t.spark))


@check("j09_anchor_join", """SELECT s.ord, coalesce(a.value, b.value) AS value FROM
(SELECT ord, CASE WHEN ord % 3 = 0 THEN '' ELSE 'R0' || ord % 7 END AS iso3, 'REGION_' || ord % 6 AS admin FROM b_adm1) s
LEFT JOIN (SELECT 'R0' || r_regionkey AS iso3, r_regionkey * 10.5::DOUBLE AS value FROM region) a ON a.iso3 = s.iso3 LEFT JOIN (SELECT 'REGION_' || r_regionkey AS name, r_regionkey * 10.5::DOUBLE AS value FROM region) b ON b.name = s.admin""")
def j09(t):
    key = F.col("ord")
    states = t.zones_adm1().select(
        "ord", F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("R0"), (key % 7).cast("string"))).alias("iso3"),
        F.concat(F.lit("REGION_"), (key % 6).cast("string")).alias("admin"),
    )
    countries = t.zones_adm0().select("ord", "iso3", "name", (F.col("ord") * 10.5).alias("value"))
    return names.anchor_join(states, countries, "value").select("ord", "value")


@check("j10_name_map", """SELECT 'Q' || chr(65 + k // 26) || chr(65 + k % 26) AS iso3, CASE WHEN k % 3 = 0 THEN 'Map ' || k WHEN k % 3 = 1 THEN 'Vietnam' ELSE 'Land ' || k END AS name FROM (SELECT DISTINCT CAST(c_custkey % 100 AS INTEGER) AS k FROM customer)""")
def j10(t):
    key = (F.col("c_custkey") % 100).cast("int")
    iso = F.concat(F.lit("Q"), F.chr(F.floor(key / 26) + 65), F.chr(key % 26 + 65))
    rows = t["customer"].select(F.col("c_custkey").alias("ord"), key.alias("k"), iso.alias("iso3"))
    polygons = rows.where(F.col("k") % 3 == 0).select("ord", F.lower("iso3").alias("adm0_a3"), F.concat(F.lit("Map "), F.col("k").cast("string")).alias("name"))
    indicator = rows.select("iso3", F.when(F.col("k") % 3 == 1, F.lit("Viet Nam")).otherwise(F.concat(F.lit("Land "), F.col("k").cast("string"))).alias("indicator_name")).distinct()
    return names.name_map(polygons, indicator)


def freedom_sources(t):
    """fiw, cpi and category rows by country and year, each missing for some countries."""
    ind = t.indicator().select("year", F.col("name").alias("country"), "n_nationkey", "value")
    key = F.col("n_nationkey")
    fiw = ind.where(key % 3 != 0).select("year", "country", F.bround(F.col("value") / 5000.0, 1).alias("fiw"))
    cpi = ind.where(key % 4 != 0).select("year", "country", F.floor(F.col("value") / 4000.0).cast("double").alias("score"))
    cats = ind.where(key % 2 == 0).select("year", "country", *[(F.floor(F.col("value") / (3000.0 + i)) % 100).cast("double").alias(f"cat_{k}") for i, k in enumerate("ABCDEFG")])
    return fiw, cpi, cats


FREEDOM_SQL = """SELECT year, name AS country, CASE WHEN n_nationkey % 3 <> 0 THEN round_even(value / 5000, 1) END AS fiw, CASE WHEN n_nationkey % 4 <> 0 THEN floor(value / 4000) END AS cpi,
CASE WHEN n_nationkey % 2 = 0 THEN CAST(floor(value / 3000) % 100 AS DOUBLE) END AS cat_a, CASE WHEN n_nationkey % 2 = 0 THEN CAST(floor(value / 3006) % 100 AS DOUBLE) END AS cat_g
FROM b_indicator WHERE n_nationkey % 3 <> 0 OR n_nationkey % 4 <> 0 OR n_nationkey % 2 = 0"""


@check("j11_freedom_join", FREEDOM_SQL)
def j11(t):
    from placewise.plans.freedom import freedom_join

    rows = freedom_join(*freedom_sources(t))
    return rows.select("year", "country", "fiw", "cpi", F.col("cat_A").alias("cat_a"), F.col("cat_G").alias("cat_g"))


@check("j12_merge_aliases", """SELECT year, 'Group ' || n_nationkey % 6 AS name, min_by(a, name) FILTER (a IS NOT NULL) AS a, min_by(b, name) FILTER (b IS NOT NULL) AS b FROM
(SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN round(value, 2) END AS a, CASE WHEN n_nationkey % 5 <> 0 THEN round(value, 1) END AS b FROM b_indicator WHERE n_nationkey % 7 <> 0) GROUP BY year, n_nationkey % 6
UNION ALL SELECT year, name, CASE WHEN n_nationkey % 2 = 0 THEN round(value, 2) END, CASE WHEN n_nationkey % 5 <> 0 THEN round(value, 1) END FROM b_indicator WHERE n_nationkey % 7 = 0""")
def j12(t):
    key = F.col("n_nationkey")
    records = t.indicator().select("year", "name", F.when(key % 2 == 0, F.round("value", 2)).alias("a"), F.when(key % 5 != 0, F.round("value", 1)).alias("b"))
    aliases = t["nation"].where(key % 7 != 0).select(F.lower("n_name").alias("alias"), F.concat(F.lit("Group "), (key % 6).cast("string")).alias("canonical"))
    return names.merge_aliases(records, aliases, ["a", "b"])


@check("j13_region_join", f"""SELECT ord, code, CAST(dense_rank() OVER (ORDER BY f) AS INTEGER) AS zone, shdi FROM (SELECT *, min(ord) OVER (PARTITION BY code) AS f FROM
(SELECT s_suppkey AS ord, 'R' || s_suppkey % 60 AS code FROM supplier) JOIN (SELECT code, shdi FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY year DESC, line_no) AS k FROM ({SHDI_SQL})) WHERE k = 1) USING (code))""")
def j13(t):
    polygons = t["supplier"].select(F.col("s_suppkey").alias("ord"), F.concat(F.lit(" R"), (F.col("s_suppkey") % 60).cast("string")).alias("code"))
    records = latest_per_key(readers.clean_shdi(shdi_raw(t)), "code", "year", "line_no", "shdi")
    return zones.region_join(polygons, records).select("ord", "code", "zone", "shdi")


def tile_pixels(t):
    """Tile pixels at zoom 3 for two axes, from customers; bytes 0 are holes."""
    placed = tile_pixel(t.points(), 3)
    byte = F.max((F.col("id") % 256).cast("int"))
    axis = F.when(F.col("id") % 2 == 0, F.lit("temp")).otherwise(F.lit("water"))
    return placed.groupBy(axis.alias("axis"), "z", "x", "y", "px", "py").agg(byte.alias("byte"))


MX = "((lon + 180) / 360 * 8)"
MY = "((0.5 - ln(tan(pi() / 4 + lat * pi() / 180 / 2)) / (2 * pi())) * 8)"
PLACED3 = f"""(SELECT id, CAST(floor(mx) AS INTEGER) % 8 AS x, CAST(floor(my) AS INTEGER) AS y, CAST(least(255, floor((mx - floor(mx)) * 256)) AS INTEGER) AS px, CAST(least(255, floor((my - floor(my)) * 256)) AS INTEGER) AS py FROM (SELECT id, {MX} AS mx, {MY} AS my FROM b_points))"""
TILES3 = f"(SELECT CASE WHEN id % 2 = 0 THEN 'temp' ELSE 'water' END AS axis, 3 AS z, x, y, px, py, CAST(max(id % 256) AS INTEGER) AS byte FROM {PLACED3} GROUP BY ALL)"


@check("j14_value_at", f"SELECT id, lon, lat, CASE WHEN byte > 0 THEN byte END AS byte FROM b_points JOIN {PLACED3} USING (id) LEFT JOIN (SELECT * FROM {TILES3} WHERE axis = 'temp') USING (x, y, px, py)")
def j14(t):
    return lookup.value_at(t.points(), tile_pixels(t), 3, "temp")


@check("j15_axes_at", "SELECT row, col, t.value AS f_temp, w.value AS f_water, p.value AS f_pop FROM b_temp t JOIN b_water w USING (row, col) JOIN b_pop p USING (row, col)")
def j15(t):
    return axes_at(t.layers(), ["temp", "water", "pop"], "value")


@check("j16_nearest_year", """SELECT o_orderkey AS id, CAST(CASE WHEN abs(1996 - y) <= abs(2000 - y) AND abs(1996 - y) <= abs(1998 - y) THEN 1996 WHEN abs(2000 - y) <= abs(1998 - y) THEN 2000 ELSE 1998 END AS INTEGER) AS snapped
FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)""")
def j16(t):
    listed = F.array(F.lit(1996), F.lit(2000), F.lit(1998))
    return t["orders"].select(F.col("o_orderkey").alias("id"), nearest_year(listed, F.year("o_orderdate")).alias("snapped"))


def layer_requests(t):
    key = F.col("o_orderkey")
    axis = F.element_at(F.array(F.lit("o"), F.lit("f"), F.lit("p"), F.lit("zz")), (key % 4 + 1).cast("int"))
    return t["orders"].select(
        key.alias("id"), axis.alias("axis"), (F.lit(1990) + key % 15).cast("int").alias("year"),
        F.when(key % 3 == 0, F.lit("ssp585")).otherwise(F.lit("historical")).alias("scenario"),
    )


@check("j17_resolve_layer", """SELECT o_orderkey AS id, axis, CAST(1990 + o_orderkey % 15 AS INTEGER) AS year, CASE WHEN o_orderkey % 3 = 0 THEN 'ssp585' ELSE 'historical' END AS scenario,
CASE WHEN axis = 'p' THEN 'p/p.pmtiles' WHEN axis = 'f' AND o_orderkey % 3 = 0 THEN 'f/f_ssp585_' || snap || '.pmtiles' WHEN axis = 'o' AND y <= last THEN 'o/o_' || snap || '.pmtiles' END AS layer
FROM (SELECT *, CASE WHEN y < first THEN first WHEN y > last THEN last ELSE y END AS snap FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'o' WHEN 1 THEN 'f' WHEN 2 THEN 'p' ELSE 'zz' END AS axis, 1990 + o_orderkey % 15 AS y FROM orders)
LEFT JOIN (SELECT lower(o_orderstatus) AS axis, min(year(o_orderdate)) AS first, max(year(o_orderdate)) AS last FROM orders GROUP BY 1) USING (axis))""")
def j17(t):
    return resolve_layer(layer_requests(t), build_catalog(t.artefacts()))


@check("j18_scenario_for_year", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND 2015 + o_orderkey % 20 > 2026 THEN 'ssp585' ELSE 'historical' END AS scenario FROM orders""")
def j18(t):
    key = F.col("o_orderkey")
    years = F.array(F.lit(1995), F.lit(2026))
    projections = F.when(key % 2 == 0, F.create_map(F.lit("ssp585"), F.array(F.lit(2055))))
    return t["orders"].select(key.alias("id"), scenario_for((F.lit(2015) + key % 20).cast("int"), years, projections, current_year=2024).alias("scenario"))


@check("j19_nearest_weight_year", """SELECT year, CAST(CASE WHEN year <= 1997 THEN 1996 ELSE 1999 END AS INTEGER) AS weight_year, CASE WHEN year <= 1997 THEN 'pop-1996-processed' ELSE 'pop-1999' END AS path FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)""")
def j19(t):
    """Weights exist for 1996 (processed only) and 1999 (both kinds)."""
    years = t["orders"].select(F.year("o_orderdate").alias("year")).distinct()
    stored = years.where(F.col("year").isin(1996, 1999))
    name = F.concat(F.lit("pop-"), F.col("year").cast("string"))
    weights = stored.select("year", F.concat(name, F.lit("-processed")).alias("path")).unionByName(stored.where(F.col("year") == 1999).select("year", name.alias("path")))
    return nearest_weight_year(years, weights)


@check("j20_overzoom", f"""SELECT id, axis, dz, CASE WHEN byte > 0 THEN byte END AS byte FROM (SELECT id, axis, min(dz) AS dz FROM
(SELECT id, 'temp' AS axis, x, y, px, py FROM (SELECT id, x * 4 + px // 64 AS x, y * 4 + py // 64 AS y, (px % 64) * 4 AS px, (py % 64) * 4 AS py FROM {PLACED3})), (SELECT CAST(unnest(range(6)) AS INTEGER) AS dz)
JOIN (SELECT DISTINCT axis AS ta, z AS tz, x AS tx, y AS ty FROM {TILES3} WHERE x % 3 <> 0) ON ta = axis AND tz = 5 - dz AND tx = x >> dz AND ty = y >> dz GROUP BY id, axis) m
JOIN (SELECT id, x, y, px, py FROM {PLACED3}) USING (id) LEFT JOIN (SELECT axis, x, y, px, py, byte FROM {TILES3}) USING (axis, x, y, px, py)""")
def j20(t):
    """Zoom-5 requests over a store that has zoom-3 tiles in two columns of three."""
    at = tile_pixel(t.points(), 3).select(
        "id", F.lit("temp").alias("axis"), F.lit(5).alias("z"),
        *[(F.col(c) * 4 + F.floor(F.col(p) / 64)).cast("int").alias(c) for c, p in (("x", "px"), ("y", "py"))],
        *[(F.col(p) % 64 * 4).cast("int").alias(p) for p in ("px", "py")],
    )
    return lookup.overzoom(at, tile_pixels(t).where(F.col("x") % 3 != 0))


@check("j21_gdp_tiers", """SELECT id, CASE WHEN zoom >= 6 AND d IS NOT NULL THEN 'District' WHEN zoom >= 3.5 AND s IS NOT NULL THEN 'State' WHEN c IS NOT NULL THEN 'Country' END AS tier,
CASE WHEN zoom >= 6 AND d IS NOT NULL THEN d WHEN zoom >= 3.5 AND s IS NOT NULL THEN s ELSE c END AS gdp FROM
(SELECT c_custkey AS id, c_custkey % 10 AS zoom, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS d, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 100.5::DOUBLE END AS s, CASE WHEN n_regionkey <> 3 THEN n_regionkey * 1000.25::DOUBLE END AS c FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def j21(t):
    nation = F.broadcast(t["nation"])
    points = t["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 10).cast("double").alias("zoom"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("district_value"),
        F.col("n_name").alias("state"), F.col("n_regionkey").alias("country"), F.lit(2020).alias("year"),
    )
    states = t["nation"].where(F.col("n_nationkey") % 2 == 0).select(F.col("n_name").alias("state"), F.lit(2020).alias("year"), (F.col("n_nationkey") * 100.5).alias("state_value"))
    countries = t["region"].where(F.col("r_regionkey") != 3).select(F.col("r_regionkey").alias("country"), F.lit(2020).alias("year"), (F.col("r_regionkey") * 1000.25).alias("country_value"))
    return lookup.gdp_at(points, states, countries).select("id", "tier", "gdp")


def hazard_lookup_rows(t):
    """A tenths lookup on the 10-degree grid."""
    from placewise.functions.encode import lookup_tenths

    rows = t.hazard_cells().select("hazard", *CELL, lookup_tenths(F.col("intensity") * 37.0).alias("tenths"), F.bround("intensity", 2).alias("intensity"))
    total = rows.groupBy(*CELL).agg(F.sum("tenths").cast("int").alias("composite_tenths"))
    return rows.join(total, CELL)


CELL10 = "CAST(least(greatest(floor((90 - lat) / 10), 0), 17) AS INTEGER) AS row, CAST(least(greatest(floor((lon + 180) / 10), 0), 35) AS INTEGER) AS col"
HAZARD_ROWS = "(SELECT hazard, row, col, CAST(round_even(intensity * 37 * 10, 0) AS INTEGER) AS tenths, round_even(intensity, 2) AS intensity FROM b_hazard)"


@check("j22_risk_at", f"SELECT id, hazard, tenths / 10::DOUBLE AS rate, intensity, sum(tenths) OVER (PARTITION BY id) / 10::DOUBLE AS composite FROM (SELECT id, {CELL10} FROM b_points) JOIN {HAZARD_ROWS} USING (row, col)")
def j22(t):
    return lookup.risk_at(t.points(), hazard_lookup_rows(t), GRID)


@check("j23_region_at", f"SELECT id, CASE WHEN zone > 0 THEN zone END AS zone, CASE WHEN zone > 0 THEN n_name END AS region FROM (SELECT id, {CELL10} FROM b_points) LEFT JOIN b_cell_adm1 USING (row, col) LEFT JOIN nation ON n_nationkey = zone")
def j23(t):
    cells = zones.assign_zones(t.zones_adm1(), GRID)
    records = t["nation"].select(F.col("n_nationkey").alias("zone"), F.col("n_name").alias("region"))
    return lookup.region_at(t.points(), cells, records, GRID).select("id", "zone", "region")


@check("j24_crops_at", "SELECT id, CAST(k AS INTEGER) AS rank, CASE crop " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(dims.HARVEST_CROPS)) + f""" END AS crop, CAST(round_even(value, 0) AS BIGINT) AS value FROM
(SELECT id, {CELL10} FROM b_points) JOIN (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY value DESC, crop DESC) AS k FROM b_crops) USING (row, col) WHERE k <= 5""")
def j24(t):
    lists = ranking.top_lists(ranking.top_n_per_cell(t.crop_cells(), "crop"), "crop")
    return lookup.crops_at(t.points(), lists, dims.HARVEST_CROPS, GRID)


@check("j25_energy_at", f"""SELECT id, n_name AS name, n_nationkey * 4.0::DOUBLE AS score, fuel, round(capacity, 4) AS capacity FROM (SELECT id, {CELL10} FROM b_points) JOIN b_cell_adm1 USING (row, col) JOIN nation ON n_nationkey = zone
JOIN (SELECT country, fuel, sum(capacity) AS capacity FROM b_plants GROUP BY ALL) ON country = n_name""")
def j25(t):
    fuels = fuel_breakdown(t.plants())
    scores = t["nation"].select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 4.0).alias("score")).join(fuels, F.col("name") == F.col("country")).drop("country")
    zone_names = t["nation"].select(F.col("n_nationkey").alias("zone"), F.col("n_name").alias("name"))
    out = lookup.energy_at(t.points(), zones.assign_zones(t.zones_adm1(), GRID), zone_names, scores, GRID)
    return out.select("id", "name", "score", "fuel", F.round("capacity", 4).alias("capacity"))


@check("j26_freedom_at", f"""SELECT id, name, fiw, cpi, cats FROM (SELECT id, {CELL10} FROM b_points) JOIN b_cell_adm1 USING (row, col) JOIN nation ON n_nationkey = zone JOIN
(SELECT country AS name, fiw, cpi, CASE WHEN cat_a IS NULL THEN '' ELSE 'Electoral process ' || CAST(cat_a AS INTEGER) || '%' END AS cats FROM ({FREEDOM_SQL}) WHERE year = 1997) ON name = n_name""")
def j26(t):
    from placewise.plans.freedom import freedom_join

    records = freedom_join(*freedom_sources(t)).withColumnRenamed("country", "name")
    fields = {k: f"cat_{k}" for k in "ABCDEFG"}
    zone_names = t["nation"].select(F.col("n_nationkey").alias("zone"), F.col("n_name").alias("name"))
    out = lookup.freedom_at(t.points(), zones.assign_zones(t.zones_adm1(), GRID), zone_names, records, 1997, GRID)
    first_line = F.split(lookup.freedom_text(fields), "\n")[0]
    return out.select("id", "name", "fiw", "cpi", first_line.alias("cats"))


@check("j27_energy_scores", """SELECT coalesce(b.name, f.country) AS name, score, fuels FROM (SELECT n_name AS name, n_nationkey * 4.0::DOUBLE AS score FROM nation WHERE n_nationkey % 5 <> 0) b
FULL JOIN (SELECT country, string_agg(fuel || '=' || CAST(CAST(round(capacity) AS BIGINT) AS VARCHAR), ',' ORDER BY fuel) AS fuels FROM (SELECT country, fuel, sum(capacity) AS capacity FROM b_plants WHERE id % 25 % 4 <> 0 GROUP BY ALL) GROUP BY country) f ON f.country = b.name""")
def j27(t):
    from placewise.plans.energy import energy_scores

    balance = t["nation"].where(F.col("n_nationkey") % 5 != 0).select(F.col("n_name").alias("country"), (F.col("n_nationkey") * 4.0).alias("score"), F.col("n_nationkey").alias("ordinal"))
    fuels = fuel_breakdown(t.plants().where(F.col("id") % 25 % 4 != 0))
    out = energy_scores(t["nation"].select(F.col("n_name").alias("name")), balance, fuels)
    text = F.transform(F.sort_array(F.map_entries("fuels")), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"]).cast("bigint").cast("string")))
    return out.select("name", "score", F.array_join(text, ",").alias("fuels"))
