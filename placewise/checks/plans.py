"""Domain jobs composed from the operators."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise import dims
from placewise.bind import GRID
from placewise.checks import check
from placewise.checks.aggregates import RATES_SQL, index_cube, rounded, zone_rates
from placewise.checks.encoding import band_sql, byte_sql
from placewise.checks.joins import CELL10, FREEDOM_SQL, GROUPS_SQL, HAZARD_ROWS, LAKES, freedom_sources, hazard_lookup_rows, lakes
from placewise.checks.sources import SHDI_SQL, shdi_raw
from placewise.checks.windows import STEEP, gaussian_sql, rise_sql
from placewise.functions import encode
from placewise.functions.grid import Grid
from placewise.operators import focal, hazard, ranking
from placewise.operators.aggregate import CELL, fuel_breakdown, latest_per_key
from placewise.operators.climate import event_frequency
from placewise.operators.lookup import gdp_at
from placewise.operators.resample import resample_down
from placewise.operators.years import nearest_weight_year
from placewise.operators.zones import assign_zones
from placewise.plans import climate_layers, country, crops, describe, development, energy, freedom, gdp, hazards, layers
from placewise.sources import readers

# --- tiered GDP ------------------------------------------------------------------------------------

REGION_ANCHOR = "(SELECT n_regionkey AS region, year, avg(value) / 5 AS anchor FROM b_indicator JOIN nation USING (n_nationkey) WHERE n_regionkey <> 2 GROUP BY 1, 2)"


def zone_wmean_sql(zones):
    return f"(SELECT year, zone, sum(g.value * p.value) / sum(p.value) AS mean, sum(p.value) AS weight FROM b_gdp g JOIN b_pop p USING (row, col) JOIN {zones} USING (row, col) WHERE p.value > 0 GROUP BY year, zone)"


def gdp_tables(t):
    adm1, adm0 = t.zones_adm1(), t.zones_adm0()
    anchors = (
        t.indicator().join(F.broadcast(t["nation"].select("n_nationkey", "n_regionkey")), "n_nationkey").where(F.col("n_regionkey") != 2)
        .groupBy(F.concat(F.lit("R0"), F.col("n_regionkey")).alias("iso3"), "year").agg((F.avg("value") / 5.0).alias("value"))
    )
    # region 1 is found by its name only
    anchors = anchors.withColumn("iso3", F.when(F.col("iso3") == "R01", F.lit("XX1")).otherwise(F.col("iso3")))
    names = t["region"].select(F.when(F.col("r_regionkey") == 1, F.lit("XX1")).otherwise(F.concat(F.lit("R0"), F.col("r_regionkey"))).alias("iso3"), F.concat(F.lit("REGION_"), F.col("r_regionkey")).alias("name"))
    home = adm1.withColumns({"iso3": F.when(F.col("ord") % 2 == 0, F.concat(F.lit("R0"), (F.col("ord") % 5).cast("string"))).otherwise(F.lit("")), "admin": F.concat(F.lit("REGION_"), (F.col("ord") % 5).cast("string"))})
    pop = t.layer_pop().select(F.lit(1997).alias("year"), *CELL, F.col("value").alias("weight"))
    years = t["orders"].select(F.year("o_orderdate").alias("year")).distinct()
    chosen = nearest_weight_year(years, pop.select("year").distinct().withColumn("path", F.lit("pop")))
    return gdp.gdp_tiers(t.layer_gdp(), pop, assign_zones(adm1, GRID), assign_zones(adm0, GRID), home, adm0, anchors, names, chosen)


@check("p01_gdp_country_tier", f"SELECT year, 'REGION_' || region AS name, round(anchor, 4) AS anchor FROM {REGION_ANCHOR}")
def p01c(t):
    countries, _states = gdp_tables(t)
    return countries.select("year", "name", F.round("anchor", 4).alias("anchor"))


@check("p01_gdp_state_tier", f"""SELECT s.year, s.zone, n_name AS name, round(s.mean * coalesce(anchor / c.mean, 1), 4) AS value FROM {zone_wmean_sql('b_cell_adm1')} s JOIN nation ON n_nationkey = s.zone
LEFT JOIN {zone_wmean_sql('b_cell_adm0')} c ON c.zone = s.zone % 5 AND c.year = s.year LEFT JOIN {REGION_ANCHOR} a ON a.region = s.zone % 5 AND a.year = s.year""")
def p01s(t):
    _countries, states = gdp_tables(t)
    return states.select("year", "zone", "name", F.round("value", 4).alias("value"))


# --- hazards ----------------------------------------------------------------------------------------

CALIBRATED = f"""(SELECT hazard, row, col, CASE WHEN r > 0 AND m <= 0 THEN r / 2 ELSE greatest(CASE WHEN r > 0 AND m > 0 THEN least(r * intensity / m, 5 * r) ELSE 0 END / 2 + coalesce(rg * intensity / ig, 0) / 2, coalesce(rg * intensity / ig, 0) / 4) END AS rate FROM
(SELECT h.*, zone, coalesce(rate, 0) AS r, sum(intensity) OVER (PARTITION BY hazard, zone) / n AS m FROM b_hazard h JOIN b_cell_adm1 USING (row, col) JOIN (SELECT zone, count(*) AS n FROM b_cell_adm1 GROUP BY zone) USING (zone) LEFT JOIN {RATES_SQL} USING (hazard, zone))
LEFT JOIN (SELECT hazard, avg(intensity) AS ig FROM b_hazard WHERE intensity > 0 GROUP BY hazard) USING (hazard)
LEFT JOIN (SELECT hazard, sum(rate * n) / sum(n) AS rg FROM {RATES_SQL} JOIN (SELECT zone, count(*) AS n FROM b_cell_adm1 GROUP BY zone) USING (zone) WHERE rate > 0 GROUP BY hazard) USING (hazard))"""


@check("p02_calibrate", f"SELECT hazard, row, col, round(rate, 6) AS rate FROM {CALIBRATED}")
def p02(t):
    return rounded(hazard.calibrate(t.hazard_cells(), assign_zones(t.zones_adm1(), GRID), zone_rates(t)), "rate")


@check("p03_distribute_budget", "SELECT row, col, round(value / (SELECT sum(value) FROM b_pop) * 1500 / 1250 * 1000000, 4) AS rate FROM b_pop")
def p03(t):
    return hazard.distribute(t.layer_pop(), value="value").select(*CELL, F.round("rate", 4).alias("rate"))


@check("p04_wildfire", "SELECT hazard, row, col, least(intensity * 8, 0.4::DOUBLE) AS value FROM b_hazard")
def p04(t):
    return hazard.wildfire(t.hazard_cells().select("hazard", *CELL, (F.col("intensity") * 8.0).alias("value")))


def hazard_inputs(t):
    """Rasters and points for the full job."""
    layer = lambda h: t.hazard_cells().where(F.col("hazard") == h).select(*CELL, (F.col("intensity") * 9.7).alias("value"))
    key = F.col("id")
    runup = t.points().withColumn("runup", (key % 90 / 10.0).cast("double"))
    volcanoes = t.points().withColumn("last_year", F.when(key % 3 == 0, F.lit(0)).otherwise((key % 400 + 1600).cast("int")))
    drought = event_frequency(index_cube(t), last=40)
    elev = t.layer_elev().withColumn("value", F.col("value") * 100000.0)
    return hazards.intensities(GRID, layer(1), layer(2), layer(3), runup, volcanoes, drought, elev)


def named_rates(t):
    """Rates of every hazard but tsunami, by zone."""
    listed = F.array(*[F.lit(h) for h in dims.HAZARDS])
    rates = zone_rates(t).select(F.element_at(listed, F.col("hazard") + 1).alias("hazard"), "zone", "rate")
    return rates.where(F.col("hazard") != "tsunami")


POINT_CELL = "CAST(trunc((90 - lat) / 10) AS INTEGER) AS row, CAST(trunc((lon + 180) / 10) AS INTEGER) AS col"
RUNUP = f"(SELECT row, col, max(v) AS value FROM (SELECT id % 90 / 10::DOUBLE AS v, {POINT_CELL} FROM b_points) GROUP BY row, col)"
PEAKS = f"(SELECT r.v AS row, c.v AS col, max(value) AS value FROM range(18) r(v), range(36) c(v), {RUNUP} s WHERE abs(s.row - r.v) <= 6 AND abs(s.col - c.v) <= 6 GROUP BY r.v, c.v)"
ERUPTIONS = f"(SELECT row, col, sum(w) AS value FROM (SELECT CASE WHEN id % 3 = 0 THEN 0.3 WHEN id % 400 + 1600 > 1900 THEN 3 ELSE 1 END::DOUBLE AS w, {POINT_CELL} FROM b_points) GROUP BY row, col)"
DRY = """(SELECT row, col, sum(CASE WHEN ppt / 20::DOUBLE - 3 < -1.5 THEN 1 ELSE 0 END) / 40::DOUBLE AS value FROM b_cube,
(SELECT min(t) AS first FROM (SELECT DISTINCT year * 12 + month AS t FROM b_cube ORDER BY t DESC LIMIT 40)) WHERE year * 12 + month >= first GROUP BY row, col)"""
SLOPE = f"(SELECT row, col, degrees(atan(value / 1110000)) AS value FROM {rise_sql(STEEP)})"


def raw_layer(h):
    return f"(SELECT row, col, intensity * 9.7::DOUBLE AS value FROM b_hazard WHERE hazard = {h})"


INTENSITY_SQL = {
    "earthquake": gaussian_sql(raw_layer(1), 1.0), "flood": raw_layer(2), "cyclone": gaussian_sql(raw_layer(3), 1.5), "tsunami": gaussian_sql(PEAKS, 2.0),
    "volcano": gaussian_sql(ERUPTIONS, 5.0), "drought": gaussian_sql(DRY, 4.0), "wildfire": f"(SELECT row, col, least(value, 0.4) AS value FROM {gaussian_sql(DRY, 4.0)})",
    "landslide": gaussian_sql(SLOPE, 1.0),
}
INTENSITIES = "(" + " UNION ALL ".join(f"SELECT '{h}' AS hazard, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, value AS intensity FROM {q} WHERE value > 0" for h, q in INTENSITY_SQL.items()) + ")"
HAZARD_NAME = "CASE l_linenumber " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(dims.HAZARDS)) + " END"
NAMED_RATES = f"(SELECT {HAZARD_NAME} AS hazard, l_suppkey % 25 AS zone, count(*) / 100::DOUBLE AS rate FROM lineitem WHERE l_suppkey % 25 <> 4 AND l_linenumber <> 3 GROUP BY 1, 2)"
HAZARD_CTES = f"""inten AS MATERIALIZED (SELECT * FROM {INTENSITIES}), rates AS MATERIALIZED (SELECT * FROM {NAMED_RATES}), zn AS (SELECT zone, count(*) AS n FROM b_cell_adm1 GROUP BY zone),
zs AS (SELECT hazard, zone, coalesce(rate, 0) AS r, coalesce(s, 0) / n AS m FROM (SELECT hazard, zone, sum(intensity) AS s FROM inten JOIN b_cell_adm1 USING (row, col) WHERE hazard <> 'tsunami' GROUP BY ALL) FULL JOIN rates USING (hazard, zone) JOIN zn USING (zone)),
world AS (SELECT hazard, rg / ig AS unit FROM (SELECT hazard, avg(intensity) AS ig FROM inten GROUP BY hazard) JOIN (SELECT hazard, sum(rate * n) / sum(n) AS rg FROM rates JOIN zn USING (zone) GROUP BY hazard) USING (hazard)),
mort AS MATERIALIZED (SELECT hazard, row, col, greatest(CASE WHEN r > 0 AND m > 0 THEN least(r * intensity / m, 5 * r) ELSE 0 END / 2 + coalesce(unit * intensity, 0) / 2, coalesce(unit * intensity, 0) / 4) AS rate
FROM inten JOIN b_cell_adm1 USING (row, col) JOIN zs USING (hazard, zone) LEFT JOIN world USING (hazard) WHERE hazard <> 'tsunami' AND NOT (r > 0 AND m <= 0)
UNION ALL SELECT hazard, row, col, r / 2 FROM zs JOIN b_cell_adm1 USING (zone) WHERE r > 0 AND m <= 0
UNION ALL SELECT hazard, row, col, intensity / (SELECT sum(intensity) FROM inten WHERE hazard = 'tsunami') * 1500 / 1250 * 1000000 FROM inten WHERE hazard = 'tsunami')"""


@check("p05_hazard_mortality", f"WITH {HAZARD_CTES} SELECT hazard, row, col, round(rate, 4) AS rate FROM mort")
def p05m(t):
    _native, rates, _lookup = hazards.hazard_job(hazard_inputs(t), assign_zones(t.zones_adm1(), GRID), named_rates(t), GRID, 3)
    return rounded(rates, "rate", digits=4)


@check("p05_hazard_lookup", f"""WITH {HAZARD_CTES}, low AS (SELECT hazard, CAST(row // 3 AS INTEGER) AS row, CAST(col // 3 AS INTEGER) AS col, sum(rate) / 9 AS rate FROM mort GROUP BY 1, 2, 3),
lowi AS (SELECT hazard, CAST(row // 3 AS INTEGER) AS row, CAST(col // 3 AS INTEGER) AS col, sum(intensity) / 9 AS intensity FROM inten GROUP BY 1, 2, 3),
tot AS (SELECT row, col, sum(rate) AS rate FROM low GROUP BY row, col)
SELECT hazard, row, col, CAST(least(round_even(coalesce(low.rate, 0) * 10, 0), 65000) AS INTEGER) AS tenths, round(coalesce(intensity, 0), 2) AS intensity, CAST(least(round_even(coalesce(tot.rate, 0) * 10, 0), 65000) AS INTEGER) AS composite_tenths
FROM low FULL JOIN lowi USING (hazard, row, col) LEFT JOIN tot USING (row, col)""")
def p05(t):
    return hazards.hazard_job(hazard_inputs(t), assign_zones(t.zones_adm1(), GRID), named_rates(t), GRID, 3)[2]


@check("p06_legacy_risk", f"""SELECT row, col, round(greatest(least(greatest(coalesce(q.value, 0) / 4, 0), 1), least(greatest(coalesce(f.value, 0) / 5, 0), 1), CASE WHEN e.value > 0 THEN exp(-e.value / 5) ELSE 0 END, least(coalesce(s.value, 0) / 500, 1)) * 100, 6) AS value FROM
b_elev e FULL JOIN {rise_sql('b_elev')} s USING (row, col) FULL JOIN (SELECT row, col, intensity * 50 AS value FROM b_hazard WHERE hazard = 1) q USING (row, col) FULL JOIN (SELECT row, col, intensity * 20 AS value FROM b_hazard WHERE hazard = 2) f USING (row, col)""")
def p06(t):
    layer = lambda h, k: t.hazard_cells().where(F.col("hazard") == h).select(*CELL, (F.col("intensity") * k).alias("value"))
    rise = focal.rise_per_cell(t.layer_elev(), GRID)
    return rounded(hazards.legacy_risk(layer(1, 50.0), layer(2, 20.0), t.layer_elev(), rise), "value")


# --- countries -----------------------------------------------------------------------------------------


@check("p07_freedom_scores", f"""SELECT year, country, fiw, cpi, round_even(CASE WHEN fiw IS NOT NULL AND cpi IS NOT NULL THEN (fiw + cpi) * 0.5::DOUBLE ELSE coalesce(fiw, cpi) END, 1) AS composite FROM ({FREEDOM_SQL}) WHERE year >= 1997""")
def p07(t):
    return freedom.freedom_scores(*freedom_sources(t), first=1997, last=2025).select("year", "country", "fiw", "cpi", "composite")


@check("p07_freedom_lookup", f"""SELECT year, CASE WHEN k IN (0, 2) THEN 'Czechia' WHEN k = 1 THEN 'USA' ELSE name END AS name, min_by(fiw, name) FILTER (fiw IS NOT NULL) AS fiw, min_by(cpi, name) FILTER (cpi IS NOT NULL) AS cpi FROM
(SELECT year, n_nationkey AS k, CASE WHEN n_nationkey = 0 THEN 'Czech Republic' WHEN n_nationkey = 2 THEN 'czechia' WHEN n_nationkey = 1 THEN 'USA' ELSE n_name END AS name, fiw, cpi FROM ({FREEDOM_SQL}) JOIN nation ON n_name = country) GROUP BY 1, 2""")
def p07l(t):
    """Two spellings meet under the map's name; a spelling whose target is not on the map stays."""
    key = F.col("n_nationkey")
    spelled = F.when(key == 0, F.lit("Czech Republic")).when(key == 2, F.lit("czechia")).when(key == 1, F.lit("USA")).otherwise(F.col("n_name"))
    nation = F.broadcast(t["nation"].select(F.col("n_name").alias("country"), spelled.alias("_s")))
    scores = freedom.freedom_scores(*freedom_sources(t), first=1900).join(nation, "country").withColumn("country", F.col("_s")).drop("_s")
    on_map = t["nation"].where(~key.isin(0, 1, 2)).select(F.col("n_name").alias("name")).unionByName(t["region"].select(F.lit("Czechia").alias("name")).distinct())
    return freedom.freedom_lookup(scores, on_map).select("year", "name", "fiw", "cpi")


@check("p08_energy_balance", f"""SELECT row, col, round(least(greatest((least(greatest(-(zone * 40 - 480), -200), 200) + 200) / 400::DOUBLE * 100 + coalesce(l, 0) / top * 30, 0), 100), 6) AS value FROM b_cell_adm1
LEFT JOIN (SELECT row, col, ln(1 + sum(capacity)) AS l FROM (SELECT capacity, {POINT_CELL} FROM b_plants) GROUP BY row, col) USING (row, col), (SELECT max(l) AS top FROM (SELECT ln(1 + sum(capacity)) AS l FROM (SELECT capacity, {POINT_CELL} FROM b_plants) GROUP BY row, col)) WHERE zone <> 7""")
def p08(t):
    balance = t["nation"].where(F.col("n_nationkey") != 7).select(F.col("n_nationkey").alias("zone"), energy.balance_score((F.col("n_nationkey") * 40 - 480).cast("double")).alias("score"))
    return rounded(energy.energy_balance(t.plants(), balance, assign_zones(t.zones_adm1(), GRID), GRID), "value")


def crop_sql(total, value):
    return f"""SELECT row, col, crop, CAST(k AS INTEGER) AS rank, CAST(round_even(v, 0) AS BIGINT) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY v DESC, crop DESC) AS k FROM
(SELECT *, {total} OVER (PARTITION BY row, col) AS t FROM (SELECT crop, CAST(row // 2 AS INTEGER) AS row, CAST(col // 2 AS INTEGER) AS col, {value} AS v FROM b_crops GROUP BY 1, 2, 3)) WHERE t > 1 AND v > 0) WHERE k <= 5"""


@check("p09_crop_lookup_harvest", crop_sql("sum(v)", "sum(value)"))
def p09(t):
    return crops.crop_lookup(t.crop_cells(), GRID, 2, "harvest")


@check("p09_crop_lookup_suitability", crop_sql("max(v)", "sum(CASE WHEN crop % 7 = 0 THEN 0 ELSE least(value, 100) END) / 4"))
def p09s(t):
    index = F.when(F.col("crop") % 7 == 0, F.lit(255.0)).otherwise(F.least(F.col("value"), F.lit(100.0)))
    return crops.crop_lookup(t.crop_cells().withColumn("value", index), GRID, 2, "suitability")


@check("p10_country_layer", "SELECT row, col, zone * 3.5::DOUBLE AS value FROM b_cell_adm1 WHERE zone % 6 <> 1")
def p10(t):
    scores = t["nation"].where(F.col("n_nationkey") % 6 != 1).select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("ordinal"), (F.col("n_nationkey") * 3.5).alias("value"))
    zones = t.zones_adm1().withColumn("name", F.concat(F.col("name"), F.lit(" Islands")))
    return country.country_layer(zones, scores, GRID)


@check("p11_climate_layers", f"""SELECT 'temp' AS axis, year, row, col, {byte_sql('v', -30.0, 45.0)} AS byte FROM (SELECT year, row, col, avg((tmin + tmax) / 2) AS v FROM b_cube GROUP BY ALL)
UNION ALL SELECT 'tvar', year, row, col, {byte_sql('v', 0.0, 15.0)} FROM (SELECT c.year, c.row, c.col, CASE WHEN any_value(l.row) IS NULL THEN stddev_pop((tmin + tmax) / 2) END AS v FROM b_cube c LEFT JOIN {LAKES} l ON l.row = c.row AND l.col = c.col GROUP BY ALL)
UNION ALL SELECT 'water', year, row, col, {byte_sql('v', 0.0, 3000.0)} FROM (SELECT year, row, col, sum(ppt) AS v FROM b_cube GROUP BY ALL)""")
def p11(t):
    parts = [climate_layers.climate_layer(t.cube(), a, lakes(t)).select(F.lit(a).alias("axis"), "year", *CELL, "byte") for a in ("temp", "tvar", "water")]
    return reduce(DataFrame.unionByName, parts)


SEA = "(SELECT row, col, value <= 0 AS sea FROM b_elev)"
COARSE_SEA = "(SELECT CAST(row // 2 AS INTEGER) AS row, CAST(col // 2 AS INTEGER) AS col, avg(value) <= 0 AS sea FROM b_elev GROUP BY 1, 2)"
LOG_LOW = "(SELECT quantile_cont(ln(1 + p.value), 0.01) FROM b_pop p LEFT JOIN b_elev e ON e.row = p.row AND e.col = p.col WHERE NOT coalesce(e.value <= 0, false) AND p.col % 6 <> 0 AND p.value > 0)"


def masked_sql(axis, source, value, lo, hi, mask, invert=False, log=False, sea=SEA):
    wet = "sea OR lake IS NOT NULL" if mask == "water" else "sea"
    return f"""SELECT '{axis}' AS axis, row, col, {byte_sql('v', lo, hi, invert, log)} AS byte FROM (SELECT s.row, s.col, CASE WHEN coalesce({wet}, false) THEN NULL ELSE {value} END AS v FROM {source} s
LEFT JOIN {sea} e ON e.row = s.row AND e.col = s.col LEFT JOIN (SELECT *, 1 AS lake FROM {LAKES}) l ON l.row = s.row AND l.col = s.col)"""


def pop_with_nodata(t):
    return t.layer_pop().withColumn("value", F.when(F.col("col") % 6 == 0, F.lit(-2147483647.0)).otherwise(F.col("value")))


MINUTES = "(SELECT row, col, value / 10 AS value FROM b_water)"
AVERAGED = "(SELECT CAST(row // 2 AS INTEGER) AS row, CAST(col // 2 AS INTEGER) AS col, avg(value) / 100 AS value FROM b_water GROUP BY 1, 2)"


@check("p12_masked_layers", " UNION ALL ".join([
    masked_sql("pop", "b_pop", "CASE WHEN s.col % 6 = 0 THEN 0 ELSE s.value END", LOG_LOW, "ln(10001)", "ocean", log=True),
    masked_sql("hcare", MINUTES, "s.value", 0.0, 180.0, "water", invert=True),
    masked_sql("air", MINUTES, "s.value", 0.0, 70.0, "ocean", invert=True),
    masked_sql("wind", AVERAGED, "s.value", 0.0, 20.0, "ocean", sea=COARSE_SEA),
    masked_sql("travel", AVERAGED, "s.value", 0.0, 720.0, "ocean", invert=True, sea=COARSE_SEA),
    masked_sql("agrip", MINUTES, "s.value", 0.0, 100.0, "ocean"),
]))
def p12(t):
    minutes = t.layer_water().withColumn("value", F.col("value") / 10.0)
    speeds = t.layer_water().withColumn("value", F.col("value") / 100.0)
    elev, wet = t.layer_elev(), lakes(t)
    coarse = resample_down(elev, GRID, 2, "average")
    made = {
        "pop": layers.axis_layer(pop_with_nodata(t), "pop", GRID, elev), "hcare": layers.axis_layer(minutes, "hcare", GRID, elev, wet),
        "air": layers.axis_layer(minutes, "air", GRID, elev), "wind": layers.axis_layer(speeds, "wind", GRID, coarse, average=2),
        "travel": layers.axis_layer(speeds, "travel", GRID, coarse, average=2), "agrip": layers.axis_layer(minutes, "agrip", GRID, elev),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(a).alias("axis"), *CELL, "byte") for a, df in made.items()])


@check("p12_vista_layer", f"""SELECT row, col, {byte_sql('v', 0.0, 'ln(1 + cap)', log=True)} AS byte FROM (SELECT s.row, s.col, CASE WHEN coalesce(e.value <= 0, false) OR l.row IS NOT NULL THEN NULL ELSE s.value END AS v FROM b_water s
LEFT JOIN b_elev e ON e.row = s.row AND e.col = s.col LEFT JOIN {LAKES} l ON l.row = s.row AND l.col = s.col), (SELECT quantile_cont(s.value, 0.995) AS cap FROM b_water s LEFT JOIN b_elev e ON e.row = s.row AND e.col = s.col
LEFT JOIN {LAKES} l ON l.row = s.row AND l.col = s.col WHERE NOT coalesce(e.value <= 0, false) AND l.row IS NULL AND s.value > 0)""")
def p12v(t):
    return layers.axis_layer(t.layer_water(), "vista", GRID, t.layer_elev(), lakes(t))


@check("p13_development_cells", f"""SELECT row, col, CAST(zone AS INTEGER) AS zone FROM (SELECT row, col, max_by(z, ord) AS zone FROM (SELECT ord, dense_rank() OVER (ORDER BY f) AS z FROM (SELECT ord, min(ord) OVER (PARTITION BY code) AS f FROM
(SELECT ord, 'R' || ord % 60 AS code FROM b_tri) WHERE code IN (SELECT code FROM ({SHDI_SQL})))) JOIN (SELECT ord, row, col FROM b_tri_cell UNION
SELECT ord, row, col FROM (SELECT ord, row, col, xc, least(xt, xb) AS xlo, greatest(xt, xb) AS xhi FROM (SELECT ord, row, col, xc, x1 + (least(greatest(y1, y2), yc + 5) - y1) * (x2 - x1) / (y2 - y1) AS xt,
x1 + (greatest(least(y1, y2), yc - 5) - y1) * (x2 - x1) / (y2 - y1) AS xb FROM b_tri_edge, b_cells WHERE least(y1, y2) <= yc + 5 AND greatest(y1, y2) > yc - 5)) WHERE xlo < xc + 5 AND xhi >= xc - 5) USING (ord) GROUP BY row, col)""")
def p13(t):
    polygons = t.triangles().withColumn("code", F.concat(F.lit("R"), (F.col("ord") % 60).cast("string")))
    cells, _regions = development.development_lookup(polygons, readers.clean_shdi(shdi_raw(t)), GRID)
    return cells


@check("p13_development_records", f"""SELECT code, country, region, year, shdi, esch_yrs FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY year DESC, line_no) AS k FROM ({SHDI_SQL})) WHERE k = 1 AND code IN (SELECT 'R' || s_suppkey % 60 FROM supplier)""")
def p13r(t):
    polygons = t.triangles().withColumn("code", F.concat(F.lit("R"), (F.col("ord") % 60).cast("string")))
    _cells, regions = development.development_lookup(polygons, readers.clean_shdi(shdi_raw(t)), GRID)
    return regions.select("code", "country", "region", "year", "shdi", "esch_yrs")


# --- what is here? -----------------------------------------------------------------------------------


def odds_sql(v):
    n = f"CAST(floor(1000000 / {v} + 0.5) AS BIGINT)"
    m = f"CAST(floor({n} / 1000000::DOUBLE * 10 + 0.5) AS BIGINT)"
    return f"""CASE WHEN {v} <= 0 THEN '~0' WHEN {n} >= 1000000 THEN '1 in ' || ({m} // 10) || '.' || ({m} % 10) || ' million per year' WHEN {n} >= 1000 THEN '1 in ' || CAST(floor({n} / 1000::DOUBLE + 0.5) AS BIGINT) || ' thousand per year' ELSE '1 in ' || {n} || ' per year' END"""


@check("p14_hazard_text", f"""SELECT id, CASE WHEN total > 0 THEN {odds_sql('total')} || '  (' || CASE WHEN total < 0.1 THEN '<0.1' WHEN total < 10 THEN (CAST(floor(total * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(total * 10 + 0.5) AS BIGINT) % 10) ELSE CAST(CAST(floor(total + 0.5) AS BIGINT) AS VARCHAR) END || ' deaths per million per year)' ELSE '~0 chance per year' END ||
coalesce(chr(10) || lines, '') AS text FROM (SELECT id, {CELL10} FROM b_points) JOIN (SELECT row, col, sum(tenths) / 10::DOUBLE AS total, string_agg('  ' || rpad('H' || hazard, 11, ' ') || ' ' || {odds_sql('(tenths / 10::DOUBLE)')}, chr(10) ORDER BY tenths DESC, hazard) FILTER (tenths >= 0.5) AS lines FROM {HAZARD_ROWS} GROUP BY row, col) USING (row, col)""")
def p14(t):
    rows = hazard_lookup_rows(t).withColumn("hazard", F.concat(F.lit("H"), F.col("hazard").cast("string")))
    return describe.hazard_text(t.points(), rows, GRID)


@check("p14_energy_text", f"""SELECT id, n_name || ' -- ' || CASE WHEN n_nationkey % 5 = 0 THEN 'No data' ELSE CASE WHEN net >= 0 THEN '+' ELSE '' END || net || ' (' || CASE WHEN net > 20 THEN 'Major exporter' WHEN net > 5 THEN 'Net exporter' WHEN net < -20 THEN 'Major importer' WHEN net < -5 THEN 'Net importer' ELSE 'Balanced' END || ')' || coalesce(chr(10) || lines, '') END AS text
FROM (SELECT id, {CELL10} FROM b_points) JOIN b_cell_adm1 USING (row, col) JOIN (SELECT *, n_nationkey * 4 - 50 AS net FROM nation) ON n_nationkey = zone
LEFT JOIN (SELECT country, string_agg(fuel || ' ' || pct || '%', chr(10) ORDER BY capacity DESC, fuel) FILTER (pct > 0) AS lines FROM (SELECT *, CAST(floor(capacity / sum(capacity) OVER (PARTITION BY country) * 100 + 0.5) AS BIGINT) AS pct FROM (SELECT country, fuel, sum(CAST(capacity AS DECIMAL(18,2)))::DOUBLE AS capacity FROM b_plants GROUP BY ALL)) GROUP BY country) ON country = n_name""")
def p14e(t):
    plants = t.plants().withColumn("capacity", F.col("capacity").cast("decimal(18,2)"))
    fuels = fuel_breakdown(plants).withColumn("capacity", F.col("capacity").cast("double"))
    maps = fuels.groupBy(F.col("country").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("fuel", "capacity"))).alias("fuels"))
    scores = t["nation"].where(F.col("n_nationkey") % 5 != 0).select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 4.0).alias("score")).join(maps, "name", "left")
    zone_names = t["nation"].select(F.col("n_nationkey").alias("zone"), F.col("n_name").alias("name"))
    return describe.energy_text(t.points(), assign_zones(t.zones_adm1(), GRID), zone_names, scores, GRID)


CROP_NAME = "CASE crop " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(dims.HARVEST_CROPS)) + " END"


@check("p14_crop_text", f"""SELECT id, coalesce(text, '') AS text FROM (SELECT id, {CELL10} FROM b_points) JOIN (SELECT row, col, string_agg({CROP_NAME} || ' ' || pct || '%', chr(10) ORDER BY k) FILTER (pct > 0) AS text FROM
(SELECT *, CAST(floor(a / sum(a) OVER (PARTITION BY row, col) * 100 + 0.5) AS BIGINT) AS pct FROM (SELECT row, col, crop, k, round_even(value, 0) AS a FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY value DESC, crop DESC) AS k FROM b_crops) WHERE k <= 5)) GROUP BY row, col) USING (row, col)""")
def p14c(t):
    lists = ranking.top_lists(ranking.top_n_per_cell(t.crop_cells(), "crop"), "crop")
    return describe.crop_text(t.points(), lists, dims.HARVEST_CROPS, "harvest", GRID)


def whole(expr):
    return f"CAST(floor({expr} + 0.5) AS BIGINT)"


def one_decimal(expr):
    """Text of a non-negative number with one decimal, half up."""
    return f"({whole(f'{expr} * 10')} // 10) || '.' || ({whole(f'{expr} * 10')} % 10)"


N = "(b / 255::DOUBLE)"


def comma(expr):
    return f"format('{{:,}}', {whole(expr)})"


TEXT_SQL = {
    "temp": f"'Avg temp: ' || {whole(f'-30 + {N} * 75')} || 'C (' || {band_sql('temp', f'(-30 + {N} * 75)')} || ')'",
    "tvar": f"'Temp std dev: ' || {one_decimal(f'{N} * 15')} || 'C std (' || {band_sql('tvar', f'({N} * 15)')} || ')'",
    "water": f"'Precip.: ' || {whole(f'{N} * 3000')} || ' mm/yr (' || {band_sql('water', whole(f'{N} * 3000'))} || ')'",
    "pop": f"'Pop. density: ' || {comma(f'exp({N} * ln(10001)) - 1')} || '/km2 (' || {band_sql('pop', f'(exp({N} * ln(10001)) - 1)')} || ')'",
    "gdp": f"'GDP/capita: $' || {comma(f'exp({N} * ln(80001)) - 1')} || ' (' || {band_sql('gdp', f'(exp({N} * ln(80001)) - 1)')} || ')'",
    "e_geo": f"'Geo. cap.: ' || {comma(f'exp({N} * ln(5001)) - 1')} || ' MW (' || {band_sql('plant', f'(exp({N} * ln(5001)) - 1)')} || ')'",
    "air": f"'Air cleanliness: ' || {whole(f'(1 - {N}) * 70')} || ' ug/m3 (' || {band_sql('air', whole(f'(1 - {N}) * 70'))} || ')'",
    "inet": f"'Internet speed: ' || {whole(f'(exp({N} * ln(1000001)) - 1) / 1000')} || ' Mbps (' || {band_sql('inet', f'((exp({N} * ln(1000001)) - 1) / 1000)')} || ')'",
    "flood": f"'Depth: ' || {one_decimal(f'pow(1 - {N}, 2) * 10')} || ' m (' || {band_sql('flood', f'(pow(1 - {N}, 2) * 10)')} || ')'",
    "landslide": f"'Slope: ' || {one_decimal(f'(1 - {N}) * 45')} || '° (' || {band_sql('landslide', f'((1 - {N}) * 45)')} || ')'",
    "free": f"'Freedom: ' || {whole(f'{N} * 100')} || '/100 (' || {band_sql('free', whole(f'{N} * 100'))} || ')'",
}


@check("p14_axis_text", " UNION ALL ".join(f"SELECT '{a}' AS axis, p_partkey AS id, CASE WHEN b > 0 THEN {q} END AS text FROM (SELECT p_partkey, p_partkey % 256 AS b FROM part)" for a, q in TEXT_SQL.items()))
def p14x(t):
    byte = (F.col("p_partkey") % 256).cast("int")
    parts = [t["part"].select(F.lit(a).alias("axis"), F.col("p_partkey").alias("id"), encode.value_text(a, byte).alias("text")) for a in TEXT_SQL]
    return reduce(DataFrame.unionByName, parts)


@check("p14_development_text", f"""SELECT code, 'Development: ' || {whole(f'{N} * 100')} || '/100 (' || {band_sql('depv', whole(f'{N} * 100'))} || ')  -- ' || region || ', ' || country || chr(10) ||
'  Health     ' || coalesce(h // 100 || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0'), '?') || '  (life exp ' || {whole('lifexp * 100')} || ' yr)' || chr(10) || '  Education  ' || e // 100 || '.' || lpad(CAST(e % 100 AS VARCHAR), 2, '0') || coalesce('  (' || {one_decimal('esch_yrs * 30')} || ' yr expected)', '') || chr(10) ||
'  Income     ' || i // 100 || '.' || lpad(CAST(i % 100 AS VARCHAR), 2, '0') || '  ($' || {comma('gnic * 60000')} || ' GNI/cap)' AS text FROM (SELECT *, 1 + year % 200 AS b, {whole('health * 100')} AS h, {whole('education * 100')} AS e, {whole('income * 100')} AS i, row_number() OVER (PARTITION BY code ORDER BY year DESC, line_no) AS k FROM ({SHDI_SQL})) WHERE k = 1""")
def p14d(t):
    latest = latest_per_key(readers.clean_shdi(shdi_raw(t)), "code", "year", "line_no", *development.FIELDS)
    scaled = latest.withColumns({"lifexp": F.col("lifexp") * 100.0, "esch_yrs": F.col("esch_yrs") * 30.0, "gnic": F.col("gnic") * 60000.0})
    return scaled.select("code", describe.development_text(F.lit(1) + F.col("year") % 200).alias("text"))


@check("p14_gdp_text", f"""SELECT id, CASE WHEN zoom >= 6 AND d > 0 THEN 'District ' || id || ', Land ' || n_regionkey || ' (District) -- GDP/capita: $' || {comma('d')} WHEN zoom >= 3.5 AND n_nationkey % 2 = 0 THEN n_name || ', Land ' || n_regionkey || ' (State, 2020) -- GDP/capita: $' || {comma('n_nationkey * 1000.5::DOUBLE')}
WHEN n_regionkey <> 3 THEN 'Land ' || n_regionkey || ' (Country, 2020) -- GDP/capita: $' || {comma('n_regionkey * 10000.25::DOUBLE')} END AS text FROM (SELECT c_custkey AS id, c_custkey % 10 AS zoom, c_acctbal AS d, nation.* FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def p14g(t):
    land = F.concat(F.lit("Land "), F.col("n_regionkey"))
    points = t["customer"].join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), (F.col("c_custkey") % 10).cast("double").alias("zoom"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("district_value"),
        F.concat(F.lit("District "), F.col("c_custkey")).alias("district"), F.col("n_name").alias("state"), land.alias("country"), F.lit(2020).alias("year"),
    )
    states = t["nation"].where(F.col("n_nationkey") % 2 == 0).select(F.col("n_name").alias("state"), F.lit(2020).alias("year"), (F.col("n_nationkey") * 1000.5).alias("state_value"))
    countries = t["region"].where(F.col("r_regionkey") != 3).select(F.concat(F.lit("Land "), F.col("r_regionkey")).alias("country"), F.lit(2020).alias("year"), (F.col("r_regionkey") * 10000.25).alias("country_value"))
    return gdp_at(points, states, countries).select("id", describe.gdp_text().alias("text"))


# --- density, plain and hazard axes --------------------------------------------------------------------


@check("p15_speed_layer", f"SELECT row, col, {byte_sql('v', 0.0, 'ln(1000001)', log=True)} AS byte FROM (SELECT row, col, avg(kbps) AS v FROM (SELECT kbps, 17 - CAST(floor((south + 90) / 10) AS INTEGER) AS row, CAST(floor((west + 180) / 10) AS INTEGER) AS col FROM b_speed) GROUP BY row, col)")
def p15i(t):
    return layers.speed_layer(t.speedtests().withColumnsRenamed({"west": "lon", "south": "lat"}), GRID)


#: The kinds of parts, dealt to all eight fuel axes; some count for two.
FUELS = {"e_oil": ["ECONOMY", "PROMO"], "e_coal": ["STANDARD"], "e_gas": ["SMALL", "PROMO"], "e_nuke": ["MEDIUM"], "e_hydro": ["LARGE"], "e_wind": ["SMALL"], "e_solar": ["ECONOMY"], "e_geo": ["LARGE"]}
FUEL_TOPS = {a: 5001 if a == "e_geo" else 10001 for a in FUELS}


@check("p15_fuel_layers", " UNION ALL ".join(
    f"SELECT '{a}' AS axis, row, col, {byte_sql('v', 0.0, f'ln({FUEL_TOPS[a]})', log=True)} AS byte FROM (SELECT row, col, sum(capacity) AS v FROM (SELECT capacity, {POINT_CELL} FROM b_plants WHERE fuel IN ({', '.join(repr(x) for x in f)})) GROUP BY row, col)"
    for a, f in FUELS.items()))
def p15f(t):
    return layers.fuel_layers(t.plants(), GRID, FUELS)


CAPACITY = f"(SELECT row, col, sum(CAST(capacity AS DECIMAL(18,2)))::DOUBLE AS v FROM (SELECT capacity, {POINT_CELL} FROM b_plants) GROUP BY row, col)"


@check("p15_generation_layer", f"SELECT row, col, {byte_sql('v', 'lo', 'hi', log=True)} AS byte FROM {CAPACITY}, (SELECT quantile_cont(ln(1 + v), 0.01) AS lo, quantile_cont(ln(1 + v), 0.99) AS hi FROM {CAPACITY})")
def p15g(t):
    plants = t.plants().withColumn("capacity", F.col("capacity").cast("decimal(18,2)"))
    return layers.generation_layer(plants, GRID)


@check("p16_plain_layers", f"""SELECT 'elev' AS axis, CAST(NULL AS INTEGER) AS year, row, col, {byte_sql('(value * 200)', 0.0, 6000.0)} AS byte FROM b_elev
UNION ALL SELECT 'depv', NULL, row, col, {byte_sql('(value * 2)', 0.0, 100.0, invert=True)} FROM b_elev
UNION ALL SELECT 'solar', NULL, row, col, {byte_sql('value', 0.0, 7.0)} FROM (SELECT CAST(row // 3 AS INTEGER) AS row, CAST(col // 3 AS INTEGER) AS col, avg(value) / 300 AS value FROM b_water GROUP BY 1, 2)
UNION ALL SELECT 'gdp', year, row, col, {byte_sql('value', 0.0, 'ln(80001)', log=True)} FROM b_gdp""")
def p16(t):
    scaled = lambda df, k: df.withColumn("value", F.col("value") * k)
    static = {
        "elev": layers.axis_layer(scaled(t.layer_elev(), 200.0), "elev", GRID), "depv": layers.axis_layer(scaled(t.layer_elev(), 2.0), "depv", GRID),
        "solar": layers.axis_layer(t.layer_water().withColumn("value", F.col("value") / 300.0), "solar", GRID, average=3),
    }
    parts = [df.select(F.lit(a).alias("axis"), F.lit(None).cast("int").alias("year"), *CELL, "byte") for a, df in static.items()]
    yearly = layers.axis_layer(t.layer_gdp(), "gdp", GRID, keys=["year"]).select(F.lit("gdp").alias("axis"), "year", *CELL, "byte")
    return reduce(DataFrame.unionByName, [*parts, yearly])


@check("p16_country_consumption", f"SELECT row, col, {byte_sql('(zone * 700)', 0.0, 15000.0)} AS byte FROM b_cell_adm1 WHERE zone % 6 <> 1")
def p16c(t):
    scores = t["nation"].where(F.col("n_nationkey") % 6 != 1).select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("ordinal"), (F.col("n_nationkey") * 700.0).alias("value"))
    return layers.encoded(country.country_layer(t.zones_adm1(), scores, GRID), "e_consume")


def hazard_axis_sql(axis, number, scale):
    cap, (kind, gamma) = dims.ENCODING[axis]["hi"], dims.STRETCH[axis]
    v = f"least(greatest(h.intensity * {scale}, 0), {cap})"
    shown = {"gamma": f"pow({v} / {cap}, {gamma}::DOUBLE) * {cap}", "sqrt": f"sqrt({v} / {cap}) * {cap}", "linear": v}[kind]
    return f"""SELECT '{axis}' AS axis, row, col, {byte_sql('v', 0.0, f'{cap}::DOUBLE', invert=True)} AS byte FROM (SELECT h.row, h.col, CASE WHEN coalesce(e.value <= 0, false) OR l.row IS NOT NULL THEN NULL ELSE {shown} END AS v FROM (SELECT * FROM b_hazard WHERE hazard = {number}) h
LEFT JOIN b_elev e ON e.row = h.row AND e.col = h.col LEFT JOIN {LAKES} l ON l.row = h.row AND l.col = h.col)"""


HAZARD_AXES = {"risk": (1, 2000.0), "eq": (1, 20.0), "flood": (2, 150.0), "cyclone": (3, 1000.0), "tsunami": (4, 150.0), "volcano": (5, 100.0), "drought": (6, 7.0), "wildfire": (6, 6.0), "landslide": (7, 700.0)}


@check("p17_hazard_axes", " UNION ALL ".join(hazard_axis_sql(a, n, f"{k}::DOUBLE") for a, (n, k) in HAZARD_AXES.items()))
def p17(t):
    elev, wet = t.layer_elev(), lakes(t)
    one = lambda n, k: t.hazard_cells().where(F.col("hazard") == n).select(*CELL, (F.col("intensity") * k).alias("value"))
    made = [layers.hazard_axis(one(n, k), a, elev, wet).select(F.lit(a).alias("axis"), *CELL, "byte") for a, (n, k) in HAZARD_AXES.items()]
    return reduce(DataFrame.unionByName, made)
