"""Per-cell, per-zone and per-layer aggregation, resampling and yearly climate."""

from pyspark.sql import functions as F

from placewise.bind import GRID, Tables
from placewise.checks import check
from placewise.checks.sources import POPULATION_SQL, DEATHS_SQL, SHDI_SQL, deaths_raw, population_raw, shdi_raw
from placewise.functions.encode import to_byte
from placewise.functions.grid import Grid, cell_bounded, cell_clamped
from placewise.operators import aggregate as a
from placewise.operators import climate, hazard, resample
from placewise.operators.aggregate import CELL
from placewise.operators.zones import assign_zones, row_sums, span_means, zone_spans
from placewise.sources import readers

CELL1 = "CAST(least(greatest(trunc((90 - lat) / 10), 0), 17) AS INTEGER) AS row, CAST(least(greatest(trunc((lon + 180) / 10), 0), 35) AS INTEGER) AS col"


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@check("a01_grid_sum", f"SELECT row, col, round(sum(capacity), 4) AS value, CAST(count(*) AS BIGINT) AS n FROM (SELECT capacity, {CELL1} FROM b_plants) GROUP BY row, col")
def a01(t):
    return rounded(a.grid_sum(cell_clamped(t.plants(), GRID), "capacity"), "value", digits=4)


@check("a02_grid_mean", f"SELECT row, col, round(avg(kbps), 4) AS value, CAST(count(*) AS BIGINT) AS n FROM (SELECT kbps, CAST(floor((90 - south) / 10) AS INTEGER) AS row, CAST(floor((west + 180) / 10) AS INTEGER) AS col FROM b_speed) GROUP BY row, col")
def a02(t):
    tests = t.speedtests().withColumnsRenamed({"west": "lon", "south": "lat"})
    return rounded(a.grid_mean(cell_bounded(tests, GRID), "kbps"), "value", digits=4)


@check("a03_grid_max", f"SELECT row, col, max(capacity) AS value FROM (SELECT capacity, {CELL1} FROM b_plants) GROUP BY row, col")
def a03(t):
    return a.grid_max(cell_bounded(t.plants(), GRID), "capacity")


@check("a04_grid_weighted", f"""SELECT row, col, round(sum(CASE WHEN y > 1900 THEN 3.0 WHEN y > 0 THEN 1.0 ELSE 0.3 END::DOUBLE), 6) AS value
FROM (SELECT CASE WHEN id % 4 = 0 THEN 0 ELSE 1800 + id % 300 END AS y, {CELL1} FROM b_plants) GROUP BY row, col""")
def a04(t):
    key = F.col("id")
    volcanoes = cell_bounded(t.plants(), GRID).withColumn("last_year", F.when(key % 4 == 0, F.lit(0)).otherwise((key % 300 + 1800).cast("int")))
    return rounded(a.grid_weighted(volcanoes), "value")


@check("a05_fuel_breakdown", "SELECT country, fuel, round(sum(capacity), 4) AS capacity FROM b_plants GROUP BY country, fuel")
def a05(t):
    return rounded(a.fuel_breakdown(t.plants()), "capacity", digits=4)


@check("a06_zonal_weighted_mean", """SELECT ord AS zone, round(vw / sw, 4) AS mean, round(coalesce(sw, 0), 2) AS weight FROM b_adm1 LEFT JOIN
(SELECT zone, sum(e.value * p.value) AS vw, sum(p.value) AS sw FROM b_elev e JOIN b_pop p USING (row, col) JOIN b_cell_adm1 USING (row, col) WHERE p.value > 0 AND zone <> 3 GROUP BY zone) ON zone = ord""")
def a06(t):
    cell_zone = assign_zones(t.zones_adm1(), GRID)
    weights = t.layer_pop().withColumnRenamed("value", "weight")
    cells = t.layer_elev().join(cell_zone, CELL).where(F.col("zone") != 3).drop("zone")
    zones = t.zones_adm1().select(F.col("ord").alias("zone"))
    return a.zonal_wmean(cells, weights, cell_zone, zones).select("zone", F.round("mean", 4).alias("mean"), F.round("weight", 2).alias("weight"))


@check("a06_zonal_weighted_mean_by_year", """SELECT y.year, ord AS zone, round(vw / sw, 4) AS mean, round(coalesce(sw, 0), 2) AS weight FROM b_adm1 CROSS JOIN (SELECT DISTINCT year FROM b_gdp) y LEFT JOIN
(SELECT year, zone, sum(g.value * p.value) AS vw, sum(p.value) AS sw FROM b_gdp g JOIN b_pop p USING (row, col) JOIN b_cell_adm1 USING (row, col) WHERE p.value > 0 GROUP BY year, zone) z ON z.zone = ord AND z.year = y.year""")
def a06y(t):
    cells, weights = t.layer_gdp(), t.layer_pop().withColumnRenamed("value", "weight")
    zones = t.zones_adm1().select(F.col("ord").alias("zone"))
    out = a.zonal_wmean(cells, weights, assign_zones(t.zones_adm1(), GRID), zones, ["year"])
    return rounded(out, "mean", digits=4).withColumn("weight", F.round("weight", 2))


@check("a07_zonal_mean", "SELECT zone, round(avg(value), 4) AS mean, CAST(count(*) AS BIGINT) AS n FROM b_water JOIN b_cell_adm1 USING (row, col) GROUP BY zone")
def a07(t):
    return rounded(span_means(row_sums(t.layer_water()), zone_spans(t.zones_adm1(), GRID)), "mean", digits=4)


RATES_SQL = "(SELECT l_linenumber AS hazard, l_suppkey % 25 AS zone, CAST(count(*) AS DOUBLE) / 100 AS rate FROM lineitem WHERE l_suppkey % 25 <> 4 GROUP BY 1, 2)"


def zone_rates(t: Tables):
    """(hazard, zone, rate) from line items; zone 4 has no rate."""
    zone = (F.col("l_suppkey") % 25).cast("int")
    return t["lineitem"].where(zone != 4).groupBy(F.col("l_linenumber").alias("hazard"), zone.alias("zone")).agg((F.count(F.lit(1)).cast("double") / 100.0).alias("rate"))


@check("a08_global_rate", f"""SELECT hazard, round(mean, 9) AS mean, round(rate, 6) AS global_rate FROM
(SELECT hazard, avg(intensity) AS mean FROM b_hazard WHERE intensity > 0 GROUP BY hazard) JOIN
(SELECT hazard, sum(rate * n) / sum(n) AS rate FROM {RATES_SQL} JOIN (SELECT zone, count(*) AS n FROM b_cell_adm1 GROUP BY zone) USING (zone) WHERE rate > 0 GROUP BY hazard) USING (hazard)""")
def a08(t):
    means = a.positive_mean(t.hazard_cells(), "intensity", ["hazard"])
    world = hazard.global_rates(zone_rates(t), assign_zones(t.zones_adm1(), GRID))
    return means.join(world, "hazard").select("hazard", F.round("mean", 9).alias("mean"), F.round("global_rate", 6).alias("global_rate"))


@check("a09_block_mean", "SELECT CAST(row // 5 AS INTEGER) AS row, CAST(col // 5 AS INTEGER) AS col, round(sum(value) / 25, 6) AS value FROM b_water WHERE row // 5 < 3 AND col // 5 < 7 GROUP BY 1, 2")
def a09(t):
    return rounded(resample.block_agg(t.layer_water(), GRID, 5, "avg"), "value")


@check("a10_block_sum", "SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, round(sum(value), 4) AS value FROM b_pop WHERE row // 4 < 4 AND col // 4 < 9 GROUP BY 1, 2")
def a10(t):
    return rounded(resample.block_agg(t.layer_pop(), GRID, 4, "sum"), "value", digits=4)


@check("a11_resample_average", "SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, round(avg(value), 6) AS value FROM b_water GROUP BY 1, 2")
def a11(t):
    return rounded(resample.resample_down(t.layer_water(), GRID, 4, "average"), "value")


@check("a12_resample_max", "SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, max(value) AS value FROM b_water GROUP BY 1, 2")
def a12(t):
    return resample.resample_down(t.layer_water(), GRID, 4, "max")


@check("a13_resample_sum", """SELECT CAST(tr AS INTEGER) AS row, CAST(tc AS INTEGER) AS col, round(sum(value * (least((row + 1) * 10, (tr + 1) * 15) - greatest(row * 10, tr * 15)) / 10::DOUBLE *
(least((col + 1) * 10, (tc + 1) * 15) - greatest(col * 10, tc * 15)) / 10::DOUBLE), 4) AS value FROM b_pop, range(12) r(tr), range(24) c(tc)
WHERE row * 10 < (tr + 1) * 15 AND (row + 1) * 10 > tr * 15 AND col * 10 < (tc + 1) * 15 AND (col + 1) * 10 > tc * 15 GROUP BY tr, tc""")
def a13(t):
    return rounded(resample.resample_sum(t.layer_pop(), GRID, Grid.world(15.0)), "value", digits=4)


@check("a14_resample_bilinear", """SELECT CAST(tr AS INTEGER) AS row, CAST(tc AS INTEGER) AS col, round(sum(value * wr * wc) / sum(wr * wc), 4) AS value FROM
(SELECT tr, tc, value, 1 - abs(least(greatest((tr + 0.5::DOUBLE) * 0.4 - 0.5, 0), 17) - row) AS wr, 1 - abs(least(greatest((tc + 0.5::DOUBLE) * 0.4 - 0.5, 0), 35) - col) AS wc
FROM b_water, range(45) r(tr), range(90) c(tc)) WHERE wr > 0 AND wc > 0 GROUP BY tr, tc""")
def a14(t):
    return rounded(resample.resample_bilinear(t.layer_water(), GRID, Grid.world(4.0)), "value", digits=4)


@check("a15_resample_nearest", """SELECT CAST(tr AS INTEGER) AS row, CAST(tc AS INTEGER) AS col, value FROM b_water, range(60) r(tr), range(120) c(tc)
WHERE row = floor((tr + 0.5::DOUBLE) * 3 / 10) AND col = floor((tc + 0.5::DOUBLE) * 3 / 10)""")
def a15(t):
    return resample.resample_nearest(t.layer_water(), GRID, Grid.world(3.0))


def holed_cube(t):
    """The cube with fill values in some months and one empty cell column."""
    hole = (F.col("month") == 6) | (F.col("col") == 7)
    fill = lambda c, v: F.when(hole, F.lit(v)).otherwise(F.col(c)).alias(c)
    return t.cube().select("row", "col", "year", "month", fill("tmin", -327.68), fill("tmax", -327.68), fill("ppt", -32768.0))


HOLED = "(SELECT row, col, year, month, CASE WHEN month <> 6 AND col <> 7 THEN (tmax + tmin) / 2 END AS mid, CASE WHEN month <> 6 AND col <> 7 THEN ppt END AS ppt FROM b_cube)"


@check("a16_annual_mean", f"SELECT row, col, year, round(avg(mid), 6) AS value FROM {HOLED} GROUP BY row, col, year")
def a16(t):
    return rounded(climate.annual_mean(holed_cube(t)), "value")


@check("a17_annual_std", f"SELECT row, col, year, round(stddev_pop(mid), 6) AS value FROM {HOLED} GROUP BY row, col, year")
def a17(t):
    return rounded(climate.annual_std(holed_cube(t)), "value")


@check("a18_annual_sum", f"SELECT row, col, year, coalesce(sum(ppt), 0) AS value FROM {HOLED} GROUP BY row, col, year")
def a18(t):
    return climate.annual_sum(holed_cube(t))


def index_cube(t, shift=0.0):
    """A drought-like index per cell and month count."""
    c = t.cube()
    step = (F.col("year") * 12 + F.col("month")).cast("int")
    return c.select("row", "col", step.alias("t"), (F.col("ppt") / 20.0 - 3.0 + F.lit(shift)).alias("value"))


INDEX_SQL = "(SELECT row, col, year * 12 + month AS t, ppt / 20::DOUBLE - 3 AS value FROM b_cube)"


@check("a19_event_frequency", f"""SELECT row, col, round(sum(CASE WHEN value < -1.5 THEN 1 ELSE 0 END) / 40::DOUBLE, 9) AS value FROM {INDEX_SQL} i,
(SELECT min(t) AS first FROM (SELECT DISTINCT t FROM {INDEX_SQL} ORDER BY t DESC LIMIT 40)) WHERE t >= first GROUP BY row, col""")
def a19(t):
    return rounded(climate.event_frequency(index_cube(t), last=40), "value", digits=9)


@check("a20_combine_max", """SELECT coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, CASE WHEN b.value > 0 THEN greatest(coalesce(a.value, 0), b.value) ELSE coalesce(a.value, 0) END AS value
FROM (SELECT * FROM b_temp WHERE row % 3 <> 0) a FULL JOIN (SELECT * FROM b_elev WHERE col % 2 = 0) b ON a.row = b.row AND a.col = b.col""")
def a20(t):
    return climate.combine_max(t.layer_temp().where(F.col("row") % 3 != 0), t.layer_elev().where(F.col("col") % 2 == 0))


@check("a21_mortality_rates", f"""SELECT hazard, code, round(sum(deaths) / 50 / max(population) * 1000000, 4) AS rate FROM ({DEATHS_SQL}) JOIN ({POPULATION_SQL}) USING (code)
WHERE year BETWEEN 1980 AND 2020 AND population >= 1000 GROUP BY hazard, code HAVING sum(deaths) > 0""")
def a21(t):
    deaths, people = readers.clean_deaths(deaths_raw(t)), readers.clean_population(population_raw(t))
    return rounded(hazard.mortality_rates(deaths, people), "rate", digits=4)


@check("a22_sum_layers", "SELECT row, col, sum(value) AS value FROM b_crops GROUP BY row, col")
def a22(t):
    return a.sum_layers(t.crop_cells())


@check("a23_composite", "SELECT row, col, round(sum(intensity), 9) AS rate FROM b_hazard GROUP BY row, col")
def a23(t):
    return rounded(hazard.composite(t.hazard_cells().withColumnRenamed("intensity", "rate")), "rate", digits=9)


@check("a24_latest_per_key", f"""SELECT code, country, region, year, shdi, health FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY year DESC, line_no) AS k FROM ({SHDI_SQL})) WHERE k = 1""")
def a24(t):
    return a.latest_per_key(readers.clean_shdi(shdi_raw(t)), "code", "year", "line_no", "country", "region", "shdi", "health")


@check("a25_first_and_last", """SELECT o_custkey AS key, min_by(o_totalprice, o_orderkey) AS first, max_by(o_totalprice, o_orderkey) AS last FROM orders GROUP BY o_custkey""")
def a25(t):
    orders = t["orders"].select(F.col("o_custkey").alias("key"), "o_orderkey", "o_totalprice")
    first = a.first_by(orders, ["key"], "o_orderkey", "o_totalprice").withColumnRenamed("o_totalprice", "first")
    return first.join(a.last_by(orders, ["key"], "o_orderkey", "o_totalprice").withColumnRenamed("o_totalprice", "last"), "key")


@check("a26_describe_layer", "SELECT axis, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max, round(avg(value), 6) AS mean, CAST(count(value) AS DOUBLE) / count(*) AS share, CAST(count(*) AS BIGINT) AS n FROM (SELECT axis, CASE WHEN row % 4 <> 0 THEN value END AS value FROM b_layers) GROUP BY axis")
def a26(t):
    layers = t.layers().withColumn("value", F.when(F.col("row") % 4 != 0, F.col("value")))
    return rounded(a.describe_layer(layers, ["axis"]), "median", "p99", "max", "mean")


@check("a27_coverage", "SELECT zone, CAST(count(*) AS BIGINT) AS cells, CAST(count(value) AS BIGINT) AS valid, count(value) / count(*)::DOUBLE AS share FROM b_cell_adm1 LEFT JOIN (SELECT row, col, value FROM b_elev WHERE value > 2) USING (row, col) GROUP BY zone")
def a27(t):
    return a.coverage(t.layer_elev().where(F.col("value") > 2), assign_zones(t.zones_adm1(), GRID))


@check("a28_axis_years", """SELECT axis, years AS all_years, axis IN ('o', 'f') AS temporal, CASE axis WHEN 'o' THEN first END AS first_year, CASE axis WHEN 'o' THEN last END AS last_year,
CASE WHEN axis = 'p' THEN 1980 ELSE least(1980, first) END AS slider_first, CASE WHEN axis = 'p' THEN 2050 ELSE greatest(2050, last) END AS slider_last FROM
(SELECT axis, CASE axis WHEN 'p' THEN '' ELSE string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) END AS years, min(y) AS first, max(y) AS last FROM (SELECT DISTINCT lower(o_orderstatus) AS axis, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders) GROUP BY axis)""")
def a28(t):
    from placewise.operators.years import axis_years
    from placewise.sources.sinks import build_catalog

    out = axis_years(build_catalog(t.artefacts()))
    return out.withColumn("all_years", F.array_join(F.col("all_years").cast("array<string>"), ","))


@check("a29_byte_histogram", "SELECT byte, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(trunc(least(greatest(value / 3000, 0), 1) * 254 + 1) AS INTEGER) AS byte FROM b_water) GROUP BY byte")
def a29(t):
    return a.byte_histogram(t.layer_water().select(to_byte(F.col("value"), 0, 3000).alias("byte")))


@check("a30_mask_count", "SELECT level, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT level, cx, cy FROM b_quad) GROUP BY level")
def a30(t):
    from placewise.operators.brush import mask_count

    return mask_count(t.quad_events().select("level", "cx", "cy").distinct())
