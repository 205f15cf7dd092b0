"""Neighbourhoods, rankings, shares, deltas and set operations."""

from pyspark.sql import functions as F

from placewise import dims
from placewise.bind import GRID
from placewise.checks import check
from placewise.checks.aggregates import INDEX_SQL, index_cube, rounded
from placewise.checks.encoding import formulas
from placewise.checks.joins import LAKES, lakes
from placewise.operators import brush, focal, ranking
from placewise.operators.aggregate import CELL, fuel_breakdown
from placewise.operators.climate import event_frequency
from placewise.operators.score import formula_axis_rows
from placewise.operators.years import step_year
from placewise.sources.readers import paired_cube


def reflect(i, n):
    return f"(CASE WHEN (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) >= {n} THEN 2 * {n} - 1 - (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) END)"


def gaussian_sql(source, sigma, h=18, w=36):
    r = int(4 * sigma + 0.5)
    kernel = f"(SELECT k, exp(-0.5 * pow(k / {sigma}::DOUBLE, 2)) / sum(exp(-0.5 * pow(k / {sigma}::DOUBLE, 2))) OVER () AS wt FROM range({-r}, {r + 1}) r(k))"
    dense = f"(SELECT r.v AS row, c.v AS col, coalesce(value, 0) AS value FROM range({h}) r(v) CROSS JOIN range({w}) c(v) LEFT JOIN {source} s ON s.row = r.v AND s.col = c.v)"
    down = f"(SELECT d.v AS row, s.col, sum(s.value * wt) AS value FROM range({h}) d(v), {kernel} k, {dense} s WHERE s.row = {reflect('d.v + k', h)} GROUP BY d.v, s.col)"
    return f"(SELECT s.row, d.v AS col, sum(s.value * wt) AS value FROM range({w}) d(v), {kernel} k, {down} s WHERE s.col = {reflect('d.v + k', w)} GROUP BY s.row, d.v)"


def ints(alias=""):
    return f"CAST({alias}row AS INTEGER) AS row, CAST({alias}col AS INTEGER) AS col"


@check("w01_gaussian", f"SELECT {ints()}, round(value, 5) AS value FROM {gaussian_sql('b_pop', 1.5)}")
def w01(t):
    return rounded(focal.gaussian(t.layer_pop(), GRID, 1.5), "value", digits=5)


@check("w01_gaussian_wide", f"SELECT {ints()}, round(value, 5) AS value FROM {gaussian_sql('b_pop', 5.0)}")
def w01w(t):
    """The kernel is wider than the grid is high, so values mirror more than once."""
    return rounded(focal.gaussian(t.layer_pop(), GRID, 5.0), "value", digits=5)


@check("w01_gaussian_blocks", f"SELECT {ints()}, round(value, 5) AS value FROM {gaussian_sql('b_pop', 1.0)}")
def w01b(t):
    """Cut into 8-cell blocks with halos."""
    return rounded(focal.gaussian(t.layer_pop(), GRID, 1.0, block=8), "value", digits=5)


@check("w02_max_filter", """SELECT CAST(r.v AS INTEGER) AS row, CAST(c.v AS INTEGER) AS col, max(value) AS value FROM range(18) r(v), range(36) c(v), b_pop s
WHERE abs(s.row - r.v) <= 6 AND abs(s.col - c.v) <= 6 GROUP BY r.v, c.v""")
def w02(t):
    return focal.max_filter(t.layer_pop(), GRID, 13, block=16)


def rise_sql(source):
    """Gradient length per cell from its four neighbours; cells next to an absent cell have none."""
    return f"""(SELECT c.row, c.col, sqrt(pow((e.value - w.value) / CASE WHEN c.col IN (0, 35) THEN 1 ELSE 2 END::DOUBLE, 2) + pow((s.value - n.value) / CASE WHEN c.row IN (0, 17) THEN 1 ELSE 2 END::DOUBLE, 2)) AS value
FROM {source} c JOIN {source} w ON w.row = c.row AND w.col = greatest(c.col - 1, 0) JOIN {source} e ON e.row = c.row AND e.col = least(c.col + 1, 35)
JOIN {source} n ON n.row = greatest(c.row - 1, 0) AND n.col = c.col JOIN {source} s ON s.row = least(c.row + 1, 17) AND s.col = c.col)"""


STEEP = "(SELECT row, col, value * 100000 AS value FROM b_elev)"


@check("w03_slope", f"SELECT row, col, round(degrees(atan(value / 1110000)), 9) AS value FROM {rise_sql(STEEP)}")
def w03(t):
    elev = t.layer_elev().withColumn("value", F.col("value") * 100000.0)
    return rounded(focal.slope_deg(elev, GRID, block=8), "value", digits=9)


@check("w04_top_n_per_cell", "SELECT row, col, crop, CAST(k AS INTEGER) AS rank, value, CAST(round_even(value, 0) AS BIGINT) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY value DESC, crop DESC) AS k FROM b_crops) WHERE k <= 5")
def w04(t):
    return ranking.top_n_per_cell(t.crop_cells(), "crop")


@check("w05_share_within_group", "SELECT country, fuel, CAST(floor(capacity / total * 100 + 0.5) AS BIGINT) AS pct FROM (SELECT country, fuel, sum(capacity) AS capacity, sum(sum(capacity)) OVER (PARTITION BY country) AS total FROM b_plants GROUP BY country, fuel) WHERE floor(capacity / total * 100 + 0.5) > 0")
def w05(t):
    return ranking.share_pct(fuel_breakdown(t.plants()), ["country"], "capacity").drop("capacity")


QUAD_KEYS = "(SELECT DISTINCT level, cy * CAST(1 << level AS BIGINT) + cx AS key FROM b_quad)"


@check("w06_mask_deltas", f"SELECT level, CAST(key AS BIGINT) AS key, CAST(key - coalesce(lag(key) OVER (PARTITION BY level ORDER BY key), 0) AS BIGINT) AS delta FROM {QUAD_KEYS}")
def w06(t):
    return brush.mask_deltas(t.quad_events())


@check("w07_mask_from_deltas", "SELECT DISTINCT level, cx, cy FROM b_quad WHERE level < 7")
def w07(t):
    """Deltas decode to the mask they came from; a level past 16 is ignored."""
    deltas = brush.mask_deltas(t.quad_events()).withColumn("level", F.when(F.col("level") == 7, F.lit(99)).otherwise(F.col("level")))
    return brush.mask_from_deltas(deltas.withColumnRenamed("key", "pos"))


@check("w08_dedupe_keys", """SELECT ord, CASE WHEN n = 1 THEN k ELSE k || '#' || n END AS unique_key FROM (SELECT ord, k, row_number() OVER (PARTITION BY k ORDER BY ord) AS n FROM
(SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus || '::' || o_orderpriority ELSE o_orderpriority END AS k FROM orders))""")
def w08(t):
    key = F.col("o_orderkey")
    rows = t["orders"].select(key.alias("ord"), F.when(key % 5 != 0, F.col("o_orderpriority")).alias("key"), "o_orderstatus", "o_orderpriority")
    return ranking.dedupe_keys(rows, "key", "ord", "o_orderstatus", "o_orderpriority").select("ord", "unique_key")


@check("w09_step_year", """SELECT o_orderkey AS id, CAST(CASE WHEN y < 1996 THEN 1996 WHEN y < 1998 THEN 1998 WHEN y < 2000 THEN 2000 ELSE y END AS INTEGER) AS next_year,
CAST(CASE WHEN y > 2000 THEN 2000 WHEN y > 1998 THEN 1998 WHEN y > 1996 THEN 1996 ELSE y END AS INTEGER) AS prev_year FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)""")
def w09(t):
    years, cur = F.array(F.lit(1996), F.lit(1998), F.lit(2000)), F.year("o_orderdate")
    return t["orders"].select(F.col("o_orderkey").alias("id"), step_year(years, cur, 1).alias("next_year"), step_year(years, cur, -1).alias("prev_year"))


@check("w10_last_steps", f"""SELECT row, col, round(sum(CASE WHEN value < -1 THEN 1 ELSE 0 END) / 12::DOUBLE, 9) AS value FROM {INDEX_SQL} i,
(SELECT min(t) AS first FROM (SELECT DISTINCT t FROM {INDEX_SQL} ORDER BY t DESC LIMIT 12)) WHERE t >= first GROUP BY row, col""")
def w10(t):
    return rounded(event_frequency(index_cube(t), threshold=-1.0, last=12), "value", digits=9)


@check("l01_rank_hazards", "SELECT row, col, hazard, rate, CAST(row_number() OVER (PARTITION BY row, col ORDER BY rate DESC, hazard) AS INTEGER) AS rank FROM (SELECT row, col, hazard, intensity AS rate FROM b_hazard) WHERE rate >= 0.05")
def l01(t):
    return ranking.rank_hazards(t.hazard_cells().withColumnRenamed("intensity", "rate"))


@check("l02_rank_fuels", "SELECT country, fuel, CAST(row_number() OVER (PARTITION BY country ORDER BY capacity DESC, fuel) AS INTEGER) AS rank FROM (SELECT country, fuel, sum(capacity) AS capacity FROM b_plants GROUP BY country, fuel)")
def l02(t):
    return ranking.rank_within(fuel_breakdown(t.plants()), ["country"], "capacity", "fuel").drop("capacity")


@check("l03_top_countries", "SELECT hazard, zone, rate, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY hazard ORDER BY rate DESC, zone) AS k FROM (SELECT l_linenumber AS hazard, CAST(l_suppkey % 25 AS INTEGER) AS zone, count(*) / 100::DOUBLE AS rate FROM lineitem WHERE l_suppkey % 25 <> 4 GROUP BY 1, 2)) WHERE k <= 3")
def l03(t):
    from placewise.checks.aggregates import zone_rates

    return ranking.rank_within(zone_rates(t), ["hazard"], "rate", "zone", top=3)


@check("l04_sorted_years", "SELECT o_orderstatus AS axis, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS years FROM (SELECT DISTINCT o_orderstatus, year(o_orderdate) AS y FROM orders) GROUP BY o_orderstatus")
def l04(t):
    years = F.sort_array(F.collect_set(F.year("o_orderdate")))
    return t["orders"].groupBy(F.col("o_orderstatus").alias("axis")).agg(F.array_join(years.cast("array<string>"), ",").alias("years"))


@check("u01_union_of_countries", "SELECT c_nationkey AS nation FROM customer WHERE c_nationkey % 3 <> 0 UNION SELECT s_nationkey FROM supplier WHERE s_nationkey % 4 <> 0")
def u01(t):
    a = t["customer"].where(F.col("c_nationkey") % 3 != 0).select(F.col("c_nationkey").alias("nation"))
    return a.union(t["supplier"].where(F.col("s_nationkey") % 4 != 0).select("s_nationkey")).distinct()


@check("u02_mask_or", f"SELECT row, col FROM b_elev WHERE value <= 0 UNION SELECT row, col FROM {LAKES}")
def u02(t):
    from placewise.operators.masks import ocean_cells

    return ocean_cells(t.layer_elev()).union(lakes(t)).distinct()


@check("u03_unknown_axes", "SELECT o_orderkey AS profile, u AS axis FROM orders JOIN (VALUES (1, 'bogus'), (3, 'b'), (3, 'cost'), (5, 'gas')) f(i, u) ON i = o_orderkey % 6")
def u03(t):
    return formula_axis_rows(formulas(t)).where(~F.col("axis").isin(dims.AXES))


@check("u04_union_of_years", "SELECT DISTINCT lower(o_orderstatus) AS axis, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderstatus <> 'P'")
def u04(t):
    from placewise.operators.years import axis_years
    from placewise.sources.sinks import build_catalog

    return axis_years(build_catalog(t.artefacts())).select("axis", F.explode("all_years").alias("year"))


@check("u05_paired_years", "SELECT DISTINCT year FROM b_cube WHERE year % 2 = 0")
def u05(t):
    long = t.cube().select("year", "tmin", "tmax").unpivot(["year"], ["tmin", "tmax"], "var", "value")
    return paired_cube(long.where((F.col("var") != "tmax") | (F.col("year") % 2 == 0)), ["tmin", "tmax"]).select("year").distinct()
