"""Filters, normalisation, decoding and labels."""

from pyspark.sql import functions as F

from placewise import dims
from placewise.bind import GRID, ORDER_YEARS
from placewise.checks import check
from placewise.functions import encode as e
from placewise.functions.geometry import rings_area_km2
from placewise.operators.aggregate import CELL
from placewise.operators.quantile import exact_quantiles
from placewise.operators.ranking import share_pct
from placewise.operators.score import validate_formulas
from placewise.sources import sinks


def byte_sql(value, lo, hi, invert=False, log=False):
    v = f"CASE WHEN {value} > 0 THEN ln(1 + {value}) ELSE 0 END" if log else value
    share = f"least(greatest(({v} - ({lo})) / (({hi}) - ({lo})), 0), 1)"
    share = f"1 - {share}" if invert else share
    return f"CASE WHEN {value} IS NULL THEN 0 ELSE CAST(trunc(least(greatest(({share}) * 254 + 1, 1), 255)) AS INTEGER) END"


def band_sql(name, value):
    cases = " ".join(f"WHEN {value} < {float(th)}::DOUBLE THEN '{label}'" for th, label in dims.BANDS[name] if th is not None)
    return f"CASE WHEN {value} IS NULL THEN NULL {cases} ELSE '{dims.BANDS[name][-1][1]}' END"


@check("f01_valid_values", "SELECT s_suppkey AS id, CASE WHEN abs(v + 9999) > 0.1 + 1e-5 * 9999 THEN v END AS value FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN -9999 + s_suppkey % 10 / 25::DOUBLE ELSE s_acctbal END AS v FROM supplier)")
def f01(t):
    key = F.col("s_suppkey")
    v = F.when(key % 3 == 0, F.lit(-9999.0) + (key % 10).cast("double") / 25.0).when(key % 3 == 4, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    return t["supplier"].select(key.alias("id"), e.valid_or_null(v, -9999.0).alias("value"))


@check("f02_positive_only", "SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS value FROM customer")
def f02(t):
    return t["customer"].select(F.col("c_custkey").alias("id"), e.positive_only(F.col("c_acctbal")).alias("value"))


@check("f03_zero_fill", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 IN (0, 1, 2) THEN 0 ELSE greatest(c_acctbal, 0) END::DOUBLE AS value FROM customer")
def f03(t):
    key = F.col("c_custkey")
    v = F.when(key % 5 == 0, F.lit(float("nan"))).when(key % 5 == 1, F.lit(float("inf"))).when(key % 5 != 2, F.col("c_acctbal"))
    return t["customer"].select(key.alias("id"), e.zero_fill(v).alias("value"))


@check("f04_country_codes", """SELECT code, CAST(count(*) AS BIGINT) AS n, bool_and(regexp_full_match(code, '[A-Za-z]{3}')) AS alpha
FROM (SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'EU' WHEN n_nationkey % 4 = 1 THEN 'X0' || n_nationkey % 10 ELSE 'ABC' END AS code FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE length(code) = 3 GROUP BY code""")
def f04(t):
    key = F.col("c_nationkey")
    code = F.when(key % 4 == 0, F.lit("EU")).when(key % 4 == 1, F.concat(F.lit("X0"), (key % 10).cast("string"))).otherwise(F.lit("ABC"))
    rows = t["customer"].select(code.alias("code")).where(e.is_country(F.col("code")))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.every(e.is_alpha_code(F.col("code"))).alias("alpha"))


@check("f05_fuel_filter", "SELECT id, fuel, capacity FROM b_plants WHERE fuel IN ('ECONOMY', 'PROMO')")
def f05(t):
    return t.plants().where(F.col("fuel").isin(["ECONOMY", "PROMO"])).select("id", "fuel", "capacity")


@check("f06_area_threshold", """SELECT ord, round(area, 3) AS km2 FROM (SELECT ord, abs(sum(ax * by2 - bx * ay)) / 2 AS area FROM
(SELECT ord, x1 * pi() / 180 * 6371.0072 AS ax, sin(y1 * pi() / 180) * 6371.0072 AS ay, x2 * pi() / 180 * 6371.0072 AS bx, sin(y2 * pi() / 180) * 6371.0072 AS by2 FROM b_tri_edge) GROUP BY ord) WHERE area >= 4000000""")
def f06(t):
    sized = t.triangles().withColumn("_a", rings_area_km2(F.col("rings")))
    return sized.where(F.col("_a") >= 4_000_000).select("ord", F.round("_a", 3).alias("km2"))


@check("f07_valid_zonal", "SELECT CAST(count(*) AS BIGINT) AS cells, round(sum(e.value), 4) AS total FROM b_elev e JOIN b_pop p USING (row, col) JOIN b_cell_adm1 z USING (row, col) WHERE p.value > 0")
def f07(t):
    from placewise.operators.zones import assign_zones

    zones = assign_zones(t.zones_adm1(), GRID)
    joined = t.layer_elev().join(t.layer_pop().withColumnRenamed("value", "weight"), CELL).join(zones, CELL)
    return joined.where(~F.isnan("value") & (F.col("weight") > 0)).agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("value"), 4).alias("total"))


@check("f08_keep_cells", "SELECT row, col, sum(value) AS total FROM b_crops GROUP BY row, col HAVING sum(value) > 2000")
def f08(t):
    return t.crop_cells().groupBy(*CELL).agg(F.sum("value").alias("total")).where(F.col("total") > 2000.0)


@check("f09_drop_all_null", "SELECT * FROM (SELECT row, col, " + ", ".join(f"max(CASE WHEN year = {y} AND value > 50000 THEN value END) AS y{y}" for y in ORDER_YEARS) + " FROM b_gdp GROUP BY row, col) WHERE coalesce(" + ", ".join(f"y{y}" for y in ORDER_YEARS) + ") IS NOT NULL")
def f09(t):
    rich = t.layer_gdp().withColumn("value", F.when(F.col("value") > 50000, F.col("value")))
    return sinks.drop_all_null(sinks.year_columns(rich, CELL, ORDER_YEARS, prefix="y"), "y")


def formulas(t):
    """One formula per order, drawn from six shapes."""
    shapes = ["(T x w) / p", "temp + bogus", "earthquake * hospital - 0.5", "a + b + c + p + g", "-free/(inet+1)", "oil*gas+wind*sun+travel"]
    listed = F.array(*[F.lit(s) for s in shapes])
    key = F.col("o_orderkey")
    return t["orders"].select(key.alias("profile"), F.element_at(listed, (key % len(shapes) + 1).cast("int")).alias("formula"))


FORMULA_AXES = [["temp", "water", "pop"], ["temp", "bogus"], ["risk", "hcare"], ["agri", "b", "cost", "pop", "gdp"], ["free", "inet"], ["e_oil", "gas", "wind", "solar", "travel"]]
UNKNOWN = ["", "bogus", "", "b, cost", "", "gas"]


@check("f10_validate_formulas", "SELECT o_orderkey AS profile, u AS unknown, CAST(n AS BIGINT) AS n_axes, u = '' AND n <= 4 AS ok FROM orders JOIN (VALUES "
       + ", ".join(f"({i}, '{u}', {len(a)})" for i, (u, a) in enumerate(zip(UNKNOWN, FORMULA_AXES))) + ") f(i, u, n) ON i = o_orderkey % 6")
def f10(t):
    return validate_formulas(formulas(t))


@check("f11_strict_missing", "SELECT row, col, CASE WHEN t.value > 9 THEN t.value * p.value END AS result FROM b_temp t JOIN b_pop p USING (row, col)")
def f11(t):
    temp = t.layer_temp().withColumn("temp", F.when(F.col("value") > 9, F.col("value"))).drop("value")
    return temp.join(t.layer_pop(), CELL).select(*CELL, (F.col("temp") * F.col("value")).alias("result"))


@check("n01_linear_bytes", f"SELECT row, col, {byte_sql('value', -30.0, 45.0)} AS byte, {byte_sql('value', 5.0, 6.0)} AS flat FROM (SELECT row, col, CASE WHEN col % 5 <> 0 THEN value END AS value FROM b_temp)")
def n01(t):
    v = F.when(F.col("col") % 5 != 0, F.col("value"))
    return t.layer_temp().select(*CELL, e.to_byte(v, -30, 45).alias("byte"), e.to_byte(v, 5, 5).alias("flat"))


@check("n02_percentile_bytes", f"""SELECT row, col, {byte_sql('value', 'lo', 'hi')} AS byte FROM b_water, (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM b_water)""")
def n02(t):
    layer = t.layer_water()
    marks = exact_quantiles(layer, "value", {"lo": 0.01, "hi": 0.99}).select(F.struct("lo", "hi")).scalar()
    return layer.withColumn("_m", marks).select(*CELL, e.to_byte(F.col("value"), F.col("_m.lo"), F.col("_m.hi")).alias("byte"))


@check("n03_log_bytes", f"""SELECT row, col, {byte_sql('value', 0.0, 'ln(10001)', log=True)} AS byte, {byte_sql('value', 'lo', 'hi', log=True)} AS auto FROM b_pop,
(SELECT quantile_cont(ln(1 + value), 0.01) AS lo, quantile_cont(ln(1 + value), 0.99) AS hi FROM b_pop WHERE value > 0)""")
def n03(t):
    layer = t.layer_pop()
    logs = layer.where(F.col("value") > 0).withColumn("_l", F.log1p("value"))
    marks = exact_quantiles(logs, "_l", {"lo": 0.01, "hi": 0.99}).select(F.struct("lo", "hi")).scalar()
    v = F.col("value")
    return layer.withColumn("_m", marks).select(
        *CELL, e.to_byte(v, 0, 10000, log=True).alias("byte"), e.to_byte(v, F.col("_m.lo"), F.col("_m.hi"), log=True).alias("auto")
    )


@check("n04_inverted_bytes", f"SELECT row, col, {byte_sql('value', 0.0, 3000.0, invert=True)} AS byte FROM b_water")
def n04(t):
    return t.layer_water().select(*CELL, e.to_byte(F.col("value"), 0, 3000, invert=True).alias("byte"))


@check("n05_stretch", """SELECT hazard, row, col, round(pow(v / 0.08::DOUBLE, 0.4::DOUBLE) * 0.08, 9) AS gamma, round(sqrt(v / 0.08::DOUBLE) * 0.08, 9) AS root, v AS line
FROM (SELECT hazard, row, col, least(greatest(intensity, 0), 0.08::DOUBLE) AS v FROM b_hazard)""")
def n05(t):
    v = F.col("intensity")
    return t.hazard_cells().select("hazard", *CELL, F.round(e.stretch(v, 0.08, "gamma", 0.4), 9).alias("gamma"), F.round(e.stretch(v, 0.08, "sqrt"), 9).alias("root"), e.stretch(v, 0.08, "linear").alias("line"))


@check("n06_unstretch", "SELECT row, col, hazard, round(least(intensity, 0.08::DOUBLE), 9) AS gamma, round(least(intensity, 0.08::DOUBLE), 9) AS root FROM b_hazard")
def n06(t):
    v = F.col("intensity")
    back = lambda kind, gm: F.round(e.unstretch(e.stretch(v, 0.08, kind, gm) / 0.08, 0.08, kind, gm), 9)
    return t.hazard_cells().select(*CELL, "hazard", back("gamma", 0.4).alias("gamma"), back("sqrt", 1.0).alias("root"))


@check("n07_decode", """SELECT p_partkey AS id, CASE WHEN b > 0 THEN round(-30 + b / 255::DOUBLE * 75, 6) END AS temp, CASE WHEN b > 0 THEN round(exp(b / 255::DOUBLE * ln(10001)) - 1, 4) END AS pop,
CASE WHEN b > 0 THEN round((1 - b / 255::DOUBLE) * 70, 6) END AS air, CASE WHEN b > 0 THEN round(pow(1 - b / 255::DOUBLE, 2) * 10, 6) END AS flood FROM (SELECT p_partkey, p_partkey % 256 AS b FROM part)""")
def n07(t):
    b = F.col("p_partkey") % 256
    digits = {"temp": 6, "pop": 4, "air": 6, "flood": 6}
    return t["part"].select(F.col("p_partkey").alias("id"), *[F.round(e.decode(a, b), d).alias(a) for a, d in digits.items()])


@check("n08_robust_cap", "SELECT quantile_cont(value, 0.995) AS cap, CAST(count(*) AS BIGINT) AS cells FROM (SELECT row, col, sum(value) AS value FROM b_crops GROUP BY row, col) WHERE value > 0")
def n08(t):
    from placewise.plans.layers import robust_cap
    from placewise.operators.aggregate import sum_layers

    total = sum_layers(t.crop_cells())
    return total.where(F.col("value") > 0).agg(F.count(F.lit(1)).alias("cells")).withColumn("cap", robust_cap(total))


@check("n09_units", "SELECT c_custkey AS id, v * 9 / 5 + 32 AS f, v * 9 / 5 AS df, v * 2.23694::DOUBLE AS mph, v * 3.6::DOUBLE AS kmh, v / 1000 AS mbps FROM (SELECT c_custkey, c_acctbal AS v FROM customer)")
def n09(t):
    v = F.col("c_acctbal")
    to = lambda a, b, n: e.convert_unit(v, a, b).alias(n)
    return t["customer"].select(F.col("c_custkey").alias("id"), to("C", "F", "f"), to("dC", "dF", "df"), to("m/s", "mph", "mph"), to("m/s", "km/h", "kmh"), to("kbps", "Mbps", "mbps"))


BAND_DIVISORS = {"temp": 300, "tvar": 700, "water": 3, "solar": 4, "wind": 700, "e_consume": 0.8, "plant": 4, "agri": 100, "agrip": 100, "pop": 1.5, "gdp": 0.2, "air": 250, "elev": 2, "eq": 10000, "flood": 2500, "cyclone": 60, "tsunami": 1500, "volcano": 2500, "drought": 40000, "wildfire": 40000, "landslide": 250, "inet": 25, "depv": 100, "hcare": 70, "vista": 100, "travel": 20, "free": 100}


@check("n10_bands", "SELECT c_custkey AS id, " + ", ".join(f"{band_sql(k, f'(c_acctbal / {float(d)}::DOUBLE)')} AS {k}" for k, d in BAND_DIVISORS.items()) + " FROM customer")
def n10(t):
    v = F.col("c_acctbal")
    return t["customer"].select(F.col("c_custkey").alias("id"), *[e.band(k, v / float(d)).alias(k) for k, d in BAND_DIVISORS.items()])


@check("n11_odds", """SELECT id, CASE WHEN v <= 0 THEN '~0' WHEN n >= 1000000 THEN '1 in ' || (m // 10) || '.' || (m % 10) || ' million per year'
WHEN n >= 1000 THEN '1 in ' || CAST(floor(n / 1000::DOUBLE + 0.5) AS BIGINT) || ' thousand per year' ELSE '1 in ' || n || ' per year' END AS odds,
CASE WHEN v <= 0 THEN '<0.05' WHEN v < 0.1 THEN '<0.1' WHEN v < 10 THEN (k // 10) || '.' || (k % 10) ELSE CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) END AS rate
FROM (SELECT *, CAST(floor(n / 1000000::DOUBLE * 10 + 0.5) AS BIGINT) AS m, CAST(floor(v * 10 + 0.5) AS BIGINT) AS k FROM
(SELECT event_id AS id, v, CASE WHEN v > 0 THEN CAST(floor(1000000 / v + 0.5) AS BIGINT) END AS n FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN value / 600 WHEN 2 THEN value / 20 ELSE value * 20 END::DOUBLE AS v FROM events)))""")
def n11(t):
    key, v = F.col("event_id"), F.col("value")
    rate = F.when(key % 4 == 0, F.lit(0.0)).when(key % 4 == 1, v / 600.0).when(key % 4 == 2, v / 20.0).otherwise(v * 20.0)
    return t["events"].select(key.alias("id"), e.odds(rate).alias("odds"), e.rate_text(rate).alias("rate"))


@check("n12_balance_label", """SELECT id, CASE WHEN net >= 0 THEN '+' ELSE '' END || net || ' (' || CASE WHEN net > 20 THEN 'Major exporter' WHEN net > 5 THEN 'Net exporter'
WHEN net < -20 THEN 'Major importer' WHEN net < -5 THEN 'Net importer' ELSE 'Balanced' END || ')' AS label FROM (SELECT event_id AS id, CAST(floor(value / 490.02::DOUBLE * 100 + 0.5) AS BIGINT) - 50 AS net FROM events)""")
def n12(t):
    return t["events"].select(F.col("event_id").alias("id"), e.balance_label(F.col("value") / 490.02).alias("label"))


@check("n13_minutes_label", """SELECT id, CASE WHEN m < 60 THEN m || ' min' ELSE h || ' hr' || CASE WHEN h > 1 THEN 's' ELSE '' END END AS label FROM
(SELECT *, CAST(floor(m / 60::DOUBLE + 0.5) AS BIGINT) AS h FROM (SELECT event_id AS id, CAST(floor(value * 1.3::DOUBLE + 0.5) AS BIGINT) AS m FROM events))""")
def n13(t):
    return t["events"].select(F.col("event_id").alias("id"), e.minutes_label(F.col("value") * 1.3).alias("label"))


@check("n14_lookup_tenths", "SELECT row, col, CAST(least(greatest(round_even(value * 10, 0), 0), 65000) AS INTEGER) AS tenths, round_even(value, 2) AS hundredths FROM b_temp")
def n14(t):
    v = F.col("value")
    return t.layer_temp().select(*CELL, e.lookup_tenths(v).alias("tenths"), F.bround(v, 2).alias("hundredths"))


@check("n15_share_pct", """SELECT row, col, crop, CAST(floor(value / total * 100 + 0.5) AS BIGINT) AS pct FROM (SELECT *, sum(value) OVER (PARTITION BY row, col) AS total FROM b_crops) WHERE floor(value / total * 100 + 0.5) > 0""")
def n15(t):
    return share_pct(t.crop_cells(), CELL, "value").drop("value")
