"""Curves, formulas and composite scores."""

from functools import reduce

from pyspark.sql import functions as F

from placewise import dims
from placewise.checks import check
from placewise.checks.encoding import FORMULA_AXES, byte_sql, formulas
from placewise.checks.joins import PLACED3
from placewise.checks.masks import FINE
from placewise.checks.masks import mask as painted
from placewise.functions.grid import tile_pixel
from placewise.operators import curves as c
from placewise.operators import score as s
from placewise.operators.aggregate import CELL
from placewise.operators.brush import QUAD
from placewise.operators.places import best_places

FLAGSHIP = "(temp * water) / pop"


def profile_curves(t):
    """A curve per supplier: none to four points, some steep, some unsorted."""
    key = F.col("s_suppkey")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x1, x2 = (key % 10) / 20.0, F.lit(0.5) + (key % 7) / 20.0
    y1, y2 = (key % 12) / 11.0, (key * 5 % 12) / 11.0
    points = F.when(key % 5 == 0, F.array().cast(c.POINTS_TYPE)).when(key % 5 == 1, F.array(p(x2, y2), p(x1, y1))).when(
        key % 5 == 2, F.array(p(x1, y1), p(x1, y2), p(x2, y1))).otherwise(F.array(p(x1, y1), p(x2, y2)))
    return t["supplier"].select(key.alias("profile"), points.alias("points"))


CURVE_SQL = """(SELECT s_suppkey AS profile, s_suppkey % 5 AS kind, (s_suppkey % 10) / 20::DOUBLE AS x1, 0.5::DOUBLE + (s_suppkey % 7) / 20::DOUBLE AS x2, (s_suppkey % 12) / 11::DOUBLE AS y1, (s_suppkey * 5 % 12) / 11::DOUBLE AS y2 FROM supplier)"""


def curve_value_sql(x):
    # kind 2 has points (x1, y1), (x1, y2), (x2, y1): left of x1 it is y1, past it the second segment runs from y2 to y1
    return f"""CASE WHEN kind = 0 THEN 0.5 WHEN {x} <= x1 THEN y1 WHEN {x} >= x2 THEN CASE WHEN kind = 2 THEN y1 ELSE y2 END
WHEN kind = 2 THEN y2 + ({x} - x1) / (x2 - x1) * (y1 - y2) ELSE y1 + ({x} - x1) / (x2 - x1) * (y2 - y1) END"""


LUT_SQL = f"(SELECT profile, b AS byte, least(greatest(1 - {curve_value_sql('(b / 255::DOUBLE)')}, 0), 1)::DOUBLE AS score FROM {CURVE_SQL}, range(256) r(b))"


@check("c01_curve_lut", f"SELECT profile, CAST(byte AS INTEGER) AS byte, round(score, 9) AS score FROM {LUT_SQL}")
def c01(t):
    return c.curve_lut(profile_curves(t)).withColumn("score", F.round("score", 9))


@check("c02_quantize_lut", f"SELECT profile, CAST(byte AS INTEGER) AS byte, CAST(floor(score * 255 + 0.5) AS INTEGER) AS lut_byte FROM {LUT_SQL}")
def c02(t):
    return c.quantize_lut(c.curve_lut(profile_curves(t))).select("profile", "byte", "lut_byte")


def default_lut_sql(axis):
    """Byte to score in 255ths under the axis's default curve."""
    points = sorted(dims.DEFAULT_CURVES.get(axis, dims.LINEAR_UP))
    x = "(b / 255::DOUBLE)"
    cases = [f"WHEN {x} <= {points[0][0]}::DOUBLE THEN {points[0][1]}::DOUBLE", f"WHEN {x} >= {points[-1][0]}::DOUBLE THEN {points[-1][1]}::DOUBLE"]
    for (xa, ya), (xb, yb) in zip(points, points[1:]):
        cases.append(f"WHEN {x} <= {xb}::DOUBLE THEN {ya}::DOUBLE + ({x} - {xa}::DOUBLE) / ({xb}::DOUBLE - {xa}::DOUBLE) * ({yb}::DOUBLE - {ya}::DOUBLE)")
    return f"(SELECT b AS byte, floor(least(greatest(1 - CASE {' '.join(cases)} END, 0), 1) * 255 + 0.5) / 255::DOUBLE AS score FROM range(256) r(b))"


BYTES = {"temp": byte_sql("value", -30.0, 45.0), "water": byte_sql("value", 0.0, 3000.0), "pop": byte_sql("value", 0.0, "ln(10001)", log=True)}
SCORED = {a: f"(SELECT row, col, l.score AS s FROM (SELECT row, col, {BYTES[a]} AS byte FROM b_{a}) JOIN {default_lut_sql(a)} l USING (byte) WHERE byte > 0)" for a in BYTES}


def layer(t):
    return s.encode_layers(t.layers())


@check("c03_apply_curve", " UNION ALL ".join(f"SELECT '{a}' AS axis, row, col, round(s, 9) AS score FROM {SCORED[a]}" for a in SCORED))
def c03(t):
    lut = c.quantize_lut(c.curve_lut(c.default_curves(t.spark, ["temp", "water", "pop"])))
    return c.apply_curve(layer(t), lut).select("axis", *CELL, F.round("score", 9).alias("score"))


@check("c04_curve_at", f"SELECT profile, x, round({curve_value_sql('x')}, 9) AS y FROM (SELECT *, (profile % 17) / 16::DOUBLE AS x FROM {CURVE_SQL})")
def c04(t):
    x = F.col("profile") % 17 / 16.0
    return profile_curves(t).select("profile", x.alias("x"), F.round(c.curve_at(F.col("points"), x), 9).alias("y"))


def ratio_sql(num, den):
    return f"CASE WHEN {den} = 0 THEN CASE WHEN {num} > 0 THEN 1 WHEN {num} < 0 THEN 0 END ELSE least(greatest({num} / {den}, 0), 1) END"


JOINED = f"{SCORED['temp']} t JOIN {SCORED['water']} w USING (row, col) JOIN {SCORED['pop']} p USING (row, col)"
SCORE_SQL = f"SELECT row, col, round({ratio_sql('(t.s * w.s)', 'p.s')}, 9) AS score FROM {JOINED}"


@check("c05_score", f"SELECT * FROM ({SCORE_SQL}) WHERE score IS NOT NULL")
def c05(t):
    return s.score(layer(t), FLAGSHIP, c.default_curves(t.spark)).withColumn("score", F.round("score", 9))


@check("c05_active_axis", f"SELECT row, col, round(s, 9) AS score FROM {SCORED['water']}")
def c05a(t):
    return s.score(layer(t), "  ", c.default_curves(t.spark), active_axis="water").withColumn("score", F.round("score", 9))


@check("c05_formula_shapes", f"SELECT row, col, round(least(greatest(-(t.s - 0.25) * 2 + w.s - -p.s / 4, 0), 1), 9) AS score FROM {JOINED}")
def c05f(t):
    return s.score(layer(t), "-(Temperature - .25) * 2 + rain - -people / 4 ?", c.default_curves(t.spark)).withColumn("score", F.round("score", 9))


@check("c05_flagship_top_places", f"SELECT row, col, score FROM ({SCORE_SQL}) WHERE score IS NOT NULL ORDER BY score DESC, row, col LIMIT 20")
def flagship(t):
    """The 20 best cells for the flagship formula."""
    scored = s.score(layer(t), FLAGSHIP, c.default_curves(t.spark)).withColumn("score", F.round("score", 9))
    return s.top_places(scored, 20)


@check("c06_match_pct", f"SELECT row, col, CAST(floor(score * 100 + 0.5) AS BIGINT) AS pct FROM ({SCORE_SQL}) WHERE score IS NOT NULL")
def c06(t):
    scored = s.score(layer(t), FLAGSHIP, c.default_curves(t.spark)).withColumn("score", F.round("score", 9))
    return scored.select(*CELL, s.match_pct(F.col("score")).alias("pct"))


WORDS = sorted(dims.ALIASES) + dims.AXES + ["bogus", "Nowhere"]


@check("c07_canonical_axes", "SELECT p_partkey AS id, word, axis FROM part JOIN (VALUES " + ", ".join(
    f"({i}, '{w.upper() if i % 2 else w}', '{dims.ALIASES.get(w.lower(), w.lower())}')" for i, w in enumerate(WORDS)) + f") v(i, word, axis) ON i = p_partkey % {len(WORDS)}")
def c07(t):
    key = F.col("p_partkey")
    listed = F.array(*[F.lit(w.upper() if i % 2 else w) for i, w in enumerate(WORDS)])
    words = t["part"].select(key.alias("id"), F.element_at(listed, (key % len(WORDS) + 1).cast("int")).alias("word"))
    return s.canonical_axes(words)


@check("c08_formula_axes", "SELECT o_orderkey AS profile, a AS axis FROM orders JOIN (VALUES " + ", ".join(f"({i}, '{a}')" for i, axes in enumerate(FORMULA_AXES) for a in axes) + ") f(i, a) ON i = o_orderkey % 6")
def c08(t):
    return s.formula_axis_rows(formulas(t))


@check("c05_no_curve", f"""SELECT row, col, round(least(greatest(t.s - p.byte / 255::DOUBLE, 0), 1), 9) AS score FROM {SCORED['temp']} t JOIN (SELECT row, col, {BYTES['pop']} AS byte FROM b_pop) p USING (row, col) WHERE p.byte > 0""")
def c05n(t):
    """Population has no curve here and counts as its byte."""
    return s.score(layer(t), "temp - pop", c.default_curves(t.spark, ["temp"])).withColumn("score", F.round("score", 9))


def harvest(t):
    """Cropland as its own layer: hectares of all crops in a cell."""
    return t.crop_cells().groupBy(*CELL).agg(F.sum("value").alias("value")).select(F.lit("agri").alias("axis"), *CELL, "value")


AGRI_SQL = f"""(SELECT row, col, l.score AS s FROM (SELECT row, col, {byte_sql('value', 0.0, 'ln(1 + cap)', log=True)} AS byte FROM
(SELECT row, col, sum(value) AS value FROM b_crops GROUP BY row, col), (SELECT quantile_cont(value, 0.995) AS cap FROM (SELECT sum(value) AS value FROM b_crops GROUP BY row, col) WHERE value > 0)) JOIN {default_lut_sql('agri')} l USING (byte) WHERE byte > 0)"""


@check("c05_open_bounds", f"SELECT row, col, round(least(greatest(t.s * a.s, 0), 1), 9) AS score FROM {SCORED['temp']} t JOIN {AGRI_SQL} a USING (row, col)")
def c05o(t):
    """Cropland's upper bound comes from its own cells."""
    layers = s.encode_layers(t.layers().unionByName(harvest(t)), open_axes=["agri"])
    return s.score(layers, "temp * agri", c.default_curves(t.spark)).withColumn("score", F.round("score", 9))


@check("c05_draw_axis", f"""SELECT level, cx, cy, round(least(greatest(s * 0.5 + draw / 3, 0), 1), 9) AS score FROM
(SELECT 6 AS level, col AS cx, row AS cy, s, CASE WHEN EXISTS (SELECT 1 FROM {FINE} f WHERE f.op = 'paint' AND f.x >> 1 = col AND f.y >> 1 = row) THEN 1 ELSE 0 END::DOUBLE AS draw FROM {SCORED['temp']})""")
def c05d(t):
    """Painted cells add a third, and a cell outside the paint keeps its score."""
    placed = layer(t).select("axis", F.lit(6).alias("level"), F.col("col").alias("cx"), F.col("row").alias("cy"), "byte")
    scored = s.score(placed, "temp * .5 + draw / 3", c.default_curves(t.spark), on=QUAD, mask=painted(t))
    return scored.withColumn("score", F.round("score", 9))


PROFILE_FORMULAS = ["(temp * water) / pop", "temp - water", "pop"]


def profile_layer(axis):
    """profile, row, col, s of one axis under every profile's own curve."""
    return f"(SELECT profile, row, col, floor(l.score * 255 + 0.5) / 255 AS s FROM (SELECT row, col, {BYTES[axis]} AS byte FROM b_{axis}) JOIN {LUT_SQL} l USING (byte) WHERE byte > 0)"


PT, PW, PP = (profile_layer(a) for a in ("temp", "water", "pop"))


C09_SQL = f"""SELECT profile, row, col, score FROM (SELECT profile, row, col, {ratio_sql('(t.s * w.s)', 'p.s')} AS score FROM {PT} t JOIN {PW} w USING (profile, row, col) JOIN {PP} p USING (profile, row, col) WHERE profile % 3 = 0
UNION ALL SELECT profile, row, col, least(greatest(t.s - w.s, 0), 1) FROM {PT} t JOIN {PW} w USING (profile, row, col) WHERE profile % 3 = 1 UNION ALL SELECT profile, row, col, s FROM {PP} WHERE profile % 3 = 2) WHERE score IS NOT NULL"""


def stored_profiles(t, listed):
    """A profile per supplier with one of ``listed`` formulas; one curve serves its three axes."""
    curves = profile_curves(t)
    choice = F.element_at(F.array(*[F.lit(f) for f in listed]), (F.col("profile") % len(listed) + 1).cast("int"))
    per_axis = reduce(lambda a, b: a.unionByName(b), [curves.withColumn("axis", F.lit(a)) for a in ("temp", "water", "pop")])
    return curves.select("profile", choice.alias("formula")), per_axis


@check("c09_score_profiles", f"SELECT profile, row, col, round(score, 9) AS score FROM ({C09_SQL})")
def c09(t):
    profiles, curves = stored_profiles(t, PROFILE_FORMULAS)
    return s.score_profiles(layer(t), profiles, curves).withColumn("score", F.round("score", 9))


@check("c09_best_places", f"""SELECT profile, CAST(rank AS INTEGER) AS rank, row, col, round(score, 9) AS score FROM
(SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, row, col) AS rank FROM ({C09_SQL})) WHERE rank <= 7""")
def c09b(t):
    profiles, curves = stored_profiles(t, PROFILE_FORMULAS)
    return best_places(layer(t), profiles, curves, 7, span=8, side=4).withColumn("score", F.round("score", 9))


ACTIVE_FORMULAS = ["", "temp +* water", "  ", "temp - nowhere", "pop - soil"]


@check("c09_active_axis", f"SELECT profile, row, col, round(s, 9) AS score FROM {PW} WHERE profile % 5 IN (0, 2)")
def c09a(t):
    """Profiles without a formula score their active axis; formulas that cannot be read leave the others alone."""
    profiles, curves = stored_profiles(t, ACTIVE_FORMULAS)
    return s.score_profiles(layer(t), profiles.withColumn("active_axis", F.lit("water")), curves).withColumn("score", F.round("score", 9))


@check("l05_top_places", f"SELECT row, col, score FROM ({SCORE_SQL}) WHERE score IS NOT NULL ORDER BY score DESC, row, col LIMIT 100")
def l05(t):
    scored = s.score(layer(t), FLAGSHIP, c.default_curves(t.spark)).withColumn("score", F.round("score", 9))
    return s.top_places(scored, 100)


FULL3 = {"temp": "CAST(max(id % 256) AS INTEGER)", "water": "CAST(max(id * 7 % 256) AS INTEGER)"}


def pixel_scores(axis):
    return f"(SELECT x, y, px, py, l.score AS s FROM (SELECT x, y, px, py, {FULL3[axis]} AS byte FROM {PLACED3} GROUP BY ALL) JOIN {default_lut_sql(axis)} l USING (byte) WHERE byte > 0)"


@check("j15_score_at_points", f"""SELECT id, CASE WHEN t.s IS NOT NULL AND w.s IS NOT NULL THEN round({ratio_sql('t.s', '(w.s + draw)')}, 9) END AS score FROM b_points LEFT JOIN (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM {FINE} f WHERE f.op = 'paint' AND f.x = (p.x * 256 + px) >> 4 AND f.y = (p.y * 256 + py) >> 4) THEN 1 ELSE 0 END AS draw FROM {PLACED3} p) USING (id)
LEFT JOIN {pixel_scores('temp')} t USING (x, y, px, py) LEFT JOIN {pixel_scores('water')} w USING (x, y, px, py)""")
def j15p(t):
    """A formula with the painted mask, read at points over zoom-3 tiles."""
    pixels = tile_pixel(t.points(), 3).groupBy("z", "x", "y", "px", "py").agg(
        F.max((F.col("id") % 256).cast("int")).alias("temp"), F.max((F.col("id") * 7 % 256).cast("int")).alias("water")
    )
    tiles = pixels.unpivot(["z", "x", "y", "px", "py"], ["temp", "water"], "axis", "byte")
    return s.score_at(t.points(), tiles, 3, "temp / (water + draw)", c.default_curves(t.spark), mask=painted(t)).withColumn("score", F.round("score", 9))
