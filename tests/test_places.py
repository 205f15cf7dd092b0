"""Best places of many profiles: equal to full scoring, without scoring everything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placewise.functions.formula import Formula, FormulaError
from placewise.operators import places
from placewise.operators.curves import POINTS_TYPE, curve_lut, default_curves, quantize_lut
from placewise.operators.score import encode_layers, score, score_profiles

FORMULAS = ["temp", "temp * water", "(temp - water) / pop", "temp + water - pop * .5", "-temp / (0 - water)", "temp / (water - pop)", "", "temp +* 2"]


@pytest.fixture(scope="module")
def hills(spark):
    """Smooth fields over 192 by 160 cells, with holes."""
    r, c = F.col("id") / 160 % 192, F.col("id") % 160
    cells = spark.range(192 * 160).select(F.floor(F.col("id") / 160).cast("int").alias("row"), (F.col("id") % 160).cast("int").alias("col"))
    field = lambda a, b, s: (128 + 120 * F.sin(F.col("row") / a + s) * F.cos(F.col("col") / b - s)).cast("int")
    named = cells.select("row", "col", field(31.0, 23.0, 0.3).alias("temp"), field(17.0, 41.0, 1.1).alias("water"), field(53.0, 29.0, 2.0).alias("pop"))
    long = named.unpivot(["row", "col"], ["temp", "water", "pop"], "axis", "byte")
    return long.where((F.col("axis") != "pop") | (F.col("row") % 7 != 3)).cache()


def table(spark, n):
    rows = [(i, FORMULAS[i % len(FORMULAS)], "water") for i in range(n)]
    curves = []
    for i in range(n):
        for j, axis in enumerate(("temp", "water", "pop")):
            if (i + j) % 4:  # the others have no curve
                points = [(round(((i * 7 + j * 3 + k * 5) % 11) / 10, 3), round(((i * 3 + j + k * 7) % 9) / 8, 3)) for k in range((i + j) % 5)]
                curves.append((i, axis, [{"x": x, "y": y} for x, y in points]))
    profiles = spark.createDataFrame(rows, "profile long, formula string, active_axis string")
    return profiles, spark.createDataFrame(curves, f"profile long, axis string, points {POINTS_TYPE}")


def test_best_places_equal_full_scoring(spark, hills):
    profiles, curves = table(spark, 40)
    found = places.search(hills, profiles, curves, 9, span=64, side=8)
    best = {(r.profile, r.rank): (r.row, r.col, r.score) for r in places.first_places(found, 9).collect()}
    everything = score_profiles(hills, profiles, curves)
    order = Window.partitionBy("profile").orderBy(F.desc("score"), "row", "col")
    wanted = everything.withColumn("rank", F.row_number().over(order)).where("rank <= 9")
    assert best == {(r.profile, r.rank): (r.row, r.col, r.score) for r in wanted.collect()}
    assert {p for p, _ in best} == {i for i in range(40) if i % len(FORMULAS) != 7}
    looked = sum(r.looked for r in places.cells_looked_at(found).collect())
    assert looked < 0.35 * 35 * 192 * 160


def test_scores_equal_the_column_formula(spark, hills):
    profiles, curves = table(spark, 16)
    everything = {(r.profile, r.row, r.col): r.score for r in score_profiles(hills, profiles, curves).collect()}
    for i, formula in enumerate(FORMULAS[:6]):
        own = score(hills, formula, curves.where(F.col("profile") == i).drop("profile")).collect()
        assert {(r.row, r.col): r.score for r in own} == {k[1:]: v for k, v in everything.items() if k[0] == i}


def test_plan_has_one_shape(spark, hills):
    def operators(n):
        profiles, curves = table(spark, n)
        plan = places.best_places(hills, profiles, curves, 3, span=64, side=8)._jdf.queryExecution().executedPlan().toString()
        return [line.strip(" +-:*()0123456789").split("(")[0].split(" ")[0] for line in plan.splitlines()]

    assert operators(3) == operators(60)


def test_many_profiles_share_copies_of_a_square(spark, hills, monkeypatch):
    monkeypatch.setattr(places, "SEARCHING", 3)
    profiles, curves = table(spark, 24)
    few = {tuple(r) for r in places.best_places(hills, profiles, curves, 4, span=64, side=8).collect()}
    monkeypatch.setattr(places, "SEARCHING", 1000)
    assert few == {tuple(r) for r in places.best_places(hills, profiles, curves, 4, span=64, side=8).collect()}


def test_empty_tables(spark, hills):
    profiles, curves = table(spark, 4)
    assert places.best_places(hills.limit(0), profiles, curves, 3).count() == 0
    assert places.best_places(hills, profiles.limit(0), curves, 3).count() == 0
    assert places.best_places(hills, profiles, curves.limit(0), 1, span=64, side=8).count() == 4


def test_a_fine_grid_asks_for_a_larger_span(spark, hills, monkeypatch):
    monkeypatch.setattr(places, "INDEXED", 2)
    profiles, curves = table(spark, 2)
    with pytest.raises(ValueError, match="span"):
        places.best_places(hills, profiles, curves, 3, span=64, side=8)


def test_lookup_equals_curve_lut(spark):
    _, curves = table(spark, 30)
    luts = quantize_lut(curve_lut(curves)).groupBy("profile", "axis").agg(F.sort_array(F.collect_list(F.struct("byte", "lut_byte"))).alias("l"))
    points = {(r.profile, r.axis): r.points for r in curves.collect()}
    for r in luts.collect():
        assert [e.lut_byte for e in r.l] == np.round(places.lookup([p.asDict() for p in points[r.profile, r.axis]]) * 255).tolist()


@pytest.mark.parametrize("text", FORMULAS[:6] + ["1 / temp - 2 * water", "temp * water / (pop - .5)", "(temp - .5) * (water - .5)"])
def test_bounds_hold(text):
    rng = np.random.default_rng(5)
    formula = Formula(text)
    for _ in range(200):
        low = {a: rng.integers(0, 5, 1) / 4 for a in formula.axes}
        high = {a: np.minimum(low[a] + rng.integers(0, 3, 1) / 4, 1.0) for a in formula.axes}
        inside = {a: rng.uniform(low[a], high[a], 50) for a in formula.axes}
        for a in formula.axes:
            inside[a][0], inside[a][1] = low[a][0], high[a][0]
        scores = np.broadcast_to(formula.scores(inside), 50)
        assert np.all(np.isnan(scores) | (scores <= formula.best(low, high)[0]))


def test_formula_refuses_what_columns_refuse():
    for bad in ("", "temp **", "nowhere", "temp // 2", "temp + water + pop + gdp + elev", "f(temp)"):
        with pytest.raises((FormulaError, ValueError)):
            Formula(bad)


def test_draw_needs_a_mask(spark, hills):
    with pytest.raises(FormulaError):
        score(hills, "temp * draw", default_curves(spark))


def test_axes_without_bounds_stop_the_job(spark):
    layers = spark.createDataFrame([("temp", 0, 0, 1.0), ("agri", 0, 0, 7.0), ("agri", 0, 1, math.e)], "axis string, row int, col int, value double")
    with pytest.raises(Exception, match="no bounds for axis agri"):
        encode_layers(layers).collect()
    assert encode_layers(layers, open_axes=["agri"]).where("axis = 'agri' AND byte > 0").count() == 2
