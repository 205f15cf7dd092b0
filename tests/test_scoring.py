"""Curves, formulas, composite scores, profiles."""

import pytest
from pyspark.sql import functions as F

from placewise import dims
from placewise.functions.formula import FormulaError, formula_axes, formula_column, validate_formula
from placewise.operators import curves as c
from placewise.operators import score as s


def lut(spark, points):
    df = spark.createDataFrame([(points,)], f"points {c.POINTS_TYPE}")
    return {r.byte: r.score for r in c.curve_lut(df).collect()}


def test_curve_tails_are_flat(spark):
    out = lut(spark, [(0.25, 1.0), (0.5, 0.0)])
    assert len(out) == 256 and out[0] == 0.0 and out[255] == 1.0
    assert out[96] == pytest.approx((96 / 255 - 0.25) / 0.25)


def test_curve_without_points_is_half(spark):
    assert set(lut(spark, []).values()) == {0.5}


def test_curve_points_may_come_unsorted_and_step(spark):
    df = spark.createDataFrame([([(1.0, 0.0), (0.4, 0.2), (0.4, 0.9), (0.0, 1.0)],)], f"points {c.POINTS_TYPE}")
    at = lambda x: df.select(c.curve_at(F.col("points"), F.lit(x))).first()[0]
    assert at(0.4) == pytest.approx(0.2) and at(0.2) == pytest.approx(0.6) and at(0.7) == pytest.approx(0.45)


def run(spark, formula, **axes):
    columns = [F.lit(v).cast("double").alias(f"f_{k}") for k, v in axes.items()]
    from placewise.functions.formula import clamp_score

    return spark.range(1).select(*columns).select(formula_column(formula).alias("r")).select(clamp_score(F.col("r"))).first()[0]


def test_division_by_zero(spark):
    assert run(spark, "t / p", temp=0.5, pop=0.0) == 1.0
    assert run(spark, "(t - 1) / p", temp=0.5, pop=0.0) == 0.0
    assert run(spark, "t / p", temp=0.0, pop=0.0) is None
    assert run(spark, "t / -p", temp=0.5, pop=0.0) == 0.0


def test_missing_axis_is_missing_score(spark):
    assert run(spark, "t * w", temp=None, water=0.5) is None


def test_formula_words():
    assert formula_axes("(T x w)/p") == ["temp", "water", "pop"]
    assert formula_axes("earthquake + Safety $ - hdi") == ["risk", "depv"]
    assert len(dims.ALIASES) == 135


@pytest.mark.parametrize("text", ["", "t +", "t w", "t ** w", "t // w", "+t", "(t", "t)", "$", "()"])
def test_formulas_that_do_not_read(text):
    with pytest.raises(FormulaError):
        validate_formula(text)
        formula_column(text)


def test_formula_validation():
    with pytest.raises(FormulaError, match="Unknown: cost, b"):
        validate_formula("cheap + b")
    with pytest.raises(FormulaError, match="Max 4"):
        validate_formula("t+w+p+g+a")
    assert validate_formula("t+w+p+g+t") == ["temp", "water", "pop", "gdp"]


def test_formula_precedence(spark):
    assert run(spark, "1 - t * .5 - -w / 2.", temp=0.5, water=0.25) == pytest.approx(0.875)
    assert run(spark, "--t", temp=0.5) == 0.5
    assert run(spark, "t x w", temp=0.5, water=0.5) == 0.25


def layer(spark):
    data = [("temp", 0, 0, 255), ("water", 0, 0, 255), ("pop", 0, 0, 255), ("temp", 0, 1, 0), ("water", 0, 1, 200), ("pop", 0, 1, 3), ("temp", 1, 1, 51)]
    return spark.createDataFrame(data, "axis string, row int, col int, byte int")


def linear(spark, *axes):
    return spark.createDataFrame([(a, dims.LINEAR_UP) for a in axes], f"axis string, points {c.POINTS_TYPE}")


def test_score_needs_every_axis(spark):
    out = s.score(layer(spark), "t * w * p", linear(spark, "temp", "water", "pop")).collect()
    assert [(r.row, r.col, r.score) for r in out] == [(0, 0, 1.0)]


def test_empty_formula_scores_the_active_axis(spark):
    out = s.score(layer(spark), " ", linear(spark, "temp"), active_axis="temp").collect()
    assert sorted((r.row, r.col, r.score) for r in out) == [(0, 0, 1.0), (1, 1, 0.2)]


def test_profiles_in_groups_match_single_scores(spark, monkeypatch):
    monkeypatch.setattr(s, "PROFILE_GROUP", 2)
    profiles = spark.createDataFrame([(i, ["t", "t * w"][i % 2]) for i in range(9)], "profile int, formula string")
    curves = spark.createDataFrame([(i, a, dims.LINEAR_UP) for i in range(9) for a in ("temp", "water")], f"profile int, axis string, points {c.POINTS_TYPE}")
    out = s.score_profiles(layer(spark), profiles, curves).collect()
    want = {(i, 0, 0, 1.0) for i in range(9)} | {(i, 1, 1, 0.2) for i in range(0, 9, 2)}
    assert {(r.profile, r.row, r.col, round(r.score, 6)) for r in out} == want and len(out) == len(want)
