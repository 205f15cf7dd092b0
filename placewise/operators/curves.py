"""Preference curves and the byte lookups made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise import dims
from placewise.functions.rounding import clamp

POINTS_TYPE = "array<struct<x:double,y:double>>"


def _shape(points: Column) -> Column:
    """A curve made ready to evaluate: its ends and its steps, points ordered by x (given order on ties)."""
    ordered = F.array_sort(F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p["y"].alias("y"))))
    shape = lambda o: F.struct(
        F.element_at(o, 1).alias("first"),
        F.element_at(o, -1).alias("last"),
        F.zip_with(
            F.slice(o, 1, F.size(o) - 1), F.slice(o, 2, F.size(o) - 1),
            lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")),
        ).alias("steps"),
    )
    built = F.transform(F.array(ordered), shape)[0]
    return F.when(F.coalesce(F.size(points), F.lit(0)) > 0, built)


def _evaluate(shape: Column, x: Column) -> Column:
    step = lambda s: (x >= s["x0"]) & (x <= s["x1"])
    along = lambda s: s["y0"] + F.when(s["x1"] > s["x0"], (x - s["x0"]) / F.nullif(s["x1"] - s["x0"], F.lit(0.0))).otherwise(F.lit(0.0)) * (s["y1"] - s["y0"])
    first_hit = F.transform(F.slice(F.filter(shape["steps"], step), 1, 1), along)[0]
    return (
        F.when(shape.isNull(), F.lit(0.5))
        .when(x <= shape["first"]["x"], shape["first"]["y"])
        .when(x >= shape["last"]["x"], shape["last"]["y"])
        .otherwise(first_hit)
    )


def curve_at(points: Column, x: Column) -> Column:
    """Piecewise-linear y at x with flat tails; 0.5 without points; a zero-width step takes its left y."""
    return F.transform(F.array(F.struct(_shape(points).alias("s"))), lambda h: _evaluate(h["s"], x))[0]


def curve_lut(curves: DataFrame) -> DataFrame:
    """256 rows (byte, score) per curve row: score = 1 - y at byte/255, clipped to [0, 1].

    The curve is put in order once, before its row fans out to the bytes.
    """
    shaped = curves.withColumn("_shape", _shape(F.col("points"))).drop("points")
    bytes_ = shaped.withColumn("byte", F.explode(F.sequence(F.lit(0), F.lit(255))))
    y = _evaluate(F.col("_shape"), F.col("byte").cast("double") / 255.0)
    return bytes_.withColumn("score", clamp(F.lit(1.0) - y, 0.0, 1.0)).drop("_shape")


def quantize_lut(lut: DataFrame) -> DataFrame:
    """Adds the score as a byte, nearest with ties up."""
    return lut.withColumn("lut_byte", F.floor(clamp(F.col("score"), 0.0, 1.0) * 255.0 + 0.5).cast("int"))


def apply_curve(layer: DataFrame, lut: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Layer bytes to scores in 255ths; byte 0 has no score, and without a curve a byte counts as it is.

    With one curve per axis the lookup holds 256 rows for each of at most 37 axes and is broadcast; under
    other keys (profiles) its size is not bounded and Spark chooses the join.
    """
    bounded = keys is None
    keys = keys or ["axis"]
    lookup = lut.select(*keys, "byte", (F.col("lut_byte").cast("double") / 255.0).alias("_s"))
    scored = layer.join(F.broadcast(lookup) if bounded else lookup, [*keys, "byte"], "left")
    return scored.withColumn("score", F.when(F.col("byte") > 0, F.coalesce("_s", F.col("byte").cast("double") / 255.0))).drop("_s")


def default_curves(spark: SparkSession, axes: list[str] | None = None) -> DataFrame:
    rows = [(axis, dims.DEFAULT_CURVES.get(axis, dims.LINEAR_UP)) for axis in (axes or dims.AXES)]
    rows = [(axis, [{"x": x, "y": y} for x, y in points]) for axis, points in rows]
    return dims.small_table(spark, rows, f"axis string, points {POINTS_TYPE}")
