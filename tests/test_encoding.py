"""Hand-worked values: cleaning, bytes, stretches, coordinates, labels."""

import math

import pytest
from pyspark.sql import functions as F

from placewise import dims
from placewise.functions import encode as e
from placewise.functions import grid as g
from placewise.functions.grid import Grid


def column(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} double")


def values(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_linear_bytes(spark):
    df = column(spark, [0.0, 10.0, 25.0, None])
    assert values(df, e.to_byte(F.col("v"), 0, 10)) == [1, 255, 255, 0]


def test_no_number_is_missing(spark):
    df = column(spark, [float("nan"), float("inf"), float("-inf")])
    assert values(df, e.to_byte(F.col("v"), 0, 10)) == [0, 255, 1]


def test_equal_bounds(spark):
    df = column(spark, [5.0, 9.0])
    assert values(df, e.to_byte(F.col("v"), 5, 5)) == [1, 255]


def test_log_of_zero_is_lowest_byte(spark):
    df = column(spark, [0.0, None, 100.0])
    assert values(df, e.to_byte(F.col("v"), 0, 100, log=True)) == [1, 0, 255]


def test_bytes_are_monotone(spark):
    df = column(spark, [x / 7.0 for x in range(-20, 120)])
    out = values(df, e.to_byte(F.col("v"), 0, 10))
    assert out == sorted(out) and min(out) == 1 and max(out) == 255


def test_nodata_tolerance(spark):
    df = column(spark, [-9998.85, -9998.5, float("nan"), None, 3.0])
    assert values(df, e.valid_or_null(F.col("v"), -9999.0)) == [None, -9998.5, None, None, 3.0]


def test_zero_fill(spark):
    df = column(spark, [float("nan"), float("inf"), -2.0, None, 3.0])
    assert values(df, e.zero_fill(F.col("v"))) == [0.0, 0.0, 0.0, 0.0, 3.0]


@pytest.mark.parametrize("kind,gamma", [("linear", 1.0), ("sqrt", 1.0), ("gamma", 0.4)])
def test_stretch_round_trip(spark, kind, gamma):
    df = column(spark, [0.0, 1.0, 5.5, 10.0, 12.0, None])
    out = values(df, e.unstretch(e.stretch(F.col("v"), 10, kind, gamma) / 10.0, 10, kind, gamma))
    assert out[-1] is None
    assert out[:-1] == pytest.approx([0.0, 1.0, 5.5, 10.0, 10.0])


def test_decode_inverts_what_was_stored_inverted(spark):
    df = spark.createDataFrame([(0, 255), (1, 0), (2, 51)], "i int, b int")
    assert values(df, e.decode("air", F.col("b"))) == [0.0, None, 56.0]
    assert values(df, e.decode("landslide", F.col("b")))[0] == 0.0


def test_cells_at_the_edges(spark):
    grid = Grid.world(0.1)
    df = spark.createDataFrame([(0, -180.04, 0.0), (1, 180.0, 0.0), (2, 0.0, -90.0)], "i int, lon double, lat double")
    clamped = {r.i: (r.row, r.col) for r in g.cell_clamped(df, grid).collect()}
    assert clamped[0][1] == 0 and clamped[1][1] == 3599 and clamped[2][0] == 1799
    bounded = {r.i: (r.row, r.col) for r in g.cell_bounded(df, grid).collect()}
    assert set(bounded) == {0} and bounded[0][1] == 0


def test_lookup_cell_outside_is_null(spark):
    df = spark.createDataFrame([(0, 10.0, 10.0), (1, 200.0, 10.0)], "i int, lon double, lat double")
    out = {r.i: r.row for r in g.lookup_cell_origin(df, Grid(1.0, 100, 50, left=0.0, top=50.0)).collect()}
    assert out == {0: 40, 1: None}


def test_mercator_inverse(spark):
    df = column(spark, [-80.0, -10.0, 0.0, 45.0, 84.0])
    out = values(df, g.lat_fraction(g.mercator_y(F.col("v"))) * 180.0 - 90.0)
    assert out == pytest.approx([-80.0, -10.0, 0.0, 45.0, 84.0])


def test_tile_of_date_line_wraps(spark):
    df = spark.createDataFrame([(180.0, 0.0)], "lon double, lat double")
    row = g.tile_pixel(df, 2).first()
    assert (row.x, row.y, row.px, row.py) == (0, 2, 0, 0)


def test_labels(spark):
    df = column(spark, [0.0, 0.05, 5.0, 1000.0, 20000.0])
    assert values(df, e.odds(F.col("v"))) == ["~0", "1 in 20.0 million per year", "1 in 200 thousand per year", "1 in 1 thousand per year", "1 in 50 per year"]
    assert values(df, e.rate_text(F.col("v"))) == ["<0.05", "<0.1", "5.0", "1000", "20000"]
    df = column(spark, [0.5, 0.8, 0.2, 0.57, 0.47])
    assert values(df, e.balance_label(F.col("v"))) == ["+0 (Balanced)", "+30 (Major exporter)", "-30 (Major importer)", "+7 (Net exporter)", "-3 (Balanced)"]
    df = column(spark, [12.4, 59.6, 89.0, 150.0])
    assert values(df, e.minutes_label(F.col("v"))) == ["12 min", "1 hr", "1 hr", "3 hrs"]


def test_every_band_ends_open(spark):
    df = column(spark, [-1e9, 1e9, None])
    for name, bands in dims.BANDS.items():
        assert values(df, e.band(name, F.col("v"))) == [bands[0][1], bands[-1][1], None]


def test_log_bounds_follow_sign(spark):
    df = column(spark, [math.e - 1])
    assert values(df, e.to_byte(F.col("v"), 0, math.e ** 2 - 1, log=True)) == [128]
