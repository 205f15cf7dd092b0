"""Records at points: small lookups are sent, large ones meet the points in one shuffle, hot cells are cut."""

import pytest
from pyspark.sql import functions as F

from placewise.functions.grid import Grid
from placewise.operators import lookup


@pytest.fixture
def city(spark):
    """6000 points: a third in one cell, some without a cell, the rest over 40 cells."""
    n = F.col("id")
    row = F.when(n % 3 == 0, 7).when(n % 3 == 1, n % 40).when(n % 20 != 2, n % 37)
    return spark.range(6000).select("id", row.cast("int").alias("row"), F.when(n % 3 == 0, 7).otherwise(n % 5).cast("int").alias("col"), F.lit("x").alias("name"))


@pytest.fixture
def records(spark):
    return spark.range(300).select((F.col("id") % 40).cast("int").alias("row"), F.floor(F.col("id") / 40).cast("int").alias("col"), (F.col("id") * 1.5).alias("value"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_both_ways_give_a_plain_join(spark, city, records, how, monkeypatch):
    want = sorted(map(str, city.join(records, ["row", "col"], how).select("id", "row", "col", "name", "value").collect()))
    for sent in (lookup.SENT, 10):
        monkeypatch.setattr(lookup, "SENT", sent)
        out = lookup.attach(city, records, ["row", "col"], how)
        assert out.columns == ["row", "col", "id", "name", "value"]
        assert sorted(map(str, out.select("id", "row", "col", "name", "value").collect())) == want


def exchanges(df, table):
    """Shuffles between the scan of ``table`` and the result."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Exchange rangepartitioning"), plan.count("CartesianProduct") + plan.count("NestedLoop")


def test_small_lookups_leave_the_points_in_place(city, records):
    assert exchanges(lookup.attach(city, records, ["row", "col"]), city) == (0, 0, 0)


def test_one_shuffle_each_and_no_hot_task(spark, city, records, monkeypatch):
    monkeypatch.setattr(lookup, "SENT", 10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = lookup.attach(city, records, ["row", "col"], "left")
        assert exchanges(out, city)[0] == 2  # one of the points, one of the records
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        plain = [r["count"] for r in city.join(records.hint("merge"), ["row", "col"], "left").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == sum(plain) == 6000
    assert max(plain) >= 2000 and max(sizes) < 1000


def test_risk_at_reads_a_cell_once(spark):
    points = spark.createDataFrame([(1, -179.0, 89.0), (2, -179.0, 89.0), (3, 10.0, 0.0)], "id long, lon double, lat double")
    rows = spark.createDataFrame([("eq", 0, 0, 12, 0.5, 15), ("flood", 0, 0, 3, 0.25, 15)], "hazard string, row int, col int, tenths int, intensity double, composite_tenths int")
    out = lookup.risk_at(points, rows, Grid.world(10.0))
    assert sorted(tuple(r) for r in out.collect()) == [(i, h, r, v, 1.5) for i in (1, 2) for h, r, v in (("eq", 1.2, 0.5), ("flood", 0.3, 0.25))]
    assert exchanges(out, points)[0] == 0


def test_empty_sides(spark, city, records, monkeypatch):
    for sent in (lookup.SENT, -1):
        monkeypatch.setattr(lookup, "SENT", sent)
        assert lookup.attach(city, records.limit(0), ["row", "col"], "left").where("value IS NULL").count() == 6000
        assert lookup.attach(city.limit(0), records, ["row", "col"]).count() == 0
