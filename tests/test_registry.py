"""The driver contract and the shape of the plans."""

import duckdb
import pytest

import __spark_entry__ as contract
from placewise import checks

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = sorted(n for n in contract.queries() if n in checks.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def order(row):
    return tuple((v is None, "" if v is None else v) for v in row)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=order)
    rel = duck.sql(contract.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted(rel.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=order)
    assert got == want


def test_every_query_has_sql():
    assert set(checks.QUERIES) == set(checks.SQL)


def test_entry(spark):
    assert len(contract.entry(spark).collect()) == 20


def plan(spark, name):
    return checks.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j04_assign_zones", "j05_assign_all_touched", "j07_harmonise_names", "j20_overzoom", "d04_mask_at", "a14_resample_bilinear", "c03_apply_curve", "p02_calibrate", "n02_percentile_bytes"])
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_flagship_reads_three_columns_and_keeps_no_sort(spark):
    text = plan(spark, "c05_flagship_top_places")
    assert "TakeOrderedAndProject" in text and "SortMergeJoin" not in text
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double>" in text


def test_top_n_is_trimmed_before_the_shuffle(spark):
    assert plan(spark, "w04_top_n_per_cell").count("WindowGroupLimit") == 2


def test_grids_made_from_polygons_are_not_broadcast_on_estimates(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        text = plan(spark, "a07_zonal_mean")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
