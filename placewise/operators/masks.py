"""Nulling out sea and lake cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.functions.geometry import rings_area_km2

CELL = ["row", "col"]
MIN_LAKE_KM2 = 100.0


def large_lakes(polygons: DataFrame, min_km2: float = MIN_LAKE_KM2) -> DataFrame:
    """Polygons of at least ``min_km2``; smaller lakes don't count as water."""
    return polygons.where(rings_area_km2(F.col("rings")) >= min_km2)


def ocean_cells(elev: DataFrame) -> DataFrame:
    return elev.where(F.col("value") <= 0).select(*CELL)


def null_cells(df: DataFrame, cells: DataFrame) -> DataFrame:
    """NULL the value wherever ``cells`` (distinct row, col) holds the cell."""
    # both sides are grids, and lake cells come from small polygon tables: never broadcast them on an estimate
    marked = cells.withColumn("_water", F.lit(True)).hint("merge")
    return df.join(marked, CELL, "left").withColumn("value", F.when(F.col("_water").isNull(), F.col("value"))).drop("_water")


def ocean_mask(df: DataFrame, elev: DataFrame | None) -> DataFrame:
    """Cells at or below sea level lose their value; without elevation nothing is masked."""
    if elev is None:
        return df
    return null_cells(df, ocean_cells(elev))


def water_mask(df: DataFrame, elev: DataFrame | None, lake_cells: DataFrame | None) -> DataFrame:
    """Sea or large-lake cells lose their value; without elevation nothing is masked."""
    if elev is None:
        return df
    water = ocean_cells(elev)
    if lake_cells is not None:
        water = water.unionByName(lake_cells.select(*CELL))
    return null_cells(df, water.distinct())


def lake_mask(df: DataFrame, lake_cells: DataFrame) -> DataFrame:
    return null_cells(df, lake_cells.select(*CELL).distinct())
