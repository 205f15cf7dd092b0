"""Energy balance by country, sharpened by where capacity stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise import dims
from placewise.functions.grid import Grid, cell_clamped
from placewise.functions.rounding import clamp
from placewise.operators.aggregate import CELL, fuel_breakdown, grid_sum
from placewise.operators.names import map_names
from placewise.session import materialised

MAX_BOOST = 30.0


def balance_score(net_imports: Column) -> Column:
    """Net imports (per cent of use) to 0..100: exporters above 50, clamped at +/-200 per cent."""
    return (clamp(-net_imports, -200.0, 200.0) + 200.0) / 400.0 * 100.0


def energy_scores(polygon_names: DataFrame, balance: DataFrame, fuels: DataFrame) -> DataFrame:
    """name, score, fuels (map): both sources under the map's names, kept where either has the country.

    ``balance`` holds country, score, ordinal; ``fuels`` country, fuel, capacity and, where known, first
    (the country's first line), which orders its keys; without it they are taken by name.
    """
    groups = dims.name_group_dim(polygon_names.sparkSession)
    scored = map_names(polygon_names, balance.select(F.col("country").alias("key"), "ordinal"), groups)
    scores = scored.join(balance, F.col("key") == F.col("country")).select("name", "score")
    order = F.min("first") if "first" in fuels.columns else F.first("country")
    per_country = fuels.groupBy("country").agg(
        F.map_from_entries(F.collect_list(F.struct("fuel", "capacity"))).alias("fuels"), order.alias("ordinal")
    )
    fuel_keys = per_country.select(F.col("country").alias("key"), "ordinal")
    fuelled = map_names(polygon_names, fuel_keys, groups)
    maps = fuelled.join(per_country, F.col("key") == F.col("country")).select("name", "fuels")
    return scores.join(maps, "name", "full_outer")


def energy_balance(plants: DataFrame, balance: DataFrame, cell_zone: DataFrame, grid: Grid) -> DataFrame:
    """row, col, value: the country's score plus up to 30 points where plants stand, clipped to 0..100.

    ``balance`` holds zone, score. Without any capacity the boost is 0.
    """
    capacity = grid_sum(cell_clamped(plants, grid), "capacity")
    logs = capacity.select(*CELL, F.when(F.col("value") > 0, F.log1p("value")).otherwise(F.lit(0.0)).alias("_log"))
    top = logs.agg(F.max("_log")).scalar()
    country = cell_zone.join(materialised(balance), "zone").select(*CELL, "score")
    boost = F.when(F.col("_top") > 0, F.coalesce("_log", F.lit(0.0)) / F.col("_top") * MAX_BOOST).otherwise(F.lit(0.0))
    blended = country.join(logs, CELL, "left").withColumn("_top", top)
    return blended.select(*CELL, clamp(F.col("score") + boost, 0.0, 100.0).alias("value"))
