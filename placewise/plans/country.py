"""Country scores burnt onto their polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise import dims
from placewise.functions.grid import Grid
from placewise.operators.aggregate import CELL
from placewise.operators.names import map_names
from placewise.operators.zones import assign_zones
from placewise.session import materialised


def country_layer(zones: DataFrame, scores: DataFrame, grid: Grid) -> DataFrame:
    """row, col, value: each cell takes the score of its country, names matched across sources.

    ``zones`` holds ord, name, rings; ``scores`` key, ordinal, value. Polygons without a score are not
    burnt at all, so they hide nothing beneath them.
    """
    groups = dims.name_group_dim(zones.sparkSession)
    matched = map_names(zones, scores.select("key", "ordinal"), groups).join(scores.select("key", "value"), "key")
    scored = zones.join(matched.select("name", "value"), "name")
    cells = assign_zones(scored.select("ord", "rings"), grid)
    values = materialised(scored.select(F.col("ord").alias("zone"), "value"))
    return cells.join(values, "zone").select(*CELL, "value")
