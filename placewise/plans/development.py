"""Development records on a lookup grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.functions.grid import Grid
from placewise.operators.aggregate import CELL, latest_per_key
from placewise.operators.zones import assign_zones, region_join
from placewise.session import materialised

FIELDS = ["country", "region", "shdi", "health", "education", "income", "lifexp", "esch_yrs", "gnic"]


def development_lookup(polygons: DataFrame, records: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """(cells, regions): the region id of every touched cell and the newest record per id.

    ``polygons`` holds ord, code, rings; ``records`` cleaned index rows with line_no.
    """
    latest = latest_per_key(records, "code", "year", "line_no", *FIELDS)
    matched = region_join(polygons, latest)
    ids = materialised(matched.select(F.col("ord").alias("_o"), F.col("zone").alias("_z")))
    cells = assign_zones(matched.select("ord", "rings"), grid, all_touched=True)
    by_cell = cells.join(ids, F.col("zone") == F.col("_o")).select(*CELL, F.col("_z").alias("zone"))
    regions = matched.select("zone", "code", "year", *FIELDS).distinct()
    return by_cell, regions
