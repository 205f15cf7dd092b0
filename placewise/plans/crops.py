"""Top-crop lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.functions.grid import Grid
from placewise.operators.aggregate import CELL
from placewise.operators.ranking import top_n_per_cell
from placewise.operators.resample import block_agg

SUITABILITY_NODATA = 255.0


def crop_lookup(cells: DataFrame, grid: Grid, factor: int, kind: str, top: int = 5) -> DataFrame:
    """row, col, crop, rank, amount of the best crops per block.

    ``harvest`` sums hectares and keeps blocks with more than one in total; ``suitability`` averages an
    index whose nodata counts 0 and keeps blocks where some crop passes one. Crops are a grouping key,
    so all of them share one job.
    """
    value = F.col("value")
    if kind == "harvest":
        clean = F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)
        blocks = block_agg(cells.withColumn("value", clean), grid, factor, "sum", ["crop"])
        kept = blocks.groupBy(*CELL).agg(F.sum("value").alias("_t"))
    else:
        clean = F.when(value.isNull() | (value == SUITABILITY_NODATA), 0.0).otherwise(value)
        blocks = block_agg(cells.withColumn("value", clean), grid, factor, "avg", ["crop"])
        kept = blocks.groupBy(*CELL).agg(F.max("value").alias("_t"))
    wanted = kept.where(F.col("_t") > 1.0).select(*CELL)
    return top_n_per_cell(blocks.join(wanted, CELL, "left_semi"), "crop", top).drop("value")
