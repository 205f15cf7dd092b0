"""Moving layers between grid resolutions.

Finer grids hold many more rows than an estimate from the coarse ones shows, so their tables ask for a
sort-merge join and are never broadcast on that estimate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.functions.grid import Grid

CELL = ["row", "col"]


def _blocks(df: DataFrame, factor: int) -> DataFrame:
    return df.withColumns({c: F.floor(F.col(c) / factor).cast("int") for c in CELL})


def _inside(df: DataFrame, grid: Grid) -> DataFrame:
    return df.where((F.col("row") < grid.height) & (F.col("col") < grid.width))


def block_agg(df: DataFrame, grid: Grid, factor: int, how: str, keys: list[str] | None = None) -> DataFrame:
    """Sum or mean over factor x factor blocks; partial edge blocks are discarded.

    The mean divides by factor squared, so an absent cell counts as 0.
    """
    total = F.sum("value")
    value = total if how == "sum" else total / float(factor * factor)
    blocks = _inside(_blocks(df, factor), grid.coarser(factor))
    return blocks.groupBy(*(keys or []), *CELL).agg(value.alias("value"))


def resample_down(df: DataFrame, grid: Grid, factor: int, how: str, keys: list[str] | None = None) -> DataFrame:
    """Average (missing cells ignored) or maximum over whole-number blocks, edge blocks kept."""
    agg = {"average": F.avg, "max": F.max}[how]("value")
    return _blocks(df, factor).groupBy(*(keys or []), *CELL).agg(agg.alias("value"))


def resample_sum(df: DataFrame, source: Grid, target: Grid, keys: list[str] | None = None) -> DataFrame:
    """Sum-conserving resample to any resolution: a cell's value is split by overlap area.

    Each source cell explodes into the few target cells it overlaps, then one combinable sum follows.
    """
    spread = df
    for axis, size in (("row", target.height), ("col", target.width)):
        lo = F.col(axis) * source.res
        hi = lo + source.res
        first = F.floor(lo / target.res + 1e-9).cast("int")
        last = F.least(F.ceil(hi / target.res - 1e-9).cast("int") - 1, F.lit(size - 1))
        spread = spread.where(first <= last).withColumn(f"_{axis}", F.explode(F.sequence(first, last)))
        cell_lo = F.col(f"_{axis}") * target.res
        overlap = F.least(hi, cell_lo + target.res) - F.greatest(lo, cell_lo)
        spread = spread.withColumn(f"_{axis}_share", F.greatest(overlap / source.res, F.lit(0.0)))
    value = F.col("value") * F.col("_row_share") * F.col("_col_share")
    return spread.groupBy(*(keys or []), F.col("_row").alias("row"), F.col("_col").alias("col")).agg(F.sum(value).alias("value"))


def resample_bilinear(df: DataFrame, source: Grid, target: Grid, keys: list[str] | None = None) -> DataFrame:
    """Bilinear interpolation at the target cell centres; missing neighbours drop out of the weights.

    Every source cell is sent to the target centres within one source cell of it, so the target grid is
    never built and joined: one explode, one combinable aggregation. Beyond the outermost source centres
    the edge value continues.
    """
    spread = df
    for axis, n_source, n_target in (("row", source.height, target.height), ("col", source.width, target.width)):
        ratio = target.res / source.res
        at = lambda t: F.least(F.greatest((t.cast("double") + 0.5) * ratio - 0.5, F.lit(0.0)), F.lit(float(n_source - 1)))
        edge_lo, edge_hi = F.col(axis) == 0, F.col(axis) == n_source - 1
        first = F.when(edge_lo, F.lit(0)).otherwise(F.greatest(F.floor((F.col(axis) - 0.5) / ratio - 0.5).cast("int"), F.lit(0)))
        last = F.when(edge_hi, F.lit(n_target - 1)).otherwise(
            F.least(F.ceil((F.col(axis) + 1.5) / ratio - 0.5).cast("int"), F.lit(n_target - 1))
        )
        spread = spread.where(first <= last).withColumn(f"_{axis}", F.explode(F.sequence(first, last)))
        weight = F.lit(1.0) - F.abs(at(F.col(f"_{axis}")) - F.col(axis))
        spread = spread.withColumn(f"_{axis}_w", weight).where(F.col(f"_{axis}_w") > 0)
    w = F.col("_row_w") * F.col("_col_w")
    valid = spread.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return valid.groupBy(*(keys or []), F.col("_row").alias("row"), F.col("_col").alias("col")).agg(
        (F.sum(F.col("value") * w) / F.sum(w)).alias("value")
    ).hint("merge")


def resample_nearest(df: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Each target cell takes the source cell under its centre. No shuffle: source cells explode."""
    spread = df
    for axis, size in (("row", target.height), ("col", target.width)):
        ratio = target.res / source.res
        # target t takes source floor((t + 0.5) * ratio)
        first = F.greatest(F.ceil(F.col(axis) / ratio - 0.5).cast("int"), F.lit(0))
        last = F.least(F.ceil((F.col(axis) + 1) / ratio - 0.5).cast("int") - 1, F.lit(size - 1))
        spread = spread.where(first <= last).withColumn(f"_{axis}", F.explode(F.sequence(first, last)))
    return spread.drop("row", "col").withColumnsRenamed({"_row": "row", "_col": "col"}).hint("merge")
