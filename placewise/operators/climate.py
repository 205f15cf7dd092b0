"""Monthly cubes to yearly cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_YEAR = ["row", "col", "year"]
TEMPERATURE_FILL = -326.68
RAIN_FILL = -30000.0


def paired_years(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` for years that ``right`` also has."""
    return left.join(right.select("year").distinct(), "year", "left_semi")


def _not_fill(value: Column, fill: float) -> Column:
    return F.when(~F.isnan(value) & (value > fill), value)


def monthly_mid(tmin: str = "tmin", tmax: str = "tmax") -> Column:
    return (_not_fill(F.col(tmax), TEMPERATURE_FILL) + _not_fill(F.col(tmin), TEMPERATURE_FILL)) / 2.0


def annual_mean(cube: DataFrame) -> DataFrame:
    """Mean of the monthly midpoints over the valid months; none gives NULL."""
    return cube.groupBy(*CELL_YEAR).agg(F.avg(monthly_mid()).alias("value"))


def annual_std(cube: DataFrame) -> DataFrame:
    """Population standard deviation of the monthly midpoints."""
    return cube.groupBy(*CELL_YEAR).agg(F.stddev_pop(monthly_mid()).alias("value"))


def annual_sum(cube: DataFrame, value: str = "ppt") -> DataFrame:
    """Sum over the valid months; none gives 0."""
    total = F.sum(_not_fill(F.col(value), RAIN_FILL))
    return cube.groupBy(*CELL_YEAR).agg(F.coalesce(total, F.lit(0.0)).alias("value"))


def event_frequency(index: DataFrame, threshold: float = -1.5, last: int = 324, time: str = "t", value: str = "value") -> DataFrame:
    """Share of the last ``last`` time steps of the record below ``threshold``; a missing step is not an event.

    The frame is set by the shared time axis, so it becomes a filter and a combinable sum per cell; no
    window over a cell's series is needed. The step list is as short as the record (months).
    """
    steps = index.select(time).distinct()
    frame = steps.agg(F.slice(F.sort_array(F.collect_list(time), asc=False), 1, last).alias("_steps")).select(
        F.struct(F.array_min("_steps").alias("first"), F.size("_steps").alias("n"))
    )
    kept = index.withColumn("_frame", frame.scalar()).where(F.col(time) >= F.col("_frame.first"))
    severe = F.sum(F.when(~F.isnan(value) & (F.col(value) < threshold), 1.0).otherwise(0.0))
    return kept.groupBy("row", "col").agg((severe / F.max("_frame.n")).alias("value"))


def combine_max(first: DataFrame, second: DataFrame) -> DataFrame:
    """Cellwise maximum where the second source is positive."""
    a, b = F.coalesce(first["value"], F.lit(0.0)), second["value"]
    value = F.when(b > 0, F.greatest(a, b)).otherwise(a)
    return first.join(second, [first["row"] == second["row"], first["col"] == second["col"]], "full_outer").select(
        F.coalesce(first["row"], second["row"]).alias("row"), F.coalesce(first["col"], second["col"]).alias("col"), value.alias("value")
    )
