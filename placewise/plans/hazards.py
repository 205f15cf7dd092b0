"""The hazard job: eight intensities, their mortality, the composite and the lookup grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise import dims
from placewise.functions.encode import lookup_tenths, zero_fill
from placewise.functions.grid import Grid, cell_bounded
from placewise.operators import focal
from placewise.operators.aggregate import CELL, grid_max, grid_weighted
from placewise.operators.hazard import calibrate, composite, distribute, wildfire
from placewise.operators.resample import block_agg
from placewise.session import materialised


def intensities(grid: Grid, pga: DataFrame, flood: DataFrame, wind: DataFrame, runup: DataFrame, volcanoes: DataFrame, drought: DataFrame, elev: DataFrame) -> DataFrame:
    """hazard, row, col, intensity in native units; an absent cell means 0.

    Rasters arrive on the target grid, ``runup`` and ``volcanoes`` as points.
    """
    clean = lambda df: df.withColumn("value", zero_fill(F.col("value"))).where(F.col("value") > 0)
    smooth = lambda name, df: focal.gaussian(df, grid, dims.SMOOTHING_SIGMA[name])
    peaks = focal.max_filter(grid_max(cell_bounded(runup, grid), "runup"), grid, 13)
    dry = smooth("drought", clean(drought))
    layers = {
        "earthquake": smooth("earthquake", clean(pga)),
        "flood": clean(flood),
        "cyclone": smooth("cyclone", clean(wind)),
        "tsunami": smooth("tsunami", peaks),
        "volcano": smooth("volcano", grid_weighted(cell_bounded(volcanoes, grid))),
        "drought": dry,
        "wildfire": wildfire(dry),
        "landslide": smooth("landslide", focal.slope_deg(elev, grid)),
    }
    rows = [df.select(F.lit(h).alias("hazard"), *CELL, F.col("value").alias("intensity")) for h, df in layers.items()]
    return reduce(DataFrame.unionByName, rows)


def mortality(intensity: DataFrame, cell_zone: DataFrame, rates: DataFrame) -> DataFrame:
    """hazard, row, col, rate: calibrated by country, tsunamis from a fixed budget."""
    waves = distribute(intensity.where(F.col("hazard") == "tsunami")).select("hazard", *CELL, "rate")
    rest = calibrate(intensity.where(F.col("hazard") != "tsunami"), cell_zone, rates)
    return rest.unionByName(waves)


def hazard_job(intensity: DataFrame, cell_zone: DataFrame, rates: DataFrame, grid: Grid, factor: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(intensity, mortality, lookup). The smoothed intensities and the zone grid feed several steps, so
    each is computed once into the shared folder."""
    native, zoned = materialised(intensity), materialised(cell_zone)
    deaths = mortality(native, zoned, rates)
    return native, deaths, hazard_lookup(deaths, native, grid, factor)


def hazard_lookup(rates: DataFrame, intensity: DataFrame, grid: Grid, factor: int) -> DataFrame:
    """hazard, row, col, tenths, intensity, composite_tenths on the block grid.

    Blocks average over all their cells, so absent cells count as 0.
    """
    keys = ["hazard", *CELL]
    coarse = block_agg(rates.withColumnRenamed("rate", "value"), grid, factor, "avg", ["hazard"]).withColumnRenamed("value", "rate")
    native = block_agg(intensity.withColumnRenamed("intensity", "value"), grid, factor, "avg", ["hazard"]).withColumnRenamed("value", "intensity")
    total = composite(coarse).select(*CELL, lookup_tenths(F.col("rate")).alias("composite_tenths"))
    both = coarse.join(native, keys, "full_outer").select(
        *keys, lookup_tenths(F.coalesce("rate", F.lit(0.0))).alias("tenths"), F.bround(F.coalesce("intensity", F.lit(0.0)), 2).alias("intensity")
    )
    return both.join(total, CELL, "left").withColumn("composite_tenths", F.coalesce("composite_tenths", F.lit(0)))


def legacy_risk(pga: DataFrame, flood: DataFrame, elev: DataFrame, rise: DataFrame) -> DataFrame:
    """row, col, value: worst of shaking, flooding, low coast and steepness, 0..100.

    ``rise`` is the elevation change per cell.
    """
    kinds = [("pga", pga), ("flood", flood), ("elev", elev), ("rise", rise)]
    rows = reduce(DataFrame.unionByName, [df.select(*CELL, F.lit(k).alias("k"), "value") for k, df in kinds])
    at = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("value"))), F.lit(0.0)).alias(k)
    wide = rows.groupBy(*CELL).agg(*[at(k) for k, _df in kinds])
    unit = lambda c, top: F.least(F.greatest(F.col(c) / top, F.lit(0.0)), F.lit(1.0))
    coast = F.when(F.col("elev") > 0, F.exp(-F.col("elev") / 5.0)).otherwise(F.lit(0.0))
    return wide.select(*CELL, (F.greatest(unit("pga", 4.0), unit("flood", 5.0), coast, unit("rise", 500.0)) * 100.0).alias("value"))
