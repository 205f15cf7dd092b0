"""From hazard intensity to expected deaths per million per year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise import dims
from placewise.operators.aggregate import positive_mean
from placewise.session import materialised

CELL = ["row", "col"]
YEARS_COVERED = 50.0
BLEND = 0.5
FLOOR = 0.25


def mortality_rates(deaths: DataFrame, population: DataFrame) -> DataFrame:
    """(hazard, code, rate): deaths 1980-2020 per million per year, for codes with 1000 people or more.

    ``deaths`` holds code, hazard, year, deaths, one row per death column. Both landslide columns add up.
    """
    span = deaths.where(F.col("year").between(1980, 2020) & (F.coalesce("code", F.lit("")) != ""))
    totals = span.groupBy("code", "hazard").agg(F.sum("deaths").alias("total"))
    people = population.where(F.col("population") >= 1000).select("code", "population")
    rate = F.col("total") / YEARS_COVERED / F.col("population") * 1e6
    return totals.join(people, "code").select("hazard", "code", rate.alias("rate")).where(F.col("rate") > 0)


def global_rates(rates: DataFrame, cell_zone: DataFrame) -> DataFrame:
    """(hazard, rate): country rates weighted by their number of cells."""
    sizes = cell_zone.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    rated = rates.where(F.col("rate") > 0).join(sizes, "zone")
    return rated.groupBy("hazard").agg((F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("global_rate"))


def calibrate(intensity: DataFrame, cell_zone: DataFrame, rates: DataFrame) -> DataFrame:
    """(hazard, row, col, rate) for cells inside a zone, all hazards in one job.

    ``intensity`` holds hazard, row, col, intensity, with an absent cell meaning 0; ``rates`` holds
    hazard, zone, rate. Blends the country's history, spread by relative intensity and capped, with the
    intensity's global expectation. A rated zone without any intensity gets its flat rate everywhere.
    """
    inside = intensity.join(cell_zone, CELL)
    sums = inside.groupBy("hazard", "zone").agg(F.sum("intensity").alias("_sum"))
    sizes = cell_zone.groupBy("zone").agg(F.count(F.lit(1)).alias("_cells"))
    zone_stats = (
        sums.join(rates, ["hazard", "zone"], "full_outer").join(sizes, "zone")
        .select("hazard", "zone", F.coalesce("rate", F.lit(0.0)).alias("_rate"), (F.coalesce("_sum", F.lit(0.0)) / F.col("_cells")).alias("_mean"))
    )
    # one row per hazard of the fixed list
    world = (
        positive_mean(intensity, "intensity", ["hazard"])
        .join(global_rates(rates, cell_zone), "hazard", "left")
        .select("hazard", (F.col("global_rate") / F.nullif(F.col("mean"), F.lit(0.0))).alias("_per_unit"))
    )
    zone_stats = materialised(zone_stats)
    flat = (F.col("_rate") > 0) & (F.col("_mean") <= 0)
    relative = F.col("_rate") * F.col("intensity") / F.nullif(F.col("_mean"), F.lit(0.0))
    country = F.when((F.col("_rate") > 0) & (F.col("_mean") > 0), F.least(relative, F.col("_rate") * dims.RATE_CAP_MULTIPLIER)).otherwise(F.lit(0.0))
    physical = F.coalesce(F.col("_per_unit") * F.col("intensity"), F.lit(0.0))
    blended = F.greatest(country * (1 - BLEND) + physical * BLEND, physical * FLOOR)
    spread = (
        inside.join(zone_stats, ["hazard", "zone"]).where(~flat).join(F.broadcast(world), "hazard", "left")
        .select("hazard", *CELL, blended.alias("rate"))
    )
    flat_cells = zone_stats.where(flat).join(cell_zone, "zone").select("hazard", *CELL, (F.col("_rate") * (1 - BLEND)).alias("rate"))
    return spread.unionByName(flat_cells)


def distribute(intensity: DataFrame, deaths_per_year: float = dims.TSUNAMI_DEATHS_PER_YEAR, value: str = "intensity") -> DataFrame:
    """A fixed yearly death budget spread by intensity, as deaths per million per year."""
    total = intensity.agg(F.sum(value)).scalar()
    weight = F.col(value) / F.nullif(F.col("_total"), F.lit(0.0))
    rate = F.when(F.col("_total") > 0, weight * deaths_per_year / dims.PEOPLE_PER_CELL * 1e6).otherwise(F.lit(0.0))
    return intensity.withColumn("_total", total).withColumn("rate", rate).drop("_total")


def wildfire(drought: DataFrame, value: str = "value") -> DataFrame:
    return drought.withColumn(value, F.when(F.col(value) > 0.4, F.lit(0.4)).otherwise(F.col(value)))


def composite(rates: DataFrame) -> DataFrame:
    return rates.groupBy(*CELL).agg(F.sum("rate").alias("rate"))
