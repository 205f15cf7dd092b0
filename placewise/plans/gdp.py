"""Tiered GDP per person: country anchors and rescaled states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.operators.aggregate import CELL
from placewise.operators.names import anchor_join


def country_anchor(adm0: DataFrame, indicator: DataFrame, names: DataFrame) -> DataFrame:
    """ord, iso3, name, year, anchor: the indicator by ISO code, else by the name its code maps to.

    ``adm0`` holds ord, iso3, name; ``indicator`` iso3, year, value; ``names`` iso3, name (one per code). The indicator is
    read once: a value goes out under its code and under the name, and meets the countries under both. Countries and
    their names are a few hundred rows, whatever the indicator holds, and are broadcast.
    """
    finite = indicator.where(F.col("value").isNotNull() & ~F.isnan("value")).select("iso3", "year", "value")
    named = finite.join(F.broadcast(names.select("iso3", F.col("name").alias("_name"))), "iso3", "left")
    either = lambda code, name: F.explode(F.array(F.struct(F.lit(0).alias("by"), F.col(code).alias("word")), F.struct(F.lit(1).alias("by"), F.col(name).alias("word"))))
    offered = named.select("year", "value", F.col("iso3").alias("_code"), either("iso3", "_name").alias("_k")).select("year", "value", "_code", "_k.*")
    asked = adm0.select("ord", "iso3", "name", either("iso3", "name").alias("_k")).select("ord", "iso3", "name", "_k.*")
    best = F.min_by("value", F.struct("by", "_code"))
    return offered.join(F.broadcast(asked), ["by", "word"]).groupBy("ord", "iso3", "name", "year").agg(best.alias("anchor"))


def tier_partials(gdp: DataFrame, pop: DataFrame, cell_adm1: DataFrame, cell_adm0: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """``year, state, country, vw, w``: summed weights and weighted values of the cells that lie in a state and a country.

    The sums are mergeable: states, countries and anything above them roll up from here, and no cell is read again.
    ``chosen`` (year, weight_year) says which year's weights a data year takes; it becomes a map of a few dozen entries,
    so weights are never repeated per data year. Without it both tables share their years.
    """
    zones = cell_adm1.withColumnRenamed("zone", "state").join(cell_adm0.withColumnRenamed("zone", "country"), CELL, "full")
    weights = pop.select(F.col("year").alias("_year"), *CELL, "weight").where(F.col("weight") > 0)
    if chosen is None:
        cells = gdp.withColumn("_year", F.col("year"))
    else:
        picked = chosen.agg(F.map_from_entries(F.collect_list(F.struct("year", "weight_year")))).scalar()
        cells = gdp.withColumn("_year", F.try_element_at(picked, F.col("year")))
    valid = cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
    joined = valid.join(weights, ["_year", *CELL]).join(zones, CELL)
    return joined.groupBy("year", "state", "country").agg(F.sum(F.col("value") * F.col("weight")).alias("vw"), F.sum("weight").alias("w"))


def rolled_up(partials: DataFrame, tier: str) -> DataFrame:
    """year, zone, mean, weight of one tier."""
    sums = partials.where(F.col(tier).isNotNull()).groupBy("year", F.col(tier).alias("zone")).agg(F.sum("vw").alias("vw"), F.sum("w").alias("weight"))
    return sums.select("year", "zone", (F.col("vw") / F.col("weight")).alias("mean"), "weight")


def gdp_tiers(gdp: DataFrame, pop: DataFrame, cell_adm1: DataFrame, cell_adm0: DataFrame, adm1: DataFrame, adm0: DataFrame, indicator: DataFrame, names: DataFrame, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(countries, states): country anchors and state values that average back to them.

    A state is its population-weighted mean times anchor / country mean; without an anchor it stays as
    it is. ``gdp`` holds year, row, col, value and ``pop`` year, row, col, weight, of the years in ``chosen`` or of the
    same ones. Every year is one grouping key of the same job: the cells are read once, into sums per state and country.
    """
    countries = country_anchor(adm0, indicator, names)
    partials = tier_partials(gdp, pop, cell_adm1, cell_adm0, chosen)  # both tiers roll up from one shuffle of it
    country_means = rolled_up(partials, "country").where(F.col("mean") > 0).select(F.col("zone").alias("_country"), "year", "mean")
    # from here on there are administrative units only: countries by year, and some thousand states
    factors = countries.select(F.col("ord").alias("_country"), "year", "anchor").join(F.broadcast(country_means), ["_country", "year"])
    factors = factors.select("_country", "year", (F.col("anchor") / F.col("mean")).alias("_factor")).where(F.col("_factor") > 0)
    home = anchor_join(adm1.select("ord", "iso3", "admin", "name"), adm0.select("ord", "iso3", "name", F.col("ord").alias("_country")), "_country")
    states = (
        rolled_up(partials, "state").join(home.withColumnRenamed("ord", "zone"), "zone")
        .join(F.broadcast(factors), ["_country", "year"], "left")
        .select("year", "zone", "name", F.col("_country").alias("country"), (F.col("mean") * F.coalesce("_factor", F.lit(1.0))).alias("value"), "weight")
    )
    return countries, states


def with_nearest_weights(years: DataFrame, weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """Weights repeated under each data year that picked their year (year, weight_year in ``chosen``).

    ``chosen`` has one row per data year, a few dozen, and is broadcast.
    """
    return weights.withColumnRenamed("year", "weight_year").join(F.broadcast(chosen.select("year", "weight_year")), "weight_year").drop("weight_year")
