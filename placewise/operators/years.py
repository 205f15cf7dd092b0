"""Choosing years and scenarios. Year lists are short arrays on the row, so nothing here joins on ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise import dims


def nearest_year(years: Column, target: Column) -> Column:
    """Closest listed year; equal distances go to the one listed first. NULL for an empty list."""
    ranked = F.transform(years, lambda y, i: F.struct(F.abs(y - target).alias("d"), i.alias("i"), y.alias("y")))
    return F.when(F.size(years) > 0, F.array_min(ranked)["y"])


def resolve_layer(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """The stored layer behind each (axis, year, scenario) request; NULL where there is none."""
    years, target = F.coalesce("years", F.array().cast("array<int>")), F.col("year")
    projected = F.coalesce(F.try_element_at("projections", F.col("scenario")), F.array().cast("array<int>"))
    has_projections = F.coalesce(F.size("projections"), F.lit(0)) > 0
    wants_projection = (F.col("scenario") != "historical") & (F.size(projected) > 0)
    axis = F.col("axis")
    snapped = lambda ys: nearest_year(ys, target).cast("string")
    path = (
        F.when(F.col("static"), F.concat_ws("/", axis, F.coalesce("file", F.concat(axis, F.lit(".pmtiles")))))
        .when(target.isNotNull() & wants_projection,
              F.concat(axis, F.lit("/"), axis, F.lit("_"), F.col("scenario"), F.lit("_"), snapped(projected), F.lit(".pmtiles")))
        .when(target.isNotNull() & (F.size(years) > 0) & (has_projections | (target <= F.array_max(years))),
              F.concat(axis, F.lit("/"), axis, F.lit("_"), snapped(years), F.lit(".pmtiles")))
    )
    return requests.join(catalog, "axis", "left").withColumn("layer", path).select(*requests.columns, "layer")


def scenario_for(year: Column, years: Column, projections: Column, current_year: int = dims.CURRENT_YEAR) -> Column:
    cutoff = F.greatest(F.coalesce(F.array_max(years), F.lit(0)), F.lit(current_year))
    has = F.coalesce(F.size(projections), F.lit(0)) > 0
    return F.when(has & (year > cutoff), F.lit(dims.PROJECTION_SCENARIO)).otherwise(F.lit("historical"))


def nearest_weight_year(requests: DataFrame, weights: DataFrame) -> DataFrame:
    """(year, weight_year, path): the closest weight year, ties to the earliest; raw files beat processed.

    ``weights`` holds year and path; there is one file per year and kind.
    """
    per_year = weights.groupBy("year").agg(
        F.min_by("path", F.struct(F.col("path").contains("processed"), F.col("path"))).alias("path")
    )
    listed = per_year.agg(F.sort_array(F.collect_list(F.struct("year", "path"))).alias("_all")).scalar()
    ranked = F.transform("_all", lambda w: F.struct(F.abs(w["year"] - F.col("year")).alias("d"), w["year"].alias("weight_year"), w["path"].alias("path")))
    best = requests.withColumn("_all", listed).withColumn("_best", F.array_min(ranked))
    return best.select(*requests.columns, "_best.weight_year", "_best.path")


def axis_years(catalog: DataFrame) -> DataFrame:
    """Per axis: all years (historical and projected), whether it varies, first/last, slider extent."""
    none = F.array().cast("array<int>")
    years = F.when(F.col("static"), none).otherwise(F.coalesce("years", none))
    projected = F.when(F.col("static"), none).otherwise(F.coalesce(F.flatten(F.map_values("projections")), none))
    rows = catalog.withColumns({"_y": F.array_distinct(years), "_p": projected})
    has_projection = F.size("_p") > 0
    ranged = (F.size("_y") > 0) & ((F.size("_y") >= 2) | has_projection)
    all_years = F.sort_array(F.array_distinct(F.concat("_y", "_p")))
    first, last = F.when(ranged, F.array_min("_y")), F.when(ranged, F.array_max("_y"))
    return rows.select(
        "axis", all_years.alias("all_years"), ((F.size("_y") > 1) | has_projection).alias("temporal"),
        first.alias("first_year"), last.alias("last_year"),
        F.array_min(F.concat(F.array(F.lit(dims.SLIDER_FIRST)), F.when(ranged, F.array(first)).otherwise(none), "_p")).alias("slider_first"),
        F.array_max(F.concat(F.array(F.lit(dims.SLIDER_LAST)), F.when(ranged, F.array(last)).otherwise(none), "_p")).alias("slider_last"),
    )


def step_year(years: Column, current: Column, direction: int) -> Column:
    """Next or previous data year; stays put at the ends and steps by one without data years."""
    if direction > 0:
        found = F.array_min(F.filter(years, lambda y: y > current))
    else:
        found = F.array_max(F.filter(years, lambda y: y < current))
    return F.when(F.size(years) > 0, F.coalesce(found, current)).otherwise(current + direction)
