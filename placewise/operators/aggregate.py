"""Per-cell, per-zone and per-layer aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.operators.quantile import exact_quantiles

CELL = ["row", "col"]


def grid_sum(points: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    return points.groupBy(*(keys or []), *CELL).agg(F.sum(value).alias("value"), F.count(F.lit(1)).alias("n"))


def grid_mean(points: DataFrame, value: str) -> DataFrame:
    return points.groupBy(*CELL).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"))


def grid_max(points: DataFrame, value: str) -> DataFrame:
    return points.groupBy(*CELL).agg(F.max(value).alias("value"))


def eruption_weight(last_year: Column) -> Column:
    return F.when(last_year > 1900, 3.0).when(last_year > 0, 1.0).otherwise(0.3)


def grid_weighted(volcanoes: DataFrame, year: str = "last_year") -> DataFrame:
    return volcanoes.groupBy(*CELL).agg(F.sum(eruption_weight(F.col(year))).alias("value"))


def fuel_breakdown(plants: DataFrame) -> DataFrame:
    """Capacity per country and fuel; rows without a country or fuel do not count.

    Plants that carry line_no keep each pair's first line as ``first``.
    """
    named = plants.where((F.coalesce("country", F.lit("")) != "") & (F.coalesce("fuel", F.lit("")) != ""))
    first = [F.min("line_no").alias("first")] if "line_no" in plants.columns else []
    return named.groupBy("country", "fuel").agg(F.sum("capacity").alias("capacity"), *first)


def zonal_wmean(cells: DataFrame, weights: DataFrame, cell_zone: DataFrame, zones: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Weighted mean and total weight per zone; cells without a value or weight count in neither.

    ``keys`` (for example year) are carried by ``cells``, and by ``weights`` where those differ by key: weights that lack
    a key hold for all its values. Zones without any valid cell
    keep a NULL mean and weight 0. All three cell tables meet on (row, col), so tables stored
    partitioned by cell need no further shuffle; the aggregation is combined map-side.
    """
    keys = list(keys or [])
    shared = [*[k for k in keys if k in weights.columns], *CELL]
    joined = (
        cells.join(weights.select(*shared, "weight"), shared)
        .join(cell_zone, CELL)
        .where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("weight") > 0))
    )
    per_zone = joined.groupBy(*keys, "zone").agg(
        F.sum(F.col("value") * F.col("weight")).alias("_vw"), F.sum("weight").alias("_w")
    )
    frame = zones.select("zone")
    if keys:
        years = cells.select(*keys).distinct().agg(F.collect_set(F.struct(*keys)).alias("_k"))
        frame = frame.withColumn("_k", F.explode(years.scalar())).select("zone", "_k.*")
    mean = F.col("_vw") / F.nullif(F.col("_w"), F.lit(0.0))
    return frame.join(per_zone, [*keys, "zone"], "left").select(
        *keys, "zone", mean.alias("mean"), F.coalesce("_w", F.lit(0.0)).alias("weight")
    )


def zonal_mean(cells: DataFrame, cell_zone: DataFrame, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Plain mean per zone over every cell of the zone that has a row, zeros included."""
    return cells.join(cell_zone, CELL).groupBy(*(keys or []), "zone").agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")
    )


def positive_mean(cells: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean over the finite positive cells of each layer."""
    v = F.col(value)
    good = ~F.isnan(v) & (v > 0) & (v < F.lit(float("inf")))
    return cells.groupBy(*keys).agg(F.avg(F.when(good, v)).alias("mean"))


def sum_layers(cells: DataFrame, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Cellwise sum over layers; NaN and NULL count as 0."""
    v = F.col(value)
    clean = F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v)
    return cells.groupBy(*(keys or []), *CELL).agg(F.sum(clean).alias("value"))


def describe_layer(cells: DataFrame, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Median, p99, max, mean and the share of cells with a finite value, per layer."""
    keys = list(keys or [])
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v)
    stats = cells.groupBy(*keys).agg(
        F.max(F.when(finite, v)).alias("max"), F.avg(F.when(finite, v)).alias("mean"),
        (F.count_if(finite) / F.count(F.lit(1))).alias("share"), F.count(F.lit(1)).alias("n"),
    )
    marks = exact_quantiles(cells, value, {"median": 0.5, "p99": 0.99}, keys)
    if keys:
        return stats.join(marks, keys, "left")
    both = marks.select(F.struct("median", "p99")).scalar()
    return stats.withColumn("_m", both).select(*stats.columns, "_m.*")


def coverage(cells: DataFrame, cell_zone: DataFrame) -> DataFrame:
    """Cells, valid cells and the valid share per zone."""
    v = F.col("value")
    valid = v.isNotNull() & ~F.isnan(v)
    per_zone = cell_zone.join(cells, CELL, "left").groupBy("zone").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(valid).alias("valid")
    )
    return per_zone.withColumn("share", F.col("valid") / F.col("cells"))


def byte_histogram(layer: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return layer.groupBy(*(keys or []), "byte").agg(F.count(F.lit(1)).alias("n"))


def first_by(df: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """The row with the smallest ``order`` per key, as a combinable aggregate rather than a window."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.col(order)).alias("_r")).select(*keys, "_r.*")


def last_by(df: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("_r")).select(*keys, "_r.*")


def latest_per_key(df: DataFrame, key: str, year: str, line: str, *values: str) -> DataFrame:
    """Latest year per key; among equal years the earliest line stays."""
    order = F.struct(-F.col(year), F.col(line))
    best = df.groupBy(key).agg(F.min_by(F.struct(year, *values), order).alias("_r"))
    return best.select(key, "_r.*")
