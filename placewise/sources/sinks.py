"""Sinks and the artefact catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYER_KEYS = ["axis", "scenario", "year"]
TILE_PX = 256


def nested_lookup(df: DataFrame, outer: str, inner: str, value: str, digits: int = 0) -> DataFrame:
    """One row per outer key with a JSON object {inner: value}, values rounded half-even.

    Inner keys are entity names (countries, regions): hundreds per outer key.
    """
    item = F.struct(F.col(inner).cast("string").alias("k"), F.bround(F.col(value), digits).alias("v"))
    pairs = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(outer).agg(F.sort_array(F.collect_list(item)).alias("_p"))
    return pairs.select(F.col(outer).cast("string").alias(outer), F.to_json(F.map_from_entries("_p")).alias("json"))


def write_lookup(df: DataFrame, path: str, outer: str, inner: str, value: str, digits: int = 0) -> None:
    """'outer<TAB>json' lines, one per outer key, written in parallel."""
    nested_lookup(df, outer, inner, value, digits).select(F.concat_ws("\t", outer, "json")).write.mode("overwrite").text(path)


def skip_present(layer: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of partitions (axis, scenario, year) that ``stored`` does not have yet.

    There is one key per stored file set (axes x scenarios x years), a few thousand at most.
    """
    present = stored.select(*LAYER_KEYS).distinct()
    return layer.join(F.broadcast(present), [layer[k].eqNullSafe(present[k]) for k in LAYER_KEYS], "left_anti")


def build_catalog(artefacts: DataFrame) -> DataFrame:
    """Per axis: static or not, sorted years, projection years per scenario, first static file.

    Names end in '_YYYY' for a year and '_sspNNN_YYYY' for a projection; any other axis is static.
    """
    stem = F.regexp_extract("path", r"([^/]+)\.pmtiles$", 1)
    parts = F.split(stem, "_")
    year = F.try_element_at(parts, F.lit(-1)).try_cast("int")
    projected = F.when(stem.contains("_ssp"), F.try_element_at(parts, F.lit(-2)))
    files = artefacts.select("path").distinct().select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("axis"), "path",
        F.when(stem.contains("_"), year).alias("year"), projected.alias("scenario"),
    )
    per_scenario = files.groupBy("axis", "scenario").agg(
        F.sort_array(F.collect_set("year")).alias("years"), F.min("path").alias("path")
    )
    return per_scenario.groupBy("axis").agg(
        F.every(F.col("scenario").isNull() & (F.size("years") == 0)).alias("static"),
        F.max(F.when(F.col("scenario").isNull(), F.col("years"))).alias("years"),
        F.map_from_entries(F.collect_list(F.when(F.col("scenario").isNotNull(), F.struct("scenario", "years")))).alias("projections"),
        F.min(F.when(F.size("years") == 0, F.regexp_extract("path", r"([^/]+)$", 1))).alias("file"),
    )


def layer_fingerprint(layer: DataFrame, columns: list[str]) -> DataFrame:
    """One row (cells, version): ten hex digits that change with any cell, in whatever order rows come.

    A missing value is hashed as a zero character, so that it counts at its place.
    """
    row_hash = F.sha2(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]), 256)
    folded = layer.agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum(F.conv(F.substring(row_hash, 1, 12), 16, 10).cast("decimal(20,0)")).alias("_a"),
    )
    digest = F.sha2(F.concat_ws(":", F.col("cells").cast("string"), F.col("_a").cast("string")), 256)
    return folded.select("cells", F.substring(digest, 1, 10).alias("version"))


def year_columns(rows: DataFrame, key: list[str], years: list[int], value: str = "value", prefix: str = "gdp_pc_") -> DataFrame:
    """(key, year, value) rows to one row per key with a '<prefix><year>' column for each year, NULL where there is none."""
    per_year = [F.max(F.when(F.col("year") == y, F.col(value))).alias(f"{prefix}{y}") for y in years]
    return rows.groupBy(*key).agg(*per_year)


def drop_all_null(df: DataFrame, prefix: str = "gdp_pc_") -> DataFrame:
    """Rows that have a value in one '<prefix><year>' column at least."""
    columns = [c for c in df.columns if c.startswith(prefix)]
    return df.na.drop(how="all", subset=columns) if columns else df


def split_year_columns(df: DataFrame, key: str, prefix: str = "gdp_pc_") -> DataFrame:
    """Wide '<prefix><year>' columns to (key, year, value) rows, one decimal, NULLs left out."""
    columns = [c for c in df.columns if c.startswith(prefix)]
    if not columns:
        raise ValueError(f"no {prefix}<year> columns")
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], columns, "year", "value")
    rows = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.select(key, F.substring("year", len(prefix) + 1, 4).cast("int").alias("year"), F.bround("value", 1).alias("value"))
