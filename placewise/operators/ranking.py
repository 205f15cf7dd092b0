"""Top lists, shares and key disambiguation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.rounding import half_even, half_up
from placewise.operators.prefix import running_count

CELL = ["row", "col"]


def top_n_per_cell(cells: DataFrame, index: str, n: int = 5) -> DataFrame:
    """The ``n`` largest positive values of each cell with their rank, ties to the higher index.

    Spark trims each task to ``n`` rows per cell before the shuffle (window group limit).
    """
    order = Window.partitionBy(*CELL).orderBy(F.desc("value"), F.desc(index))
    ranked = cells.where(F.col("value") > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.withColumn("amount", half_even(F.col("value")).cast("bigint"))


def top_lists(ranked: DataFrame, index: str) -> DataFrame:
    """One array of (idx, value) per cell, best first; at most the ranked rows of that cell."""
    item = F.struct("rank", F.col(index).alias("idx"), F.col("amount").alias("value"))
    lists = ranked.groupBy(*CELL).agg(F.sort_array(F.collect_list(item)).alias("_l"))
    return lists.select(*CELL, F.transform("_l", lambda t: F.struct(t["idx"].alias("idx"), t["value"].alias("value"))).alias("top"))


def share_pct(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Whole-number percentage of the group's total; shares that round to 0 are dropped."""
    totals = df.groupBy(*group).agg(F.sum(value).alias("_total"))
    rows = df.join(totals, group).where(F.col("_total") > 0)
    return rows.withColumn("pct", half_up(F.col(value) / F.col("_total") * 100.0)).where(F.col("pct") > 0).drop("_total")


def rank_within(df: DataFrame, group: list[str], value: str, tie: str, top: int | None = None) -> DataFrame:
    """Rank by value, largest first, inside short groups (hazards of a cell, fuels of a country)."""
    order = Window.partitionBy(*group).orderBy(F.desc(value), tie)
    ranked = df.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def rank_hazards(rates: DataFrame, threshold: float = 0.05) -> DataFrame:
    return rank_within(rates.where(F.col("rate") >= threshold), CELL, "rate", "hazard")


def dedupe_keys(df: DataFrame, key: str, order: str, prefix: str, name: str) -> DataFrame:
    """Keys made unique in ``order``: k, k#2, k#3; a missing key becomes 'prefix::name' first."""
    missing = F.col(key).isNull() | (F.col(key) == "")
    fallback = F.concat(F.coalesce(F.nullif(F.col(prefix), F.lit("")), F.lit("??")), F.lit("::"), F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("?")))
    keyed = df.withColumn("_k", F.when(missing, fallback).otherwise(F.col(key)))
    numbered = running_count(keyed, ["_k"], order, "_n")
    unique = F.when(F.col("_n") == 1, F.col("_k")).otherwise(F.concat("_k", F.lit("#"), F.col("_n").cast("string")))
    return numbered.withColumn("unique_key", unique).drop("_k", "_n")
