"""Political freedom by country and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise import dims
from placewise.operators.names import merge_aliases

KEYS = ["year", "country"]
CATS = [f"cat_{k}" for k, _max, _label in dims.FREEDOM_CATEGORIES]


def freedom_join(fiw: DataFrame, cpi: DataFrame, cats: DataFrame) -> DataFrame:
    """year, country, fiw, cpi, cat_A..cat_G: every country any source knows."""
    both = fiw.select(*KEYS, "fiw").join(cpi.select(*KEYS, F.col("score").alias("cpi")), KEYS, "full_outer")
    return both.join(cats.select(*KEYS, *CATS), KEYS, "full_outer")


def freedom_scores(fiw: DataFrame, cpi: DataFrame, cats: DataFrame, first: int = 2000, last: int = 2025) -> DataFrame:
    """``freedom_join`` with the composite: the mean of both scores, else whichever exists."""
    rows = freedom_join(fiw, cpi, cats).where(F.col("year").between(first, last))
    raw = F.coalesce((F.col("fiw") + F.col("cpi")) * 0.5, "fiw", "cpi")
    return rows.withColumns({"score": raw, "composite": F.bround(raw, 1), "fiw": F.bround("fiw", 1), "cpi": F.bround("cpi", 1)})


def map_aliases(map_names: DataFrame) -> DataFrame:
    """(alias, canonical) onto the map's names: the fixed spellings whose target is on the map, then the
    names themselves; one row per case-insensitive alias."""
    fixed = dims.pair_dim(map_names.sparkSession, dims.FREEDOM_NAME_ALIASES, "alias", "canonical")
    known = map_names.select(F.col("name").alias("canonical")).distinct()
    usable = fixed.join(known, "canonical", "left_semi").select("alias", "canonical", F.lit(0).alias("_o"))
    own = known.select(F.col("canonical").alias("alias"), "canonical", F.lit(1).alias("_o"))
    return usable.unionByName(own).groupBy(F.lower("alias").alias("alias")).agg(F.min_by("canonical", F.struct("_o", "canonical")).alias("canonical"))


def freedom_lookup(scores: DataFrame, map_names: DataFrame) -> DataFrame:
    """Scores under the map's country names; records that meet there merge field by field."""
    fields = ["composite", "fiw", "cpi", *CATS]
    return merge_aliases(scores.withColumnRenamed("country", "name"), map_aliases(map_names), fields)
