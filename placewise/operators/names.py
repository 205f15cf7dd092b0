"""Matching country names between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise import dims


def _word_slices(name: Column) -> Column:
    """Every piece of ``name`` that starts and ends on a word boundary."""
    n = F.length(name)
    is_word = lambda i: (i >= 1) & (i <= n) & F.substring(name, i, F.lit(1)).rlike(r"(?U)\w")
    # a boundary after position i: exactly one of the characters i and i+1 is a word character
    bounds = F.filter(F.sequence(F.lit(0), n), lambda i: is_word(i) != is_word(i + 1))
    return F.flatten(
        F.transform(
            bounds,
            lambda a: F.transform(F.filter(bounds, lambda b: b > a), lambda b: F.substring(name, a + 1, b - a)),
        )
    )


def harmonise(names: DataFrame, keys: DataFrame, prefer_exact: bool = False) -> DataFrame:
    """(name, key): per name the first key, in ordinal order, that equals it or occurs in it as whole words.

    ``keys`` holds key and ordinal. Names are cut into their whole-word pieces, so the match is an equi
    join on lower-cased text. ``prefer_exact`` lets an equal key beat an earlier partial one.
    """
    lowered = names.select("name").distinct().withColumn("_n", F.lower("name"))
    pieces = lowered.select("name", F.explode(F.array_distinct(F.concat(F.array("_n"), _word_slices(F.col("_n"))))).alias("_piece"), "_n")
    hits = pieces.join(keys.withColumn("_piece", F.lower("key")), "_piece")
    rank = F.struct(F.when(F.col("_piece") == F.col("_n"), 0).otherwise(1).alias("part"), F.col("ordinal")) if prefer_exact else F.col("ordinal")
    return hits.groupBy("name").agg(F.min_by("key", rank).alias("key"))


def apply_aliases(names: DataFrame, keys: DataFrame, groups: DataFrame) -> DataFrame:
    """(name, key) through the spelling groups, for names that ``harmonise`` left over.

    Groups are tried in order and a later hit replaces an earlier one. Within a group a canonical name
    takes its first known other spelling; then a name that is an other spelling takes the canonical key.
    """
    spelling = F.broadcast(groups)
    known = keys.select("key")
    forward = (
        names.select("name").join(spelling, F.col("name") == F.col("canonical"))
        .join(known, F.col("other") == F.col("key"))
        .groupBy("name", "grp").agg(F.min_by("key", "pos").alias("key"))
        .select("name", "key", F.struct("grp", F.lit(0).alias("step")).alias("_o"))
    )
    backward = (
        names.select("name").join(spelling, F.col("name") == F.col("other"))
        .join(known, F.col("canonical") == F.col("key"))
        .select("name", "key", F.struct("grp", F.lit(1).alias("step")).alias("_o"))
    )
    return forward.unionByName(backward).groupBy("name").agg(F.max_by("key", "_o").alias("key"))


def map_names(names: DataFrame, keys: DataFrame, groups: DataFrame, prefer_exact: bool = False) -> DataFrame:
    """Both stages: (name, key) for every name that has a key."""
    first = harmonise(names, keys, prefer_exact)
    rest = names.select("name").distinct().join(first, "name", "left_anti")
    return first.unionByName(apply_aliases(rest, keys, groups))


def name_map(adm0: DataFrame, indicator_names: DataFrame) -> DataFrame:
    """(iso3, name): the map's name for each code (first polygon wins), else the indicator's own spelling.

    ``adm0`` holds ord, adm0_a3, name; ``indicator_names`` holds iso3, indicator_name.
    """
    code = F.upper(F.trim(F.col("adm0_a3")))
    named = adm0.withColumn("iso3", code).withColumn("name", F.trim("name")).where(
        F.col("iso3").rlike("^[A-Z]{3}$") & (F.col("name") != "")
    )
    firsts = named.groupBy("iso3").agg(F.min_by("name", "ord").alias("_map"))
    overrides = F.broadcast(
        dims.pair_dim(adm0.sparkSession, dims.INDICATOR_NAME_OVERRIDES, "indicator_name", "_override")
    )
    joined = indicator_names.withColumn("_iso", F.upper("iso3")).join(firsts.withColumnRenamed("iso3", "_iso"), "_iso", "left")
    joined = joined.join(overrides, "indicator_name", "left")
    return joined.select("iso3", F.coalesce("_map", "_override", "indicator_name").alias("name"))


def anchor_join(states: DataFrame, countries: DataFrame, *values: str) -> DataFrame:
    """States with their country's values: by ISO code, else by country name.

    Both country lookups keep the last row per key.
    """
    last = lambda key: countries.where(F.col(key) != "").groupBy(key).agg(
        F.max_by(F.struct(*values, F.lit(True).alias("_hit")), "ord").alias(f"_by_{key}")
    )
    by_code = last("iso3")
    by_name = last("name").withColumnRenamed("name", "admin")
    joined = states.join(by_code, "iso3", "left").join(by_name, "admin", "left")
    chosen = F.coalesce("_by_iso3", "_by_name")
    return joined.withColumn("_c", chosen).select(*states.columns, *[F.col("_c")[v].alias(v) for v in values])


def merge_aliases(records: DataFrame, aliases: DataFrame, fields: list[str]) -> DataFrame:
    """Rename to the canonical spelling and merge what collides: per field the first non-NULL value,
    records taken in name order."""
    renamed = records.join(aliases, F.lower(records["name"]) == F.lower(aliases["alias"]), "left").select(
        "year", F.coalesce("canonical", "name").alias("_to"), "name", *fields
    )
    merged = renamed.groupBy("year", "_to").agg(
        *[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("name"))).alias(f) for f in fields]
    )
    return merged.withColumnRenamed("_to", "name")
