"""What is here? One text per point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise import dims
from placewise.functions import encode
from placewise.functions.grid import Grid, lookup_cell, lookup_cell_origin
from placewise.functions.rounding import half_up
from placewise.operators.aggregate import CELL
from placewise.operators.lookup import attach, index_name


def hazard_text(points: DataFrame, lookup: DataFrame, grid: Grid, key: str = "id") -> DataFrame:
    """key, text: odds of the composite, then one line per hazard at 0.05 or more, worst first.

    A cell has at most eight hazards, so its lines fit one short array.
    """
    rate = F.col("tenths") / 10.0
    label = F.rpad(_label(F.col("hazard")), 11, " ")
    line = F.concat(F.lit("  "), label, F.lit(" "), encode.odds(rate))
    per_cell = lookup.groupBy(*CELL).agg(
        (F.max("composite_tenths") / 10.0).alias("_total"),
        F.sort_array(F.collect_list(F.when(rate >= 0.05, F.struct((-rate).alias("_o"), "hazard", line.alias("_l"))))).alias("_lines"),
    )
    total = F.col("_total")
    headline = F.when(total > 0, F.concat(encode.odds(total), F.lit("  ("), encode.rate_text(total), F.lit(" deaths per million per year)"))).otherwise(
        F.lit("~0 chance per year")
    )
    texts = per_cell.select(*CELL, F.concat_ws("\n", headline, F.transform("_lines", lambda s: s["_l"])).alias("text"))
    return attach(lookup_cell(points, grid), texts, CELL).select(key, "text")


def _label(hazard: Column) -> Column:
    labels = F.create_map(*[F.lit(v) for pair in dims.HAZARD_LABELS.items() for v in pair])
    return F.coalesce(F.try_element_at(labels, hazard), hazard)


def energy_text(points: DataFrame, cell_zone: DataFrame, zones: DataFrame, scores: DataFrame, grid: Grid, key: str = "id") -> DataFrame:
    """key, text: 'Name -- +12 (Net exporter)' and one line per fuel share, largest first.

    ``scores`` holds name, score (0..100) and fuels (map fuel -> capacity); a missing record reads No data.
    """
    entries = F.map_entries("fuels")
    total = F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["value"])
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("_o"), e["key"].alias("fuel"), half_up(e["value"] / F.nullif(total, F.lit(0.0)) * 100.0).alias("pct"))))
    lines = F.transform(F.filter(ranked, lambda e: e["pct"] > 0), lambda e: F.concat(e["fuel"], F.lit(" "), e["pct"].cast("string"), F.lit("%")))
    lines = F.coalesce(F.when(total > 0, lines), F.array().cast("array<string>"))
    headline = F.when(F.col("score").isNull(), F.concat("name", F.lit(" -- No data"))).otherwise(
        F.concat(F.col("name"), F.lit(" -- "), encode.balance_label(F.col("score") / 100.0))
    )
    texts = zones.join(scores, "name", "left").select("zone", F.concat_ws("\n", headline, lines).alias("text"))
    return attach(lookup_cell(points, grid), cell_zone.join(texts, "zone").select(*CELL, "text"), CELL).select(key, "text")


def crop_text(points: DataFrame, lists: DataFrame, names: list[str], kind: str, grid: Grid, key: str = "id") -> DataFrame:
    """key, text: shares of the top crops ('Maize 41%') or suitability ('Maize 73 SI')."""
    total = F.aggregate("top", F.lit(0).cast("bigint"), lambda acc, e: acc + e["value"])
    name = lambda e: index_name(names, e["idx"])
    if kind == "harvest":
        share = lambda e: half_up(e["value"] / F.nullif(total, F.lit(0)) * 100.0)
        kept = F.filter("top", lambda e: share(e) > 0)
        lines = F.transform(kept, lambda e: F.concat(name(e), F.lit(" "), share(e).cast("string"), F.lit("%")))
    else:
        lines = F.transform(F.filter("top", lambda e: e["value"] > 0), lambda e: F.concat(name(e), F.lit(" "), e["value"].cast("string"), F.lit(" SI")))
    texts = lists.select(*CELL, F.concat_ws("\n", lines).alias("text"))
    return attach(lookup_cell_origin(points, grid), texts, CELL).select(key, "text")


def development_text(byte: Column) -> Column:
    """Axis headline, place and the three indices, for points joined to their region record."""
    number = lambda c: F.when(F.col(c).isNull(), F.lit("?")).otherwise(encode.fixed(F.col(c), 2))
    place = F.when(F.coalesce("region", F.lit("")) != "", F.concat("region", F.lit(", "), "country")).otherwise(F.col("country"))
    years = F.concat(F.lit("  (life exp "), encode.fixed(F.col("lifexp"), 0), F.lit(" yr)"))
    school = F.concat(F.lit("  ("), encode.fixed(F.col("esch_yrs"), 1), F.lit(" yr expected)"))
    income = F.concat(F.lit("  ($"), F.format_number(half_up(F.col("gnic")), 0), F.lit(" GNI/cap)"))
    line = lambda label, c, text: F.concat(F.lit(f"  {label.ljust(10)} "), number(c), F.coalesce(text, F.lit("")))
    return F.concat_ws(
        "\n", F.concat(encode.value_text("depv", byte), F.lit("  -- "), place),
        line("Health", "health", years), line("Education", "education", school), line("Income", "income", income),
    )


def gdp_text() -> Column:
    """'State X, Country Y (State, 2020) -- GDP/capita: $12,345' by tier."""
    dollars = F.concat(F.lit("$"), F.format_number(half_up(F.col("gdp")), 0))
    year = F.col("year").cast("string")
    return (
        F.when(F.col("tier") == "District", F.concat("district", F.lit(", "), "country", F.lit(" (District) -- GDP/capita: "), dollars))
        .when(F.col("tier") == "State", F.concat("state", F.lit(", "), "country", F.lit(" (State, "), year, F.lit(") -- GDP/capita: "), dollars))
        .when(F.col("tier") == "Country", F.concat("country", F.lit(" (Country, "), year, F.lit(") -- GDP/capita: "), dollars))
    )


def match_text(scored: DataFrame) -> DataFrame:
    """row, col, text: '87% match'."""
    return scored.select(*CELL, F.concat(half_up(F.col("score") * 100.0).cast("string"), F.lit("% match")).alias("text"))
