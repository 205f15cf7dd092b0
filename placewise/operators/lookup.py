"""Values at points: grids, tiles, tiers and country records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise import dims
from placewise.functions.grid import Grid, lookup_cell, lookup_cell_origin, tile_pixel
from placewise.session import written

CELL = ["row", "col"]
TILE = ["axis", "z", "x", "y"]
MAX_PARENT_LEVELS = 6
#: Rows of a lookup that is sent to every task; both half-degree and quarter-degree cell tables of the earth fit.
SENT = 1 << 20
DISTRICT_ZOOM, STATE_ZOOM = 6.0, 3.5


def attach(points: DataFrame, records: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``points`` with the columns of the records that have their key.

    The records are written once and counted. Up to ``SENT`` of them go to every task and the points stay where they
    are. Of more, both sides are dealt by key, the points once: keys with more points than half a task's share are cut
    into slices of that size, their few records sent to each slice; points without a key are spread as well.
    """
    spark = points.sparkSession
    records = written(records, "records")
    if records.count() <= SENT:
        return points.join(F.broadcast(records), on, how)
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = written(points.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), "counts")
    share = max(1, (counts.agg(F.sum("_n")).first()[0] or 0) // tasks)
    # fewer rows than tasks, as each stands for more than a task's half
    hot = F.broadcast(counts.where(F.col("_n") > share).select(*on, F.ceil(F.col("_n") / share).cast("int").alias("_slices")))
    keyless = F.greatest(*[F.col(c).isNull() for c in on], F.lit(False))
    slices = F.coalesce("_slices", F.when(keyless, F.lit(tasks)), F.lit(1))
    dealt = points.join(hot, on, "left").withColumn("_slice", F.pmod(F.xxhash64(*points.columns), slices.cast("long")).cast("int")).drop("_slices")
    spread = records.join(hot, on, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))).drop("_slices")
    return dealt.join(spread, [*on, "_slice"], how).drop("_slice")


def value_at(points: DataFrame, tiles: DataFrame, zoom: int, axis: str) -> DataFrame:
    """The byte of one axis under each point; NULL where there is no data."""
    placed = tile_pixel(points, zoom)
    layer = tiles.where((F.col("axis") == axis) & (F.col("byte") > 0)).select("z", "x", "y", "px", "py", "byte")
    return placed.join(layer, ["z", "x", "y", "px", "py"], "left").select(*points.columns, "byte")


def overzoom(requests: DataFrame, tiles: DataFrame, key: str = "id") -> DataFrame:
    """Tile pixels, falling back to the nearest existing ancestor tile up to six levels up.

    ``requests`` holds key, axis, z, x, y, px, py. Each request becomes at most seven candidates that
    meet the tile directory in one equi join; the pixel is then read once from the chosen tile.
    """
    directory = tiles.select(*TILE).distinct()
    up = requests.withColumn("dz", F.explode(F.sequence(F.lit(0), F.least(F.col("z"), F.lit(MAX_PARENT_LEVELS)))))
    span = F.pow(F.lit(2.0), F.col("dz")).cast("int")
    candidates = up.select(
        key, "axis", "dz", (F.col("z") - F.col("dz")).alias("z"),
        F.floor(F.col("x") / span).cast("int").alias("x"), F.floor(F.col("y") / span).cast("int").alias("y"),
        F.floor((F.pmod("x", span) * 256 + F.col("px")) / span).cast("int").alias("px"),
        F.floor((F.pmod("y", span) * 256 + F.col("py")) / span).cast("int").alias("py"),
    )
    found = candidates.join(directory, TILE, "left_semi")
    chosen = found.groupBy(key, "axis").agg(F.min_by(F.struct("z", "x", "y", "px", "py", "dz"), "dz").alias("_t"))
    pixels = tiles.where(F.col("byte") > 0)
    return chosen.select(key, "axis", "_t.*").join(pixels, [*TILE, "px", "py"], "left").select(key, "axis", "dz", "byte")


def gdp_at(points: DataFrame, states: DataFrame, countries: DataFrame) -> DataFrame:
    """District value where the zoom allows, else state, else country; adds tier and gdp.

    ``points`` holds zoom, district_value, state, country, year; ``states`` state, year, state_value;
    ``countries`` country, year, country_value. The two lookups are keyed by administrative names.
    """
    joined = attach(attach(points, states, ["state", "year"], "left"), countries, ["country", "year"], "left")
    district = (F.col("zoom") >= DISTRICT_ZOOM) & F.col("district_value").isNotNull()
    state = (F.col("zoom") >= STATE_ZOOM) & F.col("state_value").isNotNull()
    tier = F.when(district, "District").when(state, "State").when(F.col("country_value").isNotNull(), "Country")
    value = F.when(district, F.col("district_value")).when(state, F.col("state_value")).otherwise(F.col("country_value"))
    return joined.select(*points.columns, tier.alias("tier"), value.alias("gdp"))


def risk_at(points: DataFrame, lookup: DataFrame, grid: Grid, key: str = "id") -> DataFrame:
    """key, hazard, rate, intensity, composite from a tenths lookup (hazard, row, col, tenths, intensity)."""
    cells = lookup.groupBy(*CELL).agg(
        F.sort_array(F.collect_list(F.struct("hazard", (F.col("tenths") / 10.0).alias("rate"), "intensity"))).alias("_hazards"),
        (F.max("composite_tenths") / 10.0).alias("composite"),
    )
    found = attach(lookup_cell(points, grid).select(key, *CELL), cells, CELL)
    return found.select(key, F.inline("_hazards"), "composite").select(key, "hazard", "rate", "intensity", "composite")


def region_at(points: DataFrame, region_cells: DataFrame, records: DataFrame, grid: Grid) -> DataFrame:
    """Each point with the record of its region; id 0 or no cell means none."""
    placed = lookup_cell(points, grid)
    ids = region_cells.where(F.col("zone") > 0)
    return attach(placed, ids.join(records, "zone", "left"), CELL, "left").drop(*CELL)


def crops_at(points: DataFrame, lists: DataFrame, names: list[str], grid: Grid, key: str = "id") -> DataFrame:
    """(key, rank, crop, value) of the top crops under each point."""
    placed = lookup_cell_origin(points, grid).select(key, *CELL).where(F.col("row").isNotNull())
    rows = attach(placed, lists, CELL).select(key, F.posexplode("top").alias("_i", "_t"))
    return rows.select(key, (F.col("_i") + 1).alias("rank"), index_name(names, F.col("_t.idx")).alias("crop"), F.col("_t.value").alias("value"))


def index_name(names: list[str], index: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), index + 1)


def energy_at(points: DataFrame, cell_zone: DataFrame, zones: DataFrame, scores: DataFrame, grid: Grid) -> DataFrame:
    """Each point with its country's balance score and fuel capacities (one row per fuel)."""
    placed = attach(lookup_cell(points, grid), cell_zone.join(zones, "zone"), CELL)
    return attach(placed, scores, ["name"]).drop(*CELL)


def freedom_at(points: DataFrame, cell_zone: DataFrame, zones: DataFrame, records: DataFrame, year: int, grid: Grid) -> DataFrame:
    """Each point with its country's freedom record of exactly ``year``."""
    placed = attach(lookup_cell(points, grid), cell_zone.join(zones, "zone"), CELL)
    return attach(placed, records.where(F.col("year") == year), ["name"]).drop(*CELL)


def freedom_text(fields: dict[str, str]) -> Column:
    """'Electoral process 83%' lines of the categories that have a value, in fixed order."""
    lines = [
        F.when(F.col(fields[k]).isNotNull(), F.concat(F.lit(label + " "), F.floor(F.col(fields[k]) + 0.5).cast("string"), F.lit("%")))
        for k, _max, label in dims.FREEDOM_CATEGORIES
    ]
    return F.concat_ws("\n", *lines)
