"""Polygons to grid cells, as joins on exploded keys.

A polygon becomes its edges, an edge becomes the grid rows it crosses, and the sorted crossings of one
polygon in one row pair up into cell ranges. Work is spread by (polygon, row), so one huge polygon is cut
into as many pieces as it has rows. Ranges stay ranges as long as possible: overlaps are settled on them, and zonal sums
read a layer's running sums at their two ends.

The cells of a few polygons can be many millions, which no size estimate made from the polygons shows.
Cell tables therefore ask for a sort-merge join, lest they be broadcast on such an estimate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewise.functions.geometry import ring_edges
from placewise.functions.grid import Grid
from placewise.operators.prefix import running_count

CELL = ["row", "col"]
#: Columns of a row's block: ranges are cut at multiples of it.
SPAN = 256


def edges(zones: DataFrame) -> DataFrame:
    """ord, x1, y1, x2, y2 of every ring side."""
    rings = zones.select("ord", F.explode("rings").alias("_ring"))
    return rings.select("ord", F.explode(ring_edges(F.col("_ring"))).alias("_e")).select("ord", "_e.*")


def _span(first, last):
    """sequence(first, last), empty when the range is."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def ranges_by_centre(zones: DataFrame, grid: Grid) -> DataFrame:
    """(ord, row, first, last): the cells of a row whose centres a polygon holds (even-odd over all its rings)."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(F.floor(grid.y_pos(high) - 0.5).cast("int"), F.lit(0))
    last = F.least(F.ceil(grid.y_pos(low) - 0.5).cast("int"), F.lit(grid.height - 1))
    y = grid.y_center(F.col("row"))
    crossings = (
        edges(zones).where(F.col("y1") != F.col("y2"))
        .withColumn("row", F.explode(_span(first, last)))
        .where((y >= low) & (y < high))
        .select("ord", "row", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("_x"))
    )
    runs = crossings.groupBy("ord", "row").agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("_xs") / 2).cast("int") - 1),
        lambda i: F.struct(F.element_at("_xs", i * 2 + 1).alias("a"), F.element_at("_xs", i * 2 + 2).alias("b")),
    )
    inside = runs.where(F.size("_xs") >= 2).select("ord", "row", F.explode(pairs).alias("_p"))
    start = F.greatest(F.ceil(grid.x_pos(F.col("_p.a")) - 0.5).cast("int"), F.lit(0))
    stop = F.least(F.ceil(grid.x_pos(F.col("_p.b")) - 0.5).cast("int") - 1, F.lit(grid.width - 1))
    return inside.select("ord", "row", start.alias("first"), stop.alias("last")).where("first <= last")


def cells_by_centre(zones: DataFrame, grid: Grid) -> DataFrame:
    """(ord, row, col) for every cell whose centre a polygon holds."""
    return ranges_by_centre(zones, grid).select("ord", "row", F.explode(F.sequence("first", "last")).alias("col")).hint("merge")


def ranges_on_edges(zones: DataFrame, grid: Grid) -> DataFrame:
    """(ord, row, first, last): the cells of a row that one edge passes through; edges meet, so ranges overlap."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(F.floor(grid.y_pos(high)).cast("int"), F.lit(0))
    last = F.least(F.floor(grid.y_pos(low)).cast("int"), F.lit(grid.height - 1))
    banded = edges(zones).withColumn("row", F.explode(_span(first, last)))
    # the part of the edge inside the row's band
    top = F.least(high, F.lit(grid.top) - F.col("row") * grid.res)
    bottom = F.greatest(low, F.lit(grid.top) - (F.col("row") + 1) * grid.res)
    at = lambda y: F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    xa = F.coalesce(at(top), F.col("x1"))
    xb = F.coalesce(at(bottom), F.col("x2"))
    start = F.greatest(F.floor(grid.x_pos(F.least(xa, xb))).cast("int"), F.lit(0))
    stop = F.least(F.floor(grid.x_pos(F.greatest(xa, xb))).cast("int"), F.lit(grid.width - 1))
    return banded.select("ord", "row", start.alias("first"), stop.alias("last")).where("first <= last")


def zone_spans(zones: DataFrame, grid: Grid, all_touched: bool = False) -> DataFrame:
    """(row, block, first, last, zone): disjoint ranges of columns; where polygons overlap the last one wins.

    Ranges are cut at blocks of SPAN columns and settled block by block. However many polygons lie over a block, at most
    SPAN * (SPAN + 1) / 2 different ranges of it remain after the first, combinable aggregation, and SPAN after the second.
    """
    ranges = ranges_by_centre(zones, grid)
    if all_touched:
        ranges = ranges.unionByName(ranges_on_edges(zones, grid))
    block = lambda c: F.floor(F.col(c) / SPAN).cast("int")
    cut = ranges.withColumn("block", F.explode(F.sequence(block("first"), block("last"))))
    cut = cut.select("ord", "row", "block", F.greatest("first", F.col("block") * SPAN).alias("a"), F.least("last", F.col("block") * SPAN + (SPAN - 1)).alias("b"))
    top = cut.groupBy("row", "block", "a", "b").agg(F.max("ord").alias("ord"))
    over = top.groupBy("row", "block").agg(F.collect_list(F.struct("a", "b", "ord")).alias("_r"))
    ends = F.concat(F.transform("_r", lambda r: r["a"]), F.transform("_r", lambda r: r["b"] + 1))
    over = over.withColumn("_at", F.array_sort(F.array_distinct(ends)))
    covering = lambda at: F.array_max(F.transform(F.filter("_r", lambda r: (r["a"] <= at) & (at <= r["b"])), lambda r: r["ord"]))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size("_at") - 1),
        lambda i: F.struct(F.get("_at", i - 1).alias("first"), (F.get("_at", i) - 1).alias("last"), covering(F.get("_at", i - 1)).alias("zone")),
    )
    one = F.transform("_r", lambda r: F.struct(r["a"].alias("first"), r["b"].alias("last"), r["ord"].alias("zone")))
    spans = over.select("row", "block", F.explode(F.when(F.size("_r") == 1, one).otherwise(pieces)).alias("_s"))
    return spans.select("row", "block", "_s.*").where(F.col("zone").isNotNull())


def span_cells(spans: DataFrame) -> DataFrame:
    """(row, col, zone) of every cell of disjoint ranges."""
    return spans.select("row", F.explode(F.sequence("first", "last")).alias("col"), "zone").hint("merge")


def assign_zones(zones: DataFrame, grid: Grid, all_touched: bool = False) -> DataFrame:
    """(row, col, zone): the polygon each cell belongs to; where polygons overlap the last one wins."""
    return span_cells(zone_spans(zones, grid, all_touched))


def row_sums(cells: DataFrame, keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """(keys, row, block, cells): a layer's running sums along each block of a row, SPAN entries at most.

    An entry holds what its cell and those left of it in the block sum up to: rows, rows with a value, finite values, and
    how many are NaN, plus and minus infinity (which would spoil the differences of sums). Made once, it serves any zones.
    """
    at = [*(keys or []), "row", "block"]
    v, endless = F.col("_v"), float("inf")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < endless)
    placed = cells.select(*(keys or []), *CELL, F.floor(F.col("col") / SPAN).cast("int").alias("block"), F.col(value).cast("double").alias("_v"))
    parts = {"rows": F.lit(1), "n": F.when(v.isNotNull(), 1), "sum": F.when(finite, v), "nan": F.when(F.isnan(v), 1), "high": F.when(v == endless, 1), "low": F.when(v == -endless, 1)}
    per_cell = placed.groupBy(*at, "col").agg(*[F.coalesce(F.sum(part), F.lit(0)).alias(name) for name, part in parts.items()])
    so_far = Window.partitionBy(*at).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    entry = per_cell.select(*at, "col", *[F.sum(name).over(so_far).alias(name) for name in parts])
    return entry.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("col", *parts))).alias("cells"))


def span_means(sums: DataFrame, spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, zone, mean, n) over every cell of a zone that has a row, zeros included; two entries are read per range.

    As for a plain mean, missing values count in ``n`` only, and NaN or infinite ones make the mean so.
    """
    names = ["rows", "n", "sum", "nan", "high", "low"]
    steps = F.array(*[F.lit(SPAN >> i) for i in range(SPAN.bit_length())])
    upto = lambda col: F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get("cells", p + s - 1)["col"] <= col, p + s).otherwise(p))
    met = sums.join(spans.hint("merge"), ["row", "block"])
    met = met.select(*(keys or []), "zone", F.get("cells", upto(F.col("last")) - 1).alias("_b"), F.get("cells", upto(F.col("first") - 1) - 1).alias("_a"))
    between = [(F.coalesce(F.col(f"_b.{c}"), F.lit(0)) - F.coalesce(F.col(f"_a.{c}"), F.lit(0))).alias(c) for c in names]
    total = met.select(*(keys or []), "zone", *between).groupBy(*(keys or []), "zone").agg(*[F.sum(c).alias(c) for c in names]).where("rows > 0")
    mean = (
        F.when((F.col("nan") > 0) | ((F.col("high") > 0) & (F.col("low") > 0)), float("nan")).when(F.col("high") > 0, float("inf"))
        .when(F.col("low") > 0, float("-inf")).when(F.col("n") > 0, F.col("sum") / F.col("n"))
    )
    return total.select(*(keys or []), "zone", mean.alias("mean"), F.col("rows").alias("n"))


def zone_ids(zones: DataFrame) -> DataFrame:
    """ord -> (iso3, zone id): polygons sharing a code share an id, numbered by first appearance.

    A missing or '-99' code falls back to the second code; polygons with neither are left out.
    """
    code = lambda c: F.nullif(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("-99"))
    named = zones.withColumn("iso3", F.coalesce(code("iso_a3"), code("adm0_a3"))).where(F.col("iso3").isNotNull())
    firsts = named.groupBy("iso3").agg(F.min("ord").alias("_first"))
    ids = running_count(firsts, [], "_first", "zone").select("iso3", F.col("zone").cast("int").alias("zone"))
    return named.join(ids, "iso3").select("ord", "iso3", "zone")


def region_join(polygons: DataFrame, records: DataFrame) -> DataFrame:
    """Polygons with a record, numbered compactly by first appearance of their code."""
    matched = polygons.withColumn("code", F.trim("code")).join(records, "code")
    ids = zone_ids(matched.select("ord", F.col("code").alias("iso_a3"), F.lit(None).cast("string").alias("adm0_a3")))
    return matched.join(ids.select("ord", "zone"), "ord")
