"""The painted mask: brush strokes, the paint/erase fold, roll-ups and key encoding.

A mask cell is (level, cx, cy) in a quadtree of 17 levels. A cell's ancestors are at most 16 rows, so
containment is always an equi join on exploded ancestors, never a search over descendants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.grid import MAX_MASK_LEVEL
from placewise.operators.prefix import previous_value, running_sum
from placewise.session import materialised

QUAD = ["level", "cx", "cy"]
#: Levels up to here hold at most (4**8 - 1) / 3 = 21 845 cells together: always small enough to broadcast.
COARSE_LEVEL = 7


def brush_cells(strokes: DataFrame) -> DataFrame:
    """Every cell a round brush covers; x wraps around the map, y is cut off at its edges."""
    offsets = F.sequence(-F.col("r"), F.col("r"))
    size = F.expr("shiftleft(1, level)")
    spread = strokes.withColumn("_dy", F.explode(offsets)).withColumn("_dx", F.explode(offsets))
    radius = F.col("r") + 0.5
    cells = spread.where(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") <= radius * radius)
    moved = cells.withColumns({"cx": F.pmod(F.col("cx") + F.col("_dx"), size), "cy": F.col("cy") + F.col("_dy")})
    return moved.where((F.col("cy") >= 0) & (F.col("cy") < size)).drop("_dx", "_dy", "r")


def _up(coordinate: str, steps: Column) -> Column:
    return F.floor(F.col(coordinate) / F.pow(F.lit(2.0), steps)).cast("int")


def ancestors(cells: DataFrame, strict: bool, levels: Column | None = None, top: Column | None = None) -> DataFrame:
    """One row per ancestor (with the cell itself unless ``strict``): adds a_level, a_cx, a_cy.

    ``levels`` limits the ancestors to a list of levels, ``top`` to levels from there down.
    """
    last = F.col("level") - 1 if strict else F.col("level")
    first = F.lit(0) if top is None else top
    if levels is None:
        wanted = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    else:
        wanted = F.filter(levels, lambda a: (a >= first) & (a <= last))
    rows = cells.withColumn("a_level", F.explode(wanted))
    steps = F.col("level") - F.col("a_level")
    return rows.withColumns({"a_cx": _up("cx", steps), "a_cy": _up("cy", steps)})


def _levels(table: DataFrame) -> Column:
    """The levels a table has cells at (17 at most), as a scalar subquery."""
    return table.agg(F.collect_set("level")).scalar()


def _join_ancestors(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Join ancestor rows to ``table`` on its own (level, cx, cy).

    ``table`` holds each cell once. Coarse ancestors are shared by very many cells; their side of the table is tiny and is broadcast, so
    the hot keys never go through a shuffle. Finer levels meet in a shuffled join that AQE may split.
    """
    keyed = table.withColumnsRenamed({"level": "a_level", "cx": "a_cx", "cy": "a_cy"})
    keys = ["a_level", "a_cx", "a_cy"]
    coarse, fine = F.col("a_level") <= COARSE_LEVEL, F.col("a_level") > COARSE_LEVEL
    return rows.where(coarse).join(F.broadcast(keyed.where(coarse)), keys, how).unionByName(
        rows.where(fine).join(keyed.where(fine), keys, how)
    )


def _children(parents: DataFrame) -> DataFrame:
    """The four cells one level below each (level, cx, cy)."""
    quarters = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (0, 1) for y in (0, 1)])
    return parents.withColumn("_q", F.explode(quarters)).select(
        (F.col("level") + 1).alias("level"),
        (F.col("cx") * 2 + F.col("_q.x")).alias("cx"),
        (F.col("cy") * 2 + F.col("_q.y")).alias("cy"),
    )


def _events_above(cells: DataFrame, latest: DataFrame, strict: bool) -> DataFrame:
    """(cell, event) pairs of the newest events on each cell's ancestors; levels without events are skipped."""
    listed = cells.select(*QUAD).withColumn("_levels", _levels(latest))
    rows = ancestors(listed, strict, F.col("_levels")).drop("_levels")
    return _join_ancestors(rows, latest.withColumnsRenamed({"op": "_op", "seq": "_seq"}), "inner")


def _newest(events: DataFrame, *marks: str) -> DataFrame:
    """The newest event of each cell; ``marks`` are columns that go with it."""
    kept = [F.max_by(c, "seq").alias(c) for c in ("op", *marks)]
    return events.groupBy(*QUAD).agg(*kept, F.max("seq").alias("seq"))


def _visible(events: DataFrame, above: DataFrame) -> DataFrame:
    """``events`` without those on whose ancestors ``above`` has a newer one."""
    newer = _events_above(events, above, strict=True).groupBy(*QUAD).agg(F.max("_seq").alias("_newer"))
    return events.join(newer, QUAD, "left").where(F.coalesce(F.col("_newer") <= F.col("seq"), F.lit(True))).drop("_newer")


def compact_events(events: DataFrame) -> DataFrame:
    """The events (level, cx, cy, op, seq) that still decide something: the newest of each cell, unless an ancestor has a newer one.

    What lies in a hidden event's cell also lies in that of the newer one, so ``fold_mask`` gives the same rows for the
    events and for the compacted ones, with any later events added to either.
    """
    latest = materialised(_newest(events))
    return _visible(latest, latest)


def merge_events(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The compacted events after another batch; ``state`` is what ``compact_events`` or this gave before.

    Batches may come in any order of ``seq``, and may be empty or repeated. Only pairs of a new event with another are
    looked at: kept events meet new ones above them, new events meet both. Events of the state never meet each other.
    """
    fresh = materialised(_newest(batch.select(*QUAD, "op", "seq")))
    state = state.select(*QUAD, "op", "seq")
    both = materialised(_newest(state.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.lit(True))), "_new"))
    kept = _visible(both.where(~F.col("_new")), fresh)
    added = _visible(_visible(both.where("_new"), fresh), state)
    return kept.unionByName(added).drop("_new")


def fold_mask(events: DataFrame) -> DataFrame:
    """The painted cells (level, cx, cy) after all paint/erase events, the newest event winning each area.

    Events shrink to the newest per cell and then to those that change what their surroundings say. The
    event cells above each remaining event are split down to it (siblings on its path), and every piece
    takes the newest event above it. Cost is at most 17 rows per event cell, fewer when few levels are in
    use; no cell is expanded to its descendants. The result covers each painted area once, with the
    coarsest cells the erases allow.
    """
    latest = materialised(_newest(events))
    outer = _events_above(latest, latest, strict=True).groupBy(*QUAD).agg(
        F.max_by("_op", "_seq").alias("_outer"), F.max("_seq").alias("_outer_seq"), F.min("a_level").alias("_top")
    )
    seen = latest.join(outer, QUAD, "left").withColumns({
        "_own": F.when(F.col("_outer_seq") > F.col("seq"), F.col("_outer")).otherwise(F.col("op")),
        "_outer": F.coalesce("_outer", F.lit("erase")),
    })
    changing = seen.where(F.col("_own") != F.col("_outer"))
    inner = ancestors(changing.where(F.col("_top").isNotNull()), strict=True, top=F.col("_top")).select(
        F.col("a_level").alias("level"), F.col("a_cx").alias("cx"), F.col("a_cy").alias("cy")
    ).distinct()
    pieces = _children(inner).unionByName(changing.select(*QUAD)).distinct().join(inner, QUAD, "left_anti")
    said = _events_above(pieces, latest, strict=False).groupBy(*QUAD).agg(F.max_by("_op", "_seq").alias("_said"))
    return said.where(F.col("_said") == "paint").select(*QUAD)


def mask_count(mask: DataFrame) -> DataFrame:
    return mask.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def mask_has(mask: DataFrame) -> DataFrame:
    """Every cell that holds paint at or below itself."""
    rows = ancestors(mask.select(*QUAD), strict=False)
    return rows.select(F.col("a_level").alias("level"), F.col("a_cx").alias("cx"), F.col("a_cy").alias("cy")).distinct()


def mask_at(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells (level, cx, cy) that render as painted: paint in them, below them, or on an ancestor."""
    below = cells.join(mask_has(mask), QUAD, "left_semi")
    listed = cells.select(*QUAD).distinct().withColumn("_levels", _levels(mask))
    above = _join_ancestors(ancestors(listed, True, F.col("_levels")), mask.select(*QUAD).distinct(), "left_semi")
    return below.select(*QUAD).unionByName(above.select(*QUAD)).distinct()


def mask_axis(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """The mask as an axis: f_draw is 1 on paint and 0 elsewhere, never missing."""
    painted = mask_at(cells, mask).withColumn("_on", F.lit(1.0))
    return cells.join(painted, QUAD, "left").withColumn("f_draw", F.coalesce("_on", F.lit(0.0))).drop("_on")


def mask_key() -> Column:
    return F.col("cy").cast("bigint") * F.expr("shiftleft(1L, level)") + F.col("cx")


def mask_deltas(mask: DataFrame) -> DataFrame:
    """(level, key, delta): each key minus the one before it at its level."""
    keyed = mask.select("level", mask_key().alias("key")).distinct()
    rows = previous_value(keyed, ["level"], "key", "_prev")
    return rows.select("level", "key", (F.col("key") - F.coalesce("_prev", F.lit(0))).alias("delta"))


def mask_from_deltas(deltas: DataFrame) -> DataFrame:
    """Painted cells back from (level, pos, delta); levels outside 0..16 are ignored."""
    known = deltas.where(F.col("level").between(0, MAX_MASK_LEVEL))
    keys = running_sum(known, ["level"], "pos", "delta", "key")
    size = F.expr("shiftleft(1L, level)")
    return keys.select(
        "level", F.pmod("key", size).cast("int").alias("cx"), F.expr("key div shiftleft(1L, level)").cast("int").alias("cy")
    ).distinct()
