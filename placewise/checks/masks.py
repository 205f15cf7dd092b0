"""The painted mask."""

from pyspark.sql import functions as F

from placewise.checks import check
from placewise.functions.grid import mask_level
from placewise.operators import brush

STROKES = """(SELECT seq, op, level, CAST((cx + dx + 256) % 256 AS INTEGER) AS cx, CAST(cy + dy AS INTEGER) AS cy FROM b_brush, range(-3, 4) a(dx), range(-3, 4) b(dy)
WHERE abs(dx) <= r AND abs(dy) <= r AND dx * dx + dy * dy <= (r + 0.5) * (r + 0.5) AND cy + dy BETWEEN 0 AND 255)"""

# the newest event over each level-7 cell, found by brute force
FINE = """(SELECT x, y, max_by(op, seq) AS op FROM (SELECT CAST(unnest(range(cx << (7 - level), (cx + 1) << (7 - level))) AS INTEGER) AS x, cy, level, op, seq FROM b_quad) e, range(128) r(y)
WHERE y >= (cy << (7 - level)) AND y < ((cy + 1) << (7 - level)) GROUP BY x, y)"""


@check("d01_brush_cells", f"SELECT * FROM {STROKES}")
def d01(t):
    return brush.brush_cells(t.brush())


@check("d02_fold_brush", f"SELECT level, cx, cy FROM (SELECT level, cx, cy, max_by(op, seq) AS op FROM {STROKES} GROUP BY ALL) WHERE op = 'paint'")
def d02(t):
    return brush.fold_mask(brush.brush_cells(t.brush()))


def expand(mask, level=7):
    """Mask cells as cells of one fine level."""
    n = F.expr(f"shiftleft(1, {level} - level)")
    span = lambda c: F.explode(F.sequence(F.col(c) * n, (F.col(c) + 1) * n - 1))
    return mask.withColumn("x", span("cx")).withColumn("y", span("cy")).select("x", "y")


@check("d02_fold_levels", f"SELECT x, CAST(y AS INTEGER) AS y FROM {FINE} WHERE op = 'paint'")
def d02l(t):
    """Mixed levels, compared by the area they cover; every painted cell is covered exactly once."""
    return expand(brush.fold_mask(t.quad_events()))


def batches(t, n=3):
    """The compacted events after ``n`` batches whose sequence numbers are mixed."""
    events = t.quad_events()
    part = lambda k: events.where(F.pmod("seq", F.lit(n)) == k)
    state = brush.compact_events(part(n - 1))
    for k in range(n - 1):
        state = brush.merge_events(state, part(k))
    return state


@check("d02_fold_in_batches", f"SELECT x, CAST(y AS INTEGER) AS y FROM {FINE} WHERE op = 'paint'")
def d02b(t):
    return expand(brush.fold_mask(batches(t)))


@check("d02_events_in_batches", """WITH l AS (SELECT level, cx, cy, max_by(op, seq) AS op, max(seq) AS seq FROM b_quad GROUP BY level, cx, cy),
up AS (SELECT l.level, l.cx, l.cy, CAST(unnest(range(l.level)) AS INTEGER) AS a, l.seq FROM l),
hidden AS (SELECT DISTINCT up.level, up.cx, up.cy FROM up JOIN l ON l.level = up.a AND l.cx = up.cx >> (up.level - up.a) AND l.cy = up.cy >> (up.level - up.a) AND l.seq > up.seq)
SELECT level, cx, cy, op, seq FROM l ANTI JOIN hidden USING (level, cx, cy)""")
def d02e(t):
    return batches(t)


@check("d03_mask_has", "SELECT DISTINCT CAST(l AS INTEGER) AS level, CAST(cx >> (level - l) AS INTEGER) AS cx, CAST(cy >> (level - l) AS INTEGER) AS cy FROM b_quad, range(0, 8) a(l) WHERE l <= level")
def d03(t):
    return brush.mask_has(t.quad_events().select("level", "cx", "cy"))


def view_cells(t, level=5):
    """Cells of the points at a render level."""
    from placewise.functions.grid import quad_cell

    return quad_cell(t.points(), level).select("id", "level", "cx", "cy")


VIEW = """(SELECT id, 5 AS level, CAST(least(greatest(floor((lon + 180) / 360 * 32), 0), 31) AS INTEGER) AS cx,
CAST(least(greatest(floor((0.5 - ln(tan(pi() / 4 + lat * pi() / 180 / 2)) / (2 * pi())) * 32), 0), 31) AS INTEGER) AS cy FROM b_points)"""
HIT = f"(SELECT DISTINCT v.level, v.cx, v.cy FROM {VIEW} v JOIN (SELECT DISTINCT x >> 2 AS cx, y >> 2 AS cy FROM {FINE} WHERE op = 'paint') q ON q.cx = v.cx AND q.cy = v.cy)"


def mask(t):
    """What all events leave painted."""
    return brush.fold_mask(t.quad_events())


@check("d04_mask_at", f"SELECT level, cx, cy FROM {HIT}")
def d04(t):
    return brush.mask_at(view_cells(t).drop("id"), mask(t))


@check("d05_mask_axis", f"SELECT id, level, cx, cy, CASE WHEN h.cx IS NULL THEN 0 ELSE 1 END::DOUBLE AS f_draw FROM {VIEW} LEFT JOIN (SELECT *, 1 AS on_ FROM {HIT}) h USING (level, cx, cy)")
def d05(t):
    return brush.mask_axis(view_cells(t), mask(t))


@check("d06_mask_level", "SELECT c_custkey AS id, CAST(least(16, floor(c_custkey % 23 / 2::DOUBLE) + 8) AS INTEGER) AS level FROM customer")
def d06(t):
    return t["customer"].select(F.col("c_custkey").alias("id"), mask_level(F.col("c_custkey") % 23 / 2.0).alias("level"))
