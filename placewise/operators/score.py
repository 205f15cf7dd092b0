"""Scoring cells with curves and a formula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.encode import share_to_byte
from placewise.functions.formula import PIECES, FormulaError, clamp_score, formula_column, validate_formula
from placewise.functions.grid import MAX_MASK_LEVEL, TILE_PX, mercator_y, tile_pixel
from placewise.functions.rounding import half_up, squeeze
from placewise import dims
from placewise.operators.brush import QUAD, mask_axis
from placewise.operators.curves import apply_curve, curve_lut, quantize_lut
from placewise.operators.places import score_all
from placewise.operators.quantile import exact_quantiles

CELL = ["row", "col"]
DRAW = "draw"
#: Profiles that score the cells of a square together.
PROFILE_GROUP = 64
#: Share of an axis's positive cells below its upper bound where the registry leaves it open, and the bound without any.
OPEN_SHARE, DEFAULT_CAP = 0.995, 5000.0


def encode_layers(layers: DataFrame, open_axes: list[str] | None = None) -> DataFrame:
    """axis, row, col, byte under each axis's bounds.

    Fixed bounds come from a 36-row dimension; there an open lower bound counts as 0, as it does when bytes are decoded.
    ``open_axes`` names the axes whose upper bound the registry leaves open and which the layers hold: theirs is p99.5 of
    the axis's own positive cells, all of them in one keyed pass over those axes. Any other axis stops the job by name,
    so that none is lost without a word.
    """
    open_axes = list(open_axes or [])
    registry = F.broadcast(dims.axis_dim(layers.sparkSession))
    scaled = layers.join(registry, "axis", "left")
    if open_axes:
        positive = layers.where(F.col("axis").isin(open_axes) & (F.col("value") > 0))
        own = exact_quantiles(positive, "value", {"cap": OPEN_SHARE}, ["axis"])
        scaled = scaled.join(F.broadcast(own), "axis", "left")  # one row per named axis
        is_open = F.col("axis").isin(open_axes)
        bounds = {"lo": F.lit(0.0), "hi": F.log1p(F.coalesce("cap", F.lit(DEFAULT_CAP))), "is_log": F.lit(True), "inverted": F.lit(False)}
        scaled = scaled.withColumns({name: F.when(is_open, bound).otherwise(F.col(name)) for name, bound in bounds.items()})
    value, log = F.col("value"), F.col("is_log")
    shown = F.when(log & (value > 0), F.log1p(value)).when(log, F.lit(0.0)).otherwise(value)
    share = squeeze((shown - F.col("lo")) / (F.col("hi") - F.col("lo")), 0.0, 1.0)
    sign, base = F.when(F.col("inverted"), F.lit(-1.0)).otherwise(F.lit(1.0)), F.when(F.col("inverted"), F.lit(1.0)).otherwise(F.lit(0.0))
    lost = F.raise_error(F.concat(F.lit("no bounds for axis "), F.coalesce("axis", F.lit("NULL")))).cast("int")
    return scaled.select("axis", *CELL, F.when(F.col("hi").isNull(), lost).otherwise(share_to_byte(value, base + sign * share)).alias("byte"))


def axes_at(layer: DataFrame, axes: list[str], value: str, prefix: str = "f_", on: list[str] | None = None) -> DataFrame:
    """One row per cell that has every axis, a column per axis.

    Only the wanted axes are read (a partition filter on stored layers); one combinable aggregation
    does the work of a join per axis. ``on`` names the columns of a cell.
    """
    wide = layer.where(F.col("axis").isin(axes)).groupBy(*(on or CELL)).agg(
        *[F.max(F.when(F.col("axis") == a, F.col(value))).alias(f"{prefix}{a}") for a in axes]
    )
    return wide.na.drop(subset=[f"{prefix}{a}" for a in axes])


def score(layer: DataFrame, formula: str, curves: DataFrame, active_axis: str | None = None, on: list[str] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Cell and score of a byte layer under a formula; an empty formula scores the active axis alone.

    ``on`` names the columns of a cell (row and column by default). The axis ``draw`` is 1 on the painted cells of
    ``mask`` and 0 on all others; it asks for cells given as level, cx and cy, and never lacks a value.
    """
    text, on = formula.strip() or active_axis, on or CELL
    axes = validate_formula(text)
    stored = [a for a in axes if a != DRAW]
    lut = quantize_lut(curve_lut(curves.where(F.col("axis").isin(stored))))
    if stored:
        wide = axes_at(apply_curve(layer.where(F.col("axis").isin(stored)), lut), stored, "score", on=on)
    else:
        wide = layer.select(*on).distinct()
    if DRAW in axes:
        if mask is None or not set(QUAD) <= set(on):
            raise FormulaError("draw needs a mask and cells given as level, cx, cy")
        wide = mask_axis(wide, mask)
    return _finished(wide.select(*on, formula_column(text).alias("score")))


def score_at(points: DataFrame, tiles: DataFrame, zoom: int, formula: str, curves: DataFrame, active_axis: str | None = None, mask: DataFrame | None = None, key: str = "id") -> DataFrame:
    """key, score of a formula under each point; NULL where an axis has no data, the map ends or the result is no number.

    ``tiles`` holds axis, z, x, y, px, py, byte. Only the pixels that points lie on are scored, each once however many
    points share it: the distinct pixels go to the tiles, and the points pick their pixel's score up. Both joins are on
    the pixel, so a place with very many points is one row on its way to the tiles; AQE splits it on the way back.
    """
    pixel = ["z", "x", "y", "px", "py"]
    text = formula.strip() or active_axis
    axes = validate_formula(text)
    placed = tile_pixel(points, zoom).select(key, *pixel)
    wanted = placed.select(*pixel).distinct()
    if axes == [DRAW]:
        under = wanted.select(F.lit(DRAW).alias("axis"), *pixel, F.lit(1).alias("byte"))
    else:
        under = tiles.where((F.col("z") == zoom) & F.col("axis").isin([a for a in axes if a != DRAW])).join(wanted, pixel)
    # the painted cell of a pixel: its own place in the quadtree, or that of its ancestor at the deepest level
    level = F.least(F.col("z") + 8, F.lit(MAX_MASK_LEVEL)).cast("int")
    down = lambda tile, px: F.expr(f"shiftright({tile} * {TILE_PX} + {px}, z + 8 - least(z + 8, {MAX_MASK_LEVEL}))").cast("int")
    under = under.withColumns({"level": level, "cx": down("x", "px"), "cy": down("y", "py")})
    scored = score(under, text, curves, on=[*pixel, *QUAD], mask=mask)
    out = placed.join(scored.select(*pixel, "score"), pixel, "left").select(key, "score")
    return out.unionByName(points.where(mercator_y(F.col("lat")).isNull()).select(key, F.lit(None).cast("double").alias("score")))


def _finished(results: DataFrame) -> DataFrame:
    """Formula results clamped to scores; cells without a score are left out.

    A step of its own, so that the optimizer keeps the formula in one place.
    """
    return results.withColumn("score", clamp_score(F.col("score"))).where(F.col("score").isNotNull())


def match_pct(value: Column) -> Column:
    return half_up(value * 100.0)


def top_places(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best cells; ties by cell so the answer is stable. Runs as a per-task top-k."""
    return scored.orderBy(F.desc("score"), "row", "col").limit(k)


# --- tables of formulas and profiles -----------------------------------------------------------------


def canonical_axes(words: DataFrame, column: str = "word") -> DataFrame:
    """Adds the axis a word stands for; an unknown word stands for itself."""
    aliases = F.broadcast(dims.alias_dim(words.sparkSession).withColumnsRenamed({"word": "_w", "axis": "_a"}))
    lowered = F.lower(F.col(column))
    return words.join(aliases, lowered == F.col("_w"), "left").withColumn("axis", F.coalesce("_a", lowered)).drop("_w", "_a")


def formula_axis_rows(profiles: DataFrame) -> DataFrame:
    """(profile, axis) for every axis a stored formula names."""
    pieces = F.regexp_extract_all("formula", F.lit(f"({PIECES})"), F.lit(1))
    words = profiles.select("profile", F.explode(pieces).alias("word")).where(
        F.col("word").rlike("^[A-Za-z_]") & (F.lower("word") != "x")
    )
    return canonical_axes(words).select("profile", "axis").distinct()


def validate_formulas(profiles: DataFrame) -> DataFrame:
    """profile, unknown (comma list), n_axes, ok for a whole table of formulas."""
    used = formula_axis_rows(profiles)
    known = F.col("axis").isin(dims.AXES)
    per = used.groupBy("profile").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(~known, F.col("axis")))), ", ").alias("unknown"),
        F.count(F.lit(1)).alias("n_axes"),
    )
    ok = (F.col("unknown") == "") & (F.col("n_axes") <= dims.MAX_FORMULA_AXES)
    return per.withColumn("ok", ok)


def score_profiles(layer: DataFrame, profiles: DataFrame, curves: DataFrame) -> DataFrame:
    """profile, row, col, score for every stored profile over one grid: see :func:`placewise.operators.places.score_all`."""
    return score_all(layer, profiles, curves, served=PROFILE_GROUP)
