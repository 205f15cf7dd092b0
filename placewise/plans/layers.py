"""Axis layers: registry-driven composition of cleaning, masking, resampling and encoding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise import dims
from placewise.functions.encode import positive_only, stretch, to_byte, valid_or_null, zero_fill
from placewise.functions.grid import Grid, cell_binned, cell_clamped
from placewise.operators.aggregate import CELL, grid_mean, grid_sum
from placewise.operators.masks import lake_mask, ocean_mask, water_mask
from placewise.operators.quantile import exact_quantiles
from placewise.operators.resample import resample_down
from placewise.operators.score import encode_layers

DEFAULT_CAP = 5000.0


def robust_cap(layer: DataFrame, share: float = 0.995) -> Column:
    """p99.5 of the positive cells as a scalar subquery; 5000 for an empty layer."""
    positive = layer.where(F.col("value") > 0)
    return F.coalesce(exact_quantiles(positive, "value", {"cap": share}).select("cap").scalar(), F.lit(DEFAULT_CAP))


def masked(layer: DataFrame, axis: str, elev: DataFrame | None, lakes: DataFrame | None) -> DataFrame:
    """Apply the mask the registry names for the axis."""
    kind = dims.ENCODING[axis]["mask"]
    if kind == "ocean":
        return ocean_mask(layer, elev)
    if kind == "water":
        return water_mask(layer, elev, lakes)
    if kind == "lakes":
        return lake_mask(layer, lakes)
    return layer


def encoded(layer: DataFrame, axis: str, keys: list[str] | None = None) -> DataFrame:
    """Bytes under the registered bounds; a bound the registry leaves open comes from the data.

    An open upper bound is p99.5 of the positive cells; an open lower bound is p1 of their logarithms.
    """
    enc = dims.ENCODING[axis]
    value, low, high = F.col("value"), enc["lo"], enc["hi"]
    if high is None:
        layer = layer.withColumn("_hi", F.log1p(robust_cap(layer)))
        low, high = F.lit(0.0), F.col("_hi")
    elif low is None:
        logs = layer.where(value > 0).withColumn("_l", F.log1p(value))
        first = F.coalesce(exact_quantiles(logs, "_l", {"lo": 0.01}).select("lo").scalar(), F.lit(0.0))
        layer = layer.withColumn("_lo", first)
        low, high = F.col("_lo"), F.lit(math.log1p(high))
    return layer.select(*(keys or []), *CELL, to_byte(value, low, high, enc["log"], enc["invert"]).alias("byte"))


def axis_layer(cells: DataFrame, axis: str, grid: Grid, elev: DataFrame | None = None, lakes: DataFrame | None = None, average: int = 1, keys: list[str] | None = None) -> DataFrame:
    """A static or yearly raster axis: nodata out, optional averaging, mask, bytes.

    ``elev`` and ``lakes`` are on the grid of the result, after averaging.
    Population treats nodata as nobody; gridded GDP keeps only positive values.
    """
    enc = dims.ENCODING[axis]
    value = F.col("value")
    if axis == "pop":
        clean = zero_fill(valid_or_null(value, enc["nodata"]))
    elif axis in ("gdp", "agri"):
        clean = positive_only(valid_or_null(value, enc["nodata"]))
    else:
        clean = valid_or_null(value, enc["nodata"])
    layer = cells.withColumn("value", clean)
    if average > 1:
        layer = resample_down(layer, grid, average, "average", keys)
    return encoded(masked(layer, axis, elev, lakes), axis, keys)


def speed_layer(tests: DataFrame, grid: Grid) -> DataFrame:
    """Mean speed per cell, log bytes."""
    return encoded(grid_mean(cell_binned(tests, grid), "kbps"), "inet")


def fuel_layer(plants: DataFrame, axis: str, grid: Grid, fuels: list[str] | None = None) -> DataFrame:
    """Summed capacity of the axis's fuels per cell, log bytes."""
    wanted = plants.where(F.col("fuel").isin(fuels or dims.FUEL_AXES[axis]))
    return encoded(grid_sum(cell_clamped(wanted, grid), "capacity"), axis)


def fuel_layers(plants: DataFrame, grid: Grid, fuels: dict[str, list[str]] | None = None) -> DataFrame:
    """axis, row, col, byte of all fuel axes from one scan of the plants; a fuel may count for several axes.

    The fuels of an axis are a few dozen rows, and the axis is a grouping key.
    """
    pairs = [(fuel, axis) for axis, names in (fuels or dims.FUEL_AXES).items() for fuel in names]
    keyed = plants.join(F.broadcast(dims.small_table(plants.sparkSession, pairs, "fuel string, axis string")), "fuel")
    return encode_layers(grid_sum(cell_clamped(keyed, grid), "capacity", ["axis"]))


def generation_layer(plants: DataFrame, grid: Grid) -> DataFrame:
    """All capacity per cell, log bytes between the layer's own p1 and p99."""
    layer = grid_sum(cell_clamped(plants, grid), "capacity")
    logs = layer.where(F.col("value") > 0).withColumn("_l", F.log1p("value"))
    marks = exact_quantiles(logs, "_l", {"lo": 0.01, "hi": 0.99}).select(F.struct("lo", "hi")).scalar()
    byte = to_byte(F.col("value"), F.col("_m.lo"), F.col("_m.hi"), log=True)
    return layer.withColumn("_m", marks).select(*CELL, byte.alias("byte"))


def hazard_axis(cells: DataFrame, axis: str, elev: DataFrame | None, lakes: DataFrame | None) -> DataFrame:
    """Hazard display layer: stretch, water mask, inverted bytes (bright is safe)."""
    kind, gamma = dims.STRETCH[axis]
    cap = dims.ENCODING[axis]["hi"]
    shown = cells.withColumn("value", stretch(F.col("value"), cap, kind, gamma))
    return encoded(masked(shown, axis, elev, lakes), axis)
