"""Yearly climate layers from a monthly cube."""

from __future__ import annotations

from pyspark.sql import DataFrame

from placewise.operators import climate
from placewise.operators.masks import lake_mask
from placewise.plans.layers import encoded

RECIPES = {"temp": climate.annual_mean, "tvar": climate.annual_std, "water": climate.annual_sum}


def climate_layer(cube: DataFrame, axis: str, lakes: DataFrame | None = None) -> DataFrame:
    """year, row, col, byte of temp, tvar or water; all years are one job keyed by year."""
    layer = RECIPES[axis](cube)
    if axis == "tvar" and lakes is not None:
        layer = lake_mask(layer, lakes)
    return encoded(layer, axis, ["year"])
