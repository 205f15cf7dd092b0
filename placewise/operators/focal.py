"""Neighbourhood operators over grids.

Cells are grouped into square blocks; each block also receives a halo as wide as the neighbourhood, so
blocks are independent and bounded in size whatever the grid. The halo adds a few per cent of rows, where
a long-form kernel join would multiply every row by the kernel. Inside a block NumPy works on a dense
array; outside the grid, values are mirrored at the edge.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.functions.grid import Grid

BLOCK = 256


def _focal(df: DataFrame, grid: Grid, radius: int, step, keys: list[str], keep_zero: bool, fill: float, block: int) -> DataFrame:
    """Run ``step(dense, row0, col0)`` per block; ``dense`` has ``radius`` extra cells on every side.

    Absent cells hold ``fill``. NaN results are dropped, and zeros too unless ``keep_zero``.
    """
    block = max(block, radius)
    height, width = grid.height, grid.width
    halo = lambda c, size: F.explode(
        F.sequence(
            F.greatest(F.floor((F.col(c) - radius) / block).cast("int"), F.lit(0)),
            F.least(F.floor((F.col(c) + radius) / block).cast("int"), F.lit((size - 1) // block)),
        )
    )
    spread = df.select(*keys, "row", "col", "value").withColumn("_br", halo("row", height)).withColumn("_bc", halo("col", width))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType(
        [T.StructField(k, kinds[k]) for k in keys]
        + [T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("value", T.DoubleType())]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row0, col0 = int(pdf["_br"].iloc[0]) * block, int(pdf["_bc"].iloc[0]) * block
        rows, cols = min(block, height - row0), min(block, width - col0)

        def mirrored(start: int, count: int, size: int) -> np.ndarray:
            at = np.mod(np.arange(start - radius, start + count + radius), 2 * size)
            return np.where(at >= size, 2 * size - 1 - at, at) - (start - radius)

        held = np.full((rows + 2 * radius, cols + 2 * radius), fill)
        r, c = pdf["row"].to_numpy() - row0 + radius, pdf["col"].to_numpy() - col0 + radius
        here = (r >= 0) & (r < held.shape[0]) & (c >= 0) & (c < held.shape[1])
        held[r[here], c[here]] = pdf["value"].to_numpy(dtype=float)[here]
        dense = held[np.ix_(mirrored(row0, rows, height), mirrored(col0, cols, width))]
        out = step(dense, row0, col0)
        wanted = ~np.isnan(out) if keep_zero else ~np.isnan(out) & (out != 0)
        rr, cc = np.nonzero(wanted)
        result = {k: pdf[k].iloc[0] for k in keys}
        frame = pd.DataFrame({"row": (rr + row0).astype("int32"), "col": (cc + col0).astype("int32"), "value": out[rr, cc]})
        for k, v in result.items():
            frame[k] = v
        return frame[[*keys, "row", "col", "value"]]

    return spread.groupBy(*keys, "_br", "_bc").applyInPandas(run, schema)


def gaussian_kernel(sigma: float) -> np.ndarray:
    radius = int(4.0 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return weights / weights.sum()


def gaussian(df: DataFrame, grid: Grid, sigma: float, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Gaussian smoothing, kernel cut at four sigma; absent cells are 0 and zero results are left out."""
    weights = gaussian_kernel(sigma)
    radius = len(weights) // 2

    def smooth(dense, _row0, _col0):
        rows, cols = dense.shape[0] - 2 * radius, dense.shape[1] - 2 * radius
        down = sum(w * dense[k:k + rows, :] for k, w in enumerate(weights))
        return sum(w * down[:, k:k + cols] for k, w in enumerate(weights))

    return _focal(df, grid, radius, smooth, list(keys or []), False, 0.0, block)


def max_filter(df: DataFrame, grid: Grid, size: int = 13, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Maximum over a size x size window; absent cells are 0 and zero results are left out."""
    radius = size // 2

    def widen(dense, _row0, _col0):
        down = np.lib.stride_tricks.sliding_window_view(dense, size, axis=0).max(axis=-1)
        return np.lib.stride_tricks.sliding_window_view(down, size, axis=1).max(axis=-1)

    return _focal(df, grid, radius, widen, list(keys or []), False, 0.0, block)


def rise_per_cell(elev: DataFrame, grid: Grid, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Length of the elevation gradient per cell: central differences, one-sided at the grid's edge.

    Cells next to an absent cell have no gradient and are left out.
    """
    height, width = grid.height, grid.width

    def gradient(dense, row0, col0):
        down = (dense[2:, 1:-1] - dense[:-2, 1:-1]) / 2.0
        across = (dense[1:-1, 2:] - dense[1:-1, :-2]) / 2.0
        # the mirrored neighbour equals the edge cell, so an edge difference is halved once too often
        for at, size, part in ((row0, height, down), (col0, width, across.T)):
            if at == 0:
                part[0] *= 2.0
            if at + part.shape[0] == size:
                part[-1] *= 2.0
        return np.sqrt(down ** 2 + across ** 2)

    return _focal(elev, grid, 1, gradient, list(keys or []), True, math.nan, block)


def slope_deg(elev: DataFrame, grid: Grid, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Slope in degrees, one pixel being res * 111 km."""
    rise = rise_per_cell(elev, grid, keys, block)
    return rise.withColumn("value", F.degrees(F.atan(F.col("value") / (grid.res * 111_000.0))))
