"""Coordinate arithmetic: lon/lat, grid cells, Web-Mercator tiles and quadtree cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewise.functions.rounding import clamp

TILE_PX = 256
MAX_TILE_ZOOM = 10
MAX_MASK_LEVEL = 16
MERCATOR_LIMIT = 85.0
EARTH_HALF_EQUATOR_M = 20037508.342789244


@dataclass(frozen=True)
class Grid:
    """A north-up plate-carree grid: row 0 at the top, column 0 at the left."""

    res: float
    width: int
    height: int
    left: float = -180.0
    top: float = 90.0

    @classmethod
    def world(cls, res: float) -> "Grid":
        return cls(res, int(round(360 / res)), int(round(180 / res)))

    def coarser(self, factor: int) -> "Grid":
        """The block grid; partial edge blocks are left out."""
        return Grid(self.res * factor, self.width // factor, self.height // factor, self.left, self.top)

    def x_center(self, col: Column) -> Column:
        return F.lit(self.left) + (col.cast("double") + 0.5) * self.res

    def y_center(self, row: Column) -> Column:
        return F.lit(self.top) - (row.cast("double") + 0.5) * self.res

    def x_pos(self, lon: Column) -> Column:
        return (lon - F.lit(self.left)) / self.res

    def y_pos(self, lat: Column) -> Column:
        return (F.lit(self.top) - lat) / self.res


# --- lon/lat to cell ---------------------------------------------------------------------------


def cell_clamped(df: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Truncate towards zero, then clamp into the grid: every point gets a cell."""
    return df.withColumns(
        {
            "row": clamp(grid.y_pos(F.col(lat)).cast("int"), 0, grid.height - 1),
            "col": clamp(grid.x_pos(F.col(lon)).cast("int"), 0, grid.width - 1),
        }
    )


def cell_bounded(df: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Truncate towards zero, drop points outside; a position in (-1, 0) lands in cell 0."""
    cells = df.withColumns({"row": grid.y_pos(F.col(lat)).cast("int"), "col": grid.x_pos(F.col(lon)).cast("int")})
    return cells.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))


def cell_binned(df: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Left-closed bins counted from the south-west corner, flipped to north-up; outside is dropped."""
    bottom = grid.top - grid.height * grid.res
    south = F.floor((F.col(lat) - F.lit(bottom)) / grid.res).cast("int")
    cells = df.withColumns({"row": F.lit(grid.height - 1) - south, "col": F.floor(grid.x_pos(F.col(lon))).cast("int")})
    return cells.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))


def wrap_lon(lon: Column) -> Column:
    """One turn back into [-180, 180]."""
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)


def lookup_cell(df: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Wrap the longitude, floor, clamp: the cell of a coarse lookup grid, never NULL."""
    return df.withColumns(
        {
            "row": clamp(F.floor(grid.y_pos(F.col(lat))).cast("int"), 0, grid.height - 1),
            "col": clamp(F.floor(grid.x_pos(wrap_lon(F.col(lon)))).cast("int"), 0, grid.width - 1),
        }
    )


def lookup_cell_origin(df: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Cell of a lookup grid with its own origin; NULL, NULL outside."""
    row = F.floor(grid.y_pos(F.col(lat))).cast("int")
    col = F.floor(grid.x_pos(F.col(lon))).cast("int")
    inside = row.between(0, grid.height - 1) & col.between(0, grid.width - 1)
    return df.withColumns({"row": F.when(inside, row), "col": F.when(inside, col)})


def cell_center(df: DataFrame, grid: Grid) -> DataFrame:
    return df.withColumns({"lon": grid.x_center(F.col("col")), "lat": grid.y_center(F.col("row"))})


def flip_rows(df: DataFrame, grid: Grid) -> DataFrame:
    """South-up rows to north-up."""
    return df.withColumn("row", F.lit(grid.height - 1) - F.col("row"))


def clip_mercator(df: DataFrame, grid: Grid, limit: float = MERCATOR_LIMIT) -> DataFrame:
    """Keep rows lying wholly inside +/-``limit`` degrees and renumber from the first kept row.

    A row predicate on plain integers, so it reaches the scan of a stored layer.
    """
    first = max(0, math.ceil((grid.top - limit) / grid.res))
    last = min(grid.height, math.floor((grid.top + limit) / grid.res)) - 1
    return df.where(F.col("row").between(first, last)).withColumn("row", F.col("row") - F.lit(first))


# --- Web Mercator --------------------------------------------------------------------------------


def mercator_x(lon: Column) -> Column:
    return (lon + 180.0) / 360.0


def mercator_y(lat: Column) -> Column:
    """Unit y from the top; NULL outside [0, 1)."""
    y = mercator_y_raw(lat)
    return F.when((y >= 0) & (y < 1), y)


def mercator_y_raw(lat: Column) -> Column:
    lat_rad = lat * math.pi / 180.0
    return F.lit(0.5) - F.ln(F.tan(F.lit(math.pi / 4) + lat_rad / 2.0)) / (2.0 * math.pi)


def lat_fraction(merc_y: Column) -> Column:
    """Share of the way from the south to the north pole of a unit Mercator y."""
    lat_rad = 2.0 * F.atan(F.exp(math.pi * (1.0 - 2.0 * merc_y))) - math.pi / 2
    return (F.lit(math.pi / 2) + lat_rad) / math.pi


def tile_pixel(df: DataFrame, zoom: Column | int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds z, x, y, px, py; x wraps, the pixel is clamped; points beyond Mercator are dropped."""
    z = zoom if isinstance(zoom, Column) else F.lit(zoom)
    z = clamp(F.floor(z).cast("int"), 0, MAX_TILE_ZOOM)
    n = F.pow(F.lit(2.0), z)
    placed = (
        df.withColumns({"z": z, "_mx": mercator_x(F.col(lon)) * n, "_my": mercator_y(F.col(lat)) * n})
        .where(F.col("_my").isNotNull())
    )
    tile_x, tile_y = F.floor("_mx"), F.floor("_my")
    return placed.withColumns(
        {
            "x": F.pmod(tile_x, F.expr("shiftleft(1L, z)")).cast("int"),
            "y": tile_y.cast("int"),
            "px": clamp(F.floor((F.col("_mx") - tile_x) * TILE_PX).cast("int"), 0, TILE_PX - 1),
            "py": clamp(F.floor((F.col("_my") - tile_y) * TILE_PX).cast("int"), 0, TILE_PX - 1),
        }
    ).drop("_mx", "_my")


def quad_cell(df: DataFrame, level: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds cx, cy of the quadtree cell at ``level``, clamped into the grid."""
    n = 1 << level
    return df.withColumns(
        {
            "level": F.lit(level),
            "cx": clamp(F.floor(mercator_x(F.col(lon)) * n).cast("int"), 0, n - 1),
            "cy": clamp(F.floor(mercator_y_raw(F.col(lat)) * n).cast("int"), 0, n - 1),
        }
    )


def mask_level(zoom: Column) -> Column:
    return F.least(F.lit(MAX_MASK_LEVEL), F.floor(zoom).cast("int") + 8)


def tile_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """EPSG:3857 bounds of a tile in metres."""
    size = F.lit(2 * EARTH_HALF_EQUATOR_M) / F.pow(F.lit(2.0), z)
    west = F.lit(-EARTH_HALF_EQUATOR_M) + x * size
    north = F.lit(EARTH_HALF_EQUATOR_M) - y * size
    return {"west": west, "south": north - size, "east": west + size, "north": north}


def tiles_in_bbox(df: DataFrame, west="west", south="south", east="east", north="north", zoom="zoom") -> DataFrame:
    """One row per tile covering each bounding box; y is clamped, x may run past the date line.

    The output is bounded by the box area at zoom <= 10 and is produced row by row (no shuffle).
    """
    z = clamp(F.floor(F.col(zoom)).cast("int"), 0, MAX_TILE_ZOOM)
    n = F.pow(F.lit(2.0), z)
    boxed = df.withColumns(
        {
            "z": z,
            "_x0": F.floor(mercator_x(F.col(west)) * n).cast("int"),
            "_x1": F.floor(mercator_x(F.col(east)) * n).cast("int"),
            "_y0": F.greatest(F.lit(0), F.floor(mercator_y_raw(F.col(north)) * n).cast("int")),
            "_y1": F.least(n.cast("int") - 1, F.floor(mercator_y_raw(F.col(south)) * n).cast("int")),
        }
    ).where((F.col("_x0") <= F.col("_x1")) & (F.col("_y0") <= F.col("_y1")))
    rows = boxed.withColumn("y", F.explode(F.sequence("_y0", "_y1")))
    return rows.withColumn("x", F.explode(F.sequence("_x0", "_x1"))).drop("_x0", "_x1", "_y0", "_y1")


def parent_tile(df: DataFrame, dz: Column) -> DataFrame:
    """Adds the ancestor ``dz`` levels up and the quadrant of the child inside it."""
    span = F.pow(F.lit(2.0), dz).cast("int")
    return df.withColumns(
        {
            "parent_z": F.col("z") - dz,
            "parent_x": F.floor(F.col("x") / span).cast("int"),
            "parent_y": F.floor(F.col("y") / span).cast("int"),
            "quad_x": F.pmod(F.col("x"), span),
            "quad_y": F.pmod(F.col("y"), span),
        }
    )
