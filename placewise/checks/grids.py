"""Coordinate and grid projections."""

from pyspark.sql import functions as F

from placewise.bind import GRID, with_cell
from placewise.checks import check
from placewise.checks.sqlbind import rowcol
from placewise.functions import grid as g
from placewise.functions.geometry import quantize_rings, ring_centroid, wkt_ring
from placewise.functions.grid import Grid

PI = "pi()"
MX = "((lon + 180) / 360)"
MY = "(0.5 - ln(tan(pi() / 4 + lat * pi() / 180 / 2)) / (2 * pi()))"


def wide_points(t):
    """Points pushed past the edges of the map."""
    return t.points().withColumns({"lon": F.col("lon") * 1.2, "lat": F.col("lat") * 1.2})


WIDE = "(SELECT id, lon * 1.2::DOUBLE AS lon, lat * 1.2::DOUBLE AS lat FROM b_points)"


@check("g01_cell_clamped", f"""SELECT id, CAST(least(greatest(trunc((90 - lat) / 0.1::DOUBLE), 0), 1799) AS INTEGER) AS row,
CAST(least(greatest(trunc((lon + 180) / 0.1::DOUBLE), 0), 3599) AS INTEGER) AS col FROM {WIDE}""")
def g01(t):
    return g.cell_clamped(wide_points(t), Grid.world(0.1)).select("id", "row", "col")


@check("g02_cell_bounded", f"""SELECT * FROM (SELECT id, CAST(trunc((90 - lat) / 10) AS INTEGER) AS row, CAST(trunc((lon + 180) / 10) AS INTEGER) AS col FROM {WIDE})
WHERE row BETWEEN 0 AND 17 AND col BETWEEN 0 AND 35""")
def g02(t):
    return g.cell_bounded(wide_points(t), GRID).select("id", "row", "col")


@check("g03_cell_binned", f"""SELECT * FROM (SELECT id, 17 - CAST(floor((lat + 90) / 10) AS INTEGER) AS row, CAST(floor((lon + 180) / 10) AS INTEGER) AS col FROM {WIDE})
WHERE row BETWEEN 0 AND 17 AND col BETWEEN 0 AND 35""")
def g03(t):
    return g.cell_binned(wide_points(t), GRID).select("id", "row", "col")


@check("g04_lookup_cell", f"""SELECT id, CAST(least(greatest(floor((90 - lat) / 0.5::DOUBLE), 0), 359) AS INTEGER) AS row,
CAST(least(greatest(floor((CASE WHEN lon > 180 THEN lon - 360 WHEN lon < -180 THEN lon + 360 ELSE lon END + 180) / 0.5::DOUBLE), 0), 719) AS INTEGER) AS col FROM {WIDE}""")
def g04(t):
    return g.lookup_cell(wide_points(t), Grid.world(0.5)).select("id", "row", "col")


@check("g05_lookup_cell_origin", """SELECT id, CASE WHEN ok THEN r END AS row, CASE WHEN ok THEN c END AS col FROM
(SELECT *, r BETWEEN 0 AND 39 AND c BETWEEN 0 AND 79 AS ok FROM (SELECT id, CAST(floor((50 - lat) / 2.5::DOUBLE) AS INTEGER) AS r, CAST(floor((lon + 100) / 2.5::DOUBLE) AS INTEGER) AS c FROM b_points))""")
def g05(t):
    return g.lookup_cell_origin(t.points(), Grid(2.5, 80, 40, left=-100.0, top=50.0)).select("id", "row", "col")


@check("g06_mercator", f"""SELECT id, round({MX}, 9) AS mx, CASE WHEN {MY} >= 0 AND {MY} < 1 THEN round({MY}, 9) END AS my FROM
(SELECT id, lon, lat * 1.04::DOUBLE AS lat FROM b_points)""")
def g06(t):
    p = t.points().withColumn("lat", F.col("lat") * 1.04)
    return p.select("id", F.round(g.mercator_x(F.col("lon")), 9).alias("mx"), F.round(g.mercator_y(F.col("lat")), 9).alias("my"))


TILE_SQL = f"""SELECT id, 5 AS z, CAST(floor(mx) AS INTEGER) % 32 AS x, CAST(floor(my) AS INTEGER) AS y,
CAST(least(255, floor((mx - floor(mx)) * 256)) AS INTEGER) AS px, CAST(least(255, floor((my - floor(my)) * 256)) AS INTEGER) AS py
FROM (SELECT id, {MX} * 32 AS mx, {MY} * 32 AS my FROM b_points)"""


@check("g07_tile_pixel", TILE_SQL)
def g07(t):
    return g.tile_pixel(t.points(), 5).drop("lon", "lat")


@check("g08_quad_cell", f"""SELECT id, 12 AS level, CAST(least(greatest(floor({MX} * 4096), 0), 4095) AS INTEGER) AS cx,
CAST(least(greatest(floor({MY} * 4096), 0), 4095) AS INTEGER) AS cy FROM b_points""")
def g08(t):
    return g.quad_cell(t.points(), 12).drop("lon", "lat")


@check("g09_latitude_fraction", f"SELECT id, round((lat + 90) / 180, 8) AS fraction FROM b_points")
def g09(t):
    return t.points().select("id", F.round(g.lat_fraction(g.mercator_y(F.col("lat"))), 8).alias("fraction"))


@check("g10_tile_bounds", f"""SELECT id, round(-20037508.342789244 + x * s, 3) AS west, round(20037508.342789244 - (y + 1) * s, 3) AS south,
round(-20037508.342789244 + (x + 1) * s, 3) AS east, round(20037508.342789244 - y * s, 3) AS north FROM (SELECT id, x, y, 40075016.685578488::DOUBLE / 32 AS s FROM ({TILE_SQL}))""")
def g10(t):
    tiles = g.tile_pixel(t.points(), 5)
    bounds = g.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    return tiles.select("id", *[F.round(c, 3).alias(k) for k, c in bounds.items()])


@check("g11_tiles_in_bbox", f"""SELECT id, z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT id, z, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM
(SELECT id, z, CAST(floor((lon + 180) / 360 * n) AS BIGINT) AS x0, CAST(floor((lon + 20 + 180) / 360 * n) AS BIGINT) AS x1,
greatest(0, CAST(floor((0.5 - ln(tan(pi() / 4 + (lat) * pi() / 180 / 2)) / (2 * pi())) * n) AS BIGINT)) AS y0,
least(n - 1, CAST(floor((0.5 - ln(tan(pi() / 4 + (lat - 4) * pi() / 180 / 2)) / (2 * pi())) * n) AS BIGINT)) AS y1
FROM (SELECT *, CAST(id % 5 AS INTEGER) AS z, CAST(1 << CAST(id % 5 AS INTEGER) AS BIGINT) AS n FROM b_points))), range(0, 16) r(y) WHERE y BETWEEN y0 AND y1""")
def g11(t):
    boxes = t.points().select(
        "id", F.col("lon").alias("west"), (F.col("lon") + 20.0).alias("east"), F.col("lat").alias("north"),
        (F.col("lat") - 4.0).alias("south"), (F.col("id") % 5 + 0.4).alias("zoom"),
    )
    return g.tiles_in_bbox(boxes).select("id", "z", "x", "y")


@check("g12_parent_tile", f"""SELECT id, CAST(3 AS INTEGER) AS parent_z, CAST(x >> 2 AS INTEGER) AS parent_x, CAST(y >> 2 AS INTEGER) AS parent_y,
CAST(x & 3 AS INTEGER) AS quad_x, CAST(y & 3 AS INTEGER) AS quad_y FROM ({TILE_SQL})""")
def g12(t):
    up = g.parent_tile(g.tile_pixel(t.points(), 5), F.lit(2))
    return up.select("id", "parent_z", "parent_x", "parent_y", "quad_x", "quad_y")


@check("g13_clip_mercator", f"SELECT CAST(row - 1 AS INTEGER) AS row, col, value FROM b_elev WHERE row BETWEEN 1 AND 16")
def g13(t):
    return g.clip_mercator(t.layer_elev(), GRID)


@check("g14_flip_rows", "SELECT CAST(17 - row AS INTEGER) AS row, col, value FROM b_elev")
def g14(t):
    return g.flip_rows(t.layer_elev(), GRID)


@check("g15_wkt_centroid", "SELECT id, round(west + 0.05, 6) AS lon, round(south + 0.05, 6) AS lat FROM b_speed")
def g15(t):
    centres = t.speedtests().select("id", ring_centroid(wkt_ring(F.col("tile"))).alias("c"))
    return centres.select("id", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


@check("g16_cell_center", "SELECT row, col, -180 + (col + 0.5::DOUBLE) * 10 AS lon, 90 - (row + 0.5::DOUBLE) * 10 AS lat, value FROM b_elev")
def g16(t):
    return g.cell_center(t.layer_elev(), GRID)


@check("g17_quantize_rings", """SELECT ord, round(a + 0.00004, 4) AS x, round(b + 0.00004, 4) AS y, round(a + 33.5 + 0.00004, 4) AS x2 FROM b_tri""")
def g17(t):
    """Corners nudged by 0.00004 degrees come back to four decimals."""
    nudged = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct((p["x"] + 0.00004).alias("x"), (p["y"] + 0.00004).alias("y"))))
    ring = quantize_rings(nudged)[0]
    return t.triangles().select("ord", ring[0]["x"].alias("x"), ring[0]["y"].alias("y"), ring[1]["x"].alias("x2"))
