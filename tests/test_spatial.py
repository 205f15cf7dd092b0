"""Zones, resampling and neighbourhoods against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.functions.geometry import ring_centroid, rings_area_km2, wkt_ring
from placewise.functions.grid import Grid
from placewise.operators import aggregate, focal, resample, zones

GRID = Grid.world(10.0)
RINGS = "array<array<struct<x:double,y:double>>>"


def polygons(spark, shapes):
    return spark.createDataFrame([(i, rings) for i, rings in enumerate(shapes)], f"ord int, rings {RINGS}")


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x:
                odd = not odd
    return odd


def brute(shapes, grid=GRID):
    out = {}
    for r in range(grid.height):
        for c in range(grid.width):
            x, y = grid.left + (c + 0.5) * grid.res, grid.top - (r + 0.5) * grid.res
            for i, rings in enumerate(shapes):
                if inside(rings, x, y):
                    out[r, c] = i
    return out


def box(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n), (w, s)]


def test_random_polygons_with_holes(spark):
    rng = random.Random(7)
    shapes = []
    for _ in range(12):
        cx, cy = rng.uniform(-150, 150), rng.uniform(-60, 60)
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(7))
        ring = [(cx + rng.uniform(10, 60) * math.cos(a), cy + rng.uniform(10, 40) * math.sin(a)) for a in angles]
        shapes.append([ring + ring[:1], box(cx - 6.3, cy - 6.1, cx + 6.2, cy + 6.4)])
    got = {(r.row, r.col): r.zone for r in zones.assign_zones(polygons(spark, shapes), GRID).collect()}
    assert got == brute(shapes)


def test_last_polygon_wins(spark):
    shapes = [[box(-50.0, -50.0, 10.0, 10.0)], [box(-20.0, -20.0, 40.0, 40.0)]]
    got = {(r.row, r.col): r.zone for r in zones.assign_zones(polygons(spark, shapes), GRID).collect()}
    assert got == brute(shapes) and got[9, 17] == 1


def test_rectangles_partition_the_grid(spark):
    shapes = [[box(-180.0 + 72 * (i % 5), 90.0 - 36 * (i // 5) - 36, -180.0 + 72 * (i % 5) + 72, 90.0 - 36 * (i // 5))] for i in range(25)]
    cells = zones.cells_by_centre(polygons(spark, shapes), GRID).collect()
    assert len(cells) == GRID.width * GRID.height == len({(r.row, r.col) for r in cells})


def test_all_touched_adds_what_edges_cross(spark):
    thin = [[(-33.0, 12.0), (28.0, 14.0), (28.0, 14.5), (-33.0, 12.0)]]
    got = {(r.row, r.col) for r in zones.assign_zones(polygons(spark, [thin]), GRID, all_touched=True).collect()}
    assert got == {(7, c) for c in range(14, 21)}
    assert zones.assign_zones(polygons(spark, [thin]), GRID).count() == 0


def test_polygon_past_the_map_is_cut(spark):
    shapes = [[box(-400.0, -200.0, 400.0, 200.0)]]
    assert zones.assign_zones(polygons(spark, shapes), GRID).count() == 648


def test_spans_grow_with_height(spark):
    wide = Grid(0.05, 7200, 3600)
    shapes = [[box(-170.02, -20.02, 150.03, 30.03)], [box(-30.0, 0.0, -10.0, 10.0)]]
    spans = zones.zone_spans(polygons(spark, shapes), wide)
    n, covered = spans.agg(F.count(F.lit(1)), F.sum(F.col("last") - F.col("first") + 1)).first()
    rows, columns = (50.05 / 0.05), (320.05 / 0.05)
    assert n <= (rows + 1) * (columns / zones.SPAN + 4) and abs(covered - rows * columns) < rows + columns


def test_overlapping_ranges_are_settled_once(spark):
    rng = random.Random(3)
    shapes = [[box(x, y, x + rng.uniform(10, 90), y + rng.uniform(10, 60))] for x, y in ((rng.uniform(-180, 120), rng.uniform(-85, 40)) for _ in range(40))]
    cells = zones.assign_zones(polygons(spark, shapes), GRID).collect()
    got = {(r.row, r.col): r.zone for r in cells}
    assert len(got) == len(cells) and got == brute(shapes)


def test_means_from_row_sums(spark):
    """Holes, repeated cells, missing, NaN and infinite values, two layers; equal to the mean over joined cells."""
    rng, odd = random.Random(5), [None, float("nan"), float("inf"), float("-inf")]
    data = [(k, r, c, rng.choice(odd) if rng.random() < 0.01 else rng.uniform(-9, 9)) for k in "ab" for r in range(18) for c in range(36) if rng.random() < 0.8]
    data += rng.sample(data, 60)
    layer = spark.createDataFrame(data, "axis string, row int, col int, value double")
    shapes = polygons(spark, [[box(-180.0 + 60 * i, -90.0 + 30 * j, -135.0 + 60 * i, -60.0 + 30 * j)] for i in range(6) for j in range(6)])
    want = {(r.axis, r.zone): r for r in aggregate.zonal_mean(layer, zones.assign_zones(shapes, GRID), ["axis"]).collect()}
    got = {(r.axis, r.zone): r for r in zones.span_means(zones.row_sums(layer, ["axis"]), zones.zone_spans(shapes, GRID), ["axis"]).collect()}
    assert got.keys() == want.keys() and any(r.mean != r.mean for r in want.values())
    for k, r in want.items():
        assert got[k].n == r.n and (got[k].mean == pytest.approx(r.mean, rel=1e-9, nan_ok=True))
    none = layer.limit(0)
    assert zones.span_means(zones.row_sums(none), zones.zone_spans(shapes, GRID)).count() == 0


def test_wkt_centroid_and_area(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))",)], "w string")
    row = df.select(ring_centroid(wkt_ring(F.col("w"))).alias("c")).first().c
    assert (row.lon, row.lat) == (2.0, 1.0)
    shape = polygons(spark, [[box(0.0, 0.0, 1.0, 1.0), box(0.25, 0.25, 0.75, 0.75)]])
    area = shape.select(rings_area_km2(F.col("rings"))).first()[0]
    assert area == pytest.approx(12364 * 0.75, rel=0.01)


def cells(spark, array):
    rows = [(int(r), int(c), float(array[r, c])) for r in range(array.shape[0]) for c in range(array.shape[1]) if not np.isnan(array[r, c]) and array[r, c] != 0]
    return spark.createDataFrame(rows, "row int, col int, value double")


def dense(df, shape, fill=0.0):
    out = np.full(shape, fill)
    for r in df.collect():
        out[r.row, r.col] = r.value
    return out


def reflect_index(i, n):
    i %= 2 * n
    return 2 * n - 1 - i if i >= n else i


def direct_gaussian(a, sigma):
    w = focal.gaussian_kernel(sigma)
    r = len(w) // 2
    for axis in (0, 1):
        n = a.shape[axis]
        index = np.array([[reflect_index(i + k, n) for k in range(-r, r + 1)] for i in range(n)])
        a = np.tensordot(np.take(a, index, axis=axis), w, axes=([axis + 1], [0]))
    return a


@pytest.mark.parametrize("sigma,block", [(1.0, 8), (1.5, 16), (4.0, 20), (5.0, 256)])
def test_gaussian_across_blocks(spark, sigma, block):
    rng = np.random.default_rng(3)
    a = np.where(rng.random((18, 36)) < 0.2, rng.random((18, 36)) * 10, 0.0)
    got = dense(focal.gaussian(cells(spark, a), GRID, sigma, block=block), a.shape)
    assert got == pytest.approx(direct_gaussian(a, sigma), abs=1e-12)


def test_max_filter_corner(spark):
    a = np.zeros((18, 36))
    a[0, 0] = 1.0
    got = dense(focal.max_filter(cells(spark, a), GRID, 13, block=8), a.shape)
    assert got.sum() == 49 and got[:7, :7].all()


def test_slope_of_a_plane(spark):
    grid = Grid(0.05, 12, 9)
    a = np.tile(np.arange(1, 13) * 5550.0, (9, 1))
    got = dense(focal.slope_deg(cells(spark, a), grid, block=4), a.shape)
    assert got == pytest.approx(np.full(a.shape, 45.0))


def test_gradient_matches_numpy(spark):
    rng = np.random.default_rng(5)
    a = rng.random((18, 36)) + 1
    dy, dx = np.gradient(a)
    got = dense(focal.rise_per_cell(cells(spark, a), GRID, block=8), a.shape)
    assert got == pytest.approx(np.hypot(dx, dy))


def test_block_mean_discards_partial_blocks(spark):
    grid = Grid(1.0, 5, 5)
    a = np.arange(1, 26, dtype=float).reshape(5, 5)
    got = dense(resample.block_agg(cells(spark, a), grid, 2, "avg"), (2, 2))
    assert got == pytest.approx(a[:4, :4].reshape(2, 2, 2, 2).mean(axis=(1, 3)))


@pytest.mark.parametrize("res", [15.0, 20.0, 4.0, 7.5])
def test_sum_resample_conserves(spark, res):
    rng = np.random.default_rng(1)
    a = rng.random((18, 36)) + 0.1
    target = Grid.world(res)
    out = dense(resample.resample_sum(cells(spark, a), GRID, target), (target.height, target.width))
    assert out.sum() == pytest.approx(a.sum())


def test_bilinear_of_a_plane_is_the_plane(spark):
    a = np.add.outer(np.arange(18) * 2.0, np.arange(36) * 3.0) + 1
    target = Grid.world(2.5)
    got = dense(resample.resample_bilinear(cells(spark, a), GRID, target), (72, 144), np.nan)
    rows = np.clip((np.arange(72) + 0.5) / 4 - 0.5, 0, 17)
    cols = np.clip((np.arange(144) + 0.5) / 4 - 0.5, 0, 35)
    assert got == pytest.approx(np.add.outer(rows * 2.0, cols * 3.0) + 1)


def test_nearest_covers_the_target_once(spark):
    a = np.arange(1, 649, dtype=float).reshape(18, 36)
    target = Grid.world(3.0)
    rows = resample.resample_nearest(cells(spark, a), GRID, target).collect()
    assert len(rows) == len({(r.row, r.col) for r in rows}) == 60 * 120
    assert all(r.value == a[int((r.row + 0.5) * 0.3), int((r.col + 0.5) * 0.3)] for r in rows)
