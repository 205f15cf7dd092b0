"""Rings as nested arrays: parsing, area, centroid, quantising."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS_TYPE = "array<array<struct<x:double,y:double>>>"
KM2_PER_DEG2 = 12365.0
EARTH_RADIUS_KM = 6371.0072


def wkt_ring(wkt: Column) -> Column:
    """Outer ring of a WKT polygon as array<struct<x,y>>."""
    outer = F.regexp_extract(wkt, r"\(\(([^()]*)\)", 1)
    number = lambda parts, i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return F.transform(
        F.transform(F.split(outer, ","), lambda pair: F.split(F.trim(pair), r"\s+")),
        lambda parts: F.struct(number(parts, 1).alias("x"), number(parts, 2).alias("y")),
    )


def _segments(ring: Column) -> Column:
    """(x1, y1, x2, y2) per side of a closed ring."""
    ends = F.slice(ring, 2, F.size(ring) - 1)
    starts = F.slice(ring, 1, F.size(ring) - 1)
    return F.zip_with(starts, ends, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def ring_edges(ring: Column) -> Column:
    return F.when(F.size(ring) >= 2, _segments(ring)).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))


def _fold(ring: Column, term) -> Column:
    return F.aggregate(_segments(ring), F.lit(0.0), lambda acc, s: acc + term(s))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area in the ring's own units squared."""
    return _fold(ring, lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"]) / 2.0


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid as struct<lon, lat>, in one pass over the sides.

    Coordinates are taken relative to the first corner to keep digits.
    """
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def centre(r: Column) -> Column:
        x0, y0 = r[0]["x"], r[0]["y"]

        def add(acc: Column, s: Column) -> Column:
            x1, y1, x2, y2 = s["x1"] - x0, s["y1"] - y0, s["x2"] - x0, s["y2"] - y0
            cross = x1 * y2 - x2 * y1
            return F.struct(
                (acc["a"] + cross).alias("a"), (acc["x"] + (x1 + x2) * cross).alias("x"), (acc["y"] + (y1 + y2) * cross).alias("y")
            )

        def finish(acc: Column) -> Column:
            area6 = F.nullif(acc["a"] * 3.0, F.lit(0.0))
            return F.struct((x0 + acc["x"] / area6).alias("lon"), (y0 + acc["y"] / area6).alias("lat"))

        return F.aggregate(_segments(r), zero, add, finish)

    return F.transform(F.array(ring), centre)[0]


def rings_area_km2(rings: Column) -> Column:
    """Area on a cylindrical equal-area projection: outer ring minus holes."""
    project = lambda p: F.struct(
        (p["x"] * (math.pi / 180.0) * EARTH_RADIUS_KM).alias("x"), (F.sin(p["y"] * (math.pi / 180.0)) * EARTH_RADIUS_KM).alias("y")
    )
    area = lambda ring: F.abs(ring_area(F.transform(ring, project)))
    holes = F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda acc, r: acc + area(r))
    return area(rings[0]) - holes


def quantize_rings(rings: Column, digits: int = 4) -> Column:
    return F.transform(
        rings, lambda ring: F.transform(ring, lambda p: F.struct(F.bround(p["x"], digits).alias("x"), F.bround(p["y"], digits).alias("y")))
    )
