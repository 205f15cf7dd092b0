"""Connected components of a graph given as an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.session import written


def _stars(pairs: DataFrame) -> DataFrame:
    """``u, v, m``: each pair beside the smallest neighbour of ``u``, or ``u`` itself.

    The minimum is a combinable aggregation. It is joined back on a hash beside the node, so that it is dealt anew and
    a node with very many neighbours can be split among tasks.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.xxhash64("u").alias("h"), F.col("u").alias("w"), F.least("u", "m").alias("m"))
    side = pairs.withColumn("h", F.xxhash64("u")).alias("p")
    return side.join(least.alias("s"), (F.col("p.h") == F.col("s.h")) & (F.col("p.u") == F.col("s.w"))).select("u", "v", "m")


def _weight(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the smallest node that can be reached, for every node with an edge to another.

    Large-star and small-star steps (each node hangs its neighbours onto the smallest one) until nothing changes, about
    as many rounds as the logarithm of the longest path. The edges of a round are a table in the shared folder; the
    driver sees their number and a checksum. Nulls and loops are ignored; an empty table gives an empty one.
    """
    apart = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = written(apart.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _weight(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _stars(written(large, "edges"))
        edges = written(
            small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct(), "edges"
        )
        now = _weight(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

def roots(linked: np.ndarray) -> np.ndarray:
    """For each vector the first of those it is connected with inside a tile."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new
