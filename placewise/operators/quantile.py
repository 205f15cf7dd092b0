"""Exact quantiles without gathering the values.

Equal values are counted first, and the counts are written once for the passes that follow. Two rounds of
histograms, the first by decades, the second linear, narrow each wanted rank down to a sliver of the value
range, and only the distinct values of that sliver are ordered. Every step is a partially
aggregated ``groupBy`` over at most ``BUCKETS`` groups per layer, so neither many rows nor many equal
values load one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.session import materialised

BUCKETS = 4096
def _decades(value: Column) -> Column:
    """A scale in the order of the values on which decades are equally wide, on both sides of zero."""
    return F.when(F.abs(value) < 1e-300, F.lit(0.0)).otherwise(F.signum(value) * (F.log(F.abs(value)) + 700.0))


def _bucket(value: str, lo: str, hi: str, scale=lambda c: c) -> Column:
    value, lo, hi = scale(F.col(value)), scale(F.col(lo)), scale(F.col(hi))
    share = (value - lo) / F.nullif(hi - lo, F.lit(0.0))
    return F.least(F.coalesce(F.floor(share * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")


def _attach(df: DataFrame, small: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Add the columns of a one-row-per-key table; without keys it is a scalar subquery."""
    if keys:
        return df.join(small, keys)
    row = small.select(F.struct(*columns)).scalar()
    return df.withColumn("_row", row).select(*df.columns, *[F.col("_row")[c].alias(c) for c in columns])


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """One row per key with a linearly interpolated quantile per entry of ``probs``."""
    keys = list(keys or [])
    clean = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counts = materialised(clean.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    span = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))

    ranks = span.select(*keys, F.explode(_wanted(probs)).alias("_w")).select(*keys, "_w.*")
    wanted = ranks.groupBy(*keys).agg(F.sort_array(F.collect_set("rank")).alias("_ranks"))
    values = _narrowed(counts, span, wanted, keys)

    found = ranks.join(values.withColumnRenamed("_rank", "rank"), [*keys, "rank"]).select(*keys, "prob", "frac", "_v")
    per_prob = found.groupBy(*keys, "prob", "frac").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    at = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("frac")
    return per_prob.groupBy(*keys).agg(*[F.max(F.when(F.col("prob") == name, at)).alias(name) for name in probs])


def _narrowed(counts: DataFrame, span: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _rank, _v) of the wanted ranks, by histogram, finer histogram, then distinct values."""
    # two buckets per quantile and layer; with keys the number of layers is the caller's, so Spark measures it
    small = (lambda df: df) if keys else F.broadcast
    first = _attach(counts, span, keys, ["_lo", "_hi"]).withColumn("_b1", _bucket("_v", "_lo", "_hi", _decades))
    hist1 = _locate(first.groupBy(*keys, "_b1").agg(*_summary()), wanted, keys, "_b1", keys)
    second = (
        first.select(*keys, "_v", "_c", "_b1")
        .join(small(_slivers(hist1, [*keys, "_b1"])), [*keys, "_b1"])
        .withColumn("_b2", _bucket("_v", "_lo", "_hi"))
    )
    hist2 = _relocate(second.groupBy(*keys, "_b1", "_b2").agg(*_summary()), hist1, [*keys, "_b1"], "_b2")
    third = second.select(*keys, "_b1", "_b2", "_v", "_c").join(
        small(hist2.select(*keys, "_b1", "_b2").distinct()), [*keys, "_b1", "_b2"]
    )
    return _relocate(third, hist2, [*keys, "_b1", "_b2"], "_v").select(*keys, "_rank", "_v")


def _wanted(probs: dict[str, float]) -> Column:
    """(prob, rank, frac) for the two ranks around each quantile position."""
    last = (F.col("_n") - 1).cast("double")
    items = []
    for name, p in probs.items():
        position = F.lit(float(p)) * last
        low = F.floor(position)
        for rank in (low, F.least(low + 1, F.col("_n") - 1)):
            items.append(F.struct(F.lit(name).alias("prob"), rank.alias("rank"), (position - low).alias("frac")))
    return F.array(*items)


def _summary() -> list[Column]:
    return [F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]


def _locate(hist: DataFrame, wanted: DataFrame, keys: list[str], cell: str, group: list[str]) -> DataFrame:
    """Bucket rows holding a wanted rank: adds _rank (overall) and _inside (rank within the bucket)."""
    order = Window.partitionBy(*group).orderBy(cell)
    before = hist.withColumn("_before", F.sum("_c").over(order) - F.col("_c"))
    placed = _attach(before, wanted, keys, ["_ranks"])
    held = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))
    return placed.withColumn("_rank", F.explode(held)).withColumn("_inside", F.col("_rank") - F.col("_before")).drop("_ranks", "_before")


def _relocate(hist: DataFrame, parents: DataFrame, group: list[str], cell: str) -> DataFrame:
    """As ``_locate`` one level down: ranks come from the parent bucket they fall into."""
    order = Window.partitionBy(*group).orderBy(cell)
    before = hist.withColumn("_before", F.sum("_c").over(order) - F.col("_c"))
    wanted = parents.groupBy(*group).agg(F.collect_set(F.struct("_rank", "_inside")).alias("_ranks"))
    placed = before.join(wanted, group)
    held = F.filter("_ranks", lambda r: (r["_inside"] >= F.col("_before")) & (r["_inside"] < F.col("_before") + F.col("_c")))
    hit = placed.withColumn("_hit", F.explode(held))
    return hit.withColumns({"_rank": F.col("_hit._rank"), "_inside": F.col("_hit._inside") - F.col("_before")}).drop("_ranks", "_before", "_hit")


def _slivers(hist: DataFrame, group: list[str]) -> DataFrame:
    """Distinct buckets that hold a wanted rank (at most two per quantile and layer)."""
    return hist.select(*group, "_lo", "_hi").distinct()
