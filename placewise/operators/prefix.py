"""Order-dependent operators that never put a whole long key into one task.

Keys of up to ``BLOCK`` rows are finished in one window. Longer ones are cut into blocks of about equal row counts at
values that a mergeable quantile sketch of their order column proposes, so it does not matter how densely the order values
lie. Blocks are summarised with an ordinary aggregation, the summaries (at most ``2 * PIECES`` for a key) are chained with
a window, and the rows of a block are then finished inside that block only. A key holding a third of all rows is thus
spread over its blocks.

Rows without an order value come first in their key; rows with a missing key form a key of their own. The input is read
once to count keys, and once more for its sketches where there are long keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.session import written

#: Rows of a key that one task finishes.
BLOCK = 65_536
#: Marks of a long key's sketch, a power of two, and the sketch's accuracy: ranks are off by 1 / ACCURACY of the key's rows at most.
PIECES, ACCURACY = 1024, 10_000


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))


def _splits(df: DataFrame, keys: list[str], order: str, block: int) -> DataFrame:
    """One row per key of more than ``block`` rows: the ascending order values at which its blocks start."""
    long_keys = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    rows = df.select(*keys, order)
    if keys:
        long_keys = written(long_keys, "long_keys")
        if long_keys.isEmpty():
            return long_keys.withColumn("_at", F.array().cast("array<bigint>")).drop("_n")
        rows = rows.join(long_keys, _same(rows, long_keys, keys), "left_semi")
    marks = F.percentile_approx(order, [i / PIECES for i in range(1, PIECES)], ACCURACY).alias("_q")
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), marks).where(F.col("_n") > block)
    stride = F.greatest(F.floor(PIECES / F.ceil(F.col("_n") / block)), F.lit(1))
    kept = F.array_distinct(F.filter(F.col("_q").cast("array<bigint>"), lambda _, i: (i + 1) % stride == 0))
    return written(sketch.select(*keys, kept.alias("_at")), "splits")


def _block_of(order: Column, at: Column) -> Column:
    """How many of the ascending values ``at`` are not above ``order``, by bisection."""
    steps = F.array(*[F.lit(PIECES >> i) for i in range(PIECES.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda p, step: F.when(F.get(at, p + step - 1) <= order, p + step).otherwise(p))


def _blocked(df: DataFrame, keys: list[str], order: str, block: int) -> DataFrame | None:
    """``df`` with the block of each row; None where no key is long."""
    splits = _splits(df, keys, order, block)
    some = splits.first()
    if some is None:
        return None
    if not keys:
        return df.withColumn("_block", _block_of(F.col(order).cast("bigint"), F.lit(some["_at"]).cast("array<bigint>")))
    at = splits.select(*[F.col(k).alias(f"_s_{k}") for k in keys], "_at")
    joined = df.join(at, reduce(Column.__and__, [df[k].eqNullSafe(at[f"_s_{k}"]) for k in keys]), "left")
    return joined.withColumn("_block", F.coalesce(_block_of(F.col(order).cast("bigint"), F.col("_at")), F.lit(0))).drop(*at.columns)


def _with_carry(df: DataFrame, keys: list[str], summary: Column, carry: Column) -> DataFrame:
    """Join each row to the ``carry`` of its block, computed over the block summaries."""
    per_block = df.groupBy(*keys, "_block").agg(summary.alias("_summary")).withColumn("_carry", carry)
    renamed = per_block.select(*[F.col(k).alias(f"_c_{k}") for k in [*keys, "_block"]], "_carry")
    return df.join(renamed, reduce(Column.__and__, [df[k].eqNullSafe(renamed[f"_c_{k}"]) for k in [*keys, "_block"]])).drop(*[f"_c_{k}" for k in [*keys, "_block"]])


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Inclusive running sum of ``value`` along the integer ``order`` within ``keys``."""
    rows = _blocked(df, keys, order, block)
    so_far = lambda *by: F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    if rows is None:
        return df.withColumn(out, so_far(*keys))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    rows = _with_carry(rows, keys, F.sum(value), F.coalesce(F.sum("_summary").over(before), F.lit(0)))
    return rows.withColumn(out, F.col("_carry") + so_far(*keys, "_block")).drop("_block", "_carry")


def running_count(df: DataFrame, keys: list[str], order: str, out: str, block: int = BLOCK) -> DataFrame:
    """Row number along the integer ``order`` within ``keys``, starting at 1."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, "_one", out, block).drop("_one")


def previous_value(df: DataFrame, keys: list[str], order: str, out: str, block: int = BLOCK) -> DataFrame:
    """The next smaller ``order`` value within ``keys``; NULL for the first row."""
    rows = _blocked(df, keys, order, block)
    if rows is None:
        return df.withColumn(out, F.lag(order).over(Window.partitionBy(*keys).orderBy(order)))
    before = Window.partitionBy(*keys).orderBy("_block")
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    rows = _with_carry(rows, keys, F.max(order), F.lag("_summary").over(before))
    return rows.withColumn(out, F.coalesce(F.lag(order).over(inside), F.col("_carry"))).drop("_block", "_carry")
