"""Fixed-size arrays that tasks fill and the driver puts together: bit filters and frequency sketches.

Their size is a constant of the caller, whatever the table holds. A task sends the blocks it has touched; parts of one
block are combined in two steps, as there are few blocks and up to one part from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.session import shuffles_removed

#: Bytes of a block.
BLOCK = 1 << 17
FIELDS = "block int, part binary"
BITS = 1 << 26


def parts(array: np.ndarray) -> pa.RecordBatch:
    """The blocks of a task's array that hold anything."""
    raw = array.view(np.uint8)
    used = [k for k in range(0, len(raw), BLOCK) if raw[k : k + BLOCK].any()]
    return pa.RecordBatch.from_pydict({"block": pa.array([k // BLOCK for k in used], pa.int32()), "part": pa.array([raw[k : k + BLOCK].tobytes() for k in used], pa.binary())})


def gathered(made: DataFrame, size: int, dtype: type, combine: np.ufunc):
    """Broadcast array of ``size`` elements from the parts of all tasks."""

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(group["part"].iloc[0], dtype).copy()
        for p in group["part"].iloc[1:]:
            combine(total, np.frombuffer(p, dtype), out=total)
        return pd.DataFrame({"block": np.array([key[0]], np.int32), "part": [total.tobytes()]})

    for keys in (["block", "half"], ["block"]):
        made = made.withColumn("half", F.pmod(F.xxhash64("part"), F.lit(64))).groupBy(*keys).applyInPandas(join, FIELDS)
    array = np.zeros(size, dtype)
    raw = array.view(np.uint8)
    with shuffles_removed(made.sparkSession):
        rows = made.collect()
    for r in rows:
        part = np.frombuffer(r["part"], np.uint8)
        raw[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return made.sparkSession.sparkContext.broadcast(array)


def bit_filter(df: DataFrame, column: str, bits: int = BITS):
    """Bits set where the values of a long column fall; :func:`may_hold` never misses one of them."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits // 8, np.uint8)
        for rows in batches:
            at = rows.column(0).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(bits)
            np.bitwise_or.at(field, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield parts(field)

    return gathered(df.select(column).mapInArrow(mark, FIELDS), bits // 8, np.uint8, np.bitwise_or)


def may_hold(field: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.view(np.uint64) % np.uint64(8 * len(field))
    return (field[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
