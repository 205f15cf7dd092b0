"""Uniform shuffle of a table into shards of exact sizes, by a hypergeometric communication matrix.

Where a row goes is settled before any row moves: how many rows of partition p belong to shard s is drawn from the
multivariate hypergeometric law, so that the counts are those of a uniform permutation and every shard gets its exact
number. Then partitions are permuted locally, rows are exchanged, and shards are permuted locally.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewise.session import written

#: Rows of the blocks in which a shard is permuted; a shard may be larger than a task.
BLOCK_ROWS = 20_000
#: Numbers of the matrix up to which it is sent to all tasks; a larger one is joined as Spark sees fit.
SENT = 1 << 22


def hypergeometric_law(good: int, bad: int, drawn: int) -> tuple[int, np.ndarray]:
    """The law of the number of good items among ``drawn`` of ``good + bad``: its first value, and probabilities from there.

    Neighbouring probabilities have a short quotient, so all follow from the mode, where 1 is put; nothing large is
    subtracted, and the sum sets the scale. Both tails go on to where a quotient of 1e-20 to the mode is passed.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    total = good + bad
    spread = math.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / max(1, total - 1))) if total else 0.0

    def tail(last: int, quotient) -> np.ndarray:
        steps, width = abs(last - mode), int(10 * spread) + 60
        while True:
            weights = np.cumprod(quotient(np.arange(min(steps, width), dtype=np.float64)))
            if width >= steps or weights[-1] < 1e-20:
                return weights
            width *= 2

    up = tail(high, lambda k: (good - mode - k) * (drawn - mode - k) / ((mode + k + 1) * (bad - drawn + mode + k + 1)))
    down = tail(low, lambda k: (mode - k) * (bad - drawn + mode - k) / ((good - mode + k + 1) * (drawn - mode + k + 1)))
    weights = np.concatenate([down[::-1], [1.0], up])
    return mode - len(down), weights / weights.sum()


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items taken from ``good + bad`` are good, by inversion of the law."""
    first, law = hypergeometric_law(good, bad, drawn)
    return first + min(int(np.searchsorted(np.cumsum(law), rng.random(), side="right")), len(law) - 1)


def communication_matrix(rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of each partition that go to each shard: row sums are ``rows``, column sums are ``sizes``."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in rows:
        rest, line = sum(left), []
        for k, size in enumerate(left):
            rest -= size
            got = hypergeometric(rng, size, rest, n)
            line.append(got)
            n -= got
        left = [a - b for a, b in zip(left, line)]
        out.append(line)
    return out


def shard(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard), in uniformly random order.

    Sizes of shards differ by one at most. All rows count, equal ones and nulls too; an empty table gives an empty one.
    Existing columns named ``shard`` or ``slot`` are replaced; all others may have any name.

    The rows are written once with their partition and their random place in it, so what follows doesn't depend on how
    they are read. The matrix has partitions x shards numbers, drawn from the partitions' counts; its size is known
    before it is joined and doesn't grow with the rows of a partition. Large shards are permuted in blocks of a random
    key's range.
    """
    spark, columns = df.sparkSession, [c for c in df.columns if c not in ("shard", "slot")]
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.rand(seed).alias("_local"), F.rand(seed + 1).alias("_again"))
    placed = keyed.sortWithinPartitions("_local").withColumn("_at", F.monotonically_increasing_id())
    local = written(placed.select("row", "_again", F.shiftright("_at", 33).cast("int").alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_rank")), "permuted")
    counts = local.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    total = sum(r["n"] for r in counts)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([r["n"] for r in counts], sizes, seed)
    bounds = []
    for r, line in zip(counts, matrix):
        ends, upto = [], 0
        for n in line:
            ends.append(upto := upto + n)
        bounds.append((r["_part"], ends))
    table = spark.createDataFrame(bounds, "_part int, _ends array<long>")
    sent = local.join(F.broadcast(table) if len(counts) * shards <= SENT else table, "_part").withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))))
    blocks = [max(1, -(-n // BLOCK_ROWS)) for n in sizes]
    sent = sent.withColumn("_block", F.floor(F.col("_again") * F.get(F.array(*map(F.lit, blocks)), F.col("shard"))).cast("int"))
    before = sent.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = before.select("shard", "_block", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")).alias("_base"))
    within = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_again", "_part", "_rank")) - 1
    return sent.withColumn("_in", within).join(before, ["shard", "_block"]).select("row.*", "shard", (F.col("_base") + F.col("_in")).cast("long").alias("slot"))
