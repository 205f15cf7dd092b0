"""Hard negatives: exact integer scores by residues, then windows around the scores of positives.

Inner products of integer vectors are taken modulo several small primes as float32 matrix products (a product of
residues and its sum over a stretch of components stay below 2^24, so each is exact), and put together by Chinese
remaindering into exact signed integers. As many primes are used as the longest vector asks for.

Anchors and rows meet in blocks: a task holds a block of anchors and streams the rows of a block past them, keeping the
best few of each anchor. Neither all rows nor all scores are ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placewise.llm.segments import changes
from placewise.session import written

PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199)
#: Components that one float32 sum may take: each product is at most 125 * 125.
STRETCH = (1 << 24) // 125**2
#: Anchors that a task holds, rows of a block where there are few, and rows compared at once.
ANCHORS, ROWS, SLICE = 4096, 8192, 512
#: Vectors with a squared length from here on take no part: no long holds their scores.
LONGEST = 2.0**62
_LEAST = np.iinfo(np.int64).min


def primes_for(bound: int) -> tuple[int, ...]:
    """The first primes whose product tells all integers from ``-bound`` to ``bound`` apart."""
    product, used = 1, 0
    while product <= 2 * bound:
        product, used = product * PRIMES[used], used + 1
    return PRIMES[: max(used, 1)]


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo ``p`` between ``-(p - 1) / 2`` and ``(p - 1) / 2``."""
    half = p // 2
    return (x + half) % p - half


def residues(vectors: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    wide = vectors.astype(np.int64)
    return [centred(wide, p).astype(np.float32) for p in primes]


def products(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``, from their residues.

    Garner's mixed digits are taken around zero, so their sum is the signed score itself.
    """
    digits: list[np.ndarray] = []
    for k, (x, y, p) in enumerate(zip(a, b, primes)):
        rest = np.zeros((len(x), len(y)), np.int32)
        for c in range(0, x.shape[1], STRETCH):
            rest = centred(rest + (x[:, c : c + STRETCH] @ y[:, c : c + STRETCH].T).astype(np.int32), p)
        for d, q in zip(digits, primes[:k]):
            rest = centred((rest - d) * pow(q, -1, p), p)
        digits.append(rest)
    total, weight = np.zeros(digits[0].shape, np.int64), 1
    for d, p in zip(digits, primes):
        total += d.astype(np.int64) * np.uint64(weight % (1 << 64)).astype(np.int64)
        weight *= p
    return total


class Best:
    """The ``k`` highest scores of each line, earlier rows first among equals; rows come by ascending id."""

    def __init__(self, lines: int, k: int):
        self.scores, self.ids = np.full((lines, k), _LEAST), np.zeros((lines, k), np.int64)

    def take(self, scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> None:
        line, row = np.nonzero(wanted & (scores > self.scores[:, -1:]))
        if not len(line):
            return
        touched = np.unique(line)
        k = self.scores.shape[1]
        lines = np.concatenate([np.repeat(touched, k), line])
        s = np.concatenate([self.scores[touched].ravel(), scores[line, row]])
        i = np.concatenate([self.ids[touched].ravel(), ids[row]])
        order = np.lexsort((i, ~s, lines))
        begins = np.searchsorted(lines[order], touched)
        kept = order[begins[:, None] + np.arange(k)]
        self.scores[touched], self.ids[touched] = s[kept], i[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, id and score of all that is held."""
        line, at = np.nonzero(self.scores > _LEAST)
        return line, self.ids[line, at], self.scores[line, at]


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    return part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Iterator[pa.RecordBatch]]]:
    """The anchors of each block of a sorted partition and the batches of rows that come after them."""
    parts = _parts(batches)
    held = next(parts, None)
    while held is not None:
        anchors, here = [], _block(held)
        while held is not None and _block(held) == here and held.column("side")[0].as_py() == 0:
            anchors.append(held)
            held = next(parts, None)
        ahead: list[pa.RecordBatch | None] = [held]

        def rows() -> Iterator[pa.RecordBatch]:
            while ahead[0] is not None and _block(ahead[0]) == here:
                yield ahead[0]
                ahead[0] = next(parts, None)

        stream = rows()
        if anchors:
            yield _once(pa.Table.from_batches(anchors).combine_chunks()), stream
        for _ in stream:
            pass
        held = ahead[0]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where the block or the side changes."""
    for rows in batches:
        begins = np.append(np.flatnonzero(changes(rows, ["dim", "i", "j", "side"])), rows.num_rows)
        for a, b in zip(begins[:-1], begins[1:]):
            yield rows.slice(a, b - a)


def _block(part: pa.RecordBatch) -> tuple:
    return tuple(part.column(c)[0].as_py() for c in ("dim", "i", "j"))


def _once(rows: pa.Table) -> pa.RecordBatch:
    """The first row of each id."""
    return rows.filter(pa.array(changes(rows, ["id"]))).combine_chunks().to_batches()[0]


def _slices(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, groups and vectors of a few rows at a time; of rows that share an id only the first."""
    last, size = None, 32
    for part in stream:
        fresh = changes(part, ["id"])
        fresh[0] &= part.column("id")[0].as_py() != last
        last = part.column("id")[part.num_rows - 1].as_py()
        part = part.filter(pa.array(fresh))
        at = 0
        while at < part.num_rows:
            some = part.slice(at, size)
            at, size = at + size, min(2 * size, SLICE)
            yield some.column("id").to_numpy(), some.column("g").to_numpy(), _matrix(some)


def mine(df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchors`` holds.

    Components become ``floor(scale * x)``; a score is the exact inner product of such vectors. An anchor's positives
    are its ``positives`` highest other rows of the same label (all, if fewer; ties by smaller key). For each of them
    come the ``negatives`` highest rows of another label whose score is between ``low`` and ``high`` per cent of the
    positive's (none where the positive's is negative). Positives without such rows give no row.

    Rows with a null key, label or vector, an empty vector, null or non-finite components, or a squared length of
    ``LONGEST`` or more take no part. Of rows that share a key the one with the smallest label and vector counts.
    Vectors of different lengths never meet. An empty table gives an empty one; further columns are ignored.

    ``anchors`` is compared with all rows, in blocks; the shuffle takes every row once per ``ANCHORS`` anchors.
    """
    spark = df.sparkSession
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    sound = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c)) & (F.size(vector) > 0)
    held = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(sound)
    held = held.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(label).cast("string")).alias("g"), F.coalesce(anchors, F.lit(False)).alias("anchor"), x.alias("v"))
    held = held.withColumn("length", F.aggregate("v", F.lit(0.0), lambda t, c: t + c * c)).where(F.col("length") < LONGEST)
    held = written(held.select("id", "g", "anchor", "length", F.size("v").alias("dim"), F.transform("v", lambda c: c.cast("int")).alias("v")), "vectors")
    total, count, longest = held.agg(F.count("*"), F.count_if("anchor"), F.max("length")).first()
    primes = primes_for(int(longest or 0) + int(longest or 0) // (1 << 40) + 1)
    across = -(-(count or 0) // ANCHORS) or 1
    down = max(1, min(-(-total // ROWS), -(-4 * spark.sparkContext.defaultParallelism // across)))

    def blocks(side: DataFrame) -> DataFrame:
        """Anchors, with what they bring along, and rows, dealt into blocks."""
        asked = side.withColumns({"side": F.lit(0), "i": F.pmod(F.xxhash64("id"), F.lit(across)).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))})
        rows = held.withColumns({"side": F.lit(1), "j": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(down)).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})
        order = ["dim", "i", "j", "side", "id", "g", "v"]
        both = asked.select(*order, *[c for c in side.columns if c.startswith("at_")]).unionByName(rows.select(*order), allowMissingColumns=True)
        return both.repartition("dim", "i", "j").sortWithinPartitions(*order)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, stream in _meetings(batches):
            own, group, a = block.column("id").to_numpy(), block.column("g").to_numpy(), residues(_matrix(block), primes)
            best = Best(len(own), positives)
            for ids, groups, vectors in _slices(stream):
                best.take(products(a, residues(vectors, primes), primes), ids, (group[:, None] == groups) & (own[:, None] != ids))
            line, ids, scores = best.rows()
            yield pa.RecordBatch.from_pydict({"anchor_id": own[line], "positive_id": ids, "positive_score": scores})

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, stream in _meetings(batches):
            own, group, a = block.column("id").to_numpy(), block.column("g").to_numpy(), residues(_matrix(block), primes)
            owner = np.repeat(np.arange(len(own)), np.diff(block.column("at_id").offsets.to_numpy()))
            positive, score = (block.column(c).flatten().to_numpy() for c in ("at_id", "at_score"))
            # in tenths, as the products with whole percentages might pass 64 bits
            least, most = _share(score, low, up=True), _share(score, high, up=False)
            best = Best(len(owner), negatives)
            for ids, groups, vectors in _slices(stream):
                scores = products(a, residues(vectors, primes), primes)[owner]
                best.take(scores, ids, (group[owner][:, None] != groups) & (scores >= least[:, None]) & (scores <= most[:, None]))
            line, ids, scores = best.rows()
            yield pa.RecordBatch.from_pydict({"anchor_id": own[owner[line]], "positive_id": positive[line], "negative_id": ids, "positive_score": score[line], "negative_score": scores})

    def first(found: DataFrame, by: list[str], score: str, other: str, most: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col(score).desc(), other)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    chosen = held.where("anchor").select("id", "g", "dim", "v")
    near = blocks(chosen).mapInArrow(nearest, "anchor_id long, positive_id long, positive_score long")
    near = first(near, ["anchor_id"], "positive_score", "positive_id", positives)
    near = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))
    near = written(near.select("anchor_id", F.col("p.positive_id").alias("at_id"), F.col("p.positive_score").alias("at_score")), "positives")
    asked = chosen.join(near, F.col("id") == F.col("anchor_id")).drop("anchor_id")
    fields = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    out = first(blocks(asked).mapInArrow(within, fields), ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` of each score, rounded up or down to a whole number, without passing 64 bits."""
    whole, rest = score // 100, score % 100
    return whole * percent + (-(-rest * percent // 100) if up else rest * percent // 100)
