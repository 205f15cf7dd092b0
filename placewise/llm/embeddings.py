"""Near-duplicate embeddings: sign hashes of random hyperplanes, exact cosines, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.components import connected_components, roots
from placewise.llm.segments import runs
from placewise.session import written

#: Hyperplanes of a table, and tables. Vectors at an angle a share a bucket of one table with probability
#: (1 - a / pi) ** BITS, so at cosine 0.93 one of 20 tables finds a pair with probability 0.99; nearer pairs sooner.
BITS, TABLES = 12, 20
#: Vectors that meet in one task; a larger bucket is cut into pairs of tiles.
TILE = 1024


def reach(threshold: float, total: int) -> float:
    """Sign bits in which vectors at ``threshold`` may differ: seven standard deviations above the mean, which one pair in 10^8 exceeds."""
    p = float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)
    return total * p + 7 * (total * p * (1 - p)) ** 0.5 + 3


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def near_duplicates(df: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", bits: int = BITS, tables: int = TABLES, seed: int = 17) -> DataFrame:
    """``key, n_links, component_id, kept``: one row for each row of ``df``.

    Two vectors are linked when their labels are equal (all are where ``label`` is None), they share a bucket of one
    table and their cosine in double precision is at least ``threshold``. Vectors that are null, zero or hold null or
    non-finite components, and those with a null label, have no links; vectors of different lengths never meet.
    ``component_id`` is the smallest key that links reach.

    Equal vectors are one vertex with a weight. Buckets are cut into tiles. Only the sign bits go there at first: a
    vector stays where another of the tile differs in few of all the bits and hasn't met it in an earlier table. The
    vectors that stay are joined and compared by matrix products; only counts of links and a spanning forest of them
    leave a task, never the pairs. Rows with a null key take no part.
    """
    held = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.lit("") if label is None else F.col(label).cast("string")).alias("g"))
    sound = F.col("v").isNotNull() & F.col("g").isNotNull() & (F.size("v") > 0)
    sound &= F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    held = written(held.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.col("v"))).withColumn("h", F.xxhash64("g", "v")), "vectors")
    good = held.where(F.col("v").isNotNull() & F.col("id").isNotNull())
    distinct = written(good.groupBy("g", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("h", F.xxhash64("g", "v")), "distinct")

    kind = np.int16 if bits < 16 else np.int32
    most = reach(threshold, bits * tables)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column("v")
            lengths = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1])
            for dim in np.unique(lengths):
                part = rows.filter(pa.array(lengths == dim))
                values = part.column("v").flatten().to_numpy().reshape(-1, dim)
                bit = (values @ planes(int(dim), bits, tables, seed) >= 0).reshape(len(values), tables, bits)
                codes = (bit * (1 << np.arange(bits))).sum(axis=2).astype(kind)
                signature = pa.array([c.tobytes() for c in codes], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_pydict({"g": part.column("g"), "dim": pa.array(np.full(len(codes), dim, np.int32)), "t": pa.array(np.full(len(codes), t, np.int32)), "code": pa.array(codes[:, t].astype(np.int32)), "rep": part.column("rep"), "s": signature})

    fields = "g string, dim int, t int, code int, rep long, s binary"
    bucket = ["g", "dim", "t", "code"]
    signed = distinct.select("g", "v", "rep").mapInArrow(sign, fields).withColumn("b", F.xxhash64(*bucket))
    sizes = signed.groupBy("b").agg(F.count("*").alias("size")).where("size > 1").withColumn("k", F.xxhash64("b")).withColumnRenamed("b", "_b")
    met = signed.withColumn("k", F.xxhash64("b")).join(sizes, "k").withColumn("tiles", F.ceil(F.col("size") / TILE))
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).select("b", "lo", "hi", "own", "t", "rep", "s")

    def first_meetings(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Signatures, and which pairs of a tile are its own: of two parts where there are two, and of no earlier table."""
        own = group.column("own").to_numpy()
        s = np.frombuffer(b"".join(group.column("s").to_pylist()), kind).reshape(len(own), -1)
        t, lo, hi = (group.column(c)[0].as_py() for c in ("t", "lo", "hi"))
        return s[:, :t], own[:, None] != own[None, :] if lo != hi else ~np.eye(len(own), dtype=bool)

    def unseen(pairs: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        for codes in earlier.T:
            pairs &= codes[:, None] != codes[None, :]
        return pairs

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["b", "lo", "hi"]):
            if group.num_rows < 2:
                continue
            earlier, pairs = first_meetings(group)
            s = np.frombuffer(b"".join(group.column("s").to_pylist()), kind).reshape(group.num_rows, -1)
            signs = ((s[:, :, None] >> np.arange(bits)) & 1).reshape(len(s), -1).astype(np.float32) * 2 - 1
            pairs &= signs @ signs.T >= signs.shape[1] - 2 * most
            if pairs.any() and (stay := unseen(pairs, earlier).any(axis=1)).any():
                yield from group.filter(pa.array(stay)).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["b", "lo", "hi"]):
            if group.num_rows < 2:
                continue
            rep, n = (group.column(c).to_numpy() for c in ("rep", "n"))
            x = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
            norm = np.sqrt((x * x).sum(axis=1))
            earlier, pairs = first_meetings(group)
            linked = unseen(pairs & ((x @ x.T) / np.outer(norm, norm) >= threshold), earlier)
            if not linked.any():
                continue
            yield pa.RecordBatch.from_pydict({"rep": pa.array(rep), "links": pa.array(linked @ n), "near": pa.array(rep[roots(linked)])})

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("b", "lo", "hi").sortWithinPartitions("b", "lo", "hi", "rep")

    stay = dealt(met).mapInArrow(screen, met.schema).withColumnRenamed("rep", "_rep")
    near = dealt(stay.join(distinct.select("rep", "n", "v"), F.col("_rep") == F.col("rep")).drop("_rep"))
    found = written(near.mapInArrow(compare, "rep long, links long, near long").where("links > 0 OR rep != near"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("rep != near"), "rep", "near")
    classes = distinct.select("rep", "n", "h", "v", "g").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("h", F.col("v").alias("_v"), F.col("g").alias("_g"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = held.alias("a").join(classes.alias("c"), (F.col("a.h") == F.col("c.h")) & (F.col("a.v") == F.col("c._v")) & (F.col("a.g") == F.col("c._g")) & F.col("a.id").isNotNull(), "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
