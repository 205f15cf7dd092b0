"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared runs of five words. For each pair the longest matches of unmarked words are
marked again and again until none of five words is left (running Karp-Rabin matching), and an item is found in a
document where its marked words reach a share of it. As tiles may lie in any order, reordered passages are found too.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.llm.blocks import bit_filter, may_hold
from placewise.llm.text import shingle_sets, shingles, spare, text_blocks, words
from placewise.session import written

#: Words of the shortest tile, and share of an item's words that tiles must cover.
SHORTEST, COVERAGE = 5, 0.75
#: Bits of the filter of the benchmark's seeds, whatever the benchmark's size.
FILTER_BITS = 1 << 24
_BASE = np.uint64(0x9FB21C651E98DF25)


class _Words:
    """A sequence of word hashes with Karp-Rabin hashes of any run in constant time, and marks of words that are taken."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.free = hashes, np.ones(len(hashes), bool)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes), _BASE, np.uint64)], dtype=np.uint64)
        # sum of hash * base ** -place, so that runs are told by one subtraction and one product
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.shift = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes), inverse, np.uint64)], dtype=np.uint64)
        self.upto = np.r_[np.uint64(0), np.cumsum(hashes * self.shift[:-1], dtype=np.uint64)]

    def run(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.upto[at + n] - self.upto[at]) * self.power[at]

    def free_starts(self, length: int) -> np.ndarray:
        taken = np.r_[0, np.cumsum(~self.free)]
        return np.flatnonzero(taken[length:] == taken[:-length])

    def room(self) -> np.ndarray:
        """How many free words follow from each place on."""
        ends = np.r_[np.flatnonzero(~self.free), len(self.free)]
        at = np.arange(len(self.free))
        return ends[np.searchsorted(ends, at)] - at

    def before(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word before each place, and whether there is a free one."""
        has = (at > 0) & self.free[at - 1]
        return np.where(has, self.hashes[at - 1], np.uint64(0)), has


def _left_maximal(a: _Words, b: _Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all matches of ``length`` free words that can't be carried on to the left.

    Starts with the same run are grouped by the word before them; only starts of different groups, or at a border, pair.
    A word said a thousand times thus gives thousands of pairs, not a million.
    """
    at_a, at_b = a.free_starts(length), b.free_starts(length)
    of_a, of_b = a.run(at_a, length), b.run(at_b, length)
    at_a, of_a = at_a[(met := np.isin(of_a, of_b))], of_a[met]
    at_b, of_b = at_b[(met := np.isin(of_b, of_a))], of_b[met]
    left, right = [], []

    def groups(words: _Words, at: np.ndarray, of: np.ndarray) -> dict[int, dict]:
        prior, has = words.before(at)
        out: dict[int, dict] = {}
        for i, h, p, inside in zip(at.tolist(), of.tolist(), prior.tolist(), has.tolist()):
            out.setdefault(h, {}).setdefault(p if inside else None, []).append(i)
        return out

    of_b_groups = groups(b, at_b, of_b)
    for h, by_prior in groups(a, at_a, of_a).items():
        others = of_b_groups[h]
        for p, mine in by_prior.items():
            for q, theirs in others.items():
                if p is None or q is None or p != q:
                    left.append(np.repeat(mine, len(theirs)))
                    right.append(np.tile(theirs, len(mine)))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _lengths(a: _Words, b: _Words, at_a: np.ndarray, at_b: np.ndarray, length: int) -> np.ndarray:
    """Words that match from each pair of starts on, at least ``length``, by bisection over run hashes."""
    low, high = np.full(len(at_a), length), np.minimum(a.room()[at_a], b.room()[at_b])
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = a.run(at_a, middle) == b.run(at_b, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def tiles(a: np.ndarray, b: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: ``(start in a, start in b, length)``, longest first.

    Of all matches of unmarked words the longest is marked, again and again, until none of ``shortest`` words is left; no
    word lies in two tiles, and ties go to the first place in ``a``, then in ``b``. The search length starts at the shorter
    sequence and halves. Matches of one search length wait in a heap; one that others have cut into goes back in parts.
    """
    x, y, found = _Words(a), _Words(b), []
    length = min(len(a), len(b))
    while length >= shortest > 0:
        at_a, at_b = _left_maximal(x, y, length)
        heap = [(-n, i, j) for n, i, j in zip(_lengths(x, y, at_a, at_b, length).tolist(), at_a.tolist(), at_b.tolist())]
        heapq.heapify(heap)
        while heap:
            n, i, j = heapq.heappop(heap)
            free = x.free[i : i - n] & y.free[j : j - n]
            if free.all():
                x.free[i : i - n] = y.free[j : j - n] = False
                found.append((i, j, -n))
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
            for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if stop - start >= length:
                    heapq.heappush(heap, (start - stop, i + start, j + start))
        length = 0 if length == shortest else max(shortest, length // 2)
    return found


def _seed_filter(items: DataFrame, text: str):
    """A fixed number of bits, set where a seed of the benchmark falls."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for _, data, offsets in text_blocks(rows, text):
                for s in shingle_sets(data, offsets, SHORTEST):
                    yield pa.RecordBatch.from_pydict({"seed": pa.array(s.view(np.int64))})

    return bit_filter(items.select(text).mapInArrow(seeds, "seed long"), "seed", FILTER_BITS)


def _widths(items: DataFrame, text: str) -> list[int]:
    """Words of a seed: ``SHORTEST``, and the lengths of the items that have fewer words."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for _, data, offsets in text_blocks(rows, text):
                n = np.unique(np.diff(words(data, offsets)[1]))
                yield pa.RecordBatch.from_pydict({"n": pa.array(n[(n > 0) & (n < SHORTEST)], pa.int32())})

    return [*sorted(r["n"] for r in items.select(text).mapInArrow(lengths, "n int").distinct().collect()), SHORTEST]


def _regions(hashes: np.ndarray, hits: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Words of the runs (``width, starts``) that may match, apart from each other by a word that matches none."""
    covered = np.zeros(len(hashes), bool)
    for width, starts in hits:
        for k in range(width):
            covered[np.minimum(starts + k, len(hashes) - 1)] = True
    at = np.flatnonzero(covered)
    cuts = np.flatnonzero(np.diff(at) > 1) + 1
    return np.concatenate([x for part in np.split(hashes[at], cuts) for x in (part, np.zeros(1, np.uint64))])


def findings(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``h, item, coverage, tiles``: the items found in each distinct text, ``h`` being the text's xxhash64.

    Texts are scanned where they lie; a fixed-size bit filter of the benchmark's seeds lets only texts and words through
    that may match, false hits die in the join. Equal texts are searched once for each task that reads one and joined
    once. Pairs whose shared seeds can't reach ``coverage`` are dropped before tiling: a seed covers five words at most at
    each of its places in the item. Items of fewer words than five are found where these stand in a row anywhere in a
    text; items without words are never found.
    """
    seen_items = items.select(F.xxhash64(item, item_text).alias("key"), F.col(item).alias("item"), F.coalesce(item_text, F.lit("")).alias("t"))
    field, widths = _seed_filter(seen_items, "t"), _widths(seen_items, "t")

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, data, offsets in text_blocks(rows, "t"):
                hashes, at = words(data, offsets)
                runs, of = shingles(hashes, at, SHORTEST)
                sets = [np.unique(runs[a:b], return_counts=True) for a, b in zip(of[:-1], of[1:])]
                keep = [k for k in range(part.num_rows) if at[k + 1] > at[k]]
                yield pa.RecordBatch.from_pydict({
                    "key": part.column("key").take(pa.array(keep, pa.int64())), "item": part.column("item").take(pa.array(keep, pa.int64())),
                    "item_words": pa.array([hashes[at[k] : at[k + 1]].tobytes() for k in keep], pa.binary()),
                    "n_words": pa.array([int(at[k + 1] - at[k]) for k in keep], pa.int32()),
                    "seeds": pa.array([sets[k][0].astype(np.int64) for k in keep], pa.list_(pa.int64())),
                    "times": pa.array([sets[k][1] for k in keep], pa.list_(pa.int64())),
                })

    kind = dict(seen_items.dtypes)["item"]
    known = written(seen_items.dropDuplicates(["key"]).mapInArrow(item_rows, f"key long, item {kind}, item_words binary, n_words int, seeds array<long>, times array<long>"), "items")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows in batches:
            for part, data, offsets in text_blocks(rows, "t"):
                hashes, at = words(data, offsets)
                per_width = []
                for width in widths:
                    runs, of = shingles(hashes, at, width)
                    hit = np.flatnonzero(may_hold(field.value, runs))
                    per_width.append((width, runs, of, hit, np.searchsorted(hit, of)))
                out: dict[str, list] = {"h": [], "doc_words": [], "seeds": []}
                for k in np.flatnonzero(sum(np.diff(bounds) for *_, bounds in per_width)).tolist():
                    if (h := part.column("h")[k].as_py()) in seen:
                        continue
                    seen.add(h)
                    mine = [(width, runs, of[k], hit[bounds[k] : bounds[k + 1]]) for width, runs, of, hit, bounds in per_width]
                    out["h"].append(h)
                    out["doc_words"].append(_regions(hashes[at[k] : at[k + 1]], [(width, hit - first) for width, _, first, hit in mine]).tobytes())
                    out["seeds"].append(np.unique(np.concatenate([runs[hit] for _, runs, _, hit in mine])).astype(np.int64))
                yield pa.RecordBatch.from_pydict({"h": pa.array(out["h"], pa.int64()), "doc_words": pa.array(out["doc_words"], pa.binary()), "seeds": pa.array(out["seeds"], pa.list_(pa.int64()))})

    scanned = docs.select(F.xxhash64(text).alias("h"), F.coalesce(text, F.lit("")).alias("t")).mapInArrow(scan, "h long, doc_words binary, seeds array<long>")
    found = written(scanned, "scanned")
    seeds = found.select("h", F.explode("seeds").alias("seed")).distinct()
    pairs = seeds.join(known.select("key", "n_words", F.explode(F.arrays_zip("seeds", "times")).alias("s")).select("key", "n_words", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times")), "seed").groupBy("h", "key").agg(F.sum("times").alias("shared"), F.first("n_words").alias("n_words"))
    pairs = pairs.where(F.col("shared") * SHORTEST >= F.col("n_words") * coverage).select("h", "key").withColumn("k", F.xxhash64("h"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            share, number = [], []
            for a, b in zip(rows.column("doc_words").to_pylist(), rows.column("item_words").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                made = tiles(a, b, min(SHORTEST, len(b)))
                share.append(sum(n for *_, n in made) / len(b))
                number.append(len(made))
            yield pa.RecordBatch.from_pydict({"h": rows.column("h"), "item": rows.column("item"), "coverage": pa.array(share, pa.float64()), "tiles": pa.array(number, pa.int32())})

    texts = found.groupBy("h").agg(F.first("doc_words").alias("doc_words")).withColumn("k", F.xxhash64("h")).withColumnRenamed("h", "_h")
    both = pairs.join(texts, "k").where("h = _h").join(known.select("key", "item", "item_words").withColumn("k2", F.xxhash64("key")).withColumnRenamed("key", "_key"), F.xxhash64("key") == F.col("k2")).where("key = _key")
    made = both.select("h", "item", "doc_words", "item_words").mapInArrow(tile, f"h long, item {kind}, coverage double, tiles int")
    return written(made.where(F.col("coverage") >= coverage), "found")


def report(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``contaminated``, ``n_items`` and the best ``coverage`` (0.0 where nothing is found)."""
    h = spare("_h", docs.columns)
    hits = findings(docs, items, coverage, text).groupBy("h").agg(F.count("*").alias("n_items"), F.max("coverage").alias("coverage"))
    rest = [c for c in docs.columns if c not in (text, "contaminated", "n_items", "coverage")]
    out = docs.select(*rest, F.xxhash64(text).alias(h)).join(hits.withColumnRenamed("h", h), h, "left")
    return out.select(*rest, F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def remove(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item. Only texts that share a seed are joined; all others stay where they are."""
    field, widths = _seed_filter(items, "text"), _widths(items, "text")
    h = spare("_h", docs.columns)
    bad = findings(docs, items, coverage, text).select(F.col("h").alias(h)).distinct()

    def part_of(touched: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for part, data, offsets in text_blocks(rows, text):
                    hashes, at = words(data, offsets)
                    held = np.zeros(part.num_rows, bool)
                    for width in widths:
                        runs, of = shingles(hashes, at, width)
                        sums = np.r_[0, np.cumsum(may_hold(field.value, runs))]
                        held |= sums[of[1:]] > sums[of[:-1]]
                    yield part.filter(pa.array(held == touched))

        return docs.mapInArrow(run, T.StructType(docs.schema.fields))

    return part_of(False).unionByName(part_of(True).withColumn(h, F.xxhash64(text)).join(bad, h, "left_anti").drop(h))


