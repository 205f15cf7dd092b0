"""Toxicity by compression: which of two zstandard dictionaries makes the windows of a text shorter.

One dictionary is built from the words of toxic documents, one from those of ordinary documents. A window is a word
between blanks; very long ones are cut into several. Each of its bytes is written as three, so that a match, which takes as much room for a short word as for
a long one, pays for short words too. The difference of the two compressed lengths says which side knows the window
better. How many windows of a document lie above each difference goes through a logistic curve fitted on labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.llm.text import text_blocks
from placewise.llm.units import loaded

#: The bounded sample: labelled documents of either class at most, taken in order of a hash of their key.
TOXIC_SAMPLE, ORDINARY_SAMPLE = 2_000, 6_000
#: Share of a class's documents in the sample that a word of its dictionary must be in, LEAST at least, and words at most.
TOXIC_SUPPORT, ORDINARY_SUPPORT, LEAST, WORDS = 0.008, 0.0013, 3, 100_000
#: Differences of compressed lengths in bytes that are told apart.
LOW, HIGH = -10, 23
LEVEL = 15
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_SPREAD = [bytes([(c + 85 * k) % 256 for k in range(3)]) for c in range(256)]
_MOST = 150_000
#: Bytes of the longest window; in a longer one a few telling words would count for little.
LONGEST = 256
_PARTED = regex.compile(r"[^\p{P}\p{Z}]*[\p{P}\p{Z}]+|[^\p{P}\p{Z}]+")


def spread(word: bytes) -> bytes:
    return b"".join(map(_SPREAD.__getitem__, b" " + word + b" "))


def _windows(run: bytes) -> list[bytes]:
    """Consecutive parts of a long run that hold all its bytes: they end after punctuation and blanks beyond ASCII, or
    at the last character that ``LONGEST`` bytes hold whole."""
    out = []
    for part in _PARTED.findall(run.decode()):
        raw, at = part.encode(), 0
        while len(raw) - at > LONGEST:
            end = at + LONGEST
            while raw[end] & 0xC0 == 0x80:
                end -= 1
            out.append(raw[at:end])
            at = end
        out.append(raw[at:])
    return out


def window_words(text: str) -> list[bytes]:
    """Runs of letters, A-Z lower-cased, and of bytes beyond ASCII; runs of over ``LONGEST`` bytes in parts."""
    words = _WORD.findall(text.encode().lower())
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w for run in words for w in (_windows(run) if len(run) > LONGEST else (run,))]


class Scorer:
    """Differences of compressed lengths; each distinct window is compressed once per worker while memory allows."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard

        def compressor(content: bytes):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.toxic, self.ordinary, self.known = compressor(toxic), compressor(ordinary), {}

    def differences(self, words: list[bytes]) -> list[int]:
        known, made = self.known, {}
        for w in set(words).difference(known):
            window = spread(w)
            made[w] = min(HIGH, max(LOW, len(self.ordinary.compress(window)) - len(self.toxic.compress(window)))) - LOW
        if len(known) < _MOST:
            known.update(made)
        return [made[w] if w in made else known[w] for w in words]

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: share and logarithm of the number of windows at or above each positive difference, and the largest."""
        out = np.zeros((len(texts), 2 * (HIGH + 1) + 1))
        for row, text in zip(out, texts):
            if words := window_words(text):
                counts = np.bincount(self.differences(words), minlength=HIGH - LOW + 1)
                above = np.cumsum(counts[::-1])[::-1][-LOW:]
                row[: HIGH + 1], row[HIGH + 1 : -1], row[-1] = above / len(words), np.log1p(above), np.flatnonzero(counts).max()
        return out


@dataclass(frozen=True)
class ToxicityModel:
    """Contents of the two dictionaries and the coefficients; bounded by the sample."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scorer(self) -> Scorer:
        return loaded(("toxicity", hash((self.toxic, self.ordinary))), lambda: Scorer(self.toxic, self.ordinary))

    def score(self, texts: list[str]) -> np.ndarray:
        z = (self.scorer().features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -500, 500)))


def held_out(key: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(key.cast("string")) % 5 == 0


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + np.eye(len(w)), z.T @ (weight * (p - y)) + w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _dictionary(words: list) -> bytes:
    """Rare words first: zstandard reaches the end of a dictionary with the smallest offsets."""
    return b"".join(spread(bytes(r["w"])) for r in sorted(words, key=lambda r: (r["n"], bytes(r["w"]))))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learn from labelled documents that aren't held out; the keys, languages and sources are no inputs.

    Takes a sample of bounded numbers of rows (``TOXIC_SAMPLE``, ``ORDINARY_SAMPLE``), equal texts once; the classes are
    weighted back to their shares among all labels. Without documents of both classes every score is the smoothed share
    of toxic labels, one half if there are none.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key))).select(F.col(key).alias("k"), F.col(label).alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(n) for y, n in ((1, TOXIC_SAMPLE), (0, ORDINARY_SAMPLE))]
    ids = spark.createDataFrame([tuple(r) for part in ids for r in part.collect()], known.schema)
    sample = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).join(F.broadcast(ids), "k").groupBy(F.xxhash64("t").alias("h")).agg(F.first("t").alias("t"), F.max("y").alias("y")).select("t", "y")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for t, y in zip(rows.column("t").to_pylist(), rows.column("y").to_pylist()):
                found = sorted(set(window_words(t)))
                yield pa.RecordBatch.from_pydict({"w": pa.array(found, pa.binary()), "y": pa.array([y] * len(found), pa.int32())})

    sizes = [min(total.get(1, 0), TOXIC_SAMPLE), min(total.get(0, 0), ORDINARY_SAMPLE)]
    supports = [max(LEAST, round(n * share)) for n, share in zip(sizes, (TOXIC_SUPPORT, ORDINARY_SUPPORT))]
    counts = sample.mapInArrow(distinct_words, "w binary, y int").groupBy("y", "w").agg(F.count("*").alias("n"))
    dictionaries = [_dictionary(counts.where((F.col("y") == y) & (F.col("n") >= least)).orderBy(F.desc("n"), "w").limit(WORDS).collect()) for y, least in zip((1, 0), supports)]
    columns = 2 * (HIGH + 1) + 1
    share = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
    flat = ToxicityModel(*dictionaries, np.zeros(columns), np.ones(columns), np.r_[np.zeros(columns), np.log(share / (1 - share))])
    if not all(dictionaries):
        return flat
    shared = spark.sparkContext.broadcast(flat)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for rows in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array(list(scorer.features(rows.column("t").to_pylist()))), "y": rows.column("y")})

    rows = sample.repartition(16, F.xxhash64("t")).mapInArrow(measure, "x array<double>, y int").collect()
    x, y = map(np.array, zip(*sorted((r["x"], r["y"]) for r in rows)))
    weight = np.where(y == 1, total[1] / max(1, (y == 1).sum()), total[0] / max(1, (y == 0).sum())) * len(y) / sum(total.values())
    return ToxicityModel(*dictionaries, *_logistic(x, y, weight))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity of each whole text, a null text taken as empty. ``to`` is replaced."""
    docs = docs.drop(to)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, _, _ in text_blocks(rows, text):
                yield part.append_column(to, pa.array(shared.value.score(pc.fill_null(part.column(text), "").to_pylist())))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))
