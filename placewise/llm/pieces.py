"""SentencePiece encoding and decoding as a best-path problem, giant documents in parallel.

The pieces and scores of a SentencePiece model file are read as a unigram model: the ids of a text are those of the
segmentation with the largest sum of scores. That is a shortest path over the positions of the text, so a chunk of a
document acts on the scores of its boundary states as a matrix over (max, +). A state is how many characters of the
chunk the piece that began before it takes; no piece has more than ``width`` characters, so there are ``width`` states.
Matrices of chunks are multiplied up a tree, best boundary states are handed down it, and each chunk is traced back on
its own between its two states.

The merges of a BPE model are no such path problem. Its file serves here for its pieces and scores; the answer equals
that of the SentencePiece library for the same pieces declared as a unigram model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.llm.text import spare, text_blocks
from placewise.llm.units import UnitEncoder, loaded
from placewise.session import written

#: Characters of a chunk; texts of so many chunks are giants; so many chunks meet in a task of the tree.
CHUNK, GIANT, FAN = 16_384, 4, 64
#: Chunks that a task turns into Python strings at once, and ids that it decodes at once.
SOME, DECODED = 32, 1 << 18
#: A longer stretch without a blank is searched here, not by the library, whose sums are of single precision.
STRETCH = 400
#: Pieces scored this low have no score of their own: those of one character come after all others, no path takes longer ones.
UNUSED = -1e6
_MARK = "▁"
_NEVER = -np.inf


class Model:
    """Pieces, scores and bytes of a model file; sums of scores are exact in double precision."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        kind = pb.ModelProto.SentencePiece
        proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
        self.piece_ids: dict[str, int] = {}
        self.byte_ids, self.scores, self.out = {}, {}, []
        last = min(p.score for p in proto.pieces if p.type == kind.NORMAL and p.score > UNUSED) - 1
        for i, p in enumerate(proto.pieces):
            if p.type == kind.NORMAL and p.score <= UNUSED:
                p.type, p.score = (kind.NORMAL, last) if len(p.piece) == 1 else (kind.UNUSED, p.score)
            if p.type == kind.NORMAL:
                self.piece_ids[p.piece], self.scores[p.piece] = i, float(p.score)
            if p.type == kind.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.out.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.out.append(b"" if p.type == kind.CONTROL else p.piece.replace(_MARK, " ").encode())
        self.width = max(map(len, self.piece_ids))
        self.unknown = min(self.scores.values()) - 10
        library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.units = UnitEncoder(lambda units: self._encode(library, units), _MARK, _MARK, lambda t: t.split(" "))

    def _encode(self, library, units: list[str]) -> list[bytes]:
        marks = [u for u in units if 1 < len(u) <= STRETCH]  # the library has no pieces for an empty text
        made = dict(zip(marks, library.encode([u[1:] for u in marks], num_threads=1)))
        return [np.array(made[u] if u in made else self.ids(self.best(u, 0, len(u))[1]), "<i4").tobytes() for u in units]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; an empty text has none."""
        made = self.units(texts)
        return [m if t else b"" for m, t in zip(made, texts)]

    def forward(self, text: str, first: int, last: int) -> tuple[list[float], list[int]]:
        """Best score of reaching each position from ``first`` and where the last piece begins; pieces begin before ``last``."""
        size, width, scores = len(text), self.width, self.scores
        score, begin = [_NEVER] * (size + 1), [-1] * (size + 1)
        score[first] = 0.0
        for a in range(first, last):
            if (so_far := score[a]) == _NEVER:
                continue
            for b in range(a + 1, min(size, a + width) + 1):
                s = scores.get(text[a:b])
                if s is None:
                    if b > a + 1:
                        continue
                    s = self.unknown
                if so_far + s > score[b]:
                    score[b], begin[b] = so_far + s, a
        return score, begin

    def best(self, text: str, first: int, last: int, end: int | None = None) -> tuple[float, list[str]]:
        """The best path from ``first`` to ``end``; its pieces begin before ``last``."""
        end = last if end is None else end
        score, begin = self.forward(text, first, last)
        found, b = [], end
        while b > first:
            found.append(text[begin[b] : b])
            b = begin[b]
        return score[end], found[::-1]

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if (i := self.piece_ids.get(p)) is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in p.encode()]
        return out

    def path_score(self, text: str) -> float:
        return self.best(text, 0, len(text))[0]

    def cuts(self, text: str, size: int) -> tuple[int, int] | None:
        """First and last place in a chunk that every path passes: before a mark, which no piece has inside."""
        first = text.find(_MARK, 0, size)
        return None if first < 0 else (first, text.rfind(_MARK, 0, size))

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Transfer matrix of the chunk ``text[:size]``: from the state at its start to the state at its end."""
        out = np.full((self.width, self.width), _NEVER)
        ends = range(size, min(len(text), size + self.width - 1) + 1)
        if (cut := self.cuts(text, size)) is None:
            for i in range(min(self.width, size + 1)):
                score, _ = self.forward(text, i, size) if i < size else ([_NEVER] * size + [0.0] + [_NEVER] * self.width, None)
                for j in ends:
                    out[i, j - size] = score[j]
            return out
        a, b = cut
        middle = sum(self.best(_MARK + u, 0, len(u) + 1)[0] for u in text[a + 1 : b].split(_MARK)) if b > a else 0.0
        tail, _ = self.forward(text[b:], 0, size - b)
        tail = [tail[j - b] for j in ends]
        for i in range(min(self.width, a + 1)):
            out[i, : len(tail)] = self.best(text, i, a)[0] + middle + np.array(tail)
        return out

    def trace(self, text: str, size: int, start: int, end: int) -> list[int]:
        """Ids of the chunk's best path between two states."""
        if (cut := self.cuts(text, size)) is None:
            return self.ids(self.best(text, start, size, size + end)[1]) if start < size + end else []
        a, b = cut
        middle = np.frombuffer(self.units([text[a + 1 : b].replace(_MARK, " ")])[0], "<i4").tolist() if b > a else []
        return self.ids(self.best(text, start, a)[1]) + middle + self.ids(self.best(text[b:], 0, size - b, size - b + end)[1])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.out.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def model(path: str) -> Model:
    return loaded(("pieces", path), lambda: Model(path))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product over (max, +)."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def hand_down(matrices: list[np.ndarray], start: int, end: int) -> list[tuple[int, int]]:
    """The states before and after each of some neighbouring chunks on the best path from ``start`` to ``end``."""
    reach, came = np.full(len(matrices[0]), _NEVER), []
    reach[start] = 0.0
    for m in matrices:
        through = reach[:, None] + m
        came.append(through.argmax(axis=0))
        reach = through.max(axis=0)
    states = [end]
    for c in reversed(came):
        states.append(int(c[states[-1]]))
    states.reverse()
    return list(zip(states[:-1], states[1:]))


def _lists(parts: list[bytes]) -> pa.ListArray:
    flat = np.frombuffer(b"".join(parts), "<i4")
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p) // 4 for p in parts)]), pa.int32()), pa.array(flat))


def _typed(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in more)])


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows of a batch at a time."""
    for rows in batches:
        for a in range(0, rows.num_rows, SOME):
            yield rows.slice(a, SOME)


def _giants(docs: DataFrame, path: str, text: str) -> DataFrame:
    """``_row`` and ``ids`` of documents that are cut into chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = model(path).width
        for rows in batches:
            for row, t in ((rows.column("_row")[i].as_py(), rows.column("t")[i].as_py()) for i in range(rows.num_rows)):
                t = _MARK + t.replace(" ", _MARK)
                for k in range(0, len(t), CHUNK):
                    part = t[k : k + CHUNK + width - 1]
                    yield pa.RecordBatch.from_pydict({"_row": [row], "k": pa.array([k // CHUNK], pa.int64()), "size": pa.array([min(CHUNK, len(t) - k)], pa.int32()), "part": [part]})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for rows in _some(batches):
            made = [m.matrix(t, n).tobytes() for t, n in zip(rows.column("part").to_pylist(), rows.column("size").to_pylist())]
            yield rows.select(["_row", "k", "size", "part"]).append_column("m", pa.array(made, pa.binary()))

    def up(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        total = None
        for b in group["m"]:
            m = _square(b)
            total = m if total is None else product(total, m)
        return pd.DataFrame({"_row": [key[0]], "k": [key[1]], "m": [total.tobytes()]})

    def down(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        states = hand_down([_square(b) for b in group["m"]], int(group["start"].iloc[0]), int(group["end"].iloc[0]))
        return pd.DataFrame({"_row": group["_row"], "k": group["k"], "start": [s for s, _ in states], "end": [e for _, e in states]})

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for rows in _some(batches):
            made = [np.array(m.trace(r["part"], r["size"], r["start"], r["end"]), "<i4").tobytes() for r in rows.select(["part", "size", "start", "end"]).to_pylist()]
            yield pa.RecordBatch.from_pydict({"_row": rows.column("_row"), "k": rows.column("k"), "ids": _lists(made)})

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame):
        """Neighbouring chunks together, over as many tasks as there are: small tables of much work are not coalesced."""
        return rows.repartition(tasks, "_row", "p").groupBy("_row", "p")

    parts = docs.select("_row", F.col(text).alias("t")).mapInArrow(cut, "_row long, k long, size int, part string")
    chunks = written(parts.repartition("_row", "k").mapInArrow(measure, "_row long, k long, size int, part string, m binary"), "chunks")
    levels = [chunks.select("_row", "k", "m")]
    top = levels[0].agg(F.max("k")).first()[0] or 0
    while top > 0:
        levels.append(written(dealt(levels[-1].withColumn("p", F.floor(F.col("k") / FAN))).applyInPandas(up, "_row long, k long, m binary"), "products"))
        top //= FAN
    states = levels[-1].select("_row", "k", F.lit(0).alias("start"), F.lit(0).alias("end"))
    for level in reversed(levels[:-1]):
        above = states.withColumnRenamed("k", "p")
        known = level.withColumn("p", F.floor(F.col("k") / FAN)).join(above, ["_row", "p"])
        states = written(dealt(known).applyInPandas(down, "_row long, k long, start int, end int"), "states")
    traced = chunks.select("_row", "k", "size", "part").join(states, ["_row", "k"]).mapInArrow(back, "_row long, k long, ids array<int>")
    return traced.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda c: c["ids"])).alias("ids"))


def _square(b: bytes) -> np.ndarray:
    m = np.frombuffer(b)
    return m.reshape(int(len(m) ** 0.5), -1)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text; a null or empty text has none. A column named as ``ids`` is replaced.

    A text under ``GIANT`` chunks is encoded where it is read. Longer ones are written once, cut and put together by row.
    """
    docs = docs.drop(ids)
    long = F.char_length(text) >= GIANT * CHUNK
    whole = docs.where(~F.coalesce(long, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for rows in batches:
            for part, _, _ in text_blocks(rows, text):
                yield part.append_column(ids, _lists(m.encode(pc.fill_null(part.column(text), "").to_pylist())))

    short = whole.mapInArrow(run, _typed(whole, (ids, T.ArrayType(T.IntegerType()))))
    row = spare("_row", docs.columns)
    giants = written(docs.where(long).withColumn(row, F.monotonically_increasing_id()), "giants")
    made = _giants(giants.select(F.col(row).alias("_row"), F.col(text).alias("t")), path, "t").select(F.col("_row").alias(row), F.col("ids").alias(spare("_ids", docs.columns)))
    return short.unionByName(giants.join(made, row).withColumnRenamed(made.columns[1], ids).drop(row))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the text of its ids in ``text``; null ids give an empty text. Encoding and decoding give any text back."""
    df = df.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for rows in batches:
            lists = rows.column(ids)
            bounds = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
            flat, a = lists.values.to_numpy(), 0
            while a < rows.num_rows:
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + DECODED, "right")) - 1)
                texts = [m.decode(flat[x:y]) for x, y in zip(bounds[a:b], bounds[a + 1 : b + 1])]
                yield rows.slice(a, b - a).append_column(text, pa.array(texts, pa.string()))
                a = b

    return df.mapInArrow(run, _typed(df, (text, T.StringType())))
