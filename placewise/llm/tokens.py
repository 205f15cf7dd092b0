"""Token ids in Arrow stream files of equal-length sequences.

A shard is one file in Arrow's stream format. Each record batch holds the same number of sequences, ``ids`` and ``mask``
both lists of one fixed size, so every batch takes the same number of bytes and the n-th sequence is found by arithmetic
in the mapped file, without reading or copying the others (:class:`SequenceFile`). Documents follow one another without
gaps; only the end of a shard is filled up, and there the mask is false. A second stream beside it says which document
has how many tokens.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.llm.text import text_blocks
from placewise.llm.units import LONGEST, cut, loaded
from placewise.session import shared_path

#: Tokens of a sequence, and sequences of a record batch.
LENGTH, BATCH = 2048, 256
_MANIFEST = "shard int, sequences string, documents string, n_tokens long, n_documents long"
# fixed values of byte-level BPE: how text is cut, and the characters that stand for bytes which aren't printed
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = {b: 256 + k for k, b in enumerate([*range(0, 33), *range(127, 161), 173])}
#: Units that a worker remembers, at most, and where the letters end that all versions of Unicode share.
REMEMBERED, _BEYOND = 500_000, "\u0250"


def encoder(path: str, dtype: str, added: bool = False) -> Callable[[list[str]], list[bytes]]:
    """The byte-level BPE of a tokenizers file; with ``added``, the file's added tokens in a text get their own ids, as the
    library gives by default, else they are ordinary text.

    Texts are cut into units at single blanks, a unit is cut as the byte-level pre-tokenizer does, and the file's merges are
    applied to the pieces of each distinct unit.
    """
    return loaded(("tokens", path, dtype, added), lambda: _encoder(path, dtype, added))


def _encoder(path: str, dtype: str, added: bool) -> Callable[[list[str]], list[bytes]]:
    import regex
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    split, merge = regex.compile(PIECES).findall, model.model.tokenize
    raw = [i.to_bytes(np.dtype(dtype).itemsize, "little") for i in range(model.get_vocab_size())]
    shown = [chr(_SHOWN.get(b, b)) for b in range(256)]
    units: dict[str, bytes] = {}

    def merged(p: str) -> bytes:
        return b"".join([raw[t.id] for t in merge("".join(map(shown.__getitem__, p.encode())))])

    marks = lru_cache(1 << 14)(merged)

    def unit(u: str) -> bytes:
        """A unit and the blank before it; letters after a blank are one piece, and marks after them another."""
        word = u.rstrip(punctuation)
        if not word.isalpha() or not (word.isascii() or max(word) < _BEYOND):
            return b"".join([merged(p) for p in split(" " + u)])
        if len(word) == len(u):
            return merged(" " + word)
        return (units.get(word) or merged(" " + word)) + marks(u[len(word) :])

    def encode(texts: list[str]) -> list[bytes]:
        first, rest, ends = [], [], [0]
        for text in texts:
            head, *tail = cut(text)
            first.append(b"".join([merged(p) for p in split(head)]))
            rest += tail
            ends.append(len(rest))
        parts = list(map(units.get, rest))
        new = [k for k, p in enumerate(parts) if p is None]
        made = {u: unit(u) for u in {rest[k] for k in new}}
        for k in new:
            parts[k] = made[rest[k]]
        if len(units) < REMEMBERED:
            units.update((u, ids) for u, ids in made.items() if len(u) <= LONGEST)
        return [ids + b"".join(parts[a:b]) for ids, a, b in zip(first, ends, ends[1:])]

    known = {t.content: (i, t) for i, t in model.get_added_tokens_decoder().items()} if added else {}
    if not known:
        return encode
    part = regex.compile("(" + "|".join(map(regex.escape, sorted(known, key=len, reverse=True))) + ")").split
    plain = not any(t.lstrip or t.rstrip or t.single_word for _, t in known.values())

    def run(texts: list[str]) -> list[bytes]:
        holds = [any(map(text.__contains__, known)) for text in texts]
        out = encode(["" if h else text for text, h in zip(texts, holds)])
        for k in [k for k, h in enumerate(holds) if h]:
            if plain:
                out[k] = b"".join([raw[known[p][0]] if i % 2 else encode([p])[0] for i, p in enumerate(part(texts[k]))])
            else:
                out[k] = b"".join([raw[i] for i in model.encode(texts[k], add_special_tokens=False).ids])
        return out

    return run


def schema(length: int, dtype: str) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(np.dtype(dtype)), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Packs ids into sequences and writes full batches; memory is one batch and what was last put in."""

    def __init__(self, sink, length: int, batch: int, dtype: str):
        self.length, self.size, self.dtype, self.total = length, length * batch, dtype, 0
        self.schema = schema(length, dtype)
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def put(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.size:
            flat = np.concatenate(self.held)
            full = len(flat) // self.size * self.size
            for k in range(0, full, self.size):
                self._batch(flat[k : k + self.size], np.ones(self.size, bool))
            self.held, self.n_held = [flat[full:].copy()], len(flat) - full

    def _batch(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(values), self.length) for values in (ids, mask)]
        self.stream.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            out = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            out[: len(flat)] = flat
            self._batch(out, np.arange(len(out)) < len(flat))
        self.stream.close()


class SequenceFile:
    """Random access to a shard in memory or mapped: ``file[n]`` is the ids and the mask of the n-th sequence.

    The ids are a view of the file. A batch's place follows from its number, as all but the last take equal room.
    """

    def __init__(self, buffer: pa.Buffer):
        self.buffer = buffer
        reader = pa.BufferReader(buffer)
        self.schema = pa.ipc.read_schema(reader)
        self.length, self.start = self.schema.field("ids").type.list_size, reader.tell()
        try:
            self.batch = pa.ipc.read_record_batch(pa.ipc.read_message(reader), self.schema).num_rows
            self.room = reader.tell() - self.start
        except EOFError:
            self.batch, self.room = 0, 0

    @classmethod
    def map(cls, path: str) -> SequenceFile:
        return cls(pa.memory_map(path).read_buffer())

    def __getitem__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.batch or n < 0:
            raise IndexError(n)
        at = self.start + n // self.batch * self.room
        if at >= self.buffer.size:
            raise IndexError(n)
        try:
            rows = pa.ipc.read_record_batch(pa.ipc.read_message(self.buffer.slice(at)), self.schema)
        except EOFError:
            raise IndexError(n) from None
        k = n % self.batch
        if k >= rows.num_rows:
            raise IndexError(n)
        return rows.column(0)[k].values.to_numpy(), rows.column(1)[k].values.to_numpy(zero_copy_only=False)


def write_sequences(docs: DataFrame, vocabulary: str, folder: str, end: int, length: int = LENGTH, batch: int = BATCH, dtype: str = "uint16", key: str = "doc_id", text: str = "text", added: bool = False) -> list[dict]:
    """Encode whole texts, each followed by ``end``, and write them by ascending key into shards in ``folder``.

    Rows are dealt out by key range, one shard for each partition; equal keys follow in order of their texts, null keys
    come first, a null text is empty. Returns one entry per shard, in order, with its files and counts: their number is
    that of the partitions, whatever the table holds. A retried task writes under its own name and moves the files into
    place when they are whole. ``dtype`` must hold every id of the vocabulary. ``added``: as for
    :func:`encoder`.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        files, root = pa.fs.FileSystem.from_uri(folder)
        names = [f"{root}/{kind}-{shard:06d}.arrows" for kind in ("sequences", "documents")]
        temporary = [f"{n}.{task.taskAttemptId()}" for n in names]
        encode, writer, n_docs = encoder(vocabulary, dtype, added), None, 0
        last, width = np.array([end], dtype).tobytes(), np.dtype(dtype).itemsize
        for rows in batches:
            for part, _, _ in text_blocks(rows, "text"):
                if writer is None:
                    files.create_dir(root, recursive=True)
                    sinks = [files.open_output_stream(t) for t in temporary]
                    listed = pa.schema([("key", part.schema.field("key").type), ("n_tokens", pa.int64())])
                    writer, index = _Writer(sinks[0], length, batch, dtype), pa.ipc.new_stream(sinks[1], listed)
                made = [ids + last for ids in encode(pc.fill_null(part.column("text"), "").to_pylist())]
                writer.put(np.frombuffer(b"".join(made), dtype))
                index.write_batch(pa.record_batch([part.column("key"), pa.array([len(m) // width for m in made], pa.int64())], schema=listed))
                n_docs += part.num_rows
        if writer is not None:
            writer.close()
            index.close()
            for sink, t, n in zip(sinks, temporary, names):
                sink.close()
                files.move(t, n)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "sequences": [names[0]], "documents": [names[1]], "n_tokens": pa.array([writer.total], pa.int64()), "n_documents": pa.array([n_docs], pa.int64())})

    ordered = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    return sorted((r.asDict() for r in ordered.mapInArrow(write, _MANIFEST).collect()), key=lambda r: r["shard"])


def read_sequences(spark: SparkSession, folder: str, manifest: list[dict], key_type: str = "long", key: str = "doc_id") -> DataFrame:
    """Per document ``key, start, n_tokens, ids_crc32`` from the files: one task for each shard, batch by batch.

    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers.
    """
    starts = np.cumsum([0, *(m["n_tokens"] for m in manifest)])
    table = [(m["sequences"], m["documents"], int(s)) for m, s in zip(manifest, starts)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pa.fs.FileSystem.from_uri(folder)
        for rows in batches:
            for r in rows.to_pylist():
                with files.open_input_stream(r["sequences"]) as a, files.open_input_stream(r["documents"]) as b:
                    start = r["start"]
                    tokens = (batch.column(0).flatten().to_numpy()[batch.column(1).flatten().to_numpy(zero_copy_only=False)] for batch in pa.ipc.open_stream(a))
                    left = np.zeros(0, np.uint32)
                    for part in pa.ipc.open_stream(b):
                        begins, sums = [], []
                        for n in part.column("n_tokens").to_pylist():
                            begins.append(start)
                            start, crc = start + n, 0
                            while n:
                                if not len(left):
                                    left = next(tokens).astype("<u4")
                                crc = zlib.crc32(left[:n].tobytes(), crc)
                                n, left = n - min(n, len(left)), left[n:]
                            sums.append(crc)
                        yield pa.RecordBatch.from_pydict({key: part.column("key"), "start": pa.array(begins, pa.int64()), "n_tokens": part.column("n_tokens"), "ids_crc32": pa.array(sums, pa.int64())})

    paths = spark.createDataFrame(table, "sequences string, documents string, start long").repartition(max(1, len(table)))
    return paths.mapInArrow(read, f"{key} {key_type}, start long, n_tokens long, ids_crc32 long")


def _uri(folder: str) -> str:
    """``scheme:/path`` as ``scheme:///path``; a bare path is made absolute."""
    scheme, colon, path = folder.partition(":/")
    if not colon:
        return os.path.abspath(folder)
    return folder if path.startswith("/") else f"{scheme}:///{path}"


def token_table(docs: DataFrame, vocabulary: str, end: int, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as sequences and give the table that :func:`read_sequences` reads from the files."""
    spark = docs.sparkSession
    folder = _uri(folder or shared_path(spark, "sequences"))
    key = options.get("key", "doc_id")
    manifest = write_sequences(docs, vocabulary, folder, end, **options)
    return read_sequences(spark, folder, manifest, dict(docs.dtypes)[key], key)
