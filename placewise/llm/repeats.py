"""Repeated byte strings across documents, by enhanced suffix arrays over content-defined buckets.

Suffixes that begin with a repeated string of ``LENGTH`` bytes must meet in one bucket, without every suffix travelling.
The least hash of the ``GRAM``-byte strings in a window of ``LENGTH`` bytes names the window's bucket: equal windows have
the same least string at the same place. Neighbouring windows with one least string form a stretch, which is sent as one
row. Stretches that are equal as a whole need no further look. Only where a bucket holds different stretches, at the ends
of repeats, are their bytes fetched; there a suffix array with common prefixes is built, a stack scan of it yields the
intervals of the common-prefix tree, and those whose occurrences are preceded by different bytes are the maximal repeats,
given with all their occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.segments import changes, whole_groups
from placewise.llm.text import BYTE, mix, prefix_sums, span_hash, text_blocks
from placewise.session import written

#: Bytes of a repeat, and of the strings whose least hash names a bucket.
LENGTH, GRAM = 50, 24
#: Different stretches of one bucket that one suffix array takes; those of larger buckets are compared window by window.
BUCKET = 4096
_PLACES = 21


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(document, start, windows, bucket, content)`` of each stretch of windows with one least string."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = prefix_sums(BYTE[data])
    at = np.arange(len(data) - gram + 1)
    value = span_hash(sums, at, at + gram)
    rank = (value >> np.uint64(_PLACES) << np.uint64(_PLACES)) | (at.astype(np.uint64) & np.uint64((1 << _PLACES) - 1))
    wide, reach = rank, 1
    while reach * 2 <= length - gram + 1:
        wide, reach = np.minimum(wide[:-reach], wide[reach:]), reach * 2
    least = np.minimum(wide[:n], wide[length - gram + 1 - reach :][:n])
    place = np.arange(n)
    owner = np.searchsorted(offsets, place, "right") - 1
    inside = place + length <= offsets[owner + 1]
    first = np.ones(n, bool)
    first[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(first & inside)
    ends = np.flatnonzero((np.r_[first[1:], True] | ~np.r_[inside[1:], False]) & inside) + 1
    low = least[begins] & np.uint64((1 << _PLACES) - 1)
    anchor = begins + (low.astype(np.int64) - begins) % (1 << _PLACES)
    content = mix(span_hash(sums, begins, ends + length - 1) ^ mix((anchor - begins).astype(np.uint64)))
    return owner[begins], begins - offsets[owner[begins]], ends - begins, value[anchor], content


def enhanced_suffix_array(strings: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """``(string, place, common, before)``: suffixes of at least ``length`` bytes in order, the bytes each shares with the
    one before it, and the byte that precedes it (-1 at the start of a string)."""
    sizes = np.array([len(s) for s in strings])
    width = -(-int(sizes.max(initial=1)) // 8) * 8
    flat = np.frombuffer(b"".join(s.ljust(2 * width, b"\0") for s in strings), np.uint8).reshape(len(strings), 2 * width)
    counts = np.maximum(sizes - length + 1, 0)
    string = np.repeat(np.arange(len(strings)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    left = (sizes[string] - place).astype(np.int64)
    start = string * (2 * width) + place
    keys = [np.ascontiguousarray(np.lib.stride_tricks.as_strided(flat.reshape(-1), (flat.size - 7, 8), (1, 1))[start + 8 * k]).view(">u8")[:, 0].astype(np.uint64) for k in range(width // 8)]
    order = np.lexsort((string, left, *reversed(keys)))
    common, open_ = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        differ = k[order[1:]] ^ k[order[:-1]]
        same = sum((differ < np.uint64(1 << (8 * b))).astype(np.int64) for b in range(8))
        common[1:] += np.where(open_, same, 0)
        open_ &= differ == 0
    common[1:] = np.minimum(common[1:], np.minimum(left[order[1:]], left[order[:-1]]))
    before = np.where(place > 0, flat.reshape(-1)[start - 1].astype(np.int64), -1)
    return string[order], place[order], common, before[order]


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(common bytes, first, last)`` of the common-prefix intervals of at least ``least`` bytes, by a stack scan."""
    out: list[tuple[int, int, int]] = []
    deep = np.flatnonzero(common >= least)
    for run in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1) if len(deep) else []:
        stack: list[tuple[int, int]] = []
        for i, depth in zip([*run.tolist(), int(run[-1]) + 1], [*common[run].tolist(), 0]):
            first = i - 1
            while stack and stack[-1][0] > depth:
                d, first = stack.pop()
                out.append((d, first, i - 1))
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, first))
    return out


def maximal_repeats(strings: list[bytes], length: int = LENGTH) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(bytes, strings, places)`` of each maximal repeat of ``length`` bytes or more with all its occurrences.

    An interval is one where its occurrences are preceded by different bytes or one begins a string; others belong to a
    longer repeat that begins further left.
    """
    string, place, common, before = enhanced_suffix_array(strings, length)
    out = []
    for depth, a, b in intervals(common, length):
        left = before[a : b + 1]
        if (left < 0).any() or (left != left[0]).any():
            out.append((depth, string[a : b + 1], place[a : b + 1]))
    return out


def _table(out: list[tuple[np.ndarray, ...]], names: list[str], types: list) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for t in ("i8",) * len(names)]
    return pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``id, start, n``: bytes of documents (``id, t``) that stand in a document with a smaller id too.

    Marks may overlap; together they cover exactly the bytes of strings of ``length`` bytes that also start in a document
    with a smaller id. Null ids take no part.
    """
    kind = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches; those with an equal one in a smaller document of the same block are marks already, dealt anywhere."""
        for rows in batches:
            for part, data, offsets in text_blocks(rows, "t"):
                owner, start, n, bucket, content = stretches(data, offsets, length)
                ids, b = part.column("id").to_numpy()[owner], bucket.view(np.int64)
                x = content.view(np.int64)
                order = np.lexsort((ids, x, b))
                new = np.ones(len(order), bool)
                new[1:] = (b[order][1:] != b[order][:-1]) | (x[order][1:] != x[order][:-1])
                late = np.zeros(len(order), bool)
                late[order] = ids[order] > ids[order][np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else False
                b = np.where(late, mix((ids * 1_000_003 + start).view(np.uint64)).view(np.int64), b)
                yield pa.RecordBatch.from_pydict({"late": pa.array(late), "b": pa.array(b), "id": pa.array(ids), "start": pa.array(start, pa.int64()), "n": pa.array(n, pa.int32()), "x": pa.array(x)})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches with an equal one in a smaller document are marks; the first of each kind stays where kinds differ."""
        for table in whole_groups(batches, ["b", "late"]):
            bucket_new, kind_new = changes(table, ["b", "late"]), changes(table, ["b", "late", "x"])
            ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
            first = ids[np.flatnonzero(kind_new)[np.cumsum(kind_new) - 1]]
            kinds = np.add.reduceat(kind_new.astype(np.int64), np.flatnonzero(bucket_new))[np.cumsum(bucket_new) - 1]
            mark = (first < ids) | table.column("late").to_numpy()
            keep = mark | (kinds > 1)
            part = table.filter(pa.array(keep))
            yield pa.RecordBatch.from_pydict({"b": part.column("b").combine_chunks(), "id": part.column("id").combine_chunks(), "start": part.column("start").combine_chunks(), "n": pa.array(n[keep] + length - 1, pa.int32()), "mark": pa.array(mark[keep]), "kinds": pa.array(kinds[keep])})

    found = docs.where("id IS NOT NULL").mapInArrow(cut, "late boolean, b long, id long, start long, n int, x long").repartition("b").sortWithinPartitions("b", "late", "x", "id", "start")
    found = written(found.mapInArrow(meet, "b long, id long, start long, n int, mark boolean, kinds long"), "stretches")
    mixed = found.where("NOT mark").groupBy("id").agg(F.collect_list(F.struct("b", "start", "n", "kinds")).alias("parts"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i, t, parts in zip(rows.column("id").to_pylist(), rows.column("t").to_pylist(), rows.column("parts").to_pylist()):
                raw = t.encode()
                yield pa.RecordBatch.from_pydict({"b": pa.array([p["b"] for p in parts], pa.int64()), "id": pa.array([i] * len(parts), pa.int64()), "start": pa.array([p["start"] for p in parts], pa.int64()), "kinds": pa.array([p["kinds"] for p in parts], pa.int64()), "s": pa.array([raw[p["start"] : p["start"] + p["n"]] for p in parts], pa.binary())})

    bytes_of = written(docs.join(mixed, "id").select("id", "t", "parts").mapInArrow(fetch, "b long, id long, start long, kinds long, s binary"), "parts")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["b"]):
            ids, start = table.column("id").to_numpy(), table.column("start").to_numpy()
            out = []
            for size, string, place in maximal_repeats(table.column("s").to_pylist(), length):
                later = ids[string] > ids[string].min()
                if later.any():
                    where = string[later]
                    out.append((ids[where], start[where] + place[later], np.full(len(where), size)))
            yield _table(out, ["id", "start", "n"], [kind[0], kind[1], pa.int32()])

    small = bytes_of.where(F.col("kinds") <= BUCKET).repartition("b").sortWithinPartitions("b", "id", "start").mapInArrow(search, "id long, start long, n int")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, start, s = rows.column("id").to_numpy(), rows.column("start").to_numpy(), rows.column("s").to_pylist()
            counts = np.array([max(0, len(x) - length + 1) for x in s], np.int64)
            begins = np.cumsum([0, *(len(x) for x in s)])[:-1]
            which = np.repeat(np.arange(len(s)), counts)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            at = begins[which] + place
            value = span_hash(prefix_sums(BYTE[np.frombuffer(b"".join(s), np.uint8)]), at, at + length)
            yield pa.RecordBatch.from_pydict({"w": pa.array(value.view(np.int64)), "id": pa.array(ids[which]), "start": pa.array(start[which] + place)})

    large = bytes_of.where(F.col("kinds") > BUCKET).mapInArrow(windows, "w long, id long, start long")
    firsts = large.groupBy("w").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").withColumnRenamed("w", "_w")
    late = large.join(firsts, (F.xxhash64("w") == F.xxhash64("_w")) & (F.col("w") == F.col("_w"))).where("id > first").select("id", "start", F.lit(length).alias("n"))
    return found.where("mark").select("id", "start", "n").unionByName(small).unionByName(late)


def dedupe(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, n_bytes, n_removed, n_spans, kept``: documents with what is left of their bytes, ``kept`` (binary).

    Every byte goes that is covered by a string of ``length`` bytes which also starts in a document with a smaller key;
    matches are judged on the input and never cross documents. A null text is empty. Rows with a null key are left as
    they are. A key names one text: rows that repeat key and text have equal results; where a key has several texts, what is
    found in one is cut from the others as far as they reach.
    """
    held = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    marks = repeats(held, length)

    def join_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["id"]):
            ids, start = table.column("id").to_numpy(), table.column("start").to_numpy()
            end = start + table.column("n").to_numpy()
            new = changes(table, ["id"])
            base = np.cumsum(new).astype(np.int64) << 40
            reach = np.maximum.accumulate(base + end)
            first = new | (base + start > np.r_[0, reach[:-1]])
            begins = np.flatnonzero(first)
            lasts = np.r_[begins[1:], len(ids)] - 1
            docs_at = np.flatnonzero(new[begins])
            bounds = np.r_[docs_at, len(begins)].astype(np.int32)
            spans = np.empty(2 * len(begins), np.int64)
            spans[0::2], spans[1::2] = start[begins], (reach - base)[lasts]
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[begins[docs_at]]), "spans": pa.ListArray.from_arrays(pa.array(2 * bounds), pa.array(spans))})

    spans = marks.repartition("id").sortWithinPartitions("id", "start").mapInArrow(join_marks, "id long, spans array<long>")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[tuple] = []
            for t, s in zip(rows.column("t").to_pylist(), rows.column("spans").to_pylist()):
                raw, at, left = t.encode(), 0, []
                s = [min(x, len(raw)) for x in s or []]
                for a, b in zip(s[0::2], s[1::2]):
                    left.append(raw[at:a])
                    at = b
                left.append(raw[at:])
                out.append((len(raw), sum(b - a for a, b in zip(s[0::2], s[1::2])), len(s) // 2, b"".join(left)))
            n, gone, number, kept = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"id": rows.column("id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(number, pa.int64()), "kept": pa.array(kept, pa.binary())})

    out = held.join(spans.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("id", "t", "spans")
    return out.mapInArrow(strip, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", key)
