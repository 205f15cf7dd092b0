"""Whole texts as NumPy arrays inside tasks: blocks of bytes, words, shingles.

Every function takes the UTF-8 bytes of a block of documents, laid end to end, and the offsets of the documents in
them. A block is cut by bytes, so memory depends on the longest single document and on nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once.
BLOCK_BYTES = 1 << 20

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    #: A random odd value for each byte, and the same with A-Z taken as a-z.
    BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD) | np.uint64(1)
    LOWER_BYTE = BYTE.copy()
    LOWER_BYTE[65:91] = BYTE[97:123]
    _INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
    _STEP = mix(np.arange(1, 9, dtype=np.uint64) * _GOLD) | np.uint64(1)

#: Bytes that part words: space, and tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES)
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which :func:`span_hash` takes the hash of any span."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=sums[1:], dtype=np.uint64)
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans, the same wherever the span stands."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def text_blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes of their texts and the offsets of the texts; a null text is empty."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_string())
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, and how many words come before each document."""
    inside = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = span_hash(prefix_sums(LOWER_BYTE[data]), starts, ends)
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words and how many come before each document.

    A document of fewer words has its whole sequence as its only one; a document without words has none.
    """
    counts = np.diff(bounds)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.zeros(len(bounds), np.int64)
    np.cumsum(made, out=offsets[1:])
    owner = np.repeat(np.arange(len(counts)), made)
    at = bounds[:-1][owner] + np.arange(offsets[-1]) - offsets[:-1][owner]
    length = np.minimum(counts[owner], width)
    total = length.astype(np.uint64) * _GOLD
    for k in range(width):
        here = length > k
        total[here] += hashes[at[here] + k] * _STEP[k]
    return mix(total), offsets


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each document, ascending."""
    runs, at = shingles(*words(data, offsets), width)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        s = np.sort(runs[a:b])
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if b > a else s)
    return out


def spare(name: str, columns: list[str]) -> str:
    """``name``, made longer until none of ``columns`` has it, so that a caller's columns may have any names."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name
