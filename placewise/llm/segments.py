"""Groups of a sorted partition, one after another, however they fall into Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def changes(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row's keys differ from those of the row before; the first row counts as different."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for k in keys:
        values = rows.column(k).to_numpy()
        out[1:] |= values[1:] != values[:-1]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups: what may go on in the next batch is held back."""
    held: list[pa.RecordBatch] = []
    for rows in batches:
        if not rows.num_rows:
            continue
        table = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), rows]) if held else pa.Table.from_batches([rows])
        begins = np.flatnonzero(changes(table.combine_chunks(), keys)) - bool(held)
        last = begins[-1]
        if last > 0 or (held and last == 0):
            yield pa.Table.from_batches([*held, rows.slice(0, last)]).combine_chunks()
            held = []
        held.append(rows.slice(max(last, 0)))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Each group as a table."""
    for table in whole_groups(batches, keys):
        begins = np.append(np.flatnonzero(changes(table, keys)), table.num_rows)
        for a, b in zip(begins[:-1], begins[1:]):
            yield table.slice(a, b - a)
