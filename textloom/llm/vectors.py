"""What operators over columns of vectors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a list column, by length: their rows, and a matrix of doubles.

    Vectors that are null or empty, or hold null or non-finite components, are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    size = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    first = np.cumsum(size) - size
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        part = values[first[rows][:, None] + np.arange(n)]
        sound = np.isfinite(part).all(1)
        if sound.any():
            yield rows[sound], part[sound]


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of the batches in tables of about ``most`` rows: small batches cost a kernel more than their rows do."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` rows that end where the first ``keys`` columns change; rows come sorted by them."""
    held: list[pa.Table] = []
    rows = 0
    for table in gathered(batches, max(1, most // 4)):
        named = np.column_stack([table.column(k).to_numpy() for k in range(keys)])
        if held:
            held.append(table)
            rows += len(table)
        else:
            held, rows = [table], len(table)
        if rows < most:
            continue
        change = np.flatnonzero((named[1:] != named[:-1]).any(1))
        if not len(change):
            continue
        cut = rows - len(table) + int(change[-1]) + 1
        everything = pa.concat_tables(held).combine_chunks()
        yield everything.slice(0, cut)
        held, rows = [everything.slice(cut)], rows - cut
    if held:
        yield pa.concat_tables(held).combine_chunks()


def pairs_within(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of equal neighbours' groups, as arrays, every pair once: those of distance 1, 2 and so on."""
    left = np.arange(len(group))
    step = 0
    while len(left):
        step += 1
        left = left[left + step < len(group)]
        left = left[group[left] == group[left + step]]
        if len(left):
            yield left, left + step


def group_numbers(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each run of equal rows."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)
