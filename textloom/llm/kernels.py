"""Vectorised kernels over Arrow string columns.

Every kernel works on the UTF-8 buffers of a record batch, cut into chunks of whole texts, so the memory in use
follows the chunk (or the one text that is longer than a chunk) and not the partition. Bytes are hashed in blocks of a fixed
size. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch at most: texts are of kilobytes, and batches of many megabytes stay with the JVM's and the workers'
#: allocators. Kernels work on chunks anyway.
BATCH_ROWS = 1000
#: Bytes that are hashed at a time; powers of the base are kept for twice as many.
HASH_BLOCK = 1 << 18

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * _U(pow(base, len(out), 1 << 64))])
    return out[:n]


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    return _geometric(_BASE, 2 * HASH_BLOCK), _geometric(_BASE_INVERSE, 2 * HASH_BLOCK)


def _polynomial(data: np.ndarray) -> int:
    """The sum of each byte's code times base**place; for spans longer than a block."""
    up, _ = _powers()
    total = 0
    for lo in range(0, len(data), HASH_BLOCK):
        part = data[lo : lo + HASH_BLOCK]
        total += int((_BYTE_CODES[part] * up[: len(part)]).sum()) * pow(_BASE, lo, 1 << 64)
    return total % (1 << 64)


#: What kernels keep in a worker between partitions, by owner: how to drop it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """Says how to drop what owner keeps in this worker. It is dropped when a kernel of another owner runs."""
    _KEPT[owner] = drop


def trim() -> None:
    """Gives freed memory back to the system, which Python workers that are used again would keep otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object, owner: str = "") -> DataFrame:
    """df.mapInArrow(run, schema), with workers that keep nothing of it but what owner says. Names of columns may have dots.

    The session's batches are made smaller, to BATCH_ROWS rows, if they are larger: it is read when the plan runs.
    """
    names, key = df.columns, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other, drop in _KEPT.items():
            if other != owner:
                drop()
        try:
            yield from run(batch.rename_columns(names) for batch in batches)
        finally:
            trim()

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(ran, schema)


@dataclass
class Texts:
    """A run of whole texts: their bytes, and where each begins."""

    first: int  # row of the batch
    data: np.ndarray  # uint8
    offs: np.ndarray  # int64, one more than texts

    def __len__(self) -> int:
        return len(self.offs) - 1

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span, by its content only; spans in the order of their starts."""
        up, down = _powers()
        out = np.empty(len(starts), np.uint64)
        for lo in range(0, len(self.data), HASH_BLOCK):
            a, b = np.searchsorted(starts, (lo, lo + HASH_BLOCK))
            if a == b:
                continue
            s, e = starts[a:b] - lo, ends[a:b] - lo
            long = e >= 2 * HASH_BLOCK
            part = self.data[lo : lo + (int(e[~long].max()) if not long.all() else 0)]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE_CODES[part] * up[: len(part)], out=sums[1:])
            within = np.where(long, s, e) if long.any() else e
            inside = np.minimum(s, len(part)) if long.any() else s
            out[a:b] = (sums[np.minimum(within, len(part))] - sums[inside]) * down[s]
            for k in np.flatnonzero(long):
                out[a + k] = _polynomial(self.data[starts[a + k] : ends[a + k]])
        rest = np.searchsorted(starts, len(self.data))
        out[rest:] = 0  # empty spans at the very end
        return mix(out + (ends - starts).astype(np.uint64))

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask holds."""
        return np.diff(np.searchsorted(np.flatnonzero(mask), self.offs))


@dataclass
class Words:
    """Words of Texts: maximal runs of bytes outside space and tab to carriage return."""

    starts: np.ndarray
    ends: np.ndarray
    offs: np.ndarray  # first word of each text, one more than texts

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1, dtype=np.int32), np.diff(self.offs))

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many words of each text the mask holds."""
        return np.diff(np.searchsorted(np.flatnonzero(mask), self.offs))


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The column's texts in order, as runs of about ``most`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offs, offs[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield Texts(lo, whole[offs[lo] : offs[hi]], (offs[lo : hi + 1] - offs[lo]).astype(np.int64))
        lo = hi


def white(texts: Texts) -> np.ndarray:
    return _WHITE[texts.data]


def words(texts: Texts) -> Words:
    n = len(texts.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(texts) + 1, np.int64))
    ink = ~white(texts)
    edge = texts.offs[:-1]
    edge = edge[edge < n]  # texts that begin at a byte
    begins = np.empty(n, bool)  # a word begins at each of these bytes
    begins[0] = ink[0]
    np.logical_and(ink[1:], ~ink[:-1], out=begins[1:])
    begins[edge] = ink[edge]
    starts = np.flatnonzero(begins)
    ends = begins  # the same array: a word ends after each of these bytes
    ends[-1] = ink[-1]
    np.logical_and(ink[:-1], ~ink[1:], out=ends[:-1])
    before = edge[edge > 0] - 1
    ends[before] = ink[before]
    return Words(starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, texts.offs))


def lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text of every line; lines are what line feeds part, so a text has one at least."""
    cuts = np.flatnonzero(texts.data == 10)
    of = np.searchsorted(texts.offs, cuts, "right") - 1
    per = np.bincount(of, minlength=len(texts)) + 1
    text_of = np.repeat(np.arange(len(texts)), per)
    first = np.cumsum(per) - per
    starts, ends = np.empty(len(text_of), np.int64), np.empty(len(text_of), np.int64)
    is_first = np.zeros(len(text_of), bool)
    is_first[first] = True
    is_last = np.zeros(len(text_of), bool)
    is_last[first + per - 1] = True
    starts[is_first], starts[~is_first] = texts.offs[:-1], cuts + 1
    ends[is_last], ends[~is_last] = texts.offs[1:], cuts
    return starts, ends, text_of


def windows(hashes: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k words in a row, and its first word, never across texts."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.ones(n, bool)  # the window is within its text
    for end in offs[1:][np.diff(offs) > 0].tolist():
        whole[max(0, end - k + 1) : end] = False
    at = np.flatnonzero(whole)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _U(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out[at] if len(at) < n else out), at


def occurrences(group: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    """Of each item, how many equal ones of its group come before it; without groups, of all. In 32 bits, as are positions of a
    text's words."""
    order = np.argsort(values, kind="stable") if group is None else np.lexsort((values, group))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for part in (values, group):
        if part is not None:
            part = part[order]
            new[1:] |= part[1:] != part[:-1]
    start = np.flatnonzero(new).astype(np.int32)
    rank = np.arange(len(order), dtype=np.int32)
    rank -= np.repeat(start, np.diff(np.append(start, np.int32(len(order)))))
    out = np.empty(len(order), np.int32)
    out[order] = rank
    return out
