"""Flat files of named arrays as a Spark data source: tasks write at places that are known before, and read byte ranges.

A file begins with a header and an entry for each array, see ``operators.export``; the arrays follow, each at a multiple of ALIGN.
``write`` takes slices of arrays in any order. Spark sums their sizes, the driver makes the header, and every task writes its
slices where they belong: a task that is run again writes the same bytes at the same places. The file has its name only once all are
there. ``read`` gives one array as rows, a partition for each byte range.

The folder must be one that the driver and all executors have mounted, and whose files can be written at any place.
"""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from textloom.operators.export import ALIGN, CODES, ENTRY, MAGIC, VERSION

FORMAT = "textloom_flat"
#: Bytes of a partition that is read, and rows of a batch.
RANGE, BATCH = 8 << 20, 1 << 16
_HEAD = "<4sIII"
_FIELDS = "<48s4sI3QQQ"
_KINDS = {code: name for name, code in CODES.items()}


@dataclass(frozen=True)
class Entry:
    """An array of a flat file: its type, its shape, and where its bytes are."""

    name: str
    kind: str
    shape: tuple[int, ...]
    at: int
    size: int


def local(path: str) -> str:
    """The mounted path of a file URL."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: flat files are written at places of their own, which needs a mounted folder")
    return unquote(url.path) if url.scheme else path


def _padded(n: int) -> int:
    return -(-n // ALIGN) * ALIGN


def laid_out(arrays: Mapping[str, tuple[str, tuple[int, ...], int]]) -> list[Entry]:
    """Entries of arrays (type, shape, bytes) in the order of their names, each behind the one before."""
    out, at = [], _padded(struct.calcsize(_HEAD) + ENTRY * len(arrays))
    for name in sorted(arrays):
        kind, shape, size = arrays[name]
        out.append(Entry(name, kind, shape, at, size))
        at = _padded(at + size)
    return out


def header(entries: list[Entry]) -> bytes:
    rows = [struct.pack(_FIELDS, e.name.encode(), CODES[e.kind].encode(), len(e.shape), *(*e.shape, 1, 1, 1)[:3], e.at, e.size).ljust(ENTRY, b"\0") for e in entries]
    whole = struct.pack(_HEAD, MAGIC, VERSION, len(entries), 0) + b"".join(rows)
    return whole.ljust(_padded(len(whole)), b"\0")


def entries(path: str) -> dict[str, Entry]:
    """The arrays of a flat file, from its header alone."""
    with open(local(path), "rb") as file:
        magic, version, count, _ = struct.unpack(_HEAD, file.read(struct.calcsize(_HEAD)))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"{path} is not a flat file of this version")
        out = {}
        for _ in range(count):
            name, code, dims, a, b, c, at, size = struct.unpack(_FIELDS, file.read(ENTRY)[: struct.calcsize(_FIELDS)])
            name = name.rstrip(b"\0").decode()
            out[name] = Entry(name, _KINDS[code.rstrip(b"\0").decode()], (a, b, c)[:dims], at, size)
    return out


class Writer(DataSourceArrowWriter):
    """Writes rows of offset, data into a file that is there already in full size, and gives it its name in the end."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.path = local(options["path"])
        self.open = f"{self.path}.open"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        with open(self.open, "r+b") as file:
            for batch in iterator:
                for offset, data in zip(batch.column("offset").to_pylist(), batch.column("data"), strict=True):
                    file.seek(offset)
                    file.write(data.as_buffer())
            file.flush()
            os.fsync(file.fileno())
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        os.replace(self.open, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.open):
            os.remove(self.open)


@dataclass
class Range(InputPartition):
    at: int
    size: int
    first: int


class Reader(DataSourceReader):
    """place, value of an array's numbers."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.path = local(options["path"])
        self.entry = entries(self.path)[options["array"]]
        self.kind = np.dtype(self.entry.kind).newbyteorder("<")
        self.range = max(1, int(options.get("range", RANGE)) // self.kind.itemsize) * self.kind.itemsize

    def partitions(self) -> list[InputPartition]:
        cuts = range(0, self.entry.size, self.range)
        return [Range(self.entry.at + k, min(self.range, self.entry.size - k), k // self.kind.itemsize) for k in cuts] or [Range(self.entry.at, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        wide = np.float64 if self.kind.kind == "f" else np.int64
        with open(self.path, "rb") as file:
            file.seek(partition.at)
            place, left = partition.first, partition.size
            while left:
                data = np.frombuffer(file.read(min(left, BATCH * self.kind.itemsize)), self.kind)
                yield pa.record_batch({"place": pa.array(np.arange(place, place + len(data), dtype=np.int64)), "value": pa.array(data.astype(wide))})
                place, left = place + len(data), left - data.nbytes


class FlatFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        kind = entries(self.options["path"])[self.options["array"]].kind
        return f"place bigint, value {'double' if kind.startswith('float') else 'bigint'}"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options)


def write(slices: DataFrame, path: str, arrays: Mapping[str, tuple[str, int]] | None = None) -> list[Entry]:
    """Writes slices (name, kind, width, first, data) of arrays as a flat file: data holds rows of width numbers, the first of which
    is row ``first`` of the array. Slices of an array must leave no gaps; width 0 stands for an array of one dimension.

    arrays: type and width of arrays that are there even if they have no rows. Slices are read twice: store what is costly.
    """
    spark = slices.sparkSession
    spark.dataSource.register(FlatFile)
    sizes = slices.groupBy("name", "kind", "width").agg(F.sum(F.octet_length("data")).alias("size")).collect()  # one row an array
    found: dict[str, tuple[str, tuple[int, ...], int]] = {n: (kind, (0, width) if width else (0,), 0) for n, (kind, width) in (arrays or {}).items()}
    for s in sizes:
        if s["name"] in found and found[s["name"]][2]:
            raise ValueError(f"{s['name']}: slices of several types")
        rows = s["size"] // np.dtype(s["kind"]).itemsize // max(1, s["width"])
        found[s["name"]] = (s["kind"], (rows, s["width"]) if s["width"] else (rows,), s["size"])
    laid = laid_out(found)
    target = local(path)
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with open(f"{target}.open", "wb") as file:
        file.write(header(laid))
        file.truncate(_padded(laid[-1].at + laid[-1].size) if laid else file.tell())
    places = spark.createDataFrame([(e.name, e.at, np.dtype(e.kind).itemsize * max(1, *e.shape[1:], 1)) for e in laid], "name string, at long, step long")
    placed = slices.join(F.broadcast(places), "name").select((F.col("at") + F.col("first") * F.col("step")).alias("offset"), "data")  # one row an array
    placed.write.format(FORMAT).mode("append").option("path", target).save()
    return laid


def read(spark: SparkSession, path: str, array: str, range_: int = RANGE) -> DataFrame:
    """place, value of one array, a partition for each range of bytes."""
    spark.dataSource.register(FlatFile)
    return spark.read.format(FORMAT).option("array", array).option("range", str(range_)).load(path)


def together(parts: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def closed(rows: DataFrame, place: str, begin: str, size: str) -> DataFrame:
    """place, begin of the rows, and one more behind them: where the last one ends."""
    end = rows.agg((F.coalesce(F.max(place), F.lit(-1)) + 1).cast("long").alias(place), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias(begin))  # one row
    return rows.select(place, F.col(begin).cast("long").alias(begin)).unionByName(end)


def slices(rows: DataFrame, place: str, arrays: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Slices of arrays from columns: arrays has name: (column, type); place numbers the rows from 0, without gaps.

    Columns of arrays give arrays of two dimensions. Each task packs the runs of places that it has.
    """
    names, wide = list(arrays), {f.name: f.dataType.typeName() == "array" for f in rows.schema.fields}
    columns = [arrays[n][0] for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
            for name, values in zip(names, batch.columns[1:], strict=True):
                column, kind = arrays[name]
                width = 0
                if wide[column]:
                    width = len(values[0]) if len(values) else 0
                    values = values.flatten()
                data = values.to_numpy(zero_copy_only=False).astype(np.dtype(kind).newbyteorder("<")).reshape(len(at), -1)
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if hi > lo:
                        yield pa.record_batch({"name": [name], "kind": [kind], "width": pa.array([width], pa.int32()), "first": [int(at[lo])], "data": [data[lo:hi].tobytes()]})

    dealt = rows.select(place, *(F.col(c).alias(f"c{k}") for k, c in enumerate(columns))).repartitionByRange(place).sortWithinPartitions(place)
    return dealt.mapInArrow(run, "name string, kind string, width int, first long, data binary")


def text_slices(rows: DataFrame, place: str, name: str, text: str, offsets_name: str | None = "", offsets_kind: str = "uint32") -> DataFrame:
    """Slices of strings as the arrays name (bytes of the charset of books, a question mark for what it lacks) and name_off (where
    each begins, and the end), which may have another name, or none and be left out."""
    from textloom.functions.text import book_charset
    from textloom.operators.lines import running

    told = rows.select(place, book_charset(F.coalesce(F.col(text), F.lit(""))).alias("__text"))
    told = running(told.withColumn("__size", F.length("__text").cast("long")), place, "__size", "__off")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                coded = [t.encode("cp1252", "replace") for t in batch.column(1).to_pylist()]
                yield pa.record_batch({"name": [name], "kind": ["uint8"], "width": pa.array([0], pa.int32()), "first": [batch.column(0)[0].as_py()], "data": [b"".join(coded)]})

    blob = told.select("__off", "__text", place).repartitionByRange(place).sortWithinPartitions(place).drop(place).mapInArrow(run, "name string, kind string, width int, first long, data binary")
    if offsets_name is None:
        return blob
    return blob.unionByName(slices(closed(told, place, "__off", "__size"), place, {offsets_name or f"{name}_off": ("__off", offsets_kind)}))
