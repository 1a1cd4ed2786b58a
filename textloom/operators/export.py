"""Compact columns: row-wise deltas in fixed point, string blobs, interval lists, and a flat file of named arrays."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINEST, STEP_LIMIT = 8192, 65535


def delta_scale(rows: DataFrame, xs: str = "xs") -> DataFrame:
    """The finest power of two, FINEST at most, whose largest step fits 16 bits; one row. rows: arrays of rising positions."""
    steps = F.zip_with(xs, F.concat(F.array(F.lit(0.0)), xs), lambda x, before: x - before)
    most = F.max(F.array_max(F.filter(steps, lambda s: s.isNotNull())))
    top = rows.agg(F.coalesce(most, F.lit(0.0)).alias("most"))
    scales = F.filter(F.array(*(F.lit(float(FINEST >> k)) for k in range(FINEST.bit_length()))), lambda s: F.col("most") * s < STEP_LIMIT)
    return top.select(F.coalesce(F.get(scales, F.lit(0)), F.lit(1.0)).alias("scale"))


def deltas(xs: Column, scale: Column) -> Column:
    """Steps of a row's positions, rounded (half to even) before they are subtracted; the first is absolute."""
    fixed = F.transform(xs, lambda x: F.bround(x * scale).cast("long"))
    before = F.concat(F.array(F.lit(0).cast("long")), fixed)  # one more than there are positions
    return F.slice(F.zip_with(fixed, before, lambda x, last: x - last), 1, F.size(xs))


def undone(steps: Column, scale: Column) -> Column:
    """Positions from steps: running sums over the scale."""
    sums = F.aggregate(steps, F.array().cast("array<bigint>"), lambda a, d: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + d)))
    return F.transform(sums, lambda s: s / scale)


def string_offsets(rows: DataFrame, order: str, text: str) -> DataFrame:
    """Where each string begins in the blob of all, in bytes of the book charset: one for each character that is left of it."""
    from textloom.functions.text import book_charset
    from textloom.operators.lines import running

    return running(rows.withColumn("__bytes", F.length(book_charset(F.col(text))).cast("long")), order, "__bytes", "off").drop("__bytes")


def bands(curves: DataFrame, most: int = 32) -> DataFrame:
    """glyph, n: the number of bands (up to most) whose fullest band holds the fewest curves, the smallest of equals.

    curves: glyph, low, high in 0 to 1. A curve is in each band that it meets; one count for each glyph, n and band.
    """
    tried = curves.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most))))
    low = F.least(F.greatest(F.floor(F.col("low") * F.col("n")), F.lit(0)), F.col("n") - 1)
    high = F.least(F.greatest(F.floor(F.col("high") * F.col("n")), F.lit(0)), F.col("n") - 1)
    full = tried.withColumn("band", F.explode(F.sequence(low, high))).groupBy("glyph", "n", "band").agg(F.count("*").alias("c"))
    worst = full.groupBy("glyph", "n").agg(F.max("c").alias("most"))
    return worst.groupBy("glyph").agg(F.min(F.struct("most", "n")).alias("b")).select("glyph", F.col("b.n").alias("n"), F.col("b.most").alias("fullest"))


def band_totals(curves: DataFrame, most: int = 32) -> DataFrame:
    """One row: glyphs, bands and curves in all, and how many curves the fullest band holds."""
    chosen = bands(curves, most).agg(F.count("*").alias("glyphs"), F.sum("n").alias("bands"), F.max("fullest").alias("fullest"))
    return chosen.crossJoin(curves.agg(F.count("*").alias("curves")))  # one row each


def band_lists(curves: DataFrame, n: int) -> DataFrame:
    """glyph, band, list: the curves that meet each band, by falling far end."""
    low = F.least(F.greatest(F.floor(F.col("low") * n), F.lit(0)), F.lit(n - 1))
    high = F.least(F.greatest(F.floor(F.col("high") * n), F.lit(0)), F.lit(n - 1))
    met = curves.withColumn("band", F.explode(F.sequence(low, high)))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("high")).alias("far"), "curve")))
    return met.groupBy("glyph", "band").agg(F.transform(ordered, lambda x: x["curve"]).alias("list"))


#: The flat file's magic and version, entry size and alignment, and its type codes (fixed values).
MAGIC, VERSION, ENTRY, ALIGN = b"BTAT", 1, 96, 64
CODES = {"uint8": "u1", "uint16": "u2", "uint32": "u4", "uint64": "u8", "int32": "i4", "float32": "f4", "float64": "f8"}


def bundle(arrays: dict[str, np.ndarray]) -> bytes:
    """A flat file of named arrays, little endian, each at a multiple of ALIGN, names in order."""
    def padded(n: int) -> int:
        return -(-n // ALIGN) * ALIGN

    at = padded(16 + ENTRY * len(arrays))
    table, body = [struct.pack("<4sIII", MAGIC, VERSION, len(arrays), 0)], []
    for name in sorted(arrays):
        a = np.ascontiguousarray(arrays[name])
        data = a.astype(a.dtype.newbyteorder("<")).tobytes()
        shape = (*a.shape, 1, 1, 1)[:3]
        table.append(struct.pack("<48s4sI3QQQ", name.encode(), CODES[a.dtype.name].encode(), a.ndim, *shape, at, len(data)).ljust(ENTRY, b"\0"))
        body.append(data.ljust(padded(len(data)), b"\0"))
        at += padded(len(data))
    return b"".join(table).ljust(padded(16 + ENTRY * len(arrays)), b"\0") + b"".join(body)


def unbundle(data: bytes) -> dict[str, np.ndarray]:
    """The named arrays of a flat file, with their types checked."""
    magic, version, count, _ = struct.unpack_from("<4sIII", data)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a flat file of this version")
    names = {c: n for n, c in CODES.items()}
    out = {}
    for k in range(count):
        name, code, dims, a, b, c, at, size = struct.unpack_from("<48s4sI3QQQ", data, 16 + ENTRY * k)
        kind = np.dtype(names[code.rstrip(b"\0").decode()]).newbyteorder("<")
        out[name.rstrip(b"\0").decode()] = np.frombuffer(data, kind, size // kind.itemsize, at).reshape((a, b, c)[:dims])
    return out


def tables(frames: dict[str, DataFrame], orders: dict[str, Sequence[str]], types: dict[str, str]) -> dict[str, np.ndarray]:
    """Columns of small tables as named arrays (table_column), in the given order: the viewer's file is one process's food.

    Only the columns that types names are read. A column of type "strings" becomes two arrays, see ``strings``.
    """
    out: dict[str, np.ndarray] = {}
    for name, frame in frames.items():
        wanted = [c for c in frame.columns if f"{name}_{c}" in types]
        rows = frame.orderBy(*orders[name]).select(*wanted).toArrow()
        for c in wanted:
            kind = types[f"{name}_{c}"]
            if kind == "strings":
                out[f"{name}_{c}"], out[f"{name}_{c}_off"] = strings(rows[c].to_pylist())
            else:
                out[f"{name}_{c}"] = rows[c].to_numpy().astype(kind)
    return out


def strings(values: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Strings as one run of bytes in the charset of books, and where each begins, with the end; what it lacks is a question mark."""
    coded = [(v or "").encode("cp1252", "replace") for v in values]
    return np.frombuffer(b"".join(coded), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in coded], dtype=np.int64)]).astype(np.uint32)


def scheme(colours: dict[str, Sequence[str]]) -> dict[str, np.ndarray]:
    """Colours (rrggbb) by name, as arrays scheme_name of three bytes each."""
    return {f"scheme_{name}": np.array([list(bytes.fromhex(c.lstrip("#"))) for c in values], np.uint8).reshape(-1, 3) for name, values in colours.items()}


def write_bundle(spark, path: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes a flat file through Spark's file systems, so the path may be in any store; packed if the path ends in .gz."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        data = bundle(arrays)
        stream.write(bytearray(gzip.compress(data, 9, mtime=0) if path.endswith(".gz") else data))
    finally:
        stream.close()


def read_bundle(spark, path: str) -> dict[str, np.ndarray]:
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return unbundle(gzip.decompress(data) if path.endswith(".gz") else data)


def run_starts(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Is each row the first of a run of equal values?"""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("starts", ~before.eqNullSafe(F.col(value)))
