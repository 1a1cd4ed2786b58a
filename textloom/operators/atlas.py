"""An index and its layout as the arrays of one flat file: what a viewer reads, without a parser.

Every table is numbered once, in the order that the file has (directories and files in pre-order, lines, rows and items by file),
and each array is packed by the tasks that hold its rows. The driver sees sizes only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import index, layout, order, tree
from textloom.operators.lines import ranked, running
from textloom.session import cut
from textloom.sources import flat

#: Types and widths of arrays that are there even in an empty corpus (fixed values).
ARRAYS = {
    "chars": ("uint8", 0), "kinds": ("uint8", 0), "line_off": ("uint64", 0), "line_file": ("uint32", 0), "line_indent": ("uint16", 0), "line_len": ("uint16", 0),
    "file_line0": ("uint32", 0), "file_chars": ("uint32", 0), "file_dir": ("uint32", 0), "item_file": ("uint32", 0), "item_start": ("uint32", 0), "item_end": ("uint32", 0), "item_kind": ("uint8", 0),
    "world": ("float64", 0), "dir_rect": ("float64", 4), "dir_pad": ("float64", 0), "dir_depth": ("uint16", 0), "dir_hue": ("uint8", 0), "dir_parent": ("int32", 0),
    "file_rect": ("float64", 4), "file_pitch": ("float64", 0), "file_colw": ("float64", 0), "file_cols": ("uint16", 0), "file_cap": ("uint16", 0), "file_hue": ("uint8", 0), "file_rows": ("uint32", 0), "file_row0": ("uint32", 0),
    "line_row0": ("uint32", 0), "row_line": ("uint32", 0), "row_col0": ("uint16", 0), "row_len": ("uint16", 0), "row_pos": ("float32", 2), "item_rect": ("float32", 4), "item_rect_item": ("uint32", 0),
}


def _box(*names: str) -> Column:
    return F.array(*(F.col(n) for n in names))


def numbered_dirs(dirs: DataFrame) -> DataFrame:
    """dirs (path, ...) with dir_id, in pre-order, and their parents' as parent_id; -1 for the root."""
    key = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/"))
    placed = cut(ranked(dirs, [key], "dir_id").withColumn("dir_id", F.col("dir_id").cast("long")))
    above = placed.select(F.col("path").alias("__above"), F.col("dir_id").alias("parent_id"))
    named = placed.withColumn("__above", F.when(F.col("path") != "", tree.parent_path(F.col("path"))))
    return named.join(above, "__above", "left").drop("__above").fillna(-1, ["parent_id"])


def slices(indexed: Mapping[str, DataFrame], laid: Mapping[str, DataFrame], name: str, colours: Mapping[str, Sequence[str]], tint_label: str = "") -> DataFrame:
    """All arrays of an index (files, lines, items) and its layout (dirs, files, rows, item_rects), as slices for ``flat.write``.

    colours: lists of rrggbb by name. Files may have a tint. The file has its strings in the charset of books.
    """
    spark = laid["files"].sparkSession
    dirs = cut(numbered_dirs(laid["dirs"]))
    tags = tree.tags(dirs.select("path", F.when(F.col("path") != "", tree.parent_path(F.col("path"))).alias("parent"), "depth", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), "pad"))
    dirs = cut(dirs.join(tags, "path", "left").withColumns({"label": F.when(F.col("path") == "", F.lit(name)).otherwise(F.element_at(F.split("path", "/"), -1)), "rect": _box("x0", "y0", "x1", "y1")}))

    heads = indexed["files"].drop("weight").join(laid["files"].drop("path", "n", "lines", "weight"), "file_id")
    heads = running(heads, "file_id", "lines", "line0")
    own = laid["rows"].groupBy("file_id").agg(F.count("*").alias("own_rows"))
    heads = running(heads.join(own, "file_id", "left").fillna(0, ["own_rows"]), "file_id", "own_rows", "row0")
    owners = dirs.select(F.col("path").alias("dir"), "dir_id")
    heads = running(heads.withColumn("dir", tree.parent_path(F.col("path"))).join(owners, "dir").withColumn("one", F.lit(1)), "file_id", "one", "file_no")
    heads = cut(heads.withColumns({"file_no": F.col("file_no").cast("long"), "rect": _box("x0", "y0", "x1", "y1"), "wide": F.col("colw") * (1 + layout.GAP)}))
    at = heads.select("file_id", "file_no", "line0", "row0")

    lines = indexed["lines"].join(at, "file_id").withColumn("place", (F.col("line0") + F.col("line_no")).cast("long"))
    lines = cut(lines.withColumn("marks", F.array_join(F.transform("kinds", lambda r: F.repeat(F.chr(r["kind"]), r["n"])), "")))
    rows = laid["rows"].join(at, "file_id").withColumns({"place": (F.col("row0") + F.col("row_in_file")).cast("long"), "line": (F.col("line0") + F.col("line_no")).cast("long"), "pos": _box("x", "y")})
    rows = cut(rows)
    per_line = running(rows.groupBy("line").agg(F.count("*").alias("n")), "line", "n", "line_row0")

    items = ranked(indexed["items"].join(at, "file_id"), ["file_no", "first", "past", "kind", "name"], "item_no").withColumn("item_no", F.col("item_no").cast("long"))
    items = cut(items.withColumn("item_id", F.concat_ws(":", "file_id", "first", "past", "name")))
    words = index.item_words(indexed["items"], indexed["lines"], indexed["files"]).withColumn("item_id", F.concat_ws(":", "file_id", "first", "past", "name")).groupBy("item_id").agg(F.first("word").alias("word"))
    items = cut(items.join(words, "item_id"))
    first = items.groupBy("item_id").agg(F.min("item_no").alias("item_no"))
    rects = ranked(laid["item_rects"].drop("file_id").join(first, "item_id"), ["item_no", "col"], "place").withColumns({"place": F.col("place").cast("long"), "rect": _box("bx0", "by0", "bx1", "by1")})

    median = order.weighted_median(heads, "pitch", "lines")
    single = {"char_aspect": layout.CHAR, "proportional": 0.0, "flat": 0.0, "median_pitch": median or 0.0}
    parts = [
        flat.slices(dirs, "dir_id", {"dir_rect": ("rect", "float64"), "dir_pad": ("pad", "float64"), "dir_depth": ("depth", "uint16"), "dir_hue": ("hue", "uint8"), "dir_parent": ("parent_id", "int32")}),
        flat.slices(heads, "file_no", {"file_rect": ("rect", "float64"), "file_pitch": ("pitch", "float64"), "file_colw": ("wide", "float64"), "file_cols": ("k", "uint16"), "file_cap": ("cap", "uint16"), "file_hue": ("hue", "uint8"), "file_rows": ("rows", "uint32"), "file_chars": ("nonspace", "uint32"), "file_dir": ("dir_id", "uint32")}),
        flat.slices(flat.closed(heads, "file_no", "line0", "lines"), "file_no", {"file_line0": ("line0", "uint32")}),
        flat.slices(flat.closed(heads, "file_no", "row0", "own_rows"), "file_no", {"file_row0": ("row0", "uint32")}),
        flat.slices(lines, "place", {"line_file": ("file_no", "uint32"), "line_indent": ("indent", "uint16"), "line_len": ("len", "uint16")}),
        flat.text_slices(lines, "place", "chars", "text", "line_off", "uint64"),
        flat.text_slices(lines, "place", "kinds", "marks", None),
        flat.slices(flat.closed(per_line, "line", "line_row0", "n"), "line", {"line_row0": ("line_row0", "uint32")}),
        flat.slices(rows, "place", {"row_line": ("line", "uint32"), "row_col0": ("col0", "uint16"), "row_len": ("row_len", "uint16"), "row_pos": ("pos", "float32")}),
        flat.slices(items, "item_no", {"item_file": ("file_no", "uint32"), "item_start": ("first", "uint32"), "item_end": ("past", "uint32"), "item_kind": ("kind", "uint8")}),
        flat.slices(rects, "place", {"item_rect": ("rect", "float32"), "item_rect_item": ("item_no", "uint32")}),
        flat.text_slices(heads, "file_no", "s_paths", "path"),
        flat.text_slices(items, "item_no", "s_item_names", "name"),
        flat.text_slices(items, "item_no", "s_item_kws", "word"),
        flat.text_slices(dirs, "dir_id", "s_dir_labels", "label"),
        flat.text_slices(dirs, "dir_id", "s_dir_tags", "tag"),
        *_singles(spark, single, {"s_name": name, "s_tint": tint_label}, colours),
    ]
    if "tint" in indexed["files"].columns:
        parts.append(flat.slices(heads, "file_no", {"file_tint": ("tint", "float32")}))
    return flat.together(parts)


def _singles(spark: SparkSession, numbers: Mapping[str, float], texts: Mapping[str, str], colours: Mapping[str, Sequence[str]]) -> list[DataFrame]:
    """Arrays of one number or string each, and of the scheme's colours, as shares of red, green and blue."""
    w, h = layout.world()
    rows = [(n, "float64", 0, [v]) for n, v in numbers.items()] + [("world", "float64", 0, [w, h])]
    rows += [(f"sc_{n}", "float32", 3, [int(c.lstrip("#")[k : k + 2], 16) / 255 for c in values for k in (0, 2, 4)]) for n, values in colours.items()]
    out = []
    for n, kind, width, values in rows:
        frame = spark.createDataFrame([(k, values[k * max(1, width) : (k + 1) * max(1, width)]) for k in range(len(values) // max(1, width))], "place long, v array<double>")
        out.append(flat.slices(frame.select("place", "v" if width else F.col("v")[0].alias("v")), "place", {n: ("v", kind)}))
    for n, text in texts.items():
        out.append(flat.text_slices(spark.createDataFrame([(0, text)], "place long, t string"), "place", n, "t"))
    return out


def export(indexed: Mapping[str, DataFrame], laid: Mapping[str, DataFrame], path: str, name: str, colours: Mapping[str, Sequence[str]], tint_label: str = "") -> list[flat.Entry]:
    """Writes an index and its layout as one flat file."""
    return flat.write(cut(slices(indexed, laid, name, colours, tint_label)), path, ARRAYS)
