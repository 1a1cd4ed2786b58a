"""Faces with advances of their own: widths, wrapping by width, positions of characters, justified rows.

An advance table is a map of fixed size (one entry for each byte from 32 to 255 of the book charset), a literal of the plan.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import layout as Y
from textloom.session import cut

STRETCH = 0.35


def advances(letters: str = " il.,;:'!|jtf", narrow: float = 0.3, wide: float = 0.55, capital: float = 0.7) -> dict[str, float]:
    """A plain stand-in for a font's table: narrow letters, capitals, and all others."""
    out = {}
    for b in range(32, 256):
        c = bytes([b]).decode("cp1252", "replace")
        out[c] = narrow if c in letters else capital if c.isupper() else wide
    return out


def char_widths(text: Column, adv: Mapping[str, float]) -> Column:
    """Advance of every character, in line heights; characters that the face lacks take a question mark's."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        widths, begins = kernel_widths(texts, adv)
        return _nested(widths, begins, texts)

    return run(text)


def kernel_widths(texts: pa.Array, adv: Mapping[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Advances of the characters of all texts, one text after the other, and where each text begins (and the last one ends)."""
    rows = [t or "" for t in texts.to_pylist()]
    places = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    face = np.full(max(map(ord, adv)) + 2, float(adv["?"]))
    face[[ord(c) for c in adv]] = list(adv.values())
    return face[np.minimum(places, len(face) - 1)], np.append(0, np.cumsum([len(t) for t in rows], dtype=np.int64))


def _nested(values: np.ndarray, begins: np.ndarray, texts: pa.Array) -> pa.Array:
    """Values as a list for each text; null for a null."""
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(values), mask=texts.is_null() if texts.null_count else None)


def line_width(text: Column, adv: Mapping[str, float]) -> Column:
    """Width of a whole line, to a billionth of its height, so that lines of the same characters have the same width. Characters of one
    advance are counted together, so a face of few advances needs a pass for each; other faces add up their characters."""
    classes: dict[float, list[str]] = {}
    for c, width in sorted(adv.items()):
        classes.setdefault(width, []).append(c)
    classes.pop(adv["?"])  # as wide as a character that the face lacks: all that is left
    if len(classes) > 8:
        return F.round(total(char_widths(text, adv)), 9)
    counts = {w: F.length(text) - F.length(F.translate(text, "".join(chars), "")) for w, chars in classes.items()}
    rest = F.length(text)
    for n in counts.values():
        rest = rest - n
    out = rest * F.lit(float(adv["?"]))
    for w, n in counts.items():
        out = out + n * F.lit(float(w))
    return F.round(out, 9)


def total(widths: Column) -> Column:
    return F.aggregate(widths, F.lit(0.0), lambda a, w: a + w)


def rows_estimate(width: Column, cap: Column, hang: Column) -> Column:
    """Rows of a line by its width, before it is wrapped."""
    return (1 + F.ceil(F.greatest(width - cap, F.lit(0.0)) / F.greatest(cap - hang, F.lit(1e-6)))).cast("long")


def kernel_breaks(widths: np.ndarray, begins: np.ndarray, caps: np.ndarray, hang: float) -> tuple[np.ndarray, np.ndarray]:
    """Columns at which the rows of all lines begin, one line after the other, and how many each line has.

    All lines take one character at a time together, longest lines first, so those that still have characters are in front. Widths
    are added up in the order of a line, as one that is read alone would add them.
    """
    sizes = np.diff(begins)
    order = np.argsort(-sizes, kind="stable")
    at, caps, left = begins[:-1][order], caps[order], -np.sort(-sizes)
    active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")
    total = np.zeros(len(order))
    for i, n in enumerate(active.tolist()):
        total[:n] += widths[at[:n] + i]
    wide = np.flatnonzero(total > caps + 1e-9)  # others are one row; the order stays
    at, caps, left = at[wide], caps[wide], left[wide]
    active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")
    open_, room = np.zeros(len(wide)), caps + 1e-9
    lines, cols = [order], [np.zeros(len(order), np.int64)]
    for i, n in enumerate(active.tolist()):
        more = open_[:n] + widths[at[:n] + i]
        full = more > room[:n]
        if i and full.any():
            new = np.flatnonzero(full)
            more[new] = widths[at[new] + i]
            room[new] = caps[new] - hang + 1e-9
            lines.append(order[wide[new]])
            cols.append(np.full(len(new), i))
        open_[:n] = more
    lines, cols = np.concatenate(lines), np.concatenate(cols)
    return cols[np.lexsort((cols, lines))], np.bincount(lines, minlength=len(sizes))


def breaks(text: Column, cap: Column, hang: float, adv: Mapping[str, float]) -> Column:
    """Columns at which a line's rows begin: a row ends where the next character would pass the column's width; further rows
    hang in."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array, caps: pa.Array) -> pa.Array:
        cols, rows = kernel_breaks(*kernel_widths(texts, adv), caps.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), hang)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rows)), pa.int32()), pa.array(cols, pa.int32()))

    return run(text, cap)


def wrapped(lines: DataFrame, adv: Mapping[str, float], hang: float = 1.0) -> DataFrame:
    """Visual rows of lines (file_id, line_no, text, cap): row_in_line, col0, row_len, row_text."""
    rows = lines.withColumn("__cols", breaks(F.col("text"), F.col("cap"), hang, adv)).select("*", F.posexplode("__cols").alias("row_in_line", "col0"))
    size = F.coalesce(F.get("__cols", F.col("row_in_line") + 1), F.length("text")) - F.col("col0")
    rows = rows.withColumn("row_len", size).withColumn("row_text", F.expr("substring(text, col0 + 1, row_len)"))
    return rows.withColumn("last_row", F.col("row_in_line") == F.size("__cols") - 1).drop("__cols")


def positions(widths: Column) -> Column:
    """x of each character of a row: the sum of the advances before it."""
    return F.transform(F.sequence(F.lit(1), F.size(widths)), lambda i: total(F.slice(widths, 1, i - 1)))


def justified(rows: DataFrame, target: Column, adv: Mapping[str, float]) -> DataFrame:
    """rows (row_text, stretch: may it be stretched?) with add (for each gap), row_width and char_x."""

    @F.arrow_udf("struct<add:double,row_width:double,char_x:array<double>>")
    def run(texts: pa.Array, stretch: pa.Array, targets: pa.Array) -> pa.Array:
        add, width, xs, begins = kernel_justified(texts, stretch.to_numpy(zero_copy_only=False).astype(bool), targets.cast(pa.float64()).to_numpy(zero_copy_only=False), adv)
        return pa.StructArray.from_arrays([pa.array(add), pa.array(width), _nested(xs, begins, texts)], ["add", "row_width", "char_x"])

    return rows.withColumn("__j", run(F.col("row_text"), F.coalesce("stretch", F.lit(False)), target.cast("double"))).select("*", "__j.*").drop("__j")


def kernel_justified(texts: pa.Array, stretch: np.ndarray, target: np.ndarray, adv: Mapping[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """add and width of each row, and x of each character: the advances before it, in order, and add for each space before it."""
    widths, begins = kernel_widths(texts, adv)
    sizes, first = np.diff(begins), begins[:-1]
    before, width = np.zeros(len(widths)), np.zeros(len(sizes))
    order = np.argsort(-sizes, kind="stable")
    left = sizes[order]
    for i, n in enumerate(np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right").tolist()):
        own = order[:n]
        before[first[own] + i] = width[own]
        width[own] += widths[first[own] + i]
    spaces = np.append(0, np.cumsum(np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32) == 32))
    gaps, extra = spaces[begins[1:]] - spaces[first], target - width
    ok = stretch & (gaps > 0) & (extra > 0) & (extra < STRETCH * np.maximum(target, 1e-9))
    add = np.where(ok, extra / np.maximum(gaps, 1), 0.0)
    xs = before + np.repeat(add, sizes) * (spaces[:-1] - np.repeat(spaces[first], sizes))
    return add, np.where(ok, target, width), xs, begins


def settled(files: DataFrame, hang: float = 1.0, rounds: int = 4, page: tuple[int, float] | None = None) -> DataFrame:
    """Columns of files whose lines wrap by width: pitch and column width at their fixed point, after at most rounds steps.

    files: w, h, n, target, and hist, an array of (width, count) of the file's lines. page: (lines, width) of a full page; every
    file is laid out as one at least. Adds k, rows, pitch, colw and capw, the width that a column holds in line heights.
    """
    fitted = Y.with_columns_fit(files) if page is None else Y.page_fit(files, page)
    wide = F.exists("hist", lambda x: x["width"] > F.col("capw"))
    fitted = fitted.withColumn("wraps", (F.col("n") > 0) & wide)

    def rows_at(cap: Column) -> Column:
        return Y.up(F.aggregate("hist", F.lit(0).cast("long"), lambda a, x: a + x["count"] * rows_estimate(x["width"], cap, F.lit(hang))), F.col("k")).cast("long")

    def step(cap: Column, _: Column) -> Column:
        new = F.col("colw") * (rows_at(cap) + 2) / F.col("h")
        return F.when(F.abs(new - cap) < 1e-9, cap).otherwise(new)

    out = fitted.withColumn("capw", F.when(F.col("wraps"), F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("capw"), step)).otherwise(F.col("capw")))
    out = out.withColumn("rows", F.when(F.col("wraps"), rows_at(F.col("capw"))).otherwise(F.col("rows")))
    out = out.withColumn("pitch", F.when(F.col("wraps"), F.col("h") / (F.col("rows") + 2)).otherwise(F.col("pitch")))
    # as a step gives it: colw / pitch is the same but for its last bit, by which a point on a character's edge finds the one before
    return out.withColumn("capw", F.when(F.col("wraps"), F.when(F.col("pitch") > 0, F.col("colw") * (F.col("rows") + 2) / F.col("h")).otherwise(0.0)).otherwise(F.col("capw"))).drop("wraps")


def repaired(files: DataFrame, lines: DataFrame, adv: Mapping[str, float], hang: float = 1.0, rounds: int = 8) -> DataFrame:
    """files (file_id, h, k, rows, pitch, colw, capw) with more rows, and so a lower pitch, where the exact wrap of their lines
    (file_id, text) needs them. Only files that overflow are wrapped again, rounds times at most."""
    files = cut(files)
    asked = files
    for _ in range(rounds):
        met = lines.select("file_id", "text").join(asked.select("file_id", "capw"), "file_id")
        rows = met.select("file_id", F.size(breaks(F.col("text"), F.col("capw"), hang, adv)).alias("__rows"))
        need = rows.groupBy("file_id").agg(F.sum("__rows").alias("all"))
        over = asked.join(need, "file_id").withColumn("need", Y.up(F.col("all"), F.col("k")).cast("long")).where("need > rows")
        over = over.withColumn("rows", F.col("need")).withColumn("pitch", F.col("h") / (F.col("rows") + 2))
        asked = cut(over.withColumn("capw", F.col("colw") * (F.col("rows") + 2) / F.col("h")).select(files.columns))
        if asked.isEmpty():
            break
        files = cut(files.join(asked.select("file_id"), "file_id", "left_anti").unionByName(asked))
    return files


def col_offset(row: Column, width: Column, col: Column) -> Column:
    """x of a place in a row (char_x, row_width): where its character begins; behind the last one, the row's width."""
    return F.coalesce(F.get(row, col.cast("int")), width)


def letter_width(page_lines: int | Column, page_aspect: float | Column, margins: tuple[float, float, float] = (0.075, 0.09, 0.03)) -> float | Column:
    """Text width, in line heights, of a page of that shape with page_lines lines, two blank ones and a footer."""
    side, top, bottom = margins
    return page_aspect * (1 - 2 * side) / (1 - top - bottom) * (page_lines + 3 + 2)


def ink_levels(ink: float | Column, space: float | Column, bar: float = 0.7) -> tuple[float | Column, float | Column]:
    """Ink of bars and blocks that look as dark as the face: the bars leave spaces out."""
    rounded = F.round if isinstance(ink, Column) else round
    return rounded(ink * (1 - space) / bar, 3), rounded(ink / bar, 3)


def panel_chars(aspect: Column, width: int = 170, size: int = 11) -> Column:
    """Characters of a row of the result panel."""
    return F.floor(width / (size * aspect)).cast("long")
