"""Layout: columns and wrapping of files, page grids, treemaps, item boxes.

Everything but the treemap's strips is a column expression. The treemap runs one round per depth of the tree.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import tree
from textloom.operators.lines import ranked
from textloom.session import cut

#: Fixed values of the layout: world width, characters' width in line heights, gaps, bounds, margins.
WORLD, ASPECT = 1600.0, 16 / 9
CHAR, GAP, MOST_COLUMNS, MOST_CHARS = 0.571, 0.06, 64, 4096
TARGET = (24, 100)
HANG, WRAP_FROM = 2, 16
PAGE_GAP, PAGE_MARGIN = 0.08, (0.075, 0.09, 0.03)
PAGE_ASPECT = 612 / 792


def world() -> tuple[float, float]:
    return WORLD, WORLD / ASPECT


def padding(w: Column, h: Column) -> Column:
    """Of a book's root and parts: a share of the shorter side, within bounds."""
    side = F.least(w, h)
    return F.least(F.least(F.greatest(0.015 * side, F.lit(0.05)), F.lit(4.0)), 0.25 * side)


def padding_by_lines(w: Column, h: Column, lines: Column) -> Column:
    """Of a directory: two pitches of its typical file, within bounds."""
    pitch = F.sqrt(F.greatest(w * h, F.lit(1e-9)) / (34.0 * F.greatest(lines, F.lit(1))))
    return F.least(F.least(F.greatest(2 * pitch, F.lit(0.01)), F.lit(4.0)), 0.25 * F.least(w, h))


# -- columns of a file ------------------------------------------------------------------------------------------------


def up(a: Column, b: Column) -> Column:
    """a / b, rounded up, of integers."""
    return F.floor((a + b - 1) / b)


def target_width(p90: Column) -> Column:
    return F.least(F.greatest(p90, F.lit(TARGET[0] * CHAR)), F.lit(TARGET[1] * CHAR))


def with_columns_fit(files: DataFrame) -> DataFrame:
    """files (w, h, n, target) with k, rows, pitch, colw (without the gap) and capw: the most columns that hold the target width."""
    n = F.greatest("n", F.lit(1).cast("long"))

    def width(k: Column) -> Column:
        return F.col("w") / (k + GAP * (k - 1))

    def pitch(rows: Column) -> Column:
        return F.col("h") / (rows + 2)

    fits = F.filter(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(MOST_COLUMNS).cast("long"))), lambda k: width(k) >= F.col("target") * pitch(up(n, k)))
    out = files.withColumn("k", F.coalesce(F.array_max(fits), F.lit(1).cast("long")))
    out = out.withColumn("rows", up(n, F.col("k")).cast("long")).withColumn("k", up(n, F.col("rows")).cast("long"))
    out = out.withColumn("pitch", pitch(F.col("rows"))).withColumn("colw", width(F.col("k")))
    return out.withColumn("capw", F.when(F.col("pitch") > 0, F.col("colw") / F.col("pitch")).otherwise(0.0))


def rows_of_line(length: Column, cap: Column) -> Column:
    """Visual rows of a line: the first holds cap characters, further ones hang in by HANG."""
    return F.lit(1) + F.floor((F.greatest(length - cap, F.lit(0)) + (cap - HANG) - 1) / (cap - HANG))


def wrap_cap(cap: Column) -> Column:
    """Narrow columns clip: their lines take one row."""
    return F.when(cap >= WRAP_FROM, cap).otherwise(F.lit(MOST_CHARS).cast("long"))


def page_fit(files: DataFrame, page: tuple[int, float]) -> DataFrame:
    """Columns of files that are laid out as a full page of (lines, width) at least, so a short one keeps the text size of others."""
    full = files.withColumns({"__own": F.col("n"), "n": F.greatest("n", F.lit(page[0]).cast("long")), "target": F.lit(float(page[1]))})
    return with_columns_fit(full).withColumn("n", F.col("__own")).drop("__own")


def settled(files: DataFrame, rounds: int = 4, page: tuple[int, float] | None = None) -> DataFrame:
    """Columns with wrapped lines: pitch and capacity at their fixed point, after at most ``rounds`` steps.

    files: w, h, n, target, and hist, an array of (len, count) of the file's lines: bounded by MOST_CHARS lengths. The
    steps are a fold over that array, in the plan. Adds cap (characters in a column), and rows, pitch and capw for it. page: see
    ``page_fit``.
    """
    fitted = with_columns_fit(files) if page is None else page_fit(files, page)
    fitted = fitted.withColumn("cap", F.least(F.floor(F.col("capw") / CHAR), F.lit(MOST_CHARS)).cast("long"))
    longest = F.coalesce(F.array_max(F.transform("hist", lambda x: x["len"])), F.lit(0))
    fitted = fitted.withColumn("wraps", (F.col("n") > 0) & (F.col("cap") >= WRAP_FROM) & (longest > F.col("cap")))

    def rows_at(cap: Column) -> Column:
        total = F.aggregate("hist", F.lit(0).cast("long"), lambda a, x: a + x["count"] * rows_of_line(x["len"], wrap_cap(cap)).cast("long"))
        return up(total, F.col("k")).cast("long")

    def step(cap: Column, _: Column) -> Column:
        pitch = F.col("h") / (rows_at(cap) + 2)
        return F.when(pitch > 0, F.least(F.floor(F.col("colw") / (pitch * CHAR)), F.lit(MOST_CHARS))).otherwise(0).cast("long")

    cap = F.when(F.col("wraps"), F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("cap"), step)).otherwise(F.col("cap"))
    out = fitted.withColumn("cap", cap)
    out = out.withColumn("rows", F.when(F.col("wraps"), rows_at(F.col("cap"))).otherwise(F.col("rows")))
    out = out.withColumn("pitch", F.when(F.col("wraps"), F.col("h") / (F.col("rows") + 2)).otherwise(F.col("pitch")))
    return out.withColumn("capw", F.when(F.col("pitch") > 0, F.col("colw") / F.col("pitch")).otherwise(0.0)).drop("wraps")


def length_histogram(lines: DataFrame) -> DataFrame:
    """n, p90 and hist of every file: its lines, the 90th percentile of their widths, and their lengths with counts."""
    counts = lines.groupBy("file_id", "len").agg(F.count("*").alias("count"))
    p90 = F.percentile(F.col("len") * CHAR, 0.9, F.col("count"))
    return counts.groupBy("file_id").agg(F.sum("count").alias("n"), p90.alias("p90"), F.collect_list(F.struct(F.col("len").cast("long").alias("len"), "count")).alias("hist"))


# -- rows of a file ---------------------------------------------------------------------------------------------------


def wrapped(lines: DataFrame) -> DataFrame:
    """Visual rows of lines (file_id, line_no, len, cap, ...): row_in_line, col0 and row_len are added."""
    cap = wrap_cap(F.col("cap"))
    per_line = rows_of_line(F.col("len"), cap).cast("long")
    rows = lines.withColumn("row_in_line", F.explode(F.sequence(F.lit(0).cast("long"), per_line - 1)))
    first = F.col("row_in_line") == 0
    col0 = F.when(first, 0).otherwise(cap + (F.col("row_in_line") - 1) * (cap - HANG)).cast("long")
    size = F.when(first, F.least(F.col("len"), cap)).otherwise(F.least(F.col("len") - col0, cap - HANG))
    return rows.withColumn("col0", col0).withColumn("row_len", F.greatest(size, F.lit(0)).cast("long"))


def numbered(rows: DataFrame) -> DataFrame:
    """row_in_file of every row."""
    order = Window.partitionBy("file_id").orderBy("line_no", "row_in_line")
    return rows.withColumn("row_in_file", (F.row_number().over(order) - 1).cast("long"))


def row_position(x0: Column, y0: Column, row: Column, rows: Column, pitch: Column, colw: Column, first: Column, hang: float = HANG * CHAR) -> tuple[Column, Column]:
    """Top left of a row's cell; colw includes the gap. Further rows of a line hang in, by hang line heights."""
    column, place = F.floor(row / rows), row % rows
    return x0 + column * colw + F.when(first, 0.0).otherwise(hang * pitch), y0 + pitch * (1 + place)


def item_boxes(items: DataFrame) -> DataFrame:
    """One box for each column that an item spans; items: item_id, s, e (rows, past the last), total, rows, x0, y0, pitch, colw."""
    past = F.least("e", "total")
    spans = items.withColumn("e", past).where("e > s")
    first, last = F.floor(F.col("s") / F.col("rows")), F.floor((F.col("e") - 1) / F.col("rows"))
    boxes = spans.withColumns({"c0": first, "c1": last}).withColumn("col", F.explode(F.sequence("c0", "c1")))
    top = F.when(F.col("col") == F.col("c0"), F.col("s") - F.col("col") * F.col("rows")).otherwise(0)
    bottom = F.when(F.col("col") == F.col("c1"), F.col("e") - F.col("col") * F.col("rows")).otherwise(F.col("rows"))
    left = F.col("x0") + F.col("col") * F.col("colw")
    return boxes.select("item_id", "col", left.alias("bx0"), (F.col("y0") + F.col("pitch") * (1 + top)).alias("by0"), (left + F.col("colw") / (1 + GAP)).alias("bx1"), (F.col("y0") + F.col("pitch") * (1 + bottom)).alias("by1"))


# -- pages ------------------------------------------------------------------------------------------------------------


def flow_columns(count: DataFrame, page_aspect: float = PAGE_ASPECT) -> DataFrame:
    """cols, rows, cw, ch of one grid for n pages (count: one row, n): cells nearest to the page's shape, rather wide.

    The shape of cells only falls with the number of columns. If rows were not rounded up it would be the page's at a root of
    n; rounding moves it by less than the columns that a row more or less is worth, so only those around the root are tried.
    """
    w, h = world()
    pad = min(min(max(0.015 * min(w, h), 0.05), 4.0), 0.25 * min(w, h))
    n = F.col("n")
    share = (w - 2 * pad) * (1 - PAGE_GAP + page_aspect * PAGE_GAP) / (page_aspect * (h - 2 * pad))
    root, reach = F.sqrt(n * share), 2 * math.ceil(share) + 4
    tried = F.sequence(F.greatest(F.floor(root) - reach, F.lit(1)), F.least(F.ceil(root) + reach, n))
    grid = count.where("n > 0").select("n", F.explode(tried).alias("cols"))
    grid = grid.withColumn("rows", up(n, F.col("cols")).cast("long")).withColumns({"cw": F.lit(w - 2 * pad) / F.col("cols"), "ch": F.lit(h - 2 * pad) / F.col("rows")})
    gap = PAGE_GAP * F.col("cw")
    ratio = (F.col("cw") - gap) / (F.col("ch") - gap) / page_aspect
    grid = grid.where(F.col("ch") > gap).withColumn("key", F.struct((ratio < 1).alias("narrow"), F.abs(F.ln(ratio)).alias("off"), F.col("cols").alias("cols")))
    best = grid.groupBy().agg(F.min(F.struct("key", "rows", "cw", "ch")).alias("b"))
    return best.where("b IS NOT NULL").select(F.col("b.key.cols").alias("cols"), "b.rows", "b.cw", "b.ch", F.lit(pad).alias("pad"))


def flow(pages: DataFrame, page_aspect: float = PAGE_ASPECT) -> DataFrame:
    """Boxes of pages (page_no from 0, ...) in reading order on one grid."""
    best = flow_columns(pages.agg(F.count("*").alias("n")), page_aspect)
    placed = pages.crossJoin(F.broadcast(best))  # one row
    i, j, half = F.floor(F.col("page_no") / F.col("cols")), F.col("page_no") % F.col("cols"), PAGE_GAP * F.col("cw") / 2
    x, y = F.col("pad") + j * F.col("cw"), F.col("pad") + i * F.col("ch")
    return placed.withColumns({"x0": x + half, "y0": y + half, "x1": x + F.col("cw") - half, "y1": y + F.col("ch") - half}).drop("cols", "rows", "cw", "ch", "pad")


def part_bands(parts: DataFrame, page_aspect: float = PAGE_ASPECT) -> DataFrame:
    """Bands of whole page rows for parts (part_no, pages): cols, and each part's rows, y0, y1. One row for each part.

    All rows are between pages / columns and that and one more for each part, which bounds the columns whose cells can be the
    nearest to the page's shape; their number follows the parts, not the pages.
    """
    w, h = world()
    pad = min(min(max(0.015 * min(w, h), 0.05), 4.0), 0.25 * min(w, h))
    share = (w - 2 * pad) / (page_aspect * (h - 2 * pad))
    bounds = parts.agg(F.max("pages").alias("most"), F.sum("pages").alias("all"), F.count("*").alias("parts"))
    low = F.greatest(F.floor(F.sqrt(F.col("all") * share)) - 2, F.lit(1))
    high = F.least(F.ceil((F.col("parts") * share + F.sqrt(F.pow(F.col("parts") * share, F.lit(2)) + 4 * F.col("all") * share)) / 2) + 2, F.col("most"))
    bounds = bounds.select(F.least(low, F.col("most")).cast("long").alias("low"), high.cast("long").alias("high"))  # one row
    grid = parts.crossJoin(F.broadcast(bounds)).withColumn("cols", F.explode(F.sequence("low", F.greatest("low", "high"))))
    grid = grid.groupBy("cols").agg(F.sum(up(F.col("pages"), F.col("cols"))).alias("all_rows"))
    ratio = (F.lit(w - 2 * pad) / F.col("cols")) / (F.lit(h - 2 * pad) / F.col("all_rows")) / page_aspect
    best = grid.select(F.struct((ratio < 1).alias("narrow"), F.abs(F.ln(ratio)).alias("off"), F.col("cols").alias("cols")).alias("key"), "all_rows")
    best = best.agg(F.min(F.struct("key", "all_rows")).alias("b")).select(F.col("b.key.cols").alias("cols"), "b.all_rows")
    rows = parts.crossJoin(F.broadcast(best)).withColumn("rows", up(F.col("pages"), F.col("cols")).cast("long"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    high = F.lit(h - 2 * pad) / F.col("all_rows")
    return rows.select("part_no", "pages", "cols", "rows", (F.lit(pad) + before * high).alias("y0"), (F.lit(pad) + (before + F.col("rows")) * high).alias("y1"))


def in_bands(pages: DataFrame, bands: DataFrame) -> DataFrame:
    """Boxes of pages (part_no, k: their place in the part) in the bands of their parts, see ``part_bands``."""
    w, h = world()
    edge = min(min(max(0.015 * min(w, h), 0.05), 4.0), 0.25 * min(w, h))
    high = F.col("y1") - F.col("y0")
    placed = pages.join(bands.withColumn("pp", padding(F.lit(w - 2 * edge), high)).select("part_no", "cols", F.col("rows").alias("band_rows"), "y0", "y1", "pp"), "part_no")
    cw, ch = (F.lit(w - 2 * edge) - 2 * F.col("pp")) / F.col("cols"), (high - 2 * F.col("pp")) / F.col("band_rows")
    i, j = F.floor(F.col("k") / F.col("cols")), F.col("k") % F.col("cols")
    left, top = F.lit(edge) + F.col("pp"), F.col("y0") + F.col("pp")
    box = ((left + j * cw).alias("x0"), (top + i * ch).alias("y0"), (left + (j + 1) * cw).alias("x1"), (top + (i + 1) * ch).alias("y1"))
    return placed.select(*pages.columns, *box)


def text_block(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    """The part of a page inside its margins."""
    side, top, bottom = PAGE_MARGIN
    w, h = x1 - x0, y1 - y0
    return x0 + side * w, y0 + top * h, x1 - side * w, y1 - bottom * h


def page_shape(lines: int, width: float) -> float:
    """Width by height of a page around a text block of that many lines, two blank ones and that width in line heights."""
    side, top, bottom = PAGE_MARGIN
    return width / (lines + 2) * (1 - top - bottom) / (1 - 2 * side)


# -- treemap ----------------------------------------------------------------------------------------------------------


def strips(weights: Sequence[float], counts: Sequence[int], x0: float, y0: float, x1: float, y1: float) -> list[tuple]:
    """Strips that fill a box with children of falling weights, of which there are counts each: first, past (places of the
    children), before, upto (their weights summed), x0, y0, x1, y1 and across.

    A strip lies along the shorter side of what is left and takes children while the longest shape of its first and last one
    doesn't get worse. Among equal weights that turns once, so it is searched for: the steps follow strips and different
    weights, not children.
    """
    total = sum(w * c for w, c in zip(weights, counts, strict=True))
    if not total or x1 <= x0 or y1 <= y0:
        return [(0, sum(counts), 0.0, float(total), x0, y0, x0, y0, False)] if len(counts) else []
    scale = (x1 - x0) * (y1 - y0) / total
    out, at, before, run, left = [], 0, 0, 0, counts[0]
    while run < len(weights):
        w, h = x1 - x0, y1 - y0
        squared, heaviest = min(w, h) ** 2 / scale, weights[run]
        took, size, shape = 0, 0, math.inf
        while run < len(weights):
            weight = weights[run]

            def longest(n: int, size=size, weight=weight) -> float:
                s = size + n * weight
                return max(squared * heaviest / (s * s), s * s / (squared * weight))

            if longest(1) > shape:
                break
            low, high = 1, left  # the first n after which one more is worse
            while low < high:
                n = (low + high) // 2
                low, high = (low, n) if longest(n + 1) > longest(n) else (n + 1, high)
            took, size, shape, left = took + low, size + low * weight, longest(low), left - low
            if left:
                break
            run += 1
            left = counts[run] if run < len(weights) else 0
        across, last = w >= h, run == len(weights)
        thick = (w if across else h) if last else size * scale / (h if across else w)
        out.append((at, at + took, float(before), float(before + size), x0, y0, x0 + thick if across else x1, y1 if across else y0 + thick, across))
        x0, y0 = (x0 + thick, y0) if across else (x0, y0 + thick)
        at, before = at + took, before + size
    return out


#: Children of a directory that look for their strip together.
STRIP_RUN = 1024
_BOX = ("x0", "y0", "x1", "y1")


def _children(files: DataFrame, dirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and directories but the root, with their place among their parent's children and the weights before; and each
    parent's different weights with how many children have them.

    The children of all directories are sorted together, in ranges: heavy ones first, files before directories, by path.
    """
    both = [df.select("path", "weight", "lines", F.lit(is_dir).alias("is_dir"), tree.parent_path(F.col("path")).alias("parent")) for df, is_dir in ((files, False), (dirs.where("path <> ''"), True))]
    placed = ranked(both[0].unionByName(both[1]), ["parent", -F.col("weight"), "is_dir", "path"], "spot")
    kinds = placed.groupBy("parent", "weight").agg(F.count("*").alias("count"), F.min("spot").alias("begin"))
    heavier = Window.partitionBy("parent").orderBy(F.col("weight").desc()).rowsBetween(Window.unboundedPreceding, -1)
    kinds = cut(kinds.withColumn("above", F.coalesce(F.sum(F.col("weight") * F.col("count")).over(heavier), F.lit(0.0))).withColumn("start", F.min("begin").over(Window.partitionBy("parent"))))
    told = placed.join(kinds.select("parent", "weight", "begin", "above", "start"), ["parent", "weight"])
    told = told.select("path", "parent", "is_dir", "weight", "lines", (F.col("spot") - F.col("start")).alias("k"), (F.col("above") + (F.col("spot") - F.col("begin")) * F.col("weight")).alias("before"))
    return cut(told), kinds.select("parent", "weight", "count")


def _divided(kinds: DataFrame, dirs: DataFrame) -> DataFrame:
    """The strips of directories (path, pad, box): a group is a directory's different weights."""
    names = ("first", "past", "before", "upto", *_BOX, "across")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("weight", ascending=False)
        p = group.iloc[0]
        found = strips(group["weight"].tolist(), group["count"].tolist(), p["x0"] + p["pad"], p["y0"] + p["pad"], p["x1"] - p["pad"], p["y1"] - p["pad"])
        return pd.DataFrame(found, columns=names).assign(parent=p["parent"])

    schema = "first long, past long, before double, upto double, x0 double, y0 double, x1 double, y1 double, across boolean, parent string"
    return kinds.join(dirs.select(F.col("path").alias("parent"), "pad", *_BOX), "parent").groupBy("parent").applyInPandas(run, schema)


def _boxed(children: DataFrame, divided: DataFrame) -> DataFrame:
    """Children with their boxes: each finds its strip by its place, in runs of places."""
    found = divided.withColumnsRenamed({"before": "begin"}).withColumn("run", F.explode(F.sequence(F.floor(F.col("first") / STRIP_RUN), F.floor((F.col("past") - 1) / STRIP_RUN))))
    met = children.withColumn("run", F.floor(F.col("k") / STRIP_RUN)).join(found, ["parent", "run"]).where("k >= first AND k < past")
    share = F.greatest(F.col("upto") - F.col("begin"), F.lit(1e-300))  # 0 only where all weights are
    low, high = ((F.col("before") + w - F.col("begin")) / share for w in (F.lit(0.0), F.col("weight")))

    def edge(side: str, at: Column, of_strip: str, across: Column) -> Column:
        """An edge of the child: its strip's, or a part of the way along it."""
        return F.when(across, F.col(of_strip)).otherwise(F.col(f"{side}0") + (F.col(f"{side}1") - F.col(f"{side}0")) * at)

    sides = (("x", low, "x0"), ("y", low, "y0"), ("x", high, "x1"), ("y", high, "y1"))
    return met.select("path", "is_dir", "weight", "lines", *(edge(s, at, c, F.col("across") == (s == "x")).alias(c) for s, at, c in sides))


def treemap(files: DataFrame) -> DataFrame:
    """Boxes of files and directories: path, is_dir, depth, weight, pad, x0, y0, x1, y1; files: path, weight (1 at least), lines.

    Round d divides the boxes of the directories at depth d into strips and boxes the directories among their children; files
    find their strips at the end. Children are ranked, summed and boxed in as many tasks as there are rows for, whatever the
    directory that they are in; a group holds a directory's different weights.
    """
    w, h = world()
    leaves = files.select("path", F.col("weight").cast("double").alias("weight"), F.col("lines").cast("long").alias("lines"))
    dirs = cut(tree.directories(leaves, ["weight", "lines"]))
    children, kinds = _children(leaves, dirs)
    deepest = dirs.agg(F.max("depth")).first()[0]
    here = dirs.where("path = ''").select("path", F.lit(True).alias("is_dir"), "weight", "lines", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(w).alias("x1"), F.lit(h).alias("y1"))
    folders = children.where("is_dir").join(dirs.select("path", "depth"), "path")
    boxes, divided = [], []
    for d in range((deepest if deepest is not None else -1) + 1):
        here = cut(here.withColumn("pad", padding_by_lines(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("lines"))))
        boxes.append(here)
        divided.append(cut(_divided(kinds, here)))
        here = _boxed(folders.where(F.col("depth") == d + 1), divided[-1])
    if not boxes:
        return leaves.select("path", F.lit(False).alias("is_dir"), F.lit(0).alias("depth"), "weight", *(F.lit(None).cast("double").alias(c) for c in ("pad", *_BOX)))
    placed = _boxed(children.where("NOT is_dir"), functools.reduce(DataFrame.unionByName, divided)).withColumn("pad", F.lit(None).cast("double"))
    every = functools.reduce(DataFrame.unionByName, [*boxes, placed])
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    return every.select("path", "is_dir", depth.alias("depth"), "weight", "pad", *_BOX)
