"""What a view of a layout shows: visibility, level of detail, flags, draw runs, points under the cursor, camera paths.

A camera is a few numbers of the caller; they enter plans as literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import layout as Y
from textloom.operators import proportional, spatial
from textloom.operators.lines import running
from textloom.session import cut

if TYPE_CHECKING:
    from textloom.operators.camera import Camera

#: Pixels a line from which bars, then wide bars, then glyphs are drawn (fixed values).
CUTS = (1, 3, 6)
HOVERED, HIT, CURRENT, DIMMED = 1, 2, 4, 8
HEIGHT, STEP = 90.0, 5.0


def visible(x0: float, y0: float, x1: float, y1: float) -> Column:
    """Does the row's box meet the view? Edges that only touch don't count. A filter that scans push down."""
    return (F.col("x1") > x0) & (F.col("x0") < x1) & (F.col("y1") > y0) & (F.col("y0") < y1)


def projected(matrix: Sequence[Sequence[float]], focus: float, z: Column) -> tuple[Column, Column]:
    """Visibility and scale of the row's box at height z through a 4 x 4 camera: a corner behind it counts as visible."""

    def clip(x: str, y: str) -> Column:
        rows = [F.col(x) * m[0] + F.col(y) * m[1] + z * m[2] + m[3] for m in matrix]
        return F.struct(rows[0].alias("x"), rows[1].alias("y"), rows[3].alias("w"))

    corners = F.array(*(clip(x, y) for x in ("x0", "x1") for y in ("y0", "y1")))
    front = F.filter(corners, lambda c: c["w"] > 1e-6)
    nx, ny = F.transform(front, lambda c: c["x"] / c["w"]), F.transform(front, lambda c: c["y"] / c["w"])
    inside = (F.array_max(nx) > -1) & (F.array_min(nx) < 1) & (F.array_max(ny) > -1) & (F.array_min(ny) < 1)
    seen = F.when(F.size(front) == 4, inside).otherwise(F.size(front) > 0)
    mean = F.aggregate(corners, F.lit(0.0), lambda a, c: a + c["w"]) / 4
    return seen, focus / F.greatest(mean, F.lit(1e-6))


def pixels_per_line(pitch: Column, zoom: float, scale: Column | float = 1.0) -> Column:
    return pitch * zoom * scale


def detail(ppl: Column) -> Column:
    """0 to 3: how many cuts the pixels a line reach."""
    out = F.lit(0)
    for least in CUTS:
        out = out + (ppl >= least).cast("int")
    return out


def flags(hovered: Column, hit: Column, current: Column, dimmed: Column) -> Column:
    """Bits of a file's state; a null counts as no."""
    bits = ((hovered, HOVERED), (hit, HIT), (current, CURRENT), (dimmed, DIMMED))
    out = F.lit(0)
    for c, bit in bits:
        out = out.bitwiseOR(F.when(c, bit).otherwise(0))
    return out


def per_file(files: DataFrame, hits: DataFrame, view: Sequence[float], zoom: float, hovered: int, current: int, searching: bool = True, tall: bool = True, tinted: bool = True, camera: Camera | None = None) -> DataFrame:
    """What a frame needs of each file (file_id, box, pitch, height, tint) in one select: seen, ppl, lod, flags, top and tint.

    hits: file_id of the files with hits. Without a search no file is hit or dimmed; the toggles flatten files and drop tints. A
    tilted camera sees the tops of files, and lines are the thinner the further away they are; without one the view is a window.
    """
    found = files.join(hits.select("file_id").distinct().withColumn("__hit", F.lit(True)), "file_id", "left")
    hit = F.coalesce("__hit", F.lit(False)) & F.lit(searching)
    top, tint = F.col("height") if tall else F.lit(0.0), F.col("tint") if tinted else F.lit(None).cast("double")
    if camera is None or camera.tilt is None:
        seen, scale = visible(*view), F.lit(1.0)
    else:
        seen, scale = projected(camera.matrix(), camera.distance, top)
    ppl = pixels_per_line(F.col("pitch"), zoom, scale)
    bits = flags(F.col("file_id") == hovered, hit, (F.col("file_id") == current) & F.lit(searching), ~hit & F.lit(searching))
    return found.select("file_id", seen.alias("seen"), ppl.alias("ppl"), detail(ppl).alias("lod"), bits.alias("flags"), top.alias("top"), tint.alias("tint"))


def runs(files: DataFrame, seen: str = "seen", width: int = 4096) -> DataFrame:
    """Runs (first, last) of consecutive file numbers that are seen; files: file_no.

    Gaps and islands in two levels: within parts of ``width`` numbers, then those islands that touch a border of their part
    join, part by part: one row for each part that has such an island.
    """
    shown = files.where(F.col(seen)).select("file_no", F.floor(F.col("file_no") / width).alias("part"))
    order = Window.partitionBy("part").orderBy("file_no")
    islands = shown.withColumn("gap", F.col("file_no") - F.row_number().over(order)).groupBy("part", "gap").agg(F.min("file_no").alias("first"), F.max("file_no").alias("last"))
    edge = (F.col("first") == F.col("part") * width) | (F.col("last") == (F.col("part") + 1) * width - 1)
    every = Window.orderBy("first")
    starts = islands.where(edge).withColumn("starts", F.coalesce(F.lag("last").over(every) + 1 < F.col("first"), F.lit(True)).cast("long"))
    joined = starts.withColumn("run", F.sum("starts").over(every)).groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return islands.where(~edge).select("first", "last").unionByName(joined.select("first", "last"))


def sampled(row: Column, ppl: Column) -> Column:
    """Of rows thinner than a pixel, the first on each pixel."""
    return (row == 0) | (F.floor(row * ppl) != F.floor((row - 1) * ppl))


def heights(weights: DataFrame, depth: str = "depth") -> DataFrame:
    """base and height of each file: terraces by depth, the square root of its weight; weights: weight, depth."""
    most = weights.agg(F.max("weight").alias("__most"))
    return weights.crossJoin(F.broadcast(most)).withColumns({"base": STEP * F.col(depth), "height": HEIGHT * F.sqrt(F.col("weight") / F.col("__most"))}).drop("__most")


def last_at_most(values: Column, x: Column) -> Column:
    """The place of the last of rising values that is x at most, by halving; 0 if all are more."""
    steps = F.sequence(F.lit(1), F.lit(int(Y.MOST_CHARS).bit_length() + 1))
    none = F.struct(F.lit(0).alias("low"), F.size(values).alias("past"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["past"]) / 2).cast("int")
        fits = F.get(values, middle) <= x
        return F.when(s["past"] - s["low"] <= 1, s).otherwise(F.struct(F.when(fits, middle).otherwise(s["low"]).alias("low"), F.when(fits, s["past"]).otherwise(middle).alias("past")))

    return F.aggregate(steps, none, halve, lambda s: s["low"])


def hovered(points: DataFrame, files: DataFrame, rows: DataFrame, width: float, height: float, adv: Mapping[str, float] | None = None) -> DataFrame:
    """What is under points (point_id, x, y): file_id, line_no and col; line -1 beside or below the file's rows.

    files: file_id, box, pitch, k, rows, colw (with the gap). rows: file_id, row_in_file, line_no, col0, x (of the row) and, for faces
    with advances of their own (adv), row_text, stretch and target, its width if stretched. A point finds its file through the grid, its
    row by its place in the file's columns, and the character by halving the row's positions, or by the width of one where all are
    alike. Positions are made for rows under points only, so they are never moved.
    """
    met = spatial.at_points(points, files.select("file_id", "x0", "y0", "x1", "y1", "pitch", "k", "rows", F.col("colw").alias("wide")), width, height)
    column = F.least(F.greatest(F.floor((F.col("x") - F.col("x0")) / F.col("wide")), F.lit(0)), F.greatest(F.col("k") - 1, F.lit(0)))
    down = F.floor((F.col("y") - F.col("y0") - F.col("pitch")) / F.col("pitch"))
    met = met.withColumn("row_in_file", F.when((down >= 0) & (down < F.col("rows")), column * F.col("rows") + down).cast("long"))
    beside = F.floor((F.col("x") - F.col("x0") - column * F.col("wide")) / (F.col("pitch") * Y.CHAR))
    named = rows.select("file_id", "row_in_file", "line_no", "col0", F.col("x").alias("row_x"), *(["row_text", "stretch", "target"] if adv else []))
    told = met.withColumn("beside", beside).join(named, ["file_id", "row_in_file"], "left")
    if adv:
        told = proportional.justified(told, F.col("target"), adv)
    along = (F.col("x") - F.col("row_x")) / F.col("pitch")
    within = last_at_most(F.col("char_x"), along) if adv else F.greatest(F.floor(along / Y.CHAR), F.lit(0))
    col = F.when(F.col("line_no").isNull(), F.col("beside")).otherwise(F.col("col0") + within)
    return told.select("point_id", "file_id", F.coalesce(F.col("line_no").cast("long"), F.lit(-1)).alias("line_no"), col.cast("long").alias("col"))


def drawn_ranges(runs_: DataFrame, sizes: DataFrame, size: str) -> DataFrame:
    """first, last, begin, past: what each run of files (first, last) covers of a table that has ``size`` rows of each file, all files'
    rows one after the other. Runs that cover nothing draw nothing. sizes: file_no, size."""
    offsets = running(sizes.select("file_no", F.col(size).cast("long").alias("__n")), "file_no", "__n", "__begin")
    begins = offsets.select(F.col("file_no").alias("first"), F.col("__begin").cast("long").alias("begin"))
    ends = offsets.select(F.col("file_no").alias("last"), (F.col("__begin") + F.col("__n")).cast("long").alias("past"))
    return runs_.join(begins, "first").join(ends, "last").where("past > begin").select("first", "last", "begin", "past")


#: Texels in a row of a texture (fixed value).
TEXELS = 2048


def texels(rows: DataFrame, width: int = TEXELS) -> DataFrame:
    """page, place and the words of every visual row for a texture of rows of ``width`` texels: low, file, packed and high.

    rows: row (over all files), file_id, off (of the row's first character, over all files), indent (of its line), col0 and row_len.
    The offset has 64 bits and takes two words; only a line's first row is indented.
    """
    low = F.col("off").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    indent = F.when(F.col("col0") == 0, F.col("indent")).otherwise(0).cast("long")
    return rows.select(F.floor(F.col("row") / width).alias("page"), (F.col("row") % width).alias("place"), low.alias("low"), F.col("file_id").alias("file"), packed_row(indent, F.col("row_len")).alias("packed"), F.shiftrightunsigned(F.col("off").cast("long"), 32).alias("high"))


def padded_pages(texels_: DataFrame, width: int = TEXELS) -> DataFrame:
    """page and words: whole rows of the texture, four words a texel, zeros where there is none. A row has ``width`` texels, whatever
    the corpus, so one is a group of bounded size."""
    word = F.array(*(F.col(c).cast("long") for c in ("low", "file", "packed", "high")))
    held = texels_.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct(F.col("place").cast("int"), word))).alias("held"))
    blank = F.array_repeat(F.lit(0).cast("long"), 4)
    return held.select("page", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("held", i), blank))).alias("words"))


def label(path: Column, line: Column, name: Column, hits: Column, lod: Column) -> Column:
    """path[:line][ name][ · n hits]; line and name from the detail on that shows lines."""
    return F.concat(path, F.when(lod >= 2, F.concat(F.lit(":"), (line + 1).cast("string"))).otherwise(""), F.when((lod >= 2) & name.isNotNull(), F.concat(F.lit(" "), name)).otherwise(""), F.when(hits > 0, F.concat(F.lit(" · "), hits.cast("string"), F.lit(" hits"))).otherwise(""))


def hit_view(x: Column, y: Column, pitch: Column, size: Column, box: Sequence[Column], lines: int = 40, columns: int = 100) -> tuple[Column, Column, Column, Column]:
    """The box to fly to for a hit at (x, y): lines by columns around its middle, which is held inside the file's box."""
    edge = F.lit(1e-3)
    middles = []
    for middle, low, high in ((x + size * Y.CHAR * pitch / 2, box[0], box[2]), (y + pitch / 2, box[1], box[3])):
        least = low + edge
        middles.append(F.least(F.greatest(middle, least), F.greatest(high - edge, least)))
    w, h = columns * Y.CHAR * pitch, lines * pitch
    return middles[0] - w / 2, middles[1] - h / 2, middles[0] + w / 2, middles[1] + h / 2


def item_rects(items: DataFrame, files: DataFrame) -> DataFrame:
    """Boxes of items (item_id, file_id, kind, s, e: rows of the file) in their files' columns; files: file_id, box, pitch,
    rows, colw (without the gap), ppl, lod, seen."""
    placed = items.join(files.select("file_id", "x0", "y0", "pitch", "rows", (F.col("colw") * (1 + Y.GAP)).alias("colw")), "file_id").withColumn("total", F.col("e"))
    boxes = Y.item_boxes(placed)
    return boxes.join(items.select("item_id", "file_id", "kind"), "item_id").join(files.select("file_id", "ppl", "lod", "seen"), "file_id")


def coloured(rects: DataFrame, colours: Sequence[str]) -> DataFrame:
    """rects with the colour of their kind, from 1; other kinds have the last."""
    known = F.col("kind").between(1, len(colours))
    return rects.withColumn("colour", F.element_at(F.array(*map(F.lit, colours)), F.when(known, F.col("kind")).otherwise(len(colours)).cast("int")))


def bands(rects: DataFrame, colours: Sequence[str]) -> DataFrame:
    """Filled bands of items in visible files below the detail of glyphs, fading as lines get thicker."""
    return coloured(rects.where(F.col("seen") & (F.col("lod") <= 2)), colours).withColumn("alpha", band_alpha(F.col("ppl")))


def outlines(rects: DataFrame, colours: Sequence[str]) -> DataFrame:
    """Outlines of items in visible files from the detail of wide bars on."""
    return coloured(rects.where(F.col("seen") & (F.col("lod") >= 2)), colours)


def hit_boxes(hits: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Boxes of hits (file_id, line_no, col) of size characters on the visual rows they begin in; rows: visual rows of the files
    in view, with pitch, rows, colw, x0, y0. A hit that runs past its row is cut there."""
    own = ["row_in_line", "row_in_file", "col0", "row_len", "pitch", "rows", "colw", "x0", "y0"]
    begun = hits.select("file_id", "line_no", "col").join(rows.select("file_id", "line_no", *own), ["file_id", "line_no"]).where(F.col("col0") <= F.col("col"))
    last = begun.groupBy("file_id", "line_no", "col").agg(F.max(F.struct(*own)).alias("r")).select("file_id", "line_no", "col", "r.*")
    x, y = Y.row_position(F.col("x0"), F.col("y0"), F.col("row_in_file"), F.col("rows"), F.col("pitch"), F.col("colw") * (1 + Y.GAP), F.col("row_in_line") == 0)
    edge = lambda c: x + F.least(c - F.col("col0"), F.col("row_len")) * Y.CHAR * F.col("pitch")
    return last.select("file_id", "line_no", "col", edge(F.col("col")).alias("bx0"), y.alias("by0"), edge(F.col("col") + size).alias("bx1"), (y + F.col("pitch")).alias("by1"))


def tag_fits(tag: Column, width: Column, height: Column, scale: float, char: float, pad: float, least: float = 48.0, share: float = 0.4) -> Column:
    """Is a directory large enough on the screen for its tag: least pixels on the shorter side, and the tag on a share of its width?"""
    return tag.isNotNull() & (F.least(width, height) * scale >= least) & (F.length(tag) * char + 2 * pad <= share * width * scale)

#: Steps aside that a tag takes at most before it is given up (fixed value), and the pixels of a grid cell that tags are looked up by.
SLIDES, TAG_CELL = 8, 128.0


def clipped(box: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """A screen box (struct x0, y0, x1, y1) cut to the part of the screen that may hold it."""
    sides = (("x0", F.greatest, left), ("y0", F.greatest, top), ("x1", F.least, right), ("y1", F.least, bottom))
    return F.when(box.isNotNull(), F.struct(*(pick(box[c], F.lit(bound)).alias(c) for c, pick, bound in sides)))


def _slid(spot: Column, placed: Column, tag: Column, gap: float) -> Column:
    """One step of a tag: it stays where no placed tag is in its way, else it goes behind the first one placed that is, or, where
    its box ends, to the box's left in the next row."""

    def in_way(b: Column) -> Column:
        return (spot["x"] < b["x1"]) & (spot["x"] + tag["w"] > b["x0"]) & (spot["y"] < b["y1"]) & (spot["y"] + tag["h"] > b["y0"])

    behind = F.get(F.filter(placed, in_way), F.lit(0))["x1"] + gap
    wraps = behind + tag["w"] > tag["x1"]
    x = F.when(behind.isNull(), spot["x"]).when(wraps, tag["x0"]).otherwise(behind)
    y = F.when(behind.isNotNull() & wraps, spot["y"] + tag["h"] + gap).otherwise(spot["y"])
    return F.when(spot["free"], spot).otherwise(F.struct(x.alias("x"), y.alias("y"), behind.isNull().alias("free")))


def placed_tags(tags: DataFrame, gap: float, slides: int = SLIDES) -> DataFrame:
    """place, x, y of the tags that find a spot, one after the other in the order of their places (unique): each at the top left of
    its box, or slid along past the tags that are in its way. tags: place, x0, y0, x1, y1 (the box), w, h (the tag).

    Only tags whose reaches meet can be in each other's way, and these meet in the cells of a grid. A round places all tags for
    which every earlier one within reach has been settled, so there are as many rounds as a chain of such tags is long: for
    directories their depth.
    """
    fits = tags.where((F.col("x1") - F.col("x0") >= F.col("w")) & (F.col("y1") - F.col("y0") >= F.col("h"))).select("place", "x0", "y0", "x1", "y1", "w", "h")
    fits = cut(fits.withColumn("low", F.least("y1", F.col("y0") + (slides + 1) * F.col("h") + slides * gap)))
    cells = [F.explode(F.sequence(F.floor(F.col(a) / TAG_CELL), F.floor(F.col(b) / TAG_CELL))) for a, b in (("x0", "x1"), ("y0", "low"))]
    spread = fits.select("place", "x0", "y0", "x1", "low", cells[0].alias("cx")).join(fits.select("place", cells[1].alias("cy")), "place")
    earlier = spread.select("cx", "cy", *(F.col(c).alias(f"e_{c}") for c in ("place", "x0", "y0", "x1", "low")))
    meet = (F.col("e_place") < F.col("place")) & (F.col("e_x0") < F.col("x1")) & (F.col("x0") < F.col("e_x1")) & (F.col("e_y0") < F.col("low")) & (F.col("y0") < F.col("e_low"))
    before = cut(spread.join(earlier, ["cx", "cy"]).where(meet).select("place", F.col("e_place").alias("other")).distinct())
    none = fits.where(F.lit(False)).select("place", F.col("x0").alias("x"), F.col("y0").alias("y"), "w", "h")
    settled, open_ = cut(none), fits
    while not open_.isEmpty():
        waits = before.join(open_.select(F.col("place").alias("other")), "other", "left_semi").select("place").distinct()
        ready = open_.join(waits, "place", "left_anti")
        there = settled.where("x IS NOT NULL").select(F.col("place").alias("other"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
        near = before.join(there, "other").groupBy("place").agg(F.array_sort(F.collect_list(F.struct("other", "x0", "y0", "x1", "y1"))).alias("near"))
        tag = F.struct("x0", "y0", "x1", "y1", "w", "h")
        start = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(False).alias("free"))
        met = ready.join(near, "place", "left").withColumn("near", F.coalesce("near", F.array().cast("array<struct<other:long,x0:double,y0:double,x1:double,y1:double>>")))
        spot = F.aggregate(F.sequence(F.lit(1), F.lit(slides)), start, lambda spot, _: _slid(spot, F.col("near"), tag, gap))
        found = met.withColumn("spot", spot).withColumn("stays", F.col("spot.free") & (F.col("spot.y") + F.col("h") <= F.col("y1")))
        settled = cut(settled.unionByName(found.select("place", F.when(F.col("stays"), F.col("spot.x")).alias("x"), F.when(F.col("stays"), F.col("spot.y")).alias("y"), "w", "h")))
        open_ = fits.join(settled.select("place"), "place", "left_anti")
    return settled.where("x IS NOT NULL").select("place", "x", "y")



def render_errors(frames: DataFrame, key: str) -> DataFrame:
    """Of each key: mean error over all pixels and over inked ones, least time, mean and largest sparkle."""
    off = F.abs("error")
    return frames.groupBy(key).agg(F.avg(off).alias("error"), F.avg(F.when(F.col("inked"), off)).alias("ink_error"), F.min("ms").alias("ms"), F.avg("sparkle").alias("sparkle"), F.max("sparkle").alias("worst"))


def flights(targets: DataFrame, start: tuple[float, float, float], steps: int, rho: float = 1.4) -> DataFrame:
    """Smooth zooming paths (van Wijk and Nuij 2003) from (x, y, width) to every target (x, y, width, and other columns, which stay):
    step, x, y, width, in steps + 1 rows each. A target at the start's place is zoomed to."""
    x0, y0, w0 = start
    w1, off = F.col("width"), F.hypot(F.col("x") - x0, F.col("y") - y0)
    d = F.greatest(off, F.lit(1e-9))
    b0 = (w1 * w1 - w0 * w0 + rho**4 * d * d) / (2 * w0 * rho**2 * d)
    b1 = (w1 * w1 - w0 * w0 - rho**4 * d * d) / (2 * w1 * rho**2 * d)
    turn = lambda b: F.ln(F.sqrt(b * b + 1) - b)
    rest = [c for c in targets.columns if c not in ("x", "y", "width")]
    made = targets.select(*rest, F.col("x").alias("__x"), F.col("y").alias("__y"), F.ln(w1 / w0).alias("__zoom"), off.alias("__off"), turn(b0).alias("__r0"), turn(b1).alias("__r1"))
    each = made.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long")))).withColumn("__t", F.col("step") / steps)
    bent = (F.col("__r1") - F.col("__r0")) * F.col("__t") + F.col("__r0")
    share = w0 / rho**2 * (F.cosh("__r0") * F.tanh(bent) - F.sinh("__r0")) / F.greatest("__off", F.lit(1e-9))
    still = F.col("__off") < 1e-9
    place = [F.when(still, F.col(f"__{n}")).otherwise(o + (F.col(f"__{n}") - o) * share).alias(n) for n, o in (("x", x0), ("y", y0))]
    width = F.when(still, w0 * F.exp(F.col("__zoom") * F.col("__t"))).otherwise(w0 * F.cosh("__r0") / F.cosh(bent))
    return each.select(*rest, "step", *place, width.alias("width"))


def packed_row(indent: Column, length: Column) -> Column:
    """indent and length in one 32-bit word."""
    return indent.bitwiseOR(F.shiftleft(length.cast("long"), 16))


def band_alpha(ppl: Column) -> Column:
    return 0.18 * F.least(F.greatest((6 - ppl) / 3, F.lit(0.0)), F.lit(1.0))


def bar_ink(far: float, near: float, ppl: Column) -> Column:
    return far + (near - far) * F.least(F.greatest((ppl - 1) / 2, F.lit(0.0)), F.lit(1.0))
