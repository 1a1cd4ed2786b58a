"""Queries for what a view draws: bands and outlines of items, boxes of hits, tags of directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import layout as Y
from textloom.operators import search as S
from textloom.operators import tree, view
from textloom.plans.layout import FLOW, SETTLED, WRAPPED, boxes, flow_boxes, visual_rows
from textloom.plans.registry import query
from textloom.plans.search import HITS, WORD
from textloom.plans.text import doc_lines, long
from textloom.plans.view import FOCUS, SEEN, TILTED, VIEW, ZOOM, _corner
from textloom.session import cut
from textloom.sources import corpora, trees

#: Colours of the item kinds from 1 to 5; other kinds have the last.
COLOURS = ("4e79a7", "f28e2b", "59a14f", "b07aa1", "9c755f")

GEO = f"""
geo AS (SELECT file_id, x0, y0, x1, y1, pitch, rows, colw, pitch * {ZOOM} AS ppl, ((pitch * {ZOOM} >= 1)::INT + (pitch * {ZOOM} >= 3)::INT + (pitch * {ZOOM} >= 6)::INT)::BIGINT AS lod, {SEEN} AS seen FROM flow JOIN settled USING (file_id)),
places AS (SELECT event_id AS item_id, event_id % (SELECT count(*) FROM documents) AS file_id, event_id % 7 AS kind, (event_id * 7) % 90 AS s, (event_id * 7) % 90 + 1 + event_id % 45 AS e FROM events),
spans AS (SELECT p.*, unnest(range(s // rows, (e - 1) // rows + 1)) AS col, x0, y0, pitch, rows, colw * {1 + Y.GAP!r} AS wide, ppl, lod, seen FROM places p JOIN geo USING (file_id)),
rects AS (SELECT item_id, file_id, kind, col, ppl, lod, seen, x0 + col * wide AS bx0, y0 + pitch * (1 + CASE WHEN col = s // rows THEN s - col * rows ELSE 0 END) AS by0, x0 + col * wide + wide / {1 + Y.GAP!r} AS bx1, y0 + pitch * (1 + CASE WHEN col = (e - 1) // rows THEN e - col * rows ELSE rows END) AS by1 FROM spans)
"""
_BOX = ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in ("bx0", "by0", "bx1", "by1"))
_COLOUR = "list_extract([" + ", ".join(f"'{c}'" for c in COLOURS) + "], (CASE WHEN kind BETWEEN 1 AND 5 THEN kind ELSE 5 END)::INT) AS colour"


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, pitch, detail and visibility of all documents in the view."""
    placed = flow_boxes(spark, sf_dir).join(Y.settled(boxes(spark, sf_dir)).select("file_id", "pitch", "rows", "colw"), "file_id")
    ppl = view.pixels_per_line(F.col("pitch"), ZOOM)
    # stored, as several columns are filtered by that follow from the layout's folds
    return cut(placed.withColumns({"ppl": ppl, "lod": view.detail(ppl), "seen": view.visible(*VIEW)}))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all documents: one for each event, over rows of its own."""
    e = F.col("event_id")
    s = (e * 7) % 90
    count = corpora.prose(spark, sf_dir).count()
    return corpora.table(spark, sf_dir, "events").select(e.alias("item_id"), (e % count).alias("file_id"), (e % 7).alias("kind"), s.alias("s"), (s + 1 + e % 45).alias("e"))


@query(f"WITH {SETTLED}, {FLOW}, {GEO} SELECT item_id, col::BIGINT AS col, file_id, {_BOX} FROM rects")
def j_item_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every box of every item, with the file that it lies in."""
    rects = view.item_rects(places(spark, sf_dir), drawn(spark, sf_dir))
    return long(rects.select("item_id", "col", "file_id", *(F.round(c, 6).alias(c) for c in ("bx0", "by0", "bx1", "by1"))))


@query(f"WITH {SETTLED}, {FLOW}, {GEO} SELECT item_id, col::BIGINT AS col, {_BOX}, {_COLOUR}, round(0.18 * least(greatest((6 - ppl) / 3, 0), 1), 6)::DOUBLE AS alpha FROM rects WHERE seen AND lod <= 2")
def v_band_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled bands of the items of visible files, as long as lines are thin."""
    rects = view.bands(view.item_rects(places(spark, sf_dir), drawn(spark, sf_dir)), COLOURS)
    return long(rects.select("item_id", "col", *(F.round(c, 6).alias(c) for c in ("bx0", "by0", "bx1", "by1")), "colour", F.round("alpha", 6).alias("alpha")))


@query(f"WITH {SETTLED}, {FLOW}, {GEO} SELECT item_id, col::BIGINT AS col, {_BOX}, {_COLOUR} FROM rects WHERE seen AND lod >= 2")
def v_item_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of the items of visible files, once lines are three pixels high."""
    rects = view.outlines(view.item_rects(places(spark, sf_dir), drawn(spark, sf_dir)), COLOURS)
    return long(rects.select("item_id", "col", *(F.round(c, 6).alias(c) for c in ("bx0", "by0", "bx1", "by1")), "colour"))


@query(f"""
WITH {SETTLED}, {FLOW}, {GEO}, {HITS}, {WRAPPED},
on_row AS (SELECT h.file_id, h.line_no, h.col, v.row_in_line, v.col0, v.row_len, v.row_in_file, row_number() OVER (PARTITION BY h.file_id, h.line_no, h.col ORDER BY v.row_in_line DESC) AS k FROM hits h JOIN vrows v ON v.file_id = h.file_id AND v.line_no = h.line_no AND v.col0 <= h.col),
at_ AS (SELECT o.*, g.pitch, g.x0 + (row_in_file // g.rows) * g.colw * {1 + Y.GAP!r} + CASE WHEN row_in_line = 0 THEN 0 ELSE {Y.HANG * Y.CHAR!r} * g.pitch END AS rx, g.y0 + g.pitch * (1 + row_in_file % g.rows) AS ry FROM on_row o JOIN geo g ON g.file_id = o.file_id WHERE k = 1 AND seen AND lod >= 2)
SELECT file_id, line_no, col, round(rx + least(col - col0, row_len) * {Y.CHAR} * pitch, 6) AS bx0, round(ry, 6) AS by0, round(rx + least(col + {len(WORD)} - col0, row_len) * {Y.CHAR} * pitch, 6) AS bx1, round(ry + pitch, 6) AS by1 FROM at_
""")
def v_hit_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes around the hits in visible files, on the visual rows that they begin in."""
    hits = S.hits(doc_lines(spark, sf_dir), WORD)
    seen = drawn(spark, sf_dir).where("seen AND lod >= 2").select("file_id", "x0", "y0")
    rows = visual_rows(spark, sf_dir).join(F.broadcast(seen), "file_id")
    return long(view.hit_boxes(hits, rows, len(WORD)).select("file_id", "line_no", "col", *(F.round(c, 6).alias(c) for c in ("bx0", "by0", "bx1", "by1"))))


#: Directories of the pages' URLs, with boxes that narrow with depth.
TAGGED = """
p AS (SELECT DISTINCT string_split(rtrim(regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', ''), '/'), '/') AS p FROM pages),
d AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS path, i AS depth, CASE WHEN i > 0 THEN array_to_string(p[1:i - 1], '/') END AS parent, CASE WHEN i > 0 THEN p[i] ELSE '' END AS name FROM (SELECT p, unnest(range(0, len(p))) AS i FROM p)),
b AS (SELECT *, 160.0 - 4 * depth - length(path) % 9 AS w, 90.0 - 4 * depth - length(path) % 5 AS h FROM d),
k AS (SELECT parent AS path, count(*) AS kids, max(w * h) AS area FROM b WHERE parent IS NOT NULL GROUP BY parent),
m AS (SELECT b.*, coalesce(kids = 1 AND area >= 0.85 * greatest(w - 2, 0) * greatest(h - 2, 0), FALSE) AND depth > 0 AS hidden FROM b LEFT JOIN k USING (path)),
chain AS (SELECT path, depth, name, hidden, CASE WHEN hidden THEN name ELSE '' END AS chain, CASE WHEN NOT hidden THEN name END AS tag FROM m WHERE depth = 1
  UNION ALL SELECT m.path, m.depth, m.name, m.hidden, CASE WHEN m.hidden THEN CASE WHEN c.chain <> '' THEN c.chain || ' · ' || m.name ELSE m.name END ELSE '' END, CASE WHEN NOT m.hidden THEN CASE WHEN c.chain <> '' THEN c.chain || ' · ' || m.name ELSE m.name END END FROM m JOIN chain c ON m.parent = c.path)
"""


def page_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, parent, depth, w, h, pad of the directories of the pages' URLs."""
    dirs = tree.directories(corpora.markup(spark, sf_dir).select("path").distinct())
    parent = F.when(F.col("depth") > 0, F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth") - 1), "/"))
    n = F.length("path")
    return dirs.select("path", parent.alias("parent"), "depth", (160.0 - 4 * F.col("depth") - n % 9).alias("w"), (90.0 - 4 * F.col("depth") - n % 5).alias("h"), F.lit(1.0).alias("pad"))


@query(f"WITH RECURSIVE {TAGGED} SELECT path, tag FROM chain WHERE tag IS NOT NULL")
def w_dir_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag of each directory of the pages' URLs; those that one child fills have none and hand their name down."""
    return tree.tags(page_dirs(spark, sf_dir))


@query(f"""
WITH RECURSIVE {TAGGED}, t AS (SELECT path, tag, depth, w, h FROM chain JOIN b USING (path, depth) WHERE tag IS NOT NULL)
SELECT path, tag, row_number() OVER (ORDER BY depth, path) AS place FROM t WHERE least(w, h) * 0.6 >= 48 AND length(tag) * 1.7 + 2 * 3.0 <= 0.4 * w * 0.6
""")
def f_placed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of directories that are large enough on the screen, in the order in which they are placed."""
    dirs = page_dirs(spark, sf_dir)
    tagged = tree.tags(dirs).join(dirs, "path").where(view.tag_fits(F.col("tag"), F.col("w"), F.col("h"), 0.6, 1.7, 3.0))
    return long(tree.by_depth(tagged).select("path", "tag", "place"))


@query(f"WITH {TAGGED.split(',\nk AS')[0]} SELECT path, depth, row_number() OVER (ORDER BY depth, path) AS place FROM b")
def o_dirs_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories by depth, those of a depth by path."""
    return long(tree.by_depth(page_dirs(spark, sf_dir)).select("path", "depth", "place"))


def _channel(n: int) -> str:
    """A channel of a hue in SQL: 5 is red, 3 green, 1 blue."""
    return f"floor(255 * (0.9 * (1 - 0.55 * greatest(0, least(1, least(({n} + hue / 2.0) % 6, 4 - ({n} + hue / 2.0) % 6))))))::BIGINT"


@query("""
SELECT event_id, hue, channel(5, hue) AS red, channel(3, hue) AS green, channel(1, hue) AS blue FROM (SELECT event_id, ((event_id % 24) % 12)::BIGINT AS hue FROM events)
""".replace("channel(5, hue)", _channel(5)).replace("channel(3, hue)", _channel(3)).replace("channel(1, hue)", _channel(1)))
def p_hue_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red, green and blue of the hues, from their place on the colour circle."""
    hue = F.col("event_id") % 24
    red, green, blue = T.hue_rgb(hue)
    return long(corpora.table(spark, sf_dir, "events").select("event_id", (hue % 12).alias("hue"), red.alias("red"), green.alias("green"), blue.alias("blue")))


@query("""
SELECT format('{:,} files · {:,} lines · {:,} chars', count(*)::BIGINT, sum(len(string_split(text, chr(10))))::BIGINT, sum(length(text))::BIGINT) AS status, format('{:,} hits · {:,} files · {:,}/{:,}', 1234567::BIGINT, 1200::BIGINT, 1000::BIGINT, 1234567::BIGINT) AS found FROM documents
""")
def p_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status line of the corpus, and that of a search."""
    totals = corpora.prose(spark, sf_dir).agg(F.count("*").alias("files"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines"), F.sum(F.length("text")).alias("chars"))
    return totals.select(T.status(F.col("files"), F.col("lines"), F.col("chars")).alias("status"), T.search_status(F.lit(1234567), F.lit(1200), F.lit(999)).alias("found"))


@query("""
SELECT device, round(avg(abs(e)), 6)::DOUBLE AS error, round(avg(abs(e)) FILTER (WHERE inked), 6)::DOUBLE AS ink_error, round(min(ms), 6)::DOUBLE AS ms, round(avg(sparkle), 6)::DOUBLE AS sparkle, max(sparkle)::BIGINT AS worst
FROM (SELECT event_id % 7 AS device, value - 10 * (event_id % 13) AS e, event_id % 4 > 0 AS inked, value AS ms, event_id * 37 % 101 AS sparkle FROM events) GROUP BY device
""")
def a_render_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error over all and over inked pixels, least time and sparkle of each device."""
    e = F.col("event_id")
    frames = corpora.table(spark, sf_dir, "events").select((e % 7).alias("device"), (F.col("value") - 10 * (e % 13)).alias("error"), (e % 4 > 0).alias("inked"), F.col("value").alias("ms"), (e * 37 % 101).alias("sparkle"))
    done = view.render_errors(frames, "device")
    return done.select("device", *(F.round(c, 6).alias(c) for c in ("error", "ink_error", "ms", "sparkle")), F.col("worst").cast("long").alias("worst"))


_FRAME = """
t AS (SELECT doc_id AS file_id, 10.0 + 90 * sqrt(w / max(w) OVER ()) AS height, ln(1 + w) / greatest(max(ln(1 + w)) OVER (), 1e-9) AS tint FROM (SELECT doc_id, (length(text) - length(replace(text, ' ', '')) + 1)::DOUBLE AS w FROM documents)),
h AS (SELECT DISTINCT file_id FROM hits)
"""


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, pitch, height and tint of all documents."""
    weights = corpora.prose(spark, sf_dir).select("file_id", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).alias("weight"), F.lit(2).alias("depth"))
    tall = view.heights(weights).select("file_id", (F.col("base") + F.col("height")).alias("height"))
    return drawn(spark, sf_dir).drop("seen").join(tall, "file_id").join(trees.tint(weights, "file_id", "weight").select("file_id", "tint"), "file_id")


@query(f"""
WITH {SETTLED}, {FLOW}, {GEO}, {HITS}, {_FRAME}, modes AS (SELECT unnest([0, 1]) AS mode)
SELECT mode::BIGINT AS mode, g.file_id, seen, round(ppl, 6) AS ppl, lod, (CASE WHEN g.file_id = 3 THEN 1 ELSE 0 END + CASE WHEN mode = 1 THEN 0 WHEN h.file_id IS NOT NULL THEN 2 ELSE 8 END + CASE WHEN mode = 0 AND g.file_id = 5 THEN 4 ELSE 0 END)::BIGINT AS flags,
  round(CASE WHEN mode = 0 THEN height ELSE 0 END, 6)::DOUBLE AS top, round(CASE WHEN mode = 0 THEN tint END, 6)::DOUBLE AS tint FROM geo g JOIN t USING (file_id) LEFT JOIN h ON h.file_id = g.file_id, modes
""")
def v_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-file select of a frame, with a search, heights and tints, and with none of them."""
    files = framed(spark, sf_dir)
    hits = S.hits(doc_lines(spark, sf_dir), WORD)
    modes = [view.per_file(files, hits, VIEW, ZOOM, 3, 5, on, on, on).select(F.lit(k).alias("mode"), "*") for k, on in enumerate((True, False))]
    rows = modes[0].unionByName(modes[1])
    return long(rows.select("mode", "file_id", "seen", *(F.round(c, 6).alias(c) if c in ("ppl", "top", "tint") else F.col(c) for c in ("ppl", "lod", "flags", "top", "tint"))))


@query(f"""
WITH {SETTLED}, {FLOW}, {GEO}, {HITS}, {_FRAME},
c AS (SELECT *, [{", ".join(_corner(x, y) for x in ("x0", "x1") for y in ("y0", "y1"))}] AS corners FROM (SELECT g.file_id, x0, y0, x1, y1, pitch, height, height AS z FROM geo g JOIN t USING (file_id))),
s AS (SELECT *, list_filter(corners, lambda p: p.w > 1e-6) AS front, {FOCUS} / greatest(list_sum(list_transform(corners, lambda p: p.w)) / 4, 1e-6) AS scale FROM c),
n AS (SELECT *, list_transform(front, lambda p: p.x / p.w) AS nx, list_transform(front, lambda p: p.y / p.w) AS ny, pitch * {TILTED.zoom} * scale AS px FROM s)
SELECT n.file_id, CASE WHEN len(front) = 4 THEN list_max(nx) > -1 AND list_min(nx) < 1 AND list_max(ny) > -1 AND list_min(ny) < 1 ELSE len(front) > 0 END AS seen, round(px, 6) AS ppl,
  ((px >= 1)::INT + (px >= 3)::INT + (px >= 6)::INT)::BIGINT AS lod, (CASE WHEN n.file_id = 3 THEN 1 ELSE 0 END + CASE WHEN h.file_id IS NOT NULL THEN 2 ELSE 8 END + CASE WHEN n.file_id = 5 THEN 4 ELSE 0 END)::BIGINT AS flags, round(height, 6) AS top FROM n LEFT JOIN h ON h.file_id = n.file_id
""")
def v_per_file_tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-file select of a frame through a tilted camera, which sees the tops of files."""
    hits = S.hits(doc_lines(spark, sf_dir), WORD)
    rows = view.per_file(framed(spark, sf_dir), hits, VIEW, TILTED.zoom, 3, 5, camera=TILTED)
    return long(rows.select("file_id", "seen", F.round("ppl", 6).alias("ppl"), "lod", "flags", F.round("top", 6).alias("top")))
