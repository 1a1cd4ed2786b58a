"""Treemaps in SQL, child by child, and the queries over the boxes of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import layout as Y
from textloom.operators import index, spatial, tree, view
from textloom.operators.camera import Camera
from textloom.plans.layout import doc_treemap
from textloom.plans.registry import query
from textloom.plans.text import LINES, PROSE_TILES, doc_lines, long
from textloom.plans.view import POINTS, points
from textloom.session import cut
from textloom.sources import corpora

_W, _H = Y.world()
_SIDES = "least(rx1 - rx0, ry1 - ry0)"
_SHAPE = "greatest({q} * heaviest / ({s} * {s}), {s} * {s} / ({q} * {last}))"


def _level(d: int) -> str:
    """Directories at depth d with their padding, their children in order, each with the rectangle that its strip begins in,
    and the children's boxes."""
    q = f"({_SIDES} * {_SIDES} / scale)"
    now, more = _SHAPE.format(q=q, s="size", last="last"), _SHAPE.format(q=q, s="(size + weight)", last="weight")
    moved = lambda edge, side, across: f"CASE WHEN stays OR (rx1 - rx0 >= ry1 - ry0) <> {across} THEN {edge} ELSE {edge} + size * scale / ({side}) END"
    return f"""
p{d} AS (SELECT *, least(least(greatest(2 * sqrt(greatest((x1 - x0) * (y1 - y0), 1e-9) / (34.0 * greatest(lines, 1))), 0.01), 4.0), 0.25 * least(x1 - x0, y1 - y0)) AS pad FROM d{d}),
k{d} AS (SELECT n.path, n.parent, n.is_dir, n.weight, n.lines, x0 + pad AS ix0, y0 + pad AS iy0, x1 - pad AS ix1, y1 - pad AS iy1,
    row_number() OVER w AS k, sum(n.weight) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, sum(n.weight) OVER (PARTITION BY n.parent) AS total
  FROM nodes n JOIN p{d} p ON n.parent = p.path WINDOW w AS (PARTITION BY n.parent ORDER BY n.weight DESC, n.is_dir, n.path)),
r{d} AS (
  SELECT parent, k, ix0 AS rx0, iy0 AS ry0, ix1 AS rx1, iy1 AS ry1, (ix1 - ix0) * (iy1 - iy0) / total AS scale, weight AS heaviest, weight AS size, weight AS last, 0.0::DOUBLE AS begin FROM k{d} WHERE k = 1
  UNION ALL
  SELECT parent, k, {moved("rx0", "ry1 - ry0", "TRUE")}, {moved("ry0", "rx1 - rx0", "FALSE")}, rx1, ry1, scale, CASE WHEN stays THEN heaviest ELSE weight END, CASE WHEN stays THEN size + weight ELSE weight END, weight, CASE WHEN stays THEN begin ELSE begin + size END
  FROM (SELECT r.*, k.k AS next, k.weight, {more} <= {now} AS stays FROM r{d} r JOIN k{d} k ON k.parent = r.parent AND k.k = r.k + 1) AS x(parent, was, rx0, ry0, rx1, ry1, scale, heaviest, size, last, begin, k, weight, stays)),
s{d} AS (SELECT k.*, r.rx0 AS sx0, r.ry0 AS sy0, r.rx1 AS sx1, r.ry1 AS sy1, scale, begin, max(size) OVER (PARTITION BY parent, begin) AS whole, r.rx1 - r.rx0 >= r.ry1 - r.ry0 AS across FROM r{d} r JOIN k{d} k USING (parent, k)),
t{d} AS (SELECT *, CASE WHEN begin + whole = total THEN CASE WHEN across THEN sx1 - sx0 ELSE sy1 - sy0 END ELSE whole * scale / CASE WHEN across THEN sy1 - sy0 ELSE sx1 - sx0 END END AS thick, (upto - weight - begin) / whole AS low, (upto - begin) / whole AS high FROM s{d}),
b{d} AS (SELECT path, is_dir, weight, lines, CASE WHEN across THEN sx0 ELSE sx0 + (sx1 - sx0) * low END AS x0, CASE WHEN across THEN sy0 + (sy1 - sy0) * low ELSE sy0 END AS y0, CASE WHEN across THEN sx0 + thick ELSE sx0 + (sx1 - sx0) * high END AS x1, CASE WHEN across THEN sy0 + (sy1 - sy0) * high ELSE sy0 + thick END AS y1 FROM t{d}),
d{d + 1} AS (SELECT * FROM b{d} WHERE is_dir)"""


def treemap_sql(deepest: int) -> str:
    """Tables up to ``tm`` (as the operator's), from leaves: path, weight, lines; for trees of directories to that depth. Recursive."""
    levels = range(deepest + 1)
    every = "\n  UNION ALL ".join([*(f"SELECT path, TRUE, {d}, weight, pad, x0, y0, x1, y1 FROM p{d}" for d in levels), *(f"SELECT path, FALSE, {d + 1}, weight, NULL, x0, y0, x1, y1 FROM b{d} WHERE NOT is_dir" for d in levels)])
    return f"""
above AS (SELECT array_to_string(p[1:i], '/') AS path, weight, lines FROM (SELECT p, weight, lines, unnest(range(0, len(p))) AS i FROM (SELECT string_split(path, '/') AS p, weight, lines FROM leaves))),
dirs AS (SELECT path, sum(weight)::DOUBLE AS weight, sum(lines)::BIGINT AS lines FROM above GROUP BY path),
nodes AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent FROM (SELECT path, weight::DOUBLE AS weight, lines, FALSE AS is_dir FROM leaves UNION ALL SELECT path, weight, lines, TRUE FROM dirs WHERE path <> '')),
d0 AS (SELECT path, TRUE AS is_dir, weight, lines, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, {_W!r}::DOUBLE AS x1, {_H!r}::DOUBLE AS y1 FROM dirs WHERE path = ''),
{",".join(_level(d) for d in levels)},
tm(path, is_dir, depth, weight, pad, x0, y0, x1, y1) AS ({every})"""


DOC_LEAVES = f"{PROSE_TILES}, steps AS (SELECT file_id, kind, lag(kind, 1, 0) OVER (PARTITION BY file_id ORDER BY pos) AS before FROM tiles), leaves AS (SELECT lang || '/' || source || '/' || doc_id AS path, greatest(coalesce(n, 0), 1) AS weight, len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents LEFT JOIN (SELECT file_id, count(*) AS n FROM steps WHERE kind <> 0 AND kind <> before GROUP BY file_id) r ON r.file_id = doc_id)"
TREEMAP = f"{DOC_LEAVES}, {treemap_sql(2)}"
PAGE_LEAVES = "leaves AS (SELECT rtrim(regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', ''), '/') AS path, length(html) + 1 AS weight, len(string_split(html, chr(10))) AS lines FROM pages)"
#: Directories of the pages' URLs are this deep at most.
PAGE_DEPTH = 3


def page_treemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of all pages and their directories, weighed by the length of the markup."""
    files = corpora.markup(spark, sf_dir)
    return Y.treemap(files.select("path", (F.length("text") + 1).cast("double").alias("weight"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines")))


_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("x0", "y0", "x1", "y1"))


def _shown(boxes: DataFrame) -> DataFrame:
    return long(boxes.select("path", "is_dir", "depth", "weight", F.round("pad", 6).alias("pad"), *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1"))))


@query(f"WITH RECURSIVE {TREEMAP} SELECT path, is_dir, depth::BIGINT AS depth, weight, round(pad, 6) AS pad, {_ROUNDED} FROM tm")
def l_treemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(doc_treemap(spark, sf_dir))


@query(f"WITH RECURSIVE {PAGE_LEAVES}, {treemap_sql(PAGE_DEPTH)} SELECT path, is_dir, depth::BIGINT AS depth, weight, round(pad, 6) AS pad, {_ROUNDED} FROM tm")
def l_page_treemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(page_treemap(spark, sf_dir))


_MX, _MT, _MB = Y.PAGE_MARGIN
#: All documents as pages of a book: the page's shape, the grid, the columns of a full page, and the fixed point of each page's rows.
BOOK = f"""
full_ AS (SELECT (SELECT quantile_cont((len * {Y.CHAR})::DOUBLE, 0.995) FROM lines) AS width, (SELECT max(n) FROM (SELECT count(*) AS n FROM lines GROUP BY file_id)) AS most, (SELECT count(*) FROM documents) AS pages),
shape AS (SELECT *, width / (most + 2) * {1 - _MT - _MB!r} / {1 - 2 * _MX!r} AS shape FROM full_),
tried_b AS (SELECT *, {_W - 8!r} / cols AS cw, {_H - 8!r} / ((pages + cols - 1) // cols) AS ch FROM (SELECT *, unnest(range(1, pages + 1)) AS cols FROM shape)),
best_b AS (SELECT * FROM (SELECT *, (cw - {Y.PAGE_GAP} * cw) / (ch - {Y.PAGE_GAP} * cw) / shape AS ratio FROM tried_b WHERE ch > {Y.PAGE_GAP} * cw) ORDER BY ratio < 1, abs(ln(ratio)), cols LIMIT 1),
sheet AS (SELECT *, (cw - {Y.PAGE_GAP} * cw) * {1 - 2 * _MX!r} AS w, (ch - {Y.PAGE_GAP} * cw) * {1 - _MT - _MB!r} AS h FROM best_b),
cols_b AS (SELECT sheet.*, r.k AS k0 FROM sheet, range(1, 65) AS r(k) WHERE r.k <= most AND (r.k = 1 OR w / (r.k + {Y.GAP} * (r.k - 1)) >= width * (h / ((most + r.k - 1) // r.k + 2))) ORDER BY r.k DESC LIMIT 1),
fit_a AS (SELECT *, (most + k0 - 1) // k0 AS rows0 FROM cols_b),
fit_b AS (SELECT *, (most + rows0 - 1) // rows0 AS k, h / (rows0 + 2) AS pitch0 FROM fit_a),
fit_c AS (SELECT *, w / (k + {Y.GAP} * (k - 1)) AS colw FROM fit_b),
paged AS (SELECT doc_id AS file_id, row_number() OVER (ORDER BY doc_id) - 1 AS page, coalesce(n, 0) AS n, coalesce(longest, 0) AS longest, f.* FROM documents LEFT JOIN (SELECT file_id, count(*) AS n, max(len) AS longest FROM lines GROUP BY file_id) l ON l.file_id = doc_id, fit_c f),
hist AS (SELECT file_id, len, count(*) AS c FROM lines GROUP BY ALL),
c0 AS (SELECT *, n > 0 AND cap >= {Y.WRAP_FROM} AND longest > cap AS wraps FROM (SELECT *, least(floor(colw / pitch0 / {Y.CHAR}), {Y.MOST_CHARS})::BIGINT AS cap FROM paged))"""


def _book_rounds(rounds: int = 4) -> str:
    cap = f"CASE WHEN cap >= {Y.WRAP_FROM} THEN cap ELSE {Y.MOST_CHARS} END"
    out = []
    for i in range(rounds + 1):
        out.append(f"r{i} AS (SELECT file_id, sum(c * (1 + (greatest(len - ({cap}), 0) + ({cap}) - {Y.HANG} - 1) // (({cap}) - {Y.HANG})))::BIGINT AS total FROM hist JOIN c{i} USING (file_id) GROUP BY file_id)")
        if i < rounds:
            step = f"least(floor(colw / (h / ((total + k - 1) // k + 2) * {Y.CHAR})), {Y.MOST_CHARS})::BIGINT"
            out.append(f"c{i + 1} AS (SELECT c{i}.* REPLACE (CASE WHEN wraps THEN {step} ELSE cap END AS cap) FROM c{i} LEFT JOIN r{i} USING (file_id))")
    return ",\n".join(out) + f",\nbook AS (SELECT c{rounds}.*, CASE WHEN wraps THEN (total + k - 1) // k ELSE rows0 END AS rows FROM c{rounds} LEFT JOIN r{rounds} USING (file_id))"


@query(f"""
WITH {LINES}, {BOOK}, {_book_rounds()}
SELECT file_id, k, rows::BIGINT AS rows, cap, round(h / (rows + 2), 6) AS pitch, round(4 + (page % cols) * cw + {Y.PAGE_GAP / 2} * cw + {_MX} * (cw - {Y.PAGE_GAP} * cw), 6) AS tx0, round(4 + (page // cols) * ch + {Y.PAGE_GAP / 2} * cw + {_MT} * (ch - {Y.PAGE_GAP} * cw), 6) AS ty0 FROM book
""")
def l_book_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the pages of a book, in one call: text blocks, columns, rows and pitch."""
    files = corpora.prose(spark, sf_dir).select("file_id", "path")
    done = index.build_layout({"files": files, "lines": doc_lines(spark, sf_dir)}, "book")
    return long(done["files"].select("file_id", "k", "rows", "cap", *(F.round(c, 6).alias(c) for c in ("pitch", "tx0", "ty0"))))


MAP = Camera(800.0, 450.0, 1.0, 1280.0, 720.0, 24.0).fitted(Y.world())
LETTER, INSET, TALL, SPACE = 5.0, 3.0, 18.0, 2.0  # of tags, in pixels

_X = lambda c: f"(({c} - {MAP.cx!r}) * {MAP.zoom!r} + {MAP.width / 2!r})"
_Y = lambda c: f"(({c} - {MAP.cy!r}) * {MAP.zoom!r} + {MAP.top + MAP.height / 2!r})"


def _steps(n: int) -> str:
    """A tag's spot after n steps past the tags placed, in SQL: sx, sy, free, beside the columns of tags and placed."""
    if not n:
        return "SELECT t.*, g.placed, t.x0 AS sx, t.y0 AS sy, FALSE AS free FROM g JOIN fits t ON t.place = g.place + 1"
    way = "list_filter(placed, lambda b: sx < b.x1 AND sx + w > b.x0 AND sy < b.y1 AND sy + h > b.y0)[1].x1"
    return f"""
SELECT place, path, tag, x0, y0, x1, y1, w, h, placed, CASE WHEN free OR behind IS NULL THEN sx WHEN behind + w > x1 THEN x0 ELSE behind END AS sx, CASE WHEN NOT free AND behind IS NOT NULL AND behind + w > x1 THEN sy + h + {SPACE} ELSE sy END AS sy, free OR behind IS NULL AS free
FROM (SELECT *, {way} + {SPACE} AS behind FROM ({_steps(n - 1)}) AS s{n})"""


#: The tag of every directory of the pages' URLs, as the boxes of the treemap ask for.
TAGS = """
b AS (SELECT path, depth, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, string_split(path, '/')[-1] AS name, x0, y0, x1, y1, x1 - x0 AS w, y1 - y0 AS h, pad FROM tm WHERE is_dir),
kids AS (SELECT parent AS path, count(*) AS kids, max(w * h) AS area FROM b WHERE depth > 0 GROUP BY parent),
m AS (SELECT b.*, coalesce(kids = 1 AND area >= 0.85 * greatest(w - 2 * pad, 0) * greatest(h - 2 * pad, 0), FALSE) AND depth > 0 AS hidden FROM b LEFT JOIN kids USING (path)),
chain AS (SELECT path, CASE WHEN hidden THEN name ELSE '' END AS chain, CASE WHEN NOT hidden THEN name END AS tag FROM m WHERE depth = 1
  UNION ALL SELECT m.path, CASE WHEN m.hidden THEN CASE WHEN c.chain <> '' THEN c.chain || ' · ' || m.name ELSE m.name END ELSE '' END, CASE WHEN NOT m.hidden THEN CASE WHEN c.chain <> '' THEN c.chain || ' · ' || m.name ELSE m.name END END FROM m JOIN chain c ON m.parent = c.path WHERE m.depth > 1)
"""


@query(f"""
WITH RECURSIVE {PAGE_LEAVES}, {treemap_sql(PAGE_DEPTH)}, {TAGS},
shown AS (SELECT path, tag, depth, greatest({_X("x0 + pad")}, {SPACE}) AS x0, greatest({_Y("y0 + pad")}, {MAP.top + SPACE}) AS y0, least({_X("x1 - pad")}, {MAP.width - SPACE}) AS x1, least({_Y("y1 - pad")}, {MAP.top + MAP.height - SPACE}) AS y1, length(tag) * {LETTER} + {2 * INSET} AS w, {TALL}::DOUBLE AS h
  FROM m JOIN chain USING (path) WHERE tag IS NOT NULL AND least(m.w, m.h) * {MAP.zoom!r} >= 48 AND length(tag) * {LETTER} + {2 * INSET} <= 0.4 * m.w * {MAP.zoom!r}),
fits AS (SELECT row_number() OVER (ORDER BY depth, path) AS place, * FROM shown WHERE x1 - x0 >= w AND y1 - y0 >= h),
g AS (SELECT 0::BIGINT AS place, []::STRUCT(path VARCHAR, tag VARCHAR, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS placed
  UNION ALL SELECT place, CASE WHEN free AND sy + h <= y1 THEN list_append(placed, {{'path': path, 'tag': tag, 'x0': sx, 'y0': sy, 'x1': sx + w, 'y1': sy + h}}) ELSE placed END FROM ({_steps(view.SLIDES)})),
spots AS (SELECT unnest(placed) AS t FROM (SELECT placed FROM g ORDER BY place DESC LIMIT 1))
SELECT t.path AS path, t.tag AS tag, round(t.x0, 4) AS x, round(t.y0, 4) AS y FROM spots
""")
def f_tag_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tags of the pages' directories go on the map: beside those of directories above them."""
    boxes = page_treemap(spark, sf_dir).where("is_dir")
    parent = F.when(F.col("depth") > 0, tree.parent_path(F.col("path")))
    dirs = boxes.select("path", parent.alias("parent"), "depth", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), "pad", *(((F.col(c) + s * F.col("pad"))).alias(c) for c, s in (("x0", 1), ("y0", 1), ("x1", -1), ("y1", -1))))
    tagged = tree.tags(dirs).join(dirs, "path").where(view.tag_fits(F.col("tag"), F.col("w"), F.col("h"), MAP.zoom, LETTER, INSET))
    box = view.clipped(MAP.screen_box(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))), SPACE, MAP.top + SPACE, MAP.width - SPACE, MAP.top + MAP.height - SPACE)
    shown = tree.by_depth(tagged.select("path", "tag", "depth", box.alias("b"), (F.length("tag") * LETTER + 2 * INSET).alias("w"), F.lit(TALL).alias("h")))
    shown = shown.select("path", "tag", F.col("place").cast("long").alias("place"), "b.*", "w", "h")
    return view.placed_tags(shown, SPACE).join(shown.select("place", "path", "tag"), "place").select("path", "tag", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""
WITH RECURSIVE {PAGE_LEAVES}, {treemap_sql(PAGE_DEPTH)}, {POINTS},
met AS (SELECT event_id, path, depth, row_number() OVER (PARTITION BY event_id ORDER BY depth DESC, path) AS k FROM points JOIN tm ON is_dir AND x0 <= x AND x < x1 AND y0 <= y AND y < y1)
SELECT event_id, path AS dir, depth::BIGINT AS depth FROM met WHERE k = 1
""")
def j_deepest_at_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest directory of the pages around each point of the map."""
    dirs = cut(page_treemap(spark, sf_dir).where("is_dir").select("path", "depth", "x0", "y0", "x1", "y1"))
    met = spatial.at_points(points(spark, sf_dir), dirs, *Y.world())
    return long(met.groupBy("event_id").agg(F.min(F.struct((-F.col("depth")).alias("d"), "path")).alias("m")).select("event_id", F.col("m.path").alias("dir"), (-F.col("m.d")).alias("depth")))
