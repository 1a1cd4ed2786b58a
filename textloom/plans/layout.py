"""Queries over layouts: columns, wrapping, grids, treemaps, items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import layout as Y
from textloom.operators import lines as L
from textloom.operators import order
from textloom.operators import tokens as K
from textloom.plans.registry import query
from textloom.plans.text import LINES, doc_lines, long
from textloom.session import cut
from textloom.sources import corpora

W, H = 40.0, 30.0  # every file's box where a query needs boxes of one size

_UP = "CAST(floor(({a} + {b} - 1) / {b}) AS BIGINT)"


def _up(a: str, b: str) -> str:
    return f"(({a} + {b} - 1) // {b})"


WIDTHS = f"widths AS (SELECT file_id, count(*) AS n, quantile_cont((len * {Y.CHAR})::DOUBLE, 0.9) AS p90, max(len) AS longest FROM lines GROUP BY file_id)"
FIT = f"""
targets AS (SELECT doc_id AS file_id, coalesce(n, 0) AS n, greatest(coalesce(n, 0), 1) AS m, coalesce(longest, 0) AS longest, least(greatest(coalesce(p90, 0), {24 * Y.CHAR!r}), {100 * Y.CHAR!r}) AS target FROM documents LEFT JOIN widths ON file_id = doc_id),
tried AS (SELECT file_id, max(k) AS k FROM targets, range(1, 65) AS r(k) WHERE k <= m AND (k = 1 OR {W} / (k + {Y.GAP} * (k - 1)) >= target * ({H} / ({_up("m", "k")} + 2))) GROUP BY file_id),
fit0 AS (SELECT t.*, {_up("m", "k")} AS rows FROM targets t JOIN tried USING (file_id)),
fit1 AS (SELECT *, {_up("m", "rows")} AS k FROM fit0),
fit AS (SELECT *, {H} / (rows + 2) AS pitch, {W} / (k + {Y.GAP} * (k - 1)) AS colw FROM fit1)
"""


def boxes(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """file_id, w, h, n, target, hist of all documents, or of those in only (file_id), in boxes of one size."""
    rows, files = doc_lines(spark, sf_dir), corpora.prose(spark, sf_dir).select("file_id")
    if only is not None:
        rows, files = rows.join(only, "file_id", "left_semi"), files.join(only, "file_id", "left_semi")
    files = files.join(Y.length_histogram(rows), "file_id", "left")
    none = F.array().cast("array<struct<len:bigint,count:bigint>>")
    return files.select("file_id", F.lit(W).alias("w"), F.lit(H).alias("h"), F.coalesce("n", F.lit(0)).alias("n"), Y.target_width(F.coalesce("p90", F.lit(0.0))).alias("target"), F.coalesce("hist", none).alias("hist"))


@query(f"WITH {LINES}, {WIDTHS} SELECT file_id, round(p90, 6) AS p90 FROM widths")
def a_p90_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).groupBy("file_id").agg(F.round(F.percentile(F.col("len") * Y.CHAR, 0.9), 6).alias("p90"))


@query(f"WITH {LINES} SELECT source, round(quantile_cont((len * {Y.CHAR})::DOUBLE, 0.995), 6) AS width FROM lines JOIN documents ON doc_id = file_id WHERE len > 0 GROUP BY source")
def a_p995_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line width of each source as a book. Percentiles aggregate counts by length, not lines."""
    lengths = doc_lines(spark, sf_dir).where("len > 0").join(corpora.prose(spark, sf_dir).select("file_id", "source"), "file_id").groupBy("source", "len").agg(F.count("*").alias("n"))
    return lengths.groupBy("source").agg(F.round(F.percentile(F.col("len") * Y.CHAR, 0.995, F.col("n")), 6).alias("width"))


@query(f"WITH {LINES}, {WIDTHS}, {FIT} SELECT file_id, k, rows, round(pitch, 6) AS pitch, round(colw, 6) AS colw FROM fit")
def l_file_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = Y.with_columns_fit(boxes(spark, sf_dir))
    return fitted.select("file_id", "k", "rows", F.round("pitch", 6).alias("pitch"), F.round("colw", 6).alias("colw"))


@query(f"""
WITH {LINES}, {WIDTHS}, {FIT}, s AS (SELECT pitch, file_id, sum(n) OVER (ORDER BY pitch, file_id) AS upto, sum(n) OVER () AS total FROM fit)
SELECT round(min_by(pitch, upto), 6) AS median_pitch FROM s WHERE upto >= total / 2
""")
def a_median_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pitch of the file that has the median line, found by counts of lines in ranges of pitches."""
    pitches = cut(Y.with_columns_fit(boxes(spark, sf_dir)).select("pitch", "n"))
    return spark.range(1).select(F.round(F.lit(order.weighted_median(pitches, "pitch", "n")), 6).alias("median_pitch"))


def _settle(rounds: int = 4) -> str:
    """The fixed point in SQL: a step for each round."""
    cap = f"CASE WHEN cap >= {Y.WRAP_FROM} THEN cap ELSE {Y.MOST_CHARS} END"
    out = [f"hist AS (SELECT file_id, len, count(*) AS c FROM lines GROUP BY ALL), s0 AS (SELECT *, least(floor(colw / pitch / {Y.CHAR}), {Y.MOST_CHARS})::BIGINT AS cap FROM fit)"]
    out.append(f"c0 AS (SELECT *, n > 0 AND cap >= {Y.WRAP_FROM} AND longest > cap AS wraps FROM s0)")
    for i in range(rounds + 1):
        rows = f"r{i} AS (SELECT file_id, sum(c * (1 + (greatest(len - ({cap}), 0) + ({cap}) - {Y.HANG} - 1) // (({cap}) - {Y.HANG})))::BIGINT AS total FROM hist JOIN c{i} USING (file_id) GROUP BY file_id)"
        out.append(rows)
        step = f"least(floor(colw / ({H} / ({_up('total', 'k')} + 2) * {Y.CHAR})), {Y.MOST_CHARS})::BIGINT"
        if i < rounds:
            out.append(f"c{i + 1} AS (SELECT c{i}.* REPLACE (CASE WHEN wraps THEN {step} ELSE cap END AS cap) FROM c{i} LEFT JOIN r{i} USING (file_id))")
    out.append(f"settled AS (SELECT c{rounds}.* REPLACE (CASE WHEN wraps THEN {_up('total', 'k')} ELSE rows END AS rows, CASE WHEN wraps THEN {H} / ({_up('total', 'k')} + 2) ELSE pitch END AS pitch) FROM c{rounds} LEFT JOIN r{rounds} USING (file_id))")
    return ",\n".join(out)


SETTLED = f"{LINES}, {WIDTHS}, {FIT}, {_settle()}"


@query(f"WITH {SETTLED} SELECT file_id, k, rows::BIGINT AS rows, cap, round(pitch, 6) AS pitch FROM settled")
def l_layout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns, rows and pitch of each file with its lines wrapped, at the fixed point of pitch and capacity."""
    return Y.settled(boxes(spark, sf_dir)).select("file_id", "k", "rows", "cap", F.round("pitch", 6).alias("pitch"))


WRAPPED = f"""
capped AS (SELECT l.*, CASE WHEN cap >= {Y.WRAP_FROM} THEN cap ELSE {Y.MOST_CHARS} END AS c, s.rows, s.pitch, s.colw FROM lines l JOIN settled s USING (file_id)),
wrapped AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE c + (i - 1) * (c - {Y.HANG}) END AS col0 FROM (SELECT *, unnest(range(0, 1 + (greatest(len - c, 0) + c - {Y.HANG} - 1) // (c - {Y.HANG}))) AS i FROM capped)),
vrows AS (SELECT file_id, line_no, i AS row_in_line, col0, greatest(CASE WHEN i = 0 THEN least(len, c) ELSE least(len - col0, c - {Y.HANG}) END, 0) AS row_len, rows, pitch, colw, row_number() OVER (PARTITION BY file_id ORDER BY line_no, i) - 1 AS row_in_file FROM wrapped)
"""


def visual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = Y.settled(boxes(spark, sf_dir)).select("file_id", "cap", "rows", "pitch", "colw")
    return Y.numbered(Y.wrapped(doc_lines(spark, sf_dir).drop("text").join(fitted, "file_id")))


@query(f"WITH {SETTLED}, {WRAPPED} SELECT file_id, line_no, row_in_line, col0::BIGINT AS col0, row_len::BIGINT AS row_len FROM vrows")
def l_wrap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(visual_rows(spark, sf_dir).select("file_id", "line_no", "row_in_line", "col0", "row_len"))


@query(f"""
WITH {SETTLED}, {WRAPPED} SELECT file_id, line_no, row_in_line, round((row_in_file // rows) * colw * {1 + Y.GAP!r} + CASE WHEN row_in_line = 0 THEN 0 ELSE {Y.HANG * Y.CHAR!r} * pitch END, 6) AS x, round(pitch * (1 + row_in_file % rows), 6) AS y FROM vrows
""")
def l_row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visual_rows(spark, sf_dir)
    x, y = Y.row_position(F.lit(0.0), F.lit(0.0), F.col("row_in_file"), F.col("rows"), F.col("pitch"), F.col("colw") * (1 + Y.GAP), F.col("row_in_line") == 0)
    return long(rows.select("file_id", "line_no", "row_in_line", F.round(x, 6).alias("x"), F.round(y, 6).alias("y")))


@query(f"WITH {SETTLED}, {WRAPPED} SELECT file_id, line_no, len AS wanted, sum(row_len)::BIGINT AS covered FROM vrows JOIN lines USING (file_id, line_no) GROUP BY ALL HAVING sum(row_len) <> len")
def c_row_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose rows don't cover them: none."""
    rows = visual_rows(spark, sf_dir).groupBy("file_id", "line_no", "len").agg(F.sum("row_len").alias("covered"))
    return long(rows.where("covered <> len").select("file_id", "line_no", F.col("len").alias("wanted"), "covered"))


@query(f"""
WITH {SETTLED}, {WRAPPED}, p AS (SELECT file_id, line_no, 7 * line_no % greatest(len, 1) AS col FROM lines WHERE len > 0)
SELECT p.file_id, p.line_no, p.col, row_in_line, (col - col0)::BIGINT AS within FROM p JOIN vrows v ON v.file_id = p.file_id AND v.line_no = p.line_no AND col >= col0 AND col < col0 + row_len
""")
def j_row_of_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visual row of one column of each line: an equi-join on the line with the column's range."""
    points = doc_lines(spark, sf_dir).where("len > 0").select("file_id", "line_no", ((7 * F.col("line_no")) % F.greatest("len", F.lit(1))).alias("col"))
    rows = visual_rows(spark, sf_dir).select("file_id", "line_no", "row_in_line", "col0", "row_len")
    met = points.join(rows, ["file_id", "line_no"]).where("col >= col0 AND col < col0 + row_len")
    return long(met.select("file_id", "line_no", "col", "row_in_line", (F.col("col") - F.col("col0")).alias("within")))


PAD = 4.0
_IW, _IH = Y.WORLD - 2 * PAD, Y.WORLD / Y.ASPECT - 2 * PAD
FLOW = f"""
count_ AS (SELECT count(*) AS n FROM documents),
tried_flow AS (SELECT cols, {_up("n", "cols")} AS rows, {_IW!r} / cols AS cw, {_IH!r} / {_up("n", "cols")} AS ch FROM (SELECT n, unnest(range(1, n + 1)) AS cols FROM count_)),
rated AS (SELECT *, (cw - {Y.PAGE_GAP} * cw) / (ch - {Y.PAGE_GAP} * cw) / {Y.PAGE_ASPECT!r} AS ratio FROM tried_flow WHERE ch > {Y.PAGE_GAP} * cw),
grid AS (SELECT cols, rows, cw, ch FROM rated ORDER BY ratio < 1, abs(ln(ratio)), cols LIMIT 1),
flow AS (SELECT file_id, {PAD} + (k % cols) * cw + {Y.PAGE_GAP / 2} * cw AS x0, {PAD} + (k // cols) * ch + {Y.PAGE_GAP / 2} * cw AS y0, {PAD} + (k % cols + 1) * cw - {Y.PAGE_GAP / 2} * cw AS x1, {PAD} + (k // cols + 1) * ch - {Y.PAGE_GAP / 2} * cw AS y1
  FROM (SELECT doc_id AS file_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents), grid)
"""


def flow_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of all documents as pages in reading order."""
    pages = corpora.prose(spark, sf_dir).select("file_id", F.lit(1).cast("long").alias("one"))
    pages = L.running(pages, "file_id", "one", "page_no").drop("one")
    return Y.flow(pages).drop("page_no")


@query(f"WITH {FLOW} SELECT file_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM flow")
def l_grid_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = flow_boxes(spark, sf_dir)
    return placed.select("file_id", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"""
WITH parts AS (SELECT row_number() OVER (ORDER BY source) - 1 AS part_no, count(*) AS pages FROM documents GROUP BY source),
tried AS (SELECT cols, sum({_up("pages", "cols")}) AS all_rows FROM parts, (SELECT unnest(range(1, max(pages) + 1)) AS cols FROM parts) GROUP BY cols),
rated AS (SELECT *, ({_IW!r} / cols) / ({_IH!r} / all_rows) / {Y.PAGE_ASPECT!r} AS ratio FROM tried),
best AS (SELECT cols, all_rows::BIGINT AS all_rows FROM rated ORDER BY ratio < 1, abs(ln(ratio)), cols LIMIT 1),
banded AS (SELECT part_no, pages, cols, {_up("pages", "cols")} AS rows, all_rows FROM parts, best)
SELECT part_no, pages, cols, rows, round({PAD} + coalesce(sum(rows) OVER (ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {_IH!r} / all_rows, 6)::DOUBLE AS y0, round({PAD} + sum(rows) OVER (ORDER BY part_no) * {_IH!r} / all_rows, 6)::DOUBLE AS y1 FROM banded
""")
def l_grid_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as parts of a book, in bands of whole page rows."""
    from pyspark.sql import Window

    counts = corpora.prose(spark, sf_dir).groupBy("source").agg(F.count("*").alias("pages"))
    parts = counts.select((F.row_number().over(Window.orderBy("source")) - 1).cast("long").alias("part_no"), "pages")
    return Y.part_bands(parts).withColumns({"y0": F.round("y0", 6), "y1": F.round("y1", 6)})


@query(f"""
WITH items AS (SELECT event_id AS item_id, (event_id * 7) % 90 AS s, (event_id * 7) % 90 + 1 + event_id % 45 AS e FROM events),
cut AS (SELECT item_id, s, least(e, 100) AS e FROM items WHERE least(e, 100) > s),
cols AS (SELECT *, unnest(range(s // 20, (e - 1) // 20 + 1)) AS col FROM cut)
SELECT item_id, col, round(10.0 + col * 5.0, 6)::DOUBLE AS bx0, round(4.0 + 0.5 * (1 + CASE WHEN col = s // 20 THEN s - col * 20 ELSE 0 END), 6)::DOUBLE AS by0, round(10.0 + col * 5.0 + 5.0 / 1.06, 6)::DOUBLE AS bx1, round(4.0 + 0.5 * (1 + CASE WHEN col = (e - 1) // 20 THEN e - col * 20 ELSE 20 END), 6)::DOUBLE AS by1 FROM cols
""")
def l_item_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of items over rows of a file of 100 rows in columns of 20."""
    s = (F.col("event_id") * 7) % 90
    items = corpora.table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), s.alias("s"), (s + 1 + F.col("event_id") % 45).alias("e"), F.lit(100).alias("total"), F.lit(20).alias("rows"), F.lit(10.0).alias("x0"), F.lit(4.0).alias("y0"), F.lit(0.5).alias("pitch"), F.lit(5.0).alias("colw"))
    out = Y.item_boxes(items)
    return out.select("item_id", F.col("col").cast("long").alias("col"), *(F.round(c, 6).alias(c) for c in ("bx0", "by0", "bx1", "by1")))


def doc_treemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a treemap by language and source, weighed by tokens of their text."""
    files = corpora.prose(spark, sf_dir)
    weighed = files.withColumn("runs", K.prose_runs(F.col("text")))
    return Y.treemap(weighed.select("path", F.greatest("runs", F.lit(1)).cast("double").alias("weight"), F.size(F.split("text", "\n")).cast("long").alias("lines")))


@query("SELECT * FROM (VALUES ('area', 0::BIGINT), ('containment', 0), ('overlap', 0)) AS t(rule, violations)")
def c_treemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of the treemap: children inside their parents, no overlap among siblings, areas in proportion to weights."""
    from textloom.operators import spatial, tree

    boxes_ = doc_treemap(spark, sf_dir).withColumn("parent", F.when(F.col("path") == "", F.lit(None)).otherwise(tree.parent_path(F.col("path"))))
    w, h = Y.world()
    nodes = boxes_.withColumn("id", F.concat(F.col("path"), F.when(F.col("is_dir"), "/").otherwise("")))
    parents = nodes.where("is_dir").select(F.col("path").alias("parent"), "x0", "y0", "x1", "y1")
    outside = spatial.outside(nodes.where("path <> ''"), parents, "parent")
    crossing = spatial.overlaps(nodes.where("path <> ''"), "parent", "id", w, h)
    inner = nodes.where("is_dir").select(F.col("path").alias("parent"), ((F.col("x1") - F.col("x0") - 2 * F.col("pad")) * (F.col("y1") - F.col("y0") - 2 * F.col("pad")) / F.col("weight")).alias("share"))
    skewed = nodes.where("path <> ''").join(inner, "parent").where(F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) - F.col("weight") * F.col("share")) > 1e-6 * F.greatest(F.col("weight") * F.col("share"), F.lit(1.0)))
    counts = [df.agg(F.count("*").alias("violations")).select(F.lit(n).alias("rule"), "violations") for n, df in (("area", skewed), ("containment", outside), ("overlap", crossing))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
