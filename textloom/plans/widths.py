"""Queries over proportional text and item words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import layout as Y
from textloom.operators import proportional as P
from textloom.operators import view
from textloom.plans.layout import H, W
from textloom.plans.registry import query
from textloom.plans.text import LINES, doc_lines, long
from textloom.plans.view import PER, TILES, hover_sql, points_over, tiled
from textloom.session import cut
from textloom.sources import corpora

ADV = P.advances()
CAP, HANG = 30.0, 1.0

#: Advances in SQL: a map of the same table.
_MAP = "MAP {" + ", ".join("'" + k.replace("'", "''") + f"': {v}::DOUBLE" for k, v in sorted(ADV.items())) + "}"
WIDTHS = f"""
adv AS (SELECT {_MAP} AS m),
cl AS (SELECT doc_id AS file_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
cw AS (SELECT file_id, line_no, text, CASE WHEN text = '' THEN [] ELSE list_transform(string_split(text, ''), lambda c: coalesce(m[c], {ADV["?"]})) END AS w FROM (SELECT * REPLACE (left(rtrim(text, ' '), 4096) AS text) FROM cl), adv)
"""


@query(f"WITH {WIDTHS} SELECT file_id, line_no, round(coalesce(list_sum(w), 0), 6)::DOUBLE AS width FROM cw WHERE text <> ''")
def a_line_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of every inked line in the face."""
    rows = doc_lines(spark, sf_dir).where("text <> ''")
    return rows.select("file_id", F.col("line_no").cast("long").alias("line_no"), F.round(P.line_width(F.col("text"), ADV), 6).alias("width"))


#: Rows of lines that wrap by width, in SQL: a fold over the characters of each line.
def _breaks(cap: str) -> str:
    full = f"a.x + e.x > CASE WHEN len(a.cols) > 1 THEN {cap} - {HANG} ELSE {cap} END + 1e-9"
    fold = f"list_reduce(list_transform(w, lambda c: {{'x': c, 'n': 1::BIGINT, 'cols': [0::BIGINT]}}), lambda a, e: CASE WHEN {full} THEN {{'x': e.x, 'n': a.n + 1, 'cols': list_append(a.cols, a.n)}} ELSE {{'x': a.x + e.x, 'n': a.n + 1, 'cols': a.cols}} END).cols"
    return f"CASE WHEN coalesce(list_sum(w), 0) > {cap} + 1e-9 THEN {fold} ELSE [0::BIGINT] END"


MEASURED = f"""
adv AS (SELECT {_MAP} AS m),
lw AS (SELECT file_id, line_no, text, CASE WHEN text = '' THEN []::DOUBLE[] ELSE list_transform(string_split(text, ''), lambda c: coalesce(m[c], {ADV["?"]})) END AS w FROM lines, adv)
"""
FOLDED = f"""
folded AS (SELECT *, {_breaks(str(CAP))} AS cols FROM lw),
wrows AS (SELECT file_id, line_no, i AS row_in_line, cols[i + 1] AS col0, coalesce(cols[i + 2], len(w)::BIGINT) - cols[i + 1] AS row_len, i = len(cols) - 1 AS last_row, text, w FROM (SELECT *, unnest(range(0, len(cols))) AS i FROM folded))
"""


@query(f"WITH {LINES}, {MEASURED}, {FOLDED} SELECT file_id, line_no, row_in_line, col0, row_len FROM wrows")
def l_wrap_by_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual rows of all lines in columns of 30 line heights, broken by the widths of their characters."""
    rows = P.wrapped(doc_lines(spark, sf_dir).select("file_id", "line_no", "text", F.lit(CAP).alias("cap")), ADV, HANG)
    return long(rows.select("file_id", "line_no", "row_in_line", "col0", "row_len"))


@query(f"""
WITH {LINES}, {MEASURED}, {FOLDED},
r AS (SELECT *, substr(text, col0 + 1, row_len) AS t, coalesce(list_sum(w[col0 + 1:col0 + row_len]), 0) AS width, CASE WHEN row_in_line = 0 THEN {CAP} ELSE {CAP - HANG} END AS target FROM wrows),
g AS (SELECT *, length(t) - length(replace(t, ' ', '')) AS gaps, target - width AS extra FROM r),
j AS (SELECT *, NOT last_row AND gaps > 0 AND extra > 0 AND extra < {P.STRETCH} * target AS ok FROM g)
SELECT file_id, line_no, row_in_line, round(CASE WHEN ok THEN target ELSE width END, 6)::DOUBLE AS row_width,
  round(CASE WHEN row_len > 0 THEN coalesce(list_sum(w[col0 + 1:col0 + row_len - 1]), 0) + CASE WHEN ok THEN extra / gaps ELSE 0 END * (length(left(t, row_len - 1)) - length(replace(left(t, row_len - 1), ' ', ''))) END, 6)::DOUBLE AS last_x FROM j
""")
def w_justified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of each wrapped row when all but a line's last are stretched to the column, and the x of its last character."""
    rows = P.wrapped(doc_lines(spark, sf_dir).select("file_id", "line_no", "text", F.lit(CAP).alias("cap")), ADV, HANG)
    rows = rows.withColumn("stretch", ~F.col("last_row"))
    target = F.when(F.col("row_in_line") == 0, CAP).otherwise(CAP - HANG)
    done = P.justified(rows, target, ADV)
    return long(done.select("file_id", "line_no", "row_in_line", F.round("row_width", 6).alias("row_width"), F.round(F.try_element_at("char_x", F.lit(-1)), 6).alias("last_x")))


@query(f"""
WITH {LINES}, {MEASURED}, {FOLDED},
r AS (SELECT *, substr(text, col0 + 1, row_len) AS t, coalesce(list_sum(w[col0 + 1:col0 + row_len]), 0) AS width, CASE WHEN row_in_line = 0 THEN {CAP} ELSE {CAP - HANG} END AS target FROM wrows),
g AS (SELECT *, length(t) - length(replace(t, ' ', '')) AS gaps, target - width AS extra FROM r),
j AS (SELECT *, NOT last_row AND gaps > 0 AND extra > 0 AND extra < {P.STRETCH} * target AS ok, row_len // 2 AS half FROM g)
SELECT file_id, line_no, row_in_line, round(CASE WHEN half < row_len THEN coalesce(list_sum(w[col0 + 1:col0 + half]), 0) + CASE WHEN ok THEN extra / gaps ELSE 0 END * (length(left(t, half)) - length(replace(left(t, half), ' ', ''))) WHEN ok THEN target ELSE width END, 6)::DOUBLE AS middle, round(CASE WHEN ok THEN target ELSE width END, 6)::DOUBLE AS behind FROM j
""")
def f_col_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x of the place in the middle of each justified row, and of the place behind its last character."""
    rows = P.wrapped(doc_lines(spark, sf_dir).select("file_id", "line_no", "text", F.lit(CAP).alias("cap")), ADV, HANG)
    rows = rows.withColumn("stretch", ~F.col("last_row"))
    done = P.justified(rows, F.when(F.col("row_in_line") == 0, CAP).otherwise(CAP - HANG), ADV)
    place = lambda col: F.round(P.col_offset(F.col("char_x"), F.col("row_width"), col), 6)
    return long(done.select("file_id", "line_no", "row_in_line", place(F.floor(F.col("row_len") / 2)).alias("middle"), place(F.col("row_len")).alias("behind")))


def _settled(page: tuple[int, float] | None) -> str:
    """Columns of all documents with lines that wrap by width, in SQL: a step for each round."""
    n, target = ("n", f"least(greatest(coalesce(p90, 0), {24 * Y.CHAR!r}), {100 * Y.CHAR!r})") if page is None else (f"greatest(n, {page[0]})", f"{float(page[1])}")
    up = lambda a, b: f"(({a} + {b} - 1) // {b})"
    total = f"1 + ceil(greatest(width - capw, 0) / greatest(capw - {HANG}, 1e-6))::BIGINT"
    out = [f"""lines_w AS (SELECT file_id, round(coalesce(list_sum(w), 0), 9)::DOUBLE AS width FROM lw),
own AS (SELECT file_id, count(*) AS n, quantile_cont(width, 0.9) AS p90, max(width) AS widest FROM lines_w GROUP BY file_id),
t0 AS (SELECT doc_id AS file_id, coalesce(n, 0) AS n, widest, greatest({n.replace("n", "coalesce(n, 0)") if page is None else n.replace("(n,", "(coalesce(n, 0),")}, 1) AS m, {target} AS target FROM documents LEFT JOIN own ON file_id = doc_id),
tk AS (SELECT file_id, max(k) AS k FROM t0, range(1, 65) AS r(k) WHERE k <= m AND (k = 1 OR {W} / (k + {Y.GAP} * (k - 1)) >= target * ({H} / ({up("m", "k")} + 2))) GROUP BY file_id),
t1 AS (SELECT t0.*, {up("m", "k")} AS rows FROM t0 JOIN tk USING (file_id)),
t2 AS (SELECT *, {up("m", "rows")} AS k FROM t1),
e0 AS (SELECT *, {H} / (rows + 2) AS pitch, {W} / (k + {Y.GAP} * (k - 1)) AS colw FROM t2),
f0 AS (SELECT *, colw / pitch AS capw, n > 0 AND coalesce(widest, 0) > colw / pitch AS wraps FROM e0)"""]
    for i in range(5):
        out.append(f"a{i} AS (SELECT file_id, sum({total})::BIGINT AS total FROM lines_w JOIN f{i} USING (file_id) GROUP BY file_id)")
        if i < 4:
            new = f"(colw * ({up('total', 'k')} + 2) / {H})"
            out.append(f"f{i + 1} AS (SELECT f{i}.* REPLACE (CASE WHEN wraps AND abs({new} - capw) >= 1e-9 THEN {new} ELSE capw END AS capw) FROM f{i} LEFT JOIN a{i} USING (file_id))")
    out.append(f"fw AS (SELECT f4.* REPLACE (CASE WHEN wraps THEN {up('total', 'k')} ELSE rows END AS rows, CASE WHEN wraps THEN {H} / ({up('total', 'k')} + 2) ELSE pitch END AS pitch, CASE WHEN wraps THEN colw * ({up('total', 'k')} + 2) / {H} ELSE capw END AS capw) FROM f4 LEFT JOIN a4 USING (file_id))")
    return ",\n".join(out)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, w, h, n, target, hist of all documents by the widths of their lines, in boxes of one size."""
    rows = doc_lines(spark, sf_dir).select("file_id", P.line_width(F.col("text"), ADV).alias("width"))
    counts = rows.groupBy("file_id", "width").agg(F.count("*").alias("count"))
    hist = counts.groupBy("file_id").agg(F.sum("count").alias("n"), F.percentile("width", 0.9, F.col("count")).alias("p90"), F.collect_list(F.struct("width", "count")).alias("hist"))
    files = corpora.prose(spark, sf_dir).select("file_id").join(hist, "file_id", "left")
    none = F.array().cast("array<struct<width:double,count:bigint>>")
    return files.select("file_id", F.lit(W).alias("w"), F.lit(H).alias("h"), F.coalesce("n", F.lit(0)).alias("n"), Y.target_width(F.coalesce("p90", F.lit(0.0))).alias("target"), F.coalesce("hist", none).alias("hist"))


@query(f"WITH {LINES}, {MEASURED}, {_settled(None)} SELECT file_id, k, rows::BIGINT AS rows, round(pitch, 6) AS pitch, round(capw, 6) AS capw FROM fw")
def l_layout_by_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns, rows and pitch of each file in a face with advances of its own, at the fixed point of pitch and width."""
    return P.settled(boxes(spark, sf_dir), HANG).select("file_id", "k", "rows", F.round("pitch", 6).alias("pitch"), F.round("capw", 6).alias("capw"))


PAGE = (40, 24.0)


@query(f"WITH {LINES}, {MEASURED}, {_settled(PAGE)} SELECT file_id, k, rows::BIGINT AS rows, round(pitch, 6) AS pitch, round(capw, 6) AS capw FROM fw")
def l_layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every file laid out as a full page of 40 lines of 24 line heights at least."""
    return P.settled(boxes(spark, sf_dir), HANG, page=PAGE).select("file_id", "k", "rows", F.round("pitch", 6).alias("pitch"), F.round("capw", 6).alias("capw"))


def _repaired(rounds: int) -> str:
    out = ["g0 AS (SELECT * FROM fw)"]
    for i in range(rounds):
        out.append(f"n{i} AS (SELECT file_id, sum(len({_breaks('capw')}))::BIGINT AS need FROM lw JOIN g{i} USING (file_id) GROUP BY file_id)")
        over = "coalesce((need + k - 1) // k, 0) > rows"
        out.append(f"g{i + 1} AS (SELECT g{i}.* REPLACE (CASE WHEN {over} THEN (need + k - 1) // k ELSE rows END AS rows, CASE WHEN {over} THEN {H} / ((need + k - 1) // k + 2) ELSE pitch END AS pitch, CASE WHEN {over} THEN colw * ((need + k - 1) // k + 2) / {H} ELSE capw END AS capw) FROM g{i} LEFT JOIN n{i} USING (file_id))")
    return ",\n".join(out)


@query(f"WITH {LINES}, {MEASURED}, {_settled(None)}, {_repaired(8)} SELECT file_id, rows::BIGINT AS rows, round(pitch, 6) AS pitch FROM g8")
def l_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and pitch of each file once the exact wrap of its lines fits, after eight rounds at most."""
    settled = P.settled(boxes(spark, sf_dir), HANG).select("file_id", "h", "k", "rows", "pitch", "colw", "capw")
    done = P.repaired(settled, doc_lines(spark, sf_dir).select("file_id", "text"), ADV, HANG)
    return done.select("file_id", "rows", F.round("pitch", 6).alias("pitch"))


@query(f"""
WITH {LINES}, {MEASURED}, {_settled(None)}, {TILES},
turned AS (SELECT lw.file_id, line_no, text, w, capw, colw, pitch, rows, {_breaks("capw")} AS cols FROM lw JOIN fw ON fw.file_id = lw.file_id),
prows AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no, row_in_line) - 1 AS row_in_file FROM (SELECT file_id, line_no, i AS row_in_line, cols[i + 1] AS col0, coalesce(cols[i + 2], len(w)::BIGINT) - cols[i + 1] AS row_len, i = len(cols) - 1 AS last_row, text, w, capw, colw, pitch, rows FROM (SELECT *, unnest(range(0, len(cols))) AS i FROM turned))),
jrows AS (SELECT *, CASE WHEN NOT last_row AND gaps > 0 AND target - width > 0 AND target - width < {P.STRETCH} * greatest(target, 1e-9) THEN (target - width) / gaps ELSE 0 END AS add FROM (
  SELECT *, coalesce(list_sum(w[col0 + 1:col0 + row_len]), 0) AS width, CASE WHEN row_in_line = 0 THEN capw ELSE capw - {HANG} END AS target, length(substr(text, col0 + 1, row_len)) - length(replace(substr(text, col0 + 1, row_len), ' ', '')) AS gaps FROM prows)),
""" + hover_sql("fw", "jrows", f"a_.colw * {1 + Y.GAP!r}".replace("a_.", ""), f"x0 + (v.row_in_file // a.rows) * wide + CASE WHEN row_in_line = 0 THEN 0 ELSE {HANG} * a.pitch END", "greatest(len(list_filter(range(0, row_len), lambda i: coalesce(list_sum(w[col0 + 1:col0 + i]), 0) + add * (length(left(substr(text, col0 + 1, row_len), i)) - length(replace(left(substr(text, col0 + 1, row_len), i), ' ', ''))) <= (x - row_x) / pitch)) - 1, 0)"))
def f_hover_by_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File, line and character under each point of the layout in a face with advances of its own, with justified rows."""
    files = cut(tiled(P.settled(boxes(spark, sf_dir), HANG).select("file_id", "k", "rows", "pitch", "capw", (F.col("colw") * (1 + Y.GAP)).alias("colw"))))
    lines = doc_lines(spark, sf_dir).select("file_id", "line_no", "text").join(files.select("file_id", F.col("capw").alias("cap"), "rows", "pitch", "colw", "x0", "y0"), "file_id")
    rows = Y.numbered(P.wrapped(lines, ADV, HANG))
    target = F.when(F.col("row_in_line") == 0, F.col("cap")).otherwise(F.col("cap") - HANG)
    x = F.col("x0") + F.floor(F.col("row_in_file") / F.col("rows")) * F.col("colw") + F.when(F.col("row_in_line") == 0, 0.0).otherwise(HANG * F.col("pitch"))
    over, height = points_over(spark, sf_dir)
    return long(view.hovered(over, files, rows.select("file_id", "row_in_file", "line_no", "col0", x.alias("x"), "row_text", (~F.col("last_row")).alias("stretch"), target.alias("target")), PER * W, height, ADV))
