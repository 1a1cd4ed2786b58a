"""Queries over stored indexes and layouts: search by stored kinds, rectangles along a curve, flat files, draw ranges, textures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import index, spatial, tree, view
from textloom.operators import layout as Y
from textloom.operators import lines as L
from textloom.operators import search as S
from textloom.plans.boxes import PAGE_LEAVES
from textloom.plans.layout import FLOW, SETTLED, WRAPPED, flow_boxes, visual_rows
from textloom.plans.registry import query
from textloom.plans.search import _HITS, MARKUP_WORD
from textloom.plans.sources import DOCS, source_files
from textloom.plans.text import LINES, _tile_sql, doc_lines, long
from textloom.plans.view import SEEN, VIEW
from textloom.session import cut, scratch
from textloom.sources import corpora, flat

CODE_WORD = "self"
_PATTERN = r'<!--[\s\S]*?-->|"(?:[^"\\\n]|\\.)*"|\b[0-9]+(?:\.[0-9]+)?\b|[A-Za-z_][A-Za-z0-9_]*|[0-9]+| +|\n|[\s\S]'
_KIND = r"""CASE WHEN regexp_full_match(t, ' *') OR t = chr(10) THEN 0 WHEN starts_with(t, '<!--') THEN 5 WHEN length(t) > 1 AND starts_with(t, '"') THEN 4 WHEN regexp_matches(t, '^[0-9]') AND NOT regexp_matches(f, '^[A-Za-z_]') THEN 6 WHEN regexp_matches(t, '^[A-Za-z_]') THEN 1 ELSE 7 END"""
#: Pages as an index stores them: lines without spaces at their ends, of 4096 characters at most.
STORED = r"""
stored AS (SELECT page_id, array_to_string(list_transform(string_split(regexp_replace(coalesce(html, ''), '[^\x00-\x7F]', '?', 'g'), chr(10)), lambda x: left(rtrim(x, ' '), 4096)), chr(10)) AS html FROM pages)
"""


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all source files and pages, with their kinds, from an index that is written and read again; corpus tells them apart.

    Kinds of source files are those of their whole lines, those of pages of their stored ones.
    """
    docs, pages = (index.by_file(f(spark, sf_dir).select("file_id", "text")) for f in (corpora.prose, corpora.markup))
    code = source_files(docs).withColumn("variant", F.col("lang"))
    pages = pages.select("file_id", F.lit("text").alias("lang"), F.lit("text-xml").alias("variant"), "text")
    path, tables = scratch(spark, "index"), {"code": code, "pages": pages}
    index.save({name: index.kinded_lines(index.stored_texts(f.select("file_id", "lang", "variant", "text"), whole=name == "code")) for name, f in tables.items()}, path, dealt=True)
    back = index.load(spark, path, tuple(tables))
    return back["code"].withColumn("corpus", F.lit("code")).unionByName(back["pages"].withColumn("corpus", F.lit("pages")))


@query(rf"""
WITH {DOCS}, {STORED}, {_tile_sql(_PATTERN, _KIND, "stored", "page_id", "html")},
blanked AS (SELECT file_id, string_agg(CASE WHEN kind IN (4, 5) THEN regexp_replace(t, '[A-Za-z0-9_]', chr(1), 'g') ELSE t END, '' ORDER BY pos) AS x FROM tiles GROUP BY file_id),
l AS (SELECT file_id, CASE WHEN right(x, 1) = chr(10) THEN string_split(left(x, length(x) - 1), chr(10)) ELSE string_split(x, chr(10)) END AS l FROM blanked),
mlines AS (SELECT file_id, generate_subscripts(l, 1) - 1 AS line_no, replace(unnest(l), chr(1), '_') AS text FROM l),
{_HITS.format(word=MARKUP_WORD, n=len(MARKUP_WORD), lines="mlines")}
SELECT 'pages' AS corpus, file_id, line_no, col FROM hits
UNION ALL SELECT 'code', doc_id, CASE lang WHEN 0 THEN 1 + 3 * i ELSE 1 + i END, 10 + length(i::VARCHAR) FROM each WHERE lang IN (0, 2)
""")
def f_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits outside comments and strings in source files and pages, from the kinds that an index stores beside its lines."""
    rows = stored_index(spark, sf_dir)
    found = [S.hits_without(rows.where(F.col("corpus") == c), w).select(F.lit(c).alias("corpus"), "file_id", "line_no", "col") for c, w in (("code", CODE_WORD), ("pages", MARKUP_WORD))]
    return long(found[0].unionByName(found[1]))


@query(f"WITH {FLOW} SELECT 'view' AS asked, file_id FROM flow WHERE {SEEN} UNION ALL SELECT 'point', file_id FROM flow WHERE x0 <= 801.5 AND 801.5 < x1 AND y0 <= 450.25 AND 450.25 < y1")
def v_stored_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in a view and around a point, from boxes that are stored along a curve: the comparisons reach the scan."""
    w, h = Y.world()
    path = scratch(spark, "boxes")
    spatial.store(flow_boxes(spark, sf_dir), path, w, h)
    seen, there = spatial.in_view(spark, path, *VIEW), spatial.around(spark, path, 801.5, 450.25)
    return seen.select(F.lit("view").alias("asked"), "file_id").unionByName(there.select(F.lit("point").alias("asked"), "file_id"))


@query(f"""
WITH {SETTLED}, {WRAPPED}, {FLOW}, runs AS (SELECT min(file_id) AS first, max(file_id) AS last FROM (SELECT file_id, file_id - row_number() OVER (ORDER BY file_id) AS g FROM flow WHERE {SEEN}) GROUP BY g),
sizes AS (SELECT doc_id AS file_id, coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM documents LEFT JOIN (SELECT file_id, count(*) AS r FROM vrows GROUP BY file_id) vr ON doc_id = vr.file_id LEFT JOIN (SELECT file_id, sum(len) AS c FROM lines GROUP BY file_id) ln ON doc_id = ln.file_id),
upto AS (SELECT file_id, r, c, sum(r) OVER w AS r1, sum(c) OVER w AS c1 FROM sizes WINDOW w AS (ORDER BY file_id))
SELECT what, first, last, (begin)::BIGINT AS begin, (past)::BIGINT AS past FROM (
  SELECT 'rows' AS what, first, last, a.r1 - a.r AS begin, b.r1 AS past FROM runs JOIN upto a ON a.file_id = first JOIN upto b ON b.file_id = last
  UNION ALL SELECT 'characters', first, last, a.c1 - a.c, b.c1 FROM runs JOIN upto a ON a.file_id = first JOIN upto b ON b.file_id = last) WHERE past > begin
""")
def v_draw_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last visual row and character of each run of visible files, over all files."""
    runs = cut(view.runs(flow_boxes(spark, sf_dir).select(F.col("file_id").alias("file_no"), view.visible(*VIEW).alias("seen"))))
    rows = visual_rows(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("rows"))
    sizes = L.file_metrics(doc_lines(spark, sf_dir), corpora.prose(spark, sf_dir)).join(rows, "file_id", "left")
    sizes = cut(sizes.select(F.col("file_id").alias("file_no"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("chars", F.lit(0)).alias("characters")))
    found = [view.drawn_ranges(runs, sizes, what).select(F.lit(what).alias("what"), "first", "last", "begin", "past") for what in ("rows", "characters")]
    return found[0].unionByName(found[1])


@query(f"""
WITH {PAGE_LEAVES}, dirs AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS path, i AS depth FROM (SELECT p, unnest(range(0, len(p))) AS i FROM (SELECT string_split(path, '/') AS p FROM leaves)))
SELECT row_number() OVER (ORDER BY path) - 1 AS id, depth, path, replace(path, '/', ' › ') AS crumb FROM dirs
""")
def j_crumb_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crumbs of the directories of the pages' URLs by their ids and their parents' alone."""
    dirs = tree.directories(corpora.markup(spark, sf_dir).select("path").distinct())
    named = L.ranked(dirs.select("path"), ["path"], "id").select(F.col("id").cast("long").alias("id"), "path")
    above = named.select(F.col("id").alias("parent"), F.col("path").alias("dir"))
    numbered = named.withColumn("dir", F.when(F.col("path") != "", tree.parent_path(F.col("path")))).join(above, "dir", "left")
    return long(tree.walked(cut(numbered.select("id", "parent", F.element_at(F.split("path", "/"), -1).alias("label")))).select("id", "depth", "path", "crumb"))


@query(f"""
WITH {SETTLED}, {WRAPPED}, offs AS (SELECT file_id, line_no, indent, coalesce(sum(len) OVER (ORDER BY file_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (SELECT *, length(text) - length(ltrim(text, ' ')) AS indent FROM lines)),
t AS (SELECT row_number() OVER (ORDER BY v.file_id, v.line_no, row_in_line) - 1 AS row, v.file_id, (off + col0)::BIGINT AS off, CASE WHEN col0 = 0 THEN indent ELSE 0 END AS indent, row_len FROM vrows v JOIN offs o ON o.file_id = v.file_id AND o.line_no = v.line_no)
SELECT (row // {view.TEXELS})::BIGINT AS page, row % {view.TEXELS} AS place, off & 4294967295 AS low, file_id AS file, (indent + row_len * 65536)::BIGINT AS packed, off >> 32 AS high FROM t
""")
def v_texels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every visual row is in a texture, and its four words."""
    lines = doc_lines(spark, sf_dir)
    rows = visual_rows(spark, sf_dir).select("file_id", "line_no", "row_in_file", "col0", "row_len", "indent")
    counts = rows.groupBy("file_id").agg(F.count("*").alias("rows"))
    begins = L.running(counts, "file_id", "rows", "row0").select("file_id", "row0")
    offsets = L.line_offsets(lines).select("file_id", "line_no", F.col("off").alias("line_off"))
    placed = rows.join(begins, "file_id").join(offsets, ["file_id", "line_no"])
    return long(view.texels(placed.select((F.col("row0") + F.col("row_in_file")).cast("long").alias("row"), "file_id", (F.col("line_off") + F.col("col0")).cast("long").alias("off"), "indent", "col0", "row_len")))


#: A weighted sum of an array's numbers, which depends on their places.
_SUM = "sum(value * (place % 97 + 1))"


@query(f"""
WITH {LINES}, {FLOW}, f AS (SELECT doc_id AS file_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, lang || '/' || source || '/' || doc_id AS path FROM documents),
n AS (SELECT place, coalesce(lines, 0) AS lines FROM f LEFT JOIN (SELECT file_id, count(*) AS lines FROM lines GROUP BY file_id) l ON l.file_id = f.file_id),
first AS (SELECT place, coalesce(sum(lines) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS value FROM n UNION ALL SELECT count(*), sum(lines) FROM n),
starts AS (SELECT place, coalesce(sum(length(path)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS value FROM f UNION ALL SELECT count(*), sum(length(path)) FROM f),
letters AS (SELECT row_number() OVER (ORDER BY file, i) - 1 AS place, ascii(c) AS value FROM (SELECT place AS file, generate_subscripts(string_split(path, ''), 1) AS i, unnest(string_split(path, '')) AS c FROM f)),
each AS (SELECT row_number() OVER (ORDER BY file_id, line_no) - 1 AS place, len, length(text) - length(ltrim(text, ' ')) AS indent FROM lines),
rects AS (SELECT f.place * 4 + i AS place, [x0, y0, x1, y1][i + 1] AS value FROM flow JOIN f USING (file_id), range(0, 4) AS r(i)),
every AS (SELECT 'file_line0' AS name, place, value::DOUBLE AS value FROM first UNION ALL SELECT 's_paths_off', place, value FROM starts UNION ALL SELECT 's_paths', place, value FROM letters UNION ALL SELECT 'line_len', place, len FROM each UNION ALL SELECT 'line_indent', place, indent FROM each UNION ALL SELECT 'file_rect', place, value FROM rects)
SELECT name, count(*) AS numbers, round({_SUM}, 2) AS checksum FROM every GROUP BY name
""")
def k_flat_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of all documents as a flat file, and what its arrays hold when they are read again."""
    docs, lines = corpora.prose(spark, sf_dir), cut(doc_lines(spark, sf_dir))
    heads = L.running(docs.select("file_id", "path", F.lit(1).alias("one")), "file_id", "one", "place").select("file_id", "path", F.col("place").cast("long").alias("place"))
    counts = L.running(L.file_metrics(lines, docs).select("file_id", "lines"), "file_id", "lines", "line0")
    heads = cut(heads.join(counts, "file_id").join(flow_boxes(spark, sf_dir), "file_id").withColumn("rect", F.array("x0", "y0", "x1", "y1")))
    rows = lines.join(heads.select("file_id", "line0"), "file_id").select((F.col("line0") + F.col("line_no")).cast("long").alias("place"), "len", "indent")
    slices = [
        flat.slices(heads, "place", {"file_rect": ("rect", "float64")}),
        flat.slices(flat.closed(heads, "place", "line0", "lines"), "place", {"file_line0": ("line0", "uint32")}),
        flat.slices(rows, "place", {"line_len": ("len", "uint16"), "line_indent": ("indent", "uint16")}),
        flat.text_slices(heads, "place", "s_paths", "path"),
    ]
    path = scratch(spark, "viewer") + ".bin"
    written = flat.write(flat.together(slices), path)
    back = [flat.read(spark, path, e.name).select(F.lit(e.name).alias("name"), "place", F.col("value").cast("double").alias("value")) for e in written]
    return flat.together(back).groupBy("name").agg(F.count("*").alias("numbers"), F.round(F.expr(_SUM), 2).alias("checksum"))
