"""Queries over hits: search, reports, jumps, trees, tints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import lines as L
from textloom.operators import search as S
from textloom.operators import tree
from textloom.plans.registry import query
from textloom.plans.text import LINES, XML_TILES, ascii_pages, doc_lines, long
from textloom.sources import corpora, trees

WORD, MARKUP_WORD = "the", "on"

#: Columns of a word in a line: lengths of the pieces between hits, summed.
_HITS = """
hits AS (SELECT file_id, line_no, text, col FROM (
  SELECT file_id, line_no, text, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * {n}))::BIGINT AS col
  FROM (SELECT file_id, line_no, text, string_split_regex(text, '\\b{word}\\b') AS p FROM {lines})))
"""
HITS = _HITS.format(word=WORD, n=len(WORD), lines="lines")
RANKED = f"{LINES}, {HITS}, ranked AS (SELECT *, row_number() OVER (ORDER BY file_id, line_no, col) - 1 AS hit FROM hits)"


def doc_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hits(doc_lines(spark, sf_dir), WORD)


@query(f"WITH {LINES}, {HITS} SELECT file_id, line_no, col FROM hits")
def f_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(doc_hits(spark, sf_dir))


@query(f"WITH {LINES}, {HITS}, n AS (SELECT file_id, count(*) AS hits FROM hits GROUP BY file_id) SELECT doc_id AS file_id, coalesce(hits, 0) AS hits FROM documents LEFT JOIN n ON n.file_id = doc_id")
def f_hits_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpora.prose(spark, sf_dir).select("file_id")
    return files.join(S.per_file(doc_hits(spark, sf_dir)), "file_id", "left").select("file_id", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


@query(f"WITH {LINES}, {HITS} SELECT file_id, count(*) AS hits FROM hits GROUP BY file_id ORDER BY hits DESC, file_id LIMIT 20")
def f_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.per_file(doc_hits(spark, sf_dir)).orderBy(F.desc("hits"), "file_id").limit(20)


@query(f"WITH {RANKED} SELECT file_id, line_no, col, hit FROM ranked")
def w_hit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(S.ranked(doc_hits(spark, sf_dir)))


@query(f"WITH {RANKED}, n AS (SELECT count(*) AS n FROM ranked) SELECT hit, (hit + 1) % n AS following, (hit - 1 + n) % n AS previous FROM ranked, n")
def w_step_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = S.ranked(doc_hits(spark, sf_dir))
    count = F.broadcast(order.agg(F.count("*").alias("n")))  # one row
    return long(order.crossJoin(count).select("hit", S.step(F.col("hit"), 1, F.col("n")).alias("following"), S.step(F.col("hit"), -1, F.col("n")).alias("previous")))


@query(f"WITH {RANKED} SELECT file_id, line_no, col, hit FROM ranked ORDER BY hit LIMIT 40 OFFSET 100")
def o_report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the report: hits 100 to 139."""
    return long(S.ranked(doc_hits(spark, sf_dir)).orderBy("hit").offset(100).limit(40))


@query(rf"""
WITH {XML_TILES}, blanked AS (SELECT file_id, string_agg(CASE WHEN kind IN (4, 5) THEN regexp_replace(t, '[A-Za-z0-9_]', chr(1), 'g') ELSE t END, '' ORDER BY pos) AS x FROM tiles GROUP BY file_id),
l AS (SELECT file_id, CASE WHEN right(x, 1) = chr(10) THEN string_split(left(x, length(x) - 1), chr(10)) ELSE string_split(x, chr(10)) END AS l FROM blanked),
mlines AS (SELECT file_id, generate_subscripts(l, 1) - 1 AS line_no, replace(unnest(l), chr(1), '_') AS text FROM l),
{_HITS.format(word=MARKUP_WORD, n=len(MARKUP_WORD), lines="mlines")}
SELECT file_id, line_no, col FROM hits
""")
def f_search_outside_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in pages, without those in comments and strings."""
    return long(S.hits_outside(ascii_pages(spark, sf_dir).select("file_id", "text"), MARKUP_WORD, "text-xml"))


@query(f"""
WITH {RANKED}, first AS (SELECT file_id, min(hit) AS hit FROM ranked GROUP BY file_id)
SELECT -1::BIGINT AS hit, 0::BIGINT AS level, 'Hits (' || count(*) || ')' AS row FROM ranked
UNION ALL SELECT hit, 1, CASE WHEN length(p) > 60 THEN '…' || right(p, 59) ELSE p END FROM first JOIN (SELECT doc_id, lang || '/' || source || '/' || doc_id AS p FROM documents) ON doc_id = file_id
UNION ALL SELECT hit, 2, lpad((line_no + 1)::VARCHAR, 5, ' ') || ' ' || substr(text, CASE WHEN col - i + {len(WORD)} > 54 THEN greatest(col - 8, 0) ELSE i END + 1, 54)
FROM (SELECT *, length(text) - length(ltrim(text, ' ')) AS i FROM ranked)
""")
def f_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.hits(doc_lines(spark, sf_dir), WORD, ["text"])
    return long(S.report(found, corpora.prose(spark, sf_dir).select("file_id", "path"), len(WORD), 60))


@query(f"WITH {LINES}, {HITS} SELECT doc_id AS file_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.file_id = doc_id)")
def f_dimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a hit, which a view dims."""
    return corpora.prose(spark, sf_dir).select("file_id").join(doc_hits(spark, sf_dir), "file_id", "left_anti")


@query("""
WITH f AS (SELECT doc_id AS file_id, lang || '/' || source || '/' || doc_id AS path FROM documents)
SELECT file_id, path, 0::BIGINT AS line_no FROM f WHERE path = '7' OR ends_with(path, '/7') ORDER BY length(path), file_id LIMIT 1
""")
def j_goto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jump to line 1 of the file whose path ends in /7."""
    files = corpora.prose(spark, sf_dir).select("file_id", "path", F.greatest(F.size(T.line_array(F.col("text"))), F.lit(1)).cast("long").alias("lines"))
    return S.goto(files, "7:1")


@query("""
WITH e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000000)::BIGINT AS s FROM events),
spans AS (SELECT event_id AS item_id, user_id, s AS first, s + 3600 * (1 + event_id % 30) AS past FROM e),
best AS (SELECT p.event_id, item_id, row_number() OVER (PARTITION BY p.event_id ORDER BY past - first, item_id) AS k FROM e p JOIN spans ON spans.user_id = p.user_id AND first <= s AND s < past)
SELECT event_id, item_id FROM best WHERE k = 1
""")
def j_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's smallest enclosing span: a span begins at every event of a user."""
    from textloom.operators import spatial

    events = corpora.table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    spans = events.select(F.col("event_id").alias("item_id"), "user_id", F.col("at").alias("first"), (F.col("at") + 3600 * (1 + F.col("event_id") % 30)).alias("past"))
    return spatial.enclosing(events, spans, "user_id", "at", "event_id", "item_id", width=24 * 3600)


@query("""
WITH l AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
marks AS (SELECT doc_id, line_no, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM l),
found AS (SELECT doc_id, string_split_regex(text, '\\bthe\\b') AS p FROM documents),
points AS (SELECT doc_id, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * 3))::BIGINT AS place FROM found)
SELECT p.doc_id, place, line_no FROM points p ASOF JOIN marks m ON p.doc_id = m.doc_id AND p.place >= m.off
""")
def j_line_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of every hit in the whole texts, as of its start."""
    docs = corpora.prose(spark, sf_dir).where("text <> ''")
    starts = docs.select(F.col("file_id").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    marks = starts.select("doc_id", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("place"), "line_no")
    points = docs.where(F.col("text").contains(WORD)).select(F.col("file_id").alias("doc_id"), F.explode(S.hit_columns(F.col("text"), WORD)).alias("place")).withColumn("place", F.col("place").cast("long"))
    return long(L.as_of(points, marks, "doc_id", "place", "line_no"))


DIRS = """
paths AS (SELECT doc_id, string_split(lang || '/' || source || '/' || doc_id, '/') AS p, text FROM documents),
above AS (SELECT doc_id, text, array_to_string(p[1:i], '/') AS dir, i FROM (SELECT doc_id, text, p, unnest(range(0, len(p))) AS i FROM paths))
"""


@query(f"WITH {DIRS} SELECT dir AS path, i AS depth, count(*) AS files, sum(length(text))::BIGINT AS chars FROM above GROUP BY dir, i")
def l_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpora.prose(spark, sf_dir).select("path", F.length("text").alias("chars"))
    return long(tree.directories(files, ["chars"]))


@query("SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, count(*) AS files, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def a_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = corpora.prose(spark, sf_dir).rollup("lang", "source").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))
    return rolled.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "files", "chars")


@query("""
WITH p AS (SELECT DISTINCT string_split(rtrim(regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', ''), '/'), '/') AS p FROM pages),
k AS (SELECT array_to_string(p, '/') AS path, list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN '1' ELSE '0' END || x || chr(1)) AS k FROM p)
SELECT path, row_number() OVER (ORDER BY k) - 1 AS file_no FROM k
""")
def w_pre_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by URL path in pre-order: a directory's files before its directories."""
    return tree.pre_order(corpora.markup(spark, sf_dir).select("path").distinct())


@query("""
WITH d AS (SELECT DISTINCT lang || '/' || source AS path, lang FROM documents),
c AS (SELECT path, string_split(path, '/') AS p FROM d)
SELECT path, array_to_string(p, ' › ') AS crumb, p[1] AS parent FROM c
""")
def j_crumb(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = corpora.prose(spark, sf_dir).select(F.concat_ws("/", "lang", "source").alias("path")).distinct()
    return dirs.select("path", tree.crumb(F.col("path")).alias("crumb"), tree.parent_path(F.col("path")).alias("parent"))


@query(f"""
WITH {DIRS}, d AS (SELECT DISTINCT dir AS path, i AS depth, split_part(dir, '/', 1) AS top FROM above),
h AS (SELECT path AS top, row_number() OVER (ORDER BY path) % 12 AS hue FROM d WHERE depth = 1)
SELECT path, CASE WHEN depth = 0 THEN 0 ELSE hue END::BIGINT AS hue FROM d LEFT JOIN h USING (top)
""")
def p_hues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(tree.hues(tree.directories(corpora.prose(spark, sf_dir).select("path"))))


CHURN = "churn AS (SELECT c_mktsegment || '/' || c_nationkey AS path, sum(l_linenumber)::BIGINT AS churn FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY path)"


def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders, customers = (corpora.table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    joined = items.select("l_orderkey", "l_linenumber").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(customers.select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("path")).agg(F.sum("l_linenumber").alias("churn"))


@query(f"WITH {CHURN} SELECT path, churn FROM churn")
def a_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn(spark, sf_dir)


@query(f"WITH {CHURN} SELECT path, churn, round(ln(1 + churn) / greatest(max(ln(1 + churn)) OVER (), 1e-9), 6) AS tint FROM churn")
def a_tint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.tint(churn(spark, sf_dir)).withColumn("tint", F.round("tint", 6))
