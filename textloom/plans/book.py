"""Queries over books: conversations as books, and literal ones for the rules that these don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import book as B
from textloom.plans.registry import query
from textloom.plans.text import long
from textloom.sources import corpora

#: Every conversation becomes a book: its turns as chapters under two part headings, each turn's text cut into lines of 12 words.
BOOK_SQL = r"""
turns AS (SELECT conv_id AS book, turn, regexp_split_to_array(trim(text), '\s+') AS w FROM conversations WHERE text IS NOT NULL),
chunks AS (SELECT book, turn, i, array_to_string(w[i * 12 + 1:i * 12 + 12], ' ') AS text FROM (SELECT *, unnest(range(0, (len(w) + 11) // 12)) AS i FROM turns)),
raw AS (
  SELECT book, 0 AS turn, -3 AS i, 'Contents of the book' AS text FROM (SELECT DISTINCT book FROM turns)
  UNION ALL SELECT book, turn, -2, CASE WHEN turn % 4 = 0 THEN 'BOOK ' || (turn // 4 + 1) || ': 1805' ELSE '' END FROM turns
  UNION ALL SELECT book, turn, -1, 'CHAPTER ' || (turn + 1) FROM turns
  UNION ALL SELECT book, turn, i, text FROM chunks
  UNION ALL SELECT book, turn, 100000, '' FROM turns),
book AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY turn, i) - 1 AS line_no, text FROM raw)
"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, line_no, text."""
    from pyspark.sql import Window

    turns = corpora.table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("book"), "turn", F.split(F.trim("text"), r"\s+").alias("w"))
    i = F.explode(F.sequence(F.lit(0), F.floor((F.size("w") + 11) / 12).cast("int") - 1)).alias("i")
    chunks = turns.select("book", "turn", i, "w").select("book", "turn", "i", F.array_join(F.slice("w", F.col("i") * 12 + 1, 12), " ").alias("text"))
    head = turns.select("book").distinct().select("book", F.lit(0).cast("long").alias("turn"), F.lit(-3).alias("i"), F.lit("Contents of the book").alias("text"))
    parts = turns.select("book", "turn", F.lit(-2).alias("i"), F.when(F.col("turn") % 4 == 0, F.concat(F.lit("BOOK "), F.floor(F.col("turn") / 4 + 1).cast("string"), F.lit(": 1805"))).otherwise("").alias("text"))
    chapters = turns.select("book", "turn", F.lit(-1).alias("i"), F.concat(F.lit("CHAPTER "), (F.col("turn") + 1).cast("string")).alias("text"))
    blanks = turns.select("book", "turn", F.lit(100000).alias("i"), F.lit("").alias("text"))
    rows = head.unionByName(parts).unionByName(chapters).unionByName(chunks).unionByName(blanks)
    return rows.select("book", (F.row_number().over(Window.partitionBy("book").orderBy("turn", "i")) - 1).cast("long").alias("line_no"), "text")


_PART = T.PART.replace("'", "''")
SPLIT_SQL = rf"""
{BOOK_SQL},
kinds AS (SELECT *, CASE WHEN regexp_matches(rtrim(text), '{_PART}') THEN 'part' WHEN regexp_matches(rtrim(text), '{T.CHAPTER}') THEN 'chapter' END AS kind FROM book),
along AS (SELECT *, count(*) FILTER (WHERE kind = 'part') OVER w AS part_no, count(kind) OVER w AS head_no, coalesce(last_value(CASE WHEN kind = 'part' THEN rtrim(text) END IGNORE NULLS) OVER w, 'Front') AS part FROM kinds WINDOW w AS (PARTITION BY book ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
spans AS (SELECT book, part_no, head_no, bool_or(trim(text) <> '' AND trim(text) <> part) AS own, max(CASE WHEN kind = 'chapter' THEN rtrim(text) END) AS chapter, bool_or(trim(text) <> '') AS ink FROM along GROUP BY ALL),
melted AS (SELECT book, part_no, head_no, ink, CASE WHEN m THEN following ELSE coalesce(chapter, '') END AS chapter, head_no + m::INT AS chapter_no FROM (SELECT *, chapter IS NULL AND NOT own AND following IS NOT NULL AS m FROM (SELECT *, lead(chapter) OVER (PARTITION BY book, part_no ORDER BY head_no) AS following FROM spans))),
kept AS (SELECT book, part_no, chapter_no FROM melted GROUP BY ALL HAVING bool_or(ink)),
split AS (SELECT a.book, line_no, text, a.part_no, part, m.chapter_no, chapter FROM along a JOIN melted m USING (book, part_no, head_no) JOIN kept k ON k.book = a.book AND k.part_no = a.part_no AND k.chapter_no = m.chapter_no)
"""


@query(f"WITH {SPLIT_SQL} SELECT book, line_no, part_no, part, chapter_no::BIGINT AS chapter_no, chapter FROM split")
def b_parts_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(B.split(books(spark, sf_dir)).drop("text"))


BY = ["book", "part_no", "chapter_no"]
SQUEEZED_SQL = f"""
{SPLIT_SQL},
sq1 AS (SELECT *, trim(text) = '' AS blank, lag(trim(text) = '') OVER (PARTITION BY book, part_no, chapter_no ORDER BY line_no) AS before FROM split),
sq2 AS (SELECT * FROM sq1 WHERE NOT blank OR NOT coalesce(before, true)),
squeezed AS (SELECT book, part_no, chapter_no, line_no, text, blank FROM (SELECT *, bool_or(NOT blank) OVER (PARTITION BY book, part_no, chapter_no ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM sq2) WHERE later)
"""


@query(f"WITH {SQUEEZED_SQL} SELECT book, part_no, chapter_no::BIGINT AS chapter_no, line_no, blank FROM squeezed")
def w_squeeze_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.squeezed(B.split(books(spark, sf_dir)), BY)
    return long(rows.select(*BY, "line_no", (F.trim("text") == "").alias("blank")))


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pages(B.squeezed(B.split(books(spark, sf_dir)), BY), BY, 5)


PAGES_SQL = f"""
RECURSIVE {SQUEEZED_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY book, part_no, chapter_no ORDER BY line_no) - 1 AS i FROM squeezed),
sizes AS (SELECT book, part_no, chapter_no, count(*) AS n FROM numbered GROUP BY ALL),
starts AS (
  SELECT book, part_no, chapter_no, n, 0::BIGINT AS page, 0::BIGINT AS start FROM sizes
  UNION ALL
  SELECT s.book, s.part_no, s.chapter_no, n, page + 1, start + 5 + coalesce(b.blank, false)::BIGINT FROM starts s LEFT JOIN numbered b ON b.book = s.book AND b.part_no = s.part_no AND b.chapter_no = s.chapter_no AND b.i = s.start + 5 WHERE start + 5 < n),
placed AS (SELECT k.book, k.part_no, k.chapter_no, page, i - start AS place, blank, line_no FROM numbered k JOIN starts s ON s.book = k.book AND s.part_no = k.part_no AND s.chapter_no = k.chapter_no AND i >= start AND i < start + 5),
paged AS (SELECT * FROM (SELECT *, bool_or(NOT blank) OVER (PARTITION BY book, part_no, chapter_no, page ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM placed) WHERE later)
"""


@query(f"WITH {PAGES_SQL} SELECT book, part_no, chapter_no::BIGINT AS chapter_no, page, place, line_no FROM paged")
def b_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of five lines."""
    return long(book_pages(spark, sf_dir).select(*BY, "page", "place", "line_no"))


@query(f"WITH {PAGES_SQL}, k AS (SELECT DISTINCT book, part_no, chapter_no, page FROM paged) SELECT book, part_no, chapter_no::BIGINT AS chapter_no, page, row_number() OVER (PARTITION BY book ORDER BY part_no, chapter_no, page) AS number FROM k")
def w_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(B.page_numbers(book_pages(spark, sf_dir)))


WIDTH = 40.0


@query(rf"""
WITH {BOOK_SQL},
o AS (SELECT *, trim(text) = '' AS blank, lag(trim(text) = '', 1, true) OVER (PARTITION BY book ORDER BY line_no) AS before FROM book),
p AS (SELECT *, max(CASE WHEN blank OR before THEN line_no END) OVER (PARTITION BY book ORDER BY line_no) AS para FROM o),
g AS (SELECT book, para, list(rtrim(text) ORDER BY line_no) AS own, max(length(rtrim(text))) AS longest, string_agg(trim(text), ' ' ORDER BY line_no) AS joined FROM p GROUP BY book, para),
f AS (SELECT book, para, CASE WHEN longest < 60 THEN own ELSE string_split(list_reduce(list_filter(regexp_split_to_array(joined, '\s+'), lambda w: w <> ''), lambda a, w: a || CASE WHEN (length(a[len(a) - instr(reverse(a), chr(10)) + 2:]) * (instr(a, chr(10)) > 0)::INT + length(a) * (instr(a, chr(10)) = 0)::INT + 1 + length(w)) * 0.571 > {WIDTH} THEN chr(10) ELSE ' ' END || w), chr(10)) END AS done FROM g)
SELECT book, para, generate_subscripts(done, 1) - 1 AS k, unnest(done) AS text FROM f
""")
def b_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with a long line, filled anew to 40 line heights."""
    return long(B.reflowed(books(spark, sf_dir), WIDTH))


@query(f"""
SELECT conv_id, turn, a || repeat(' ', s1) || n || repeat(' ', greatest(trunc(({WIDTH} - (length(a) + s1 + length(n) + length(t)) * 0.571) / 0.571)::INT, 1)) || t AS footer FROM (
  SELECT conv_id, turn, role AS a, conv_id::VARCHAR AS n, 'Turn ' || turn AS t, greatest(round_even(({WIDTH} / 2 - length(role) * 0.571 - length(conv_id::VARCHAR) * 0.571 / 2) / 0.571, 0)::INT, 1) AS s1 FROM conversations)
""")
def b_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = corpora.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", B.footer(F.col("role"), F.col("conv_id").cast("string"), F.concat(F.lit("Turn "), F.col("turn").cast("string")), WIDTH).alias("footer"))
