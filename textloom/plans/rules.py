"""Queries that put whole tables through the small rules: normalisation, charsets, languages, logs, headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import book, export
from textloom.operators import lines as L
from textloom.operators import proportional as P
from textloom.plans.export import CURVES, curves
from textloom.plans.registry import query
from textloom.plans.text import long
from textloom.sources import corpora, trees

#: Documents with tabs after full stops, both line ends and a control character.
ROUGH = "rough AS (SELECT doc_id AS file_id, replace(replace(replace(coalesce(text, ''), '. ', '.' || chr(9)), ', ', chr(13) || chr(10)), 'e ', 'e' || chr(1) || '  ' || chr(13)) AS t FROM documents)"


def rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for a, b in ((". ", ".\t"), (", ", "\r\n"), ("e ", "e\x01  \r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return corpora.prose(spark, sf_dir).select("file_id", text.alias("text"))


@query(rf"""
WITH {ROUGH}, n AS (SELECT file_id, replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM rough),
l AS (SELECT file_id, CASE WHEN t = '' THEN [] WHEN right(t, 1) = chr(10) THEN string_split(left(t, length(t) - 1), chr(10)) ELSE string_split(t, chr(10)) END AS l FROM n),
e AS (SELECT file_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS x FROM l),
w AS (SELECT file_id, line_no, list_reduce(string_split(x, chr(9)), lambda a, p: rpad(a, ((length(a) // 4 + 1) * 4)::INT, ' ') || p) AS x FROM e),
f AS (SELECT file_id, line_no, left(rtrim(regexp_replace(regexp_replace(x, '[^\x00-\x7F]', '?', 'g'), '[\x00-\x09\x0B-\x1F\x7F]', '?', 'g'), ' '), 4096) AS x FROM w)
SELECT file_id, line_no, length(x) AS len, md5(x) AS digest FROM f
""")
def p_code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a code corpus keeps them: line ends made one, tabs widened, other characters folded."""
    return long(L.lines(rough(spark, sf_dir), "ascii").select("file_id", "line_no", "len", F.md5("text").alias("digest")))


@query(f"""
WITH c AS (SELECT doc_id AS file_id, replace(replace(replace(coalesce(text, ''), ',', '‐'), 'the', 'ſ″ '), '. ', '™日 ') AS t FROM documents)
SELECT file_id, md5(regexp_replace(translate(t, '{T.RESPELL_FROM}', '{T.RESPELL_TO.replace("'", "''")}'), '[^\\x00-\\x7F\\x{{A0}}-\\x{{FF}}{T.CP1252_EXTRAS}]', '?', 'g')) AS digest FROM c
""")
def p_book_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the charset of books, with characters of all kinds put in."""
    text = F.col("text")
    for a, b in ((",", "‐"), ("the", "ſ″ "), (". ", "™日 ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return corpora.prose(spark, sf_dir).select("file_id", F.md5(T.book_charset(text)).alias("digest"))


_NAMES = ("x.rs", "x.PY", "x.scss", "Makefile", "x.md", "x.proto", "x", ".gitignore", "x.tar.c", "x.toml")
_KNOWN = {"x.rs": ("rust", "rust"), "x.PY": ("python", "python"), "x.scss": ("text", "text-css"), "Makefile": ("text", "text-hash"), "x.md": ("text", "text-xml"), "x.proto": ("text", "text-slash"), "x.tar.c": ("clike", "clike"), "x.toml": ("text", "text-hash")}


def _case(k: int) -> str:
    return " ".join(f"WHEN name = '{n}' THEN '{v[k]}'" for n, v in _KNOWN.items())


@query(f"""
WITH f AS (SELECT doc_id AS file_id, list_extract([{", ".join(f"'{n}'" for n in _NAMES)}], (doc_id % {len(_NAMES)} + 1)::INT) AS name, list_extract(['', '#!/bin/sh', '#!/usr/bin/env python3'], (doc_id % 3 + 1)::INT) AS head FROM documents)
SELECT file_id, CASE WHEN name IN ('x.rs', 'x.PY', 'x.tar.c') THEN CASE {_case(0)} END WHEN contains(head, 'python') THEN 'python' WHEN head <> '' THEN 'shell' ELSE 'text' END AS lang,
  CASE WHEN name IN ('x.rs', 'x.PY', 'x.tar.c') THEN CASE {_case(1)} END WHEN contains(head, 'python') THEN 'python' WHEN head <> '' THEN 'shell' {_case(1)} ELSE 'text' END AS variant FROM f
""")
def s_file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and variant of files by their extension, first line and name."""
    k = F.col("file_id")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (k % len(_NAMES) + 1).cast("int"))
    head = F.element_at(F.array(F.lit(""), F.lit("#!/bin/sh"), F.lit("#!/usr/bin/env python3")), (k % 3 + 1).cast("int"))
    files = corpora.prose(spark, sf_dir).select("file_id", F.concat(F.col("path"), F.lit("/"), name).alias("path"), head.alias("head"))
    return trees.with_language(files).select("file_id", "lang", "variant")


CHANGES = """
paths AS (SELECT o_orderkey, l_linenumber, l_quantity::BIGINT AS added, 'src/' || (l_partkey % 997) AS path, l_returnflag = 'A' AS uncounted FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
churn AS (SELECT path, sum(CASE WHEN uncounted THEN 0 ELSE added + l_linenumber END)::BIGINT AS churn FROM paths GROUP BY path)
"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log: orders are commits, their items changed files; every third kind has no counts, as binary files do."""
    items, orders = (corpora.table(spark, sf_dir, t) for t in ("lineitem", "orders"))
    counts = F.when(F.col("l_returnflag") == "A", "-\t-").otherwise(F.concat_ws("\t", F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string")))
    changed = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.concat(counts, F.lit("\tsrc/"), (F.col("l_partkey") % 997).cast("string")).alias("line"))
    heads = orders.select(F.explode(F.array(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")), F.lit(""))).alias("line"))
    return changed.unionByName(heads)


@query(f"WITH {CHANGES} SELECT path, churn FROM churn UNION ALL SELECT '', count(*) FROM orders")
def s_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines changed by path; under the empty path, the number of commits."""
    changed, commits = trees.numstat(log(spark, sf_dir))
    return changed.unionByName(commits.select(F.lit("").alias("path"), F.col("commits").alias("churn")))


@query(f"WITH {CHANGES} SELECT doc_id AS file_id, churn FROM churn JOIN documents ON path = 'src/' || (doc_id * 3)")
def j_churn_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Churn by file: paths of the log that are no file's are dropped, and files without changes have none."""
    files = corpora.prose(spark, sf_dir).select("file_id", F.concat(F.lit("src/"), (F.col("file_id") * 3).cast("string")).alias("path"))
    return trees.churn_of(files, log(spark, sf_dir)).select("file_id", "churn")


@query("""
WITH h AS (SELECT event_id, lpad(to_hex((event_id * 7919) % 16777216), 6, '0') AS a, (event_id % 11) / 10.0 AS t, (event_id % 16 + 1) || ':' || (event_id % 9 + 1) AS ratio FROM events),
c AS (SELECT *, ('0x' || substr(a, 1, 2))::INT / 255.0::DOUBLE AS r, ('0x' || substr(a, 3, 2))::INT / 255.0::DOUBLE AS g, ('0x' || substr(a, 5, 2))::INT / 255.0::DOUBLE AS b FROM h)
SELECT event_id, round(r, 6) AS red, round(g, 6) AS green, round(b, 6) AS blue, round(g + (1 - g) * t, 6)::DOUBLE AS lighter, round((event_id % 16 + 1)::DOUBLE / (event_id % 9 + 1), 6) AS aspect FROM c
""")
def p_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of colours, one of them blended with white, and aspects."""
    e = F.col("event_id")
    colour = F.lower(F.lpad(F.hex(e * 7919 % 16777216), 6, "0"))
    rows = corpora.table(spark, sf_dir, "events").select("event_id", *(T.channel(colour, k).alias(n) for k, n in enumerate(("red", "green", "blue"))), T.aspect(F.concat_ws(":", (e % 16 + 1).cast("string"), (e % 9 + 1).cast("string"))).alias("aspect"))
    lighter = T.blend(F.col("green"), F.lit(1.0), F.col("event_id") % 11 / 10.0)
    return rows.select("event_id", *(F.round(c, 6).alias(c) for c in ("red", "green", "blue")), F.round(lighter, 6).alias("lighter"), F.round("aspect", 6).alias("aspect"))


@query("""
SELECT doc_id AS file_id, repeat(' ', greatest(round_even((60.0 - length(h) * 0.571) / 2 / 0.571, 0), 1)::INT) || trim(h, ' ') AS line FROM (SELECT doc_id, 'CHAPTER ' || (doc_id % 90 + 1) || repeat(' ', (doc_id % 4)::INT) AS h FROM documents)
""")
def p_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter headings in the middle of their pages."""
    k = F.col("file_id")
    heading = F.concat(F.lit("CHAPTER "), (k % 90 + 1).cast("string"), F.repeat(F.lit(" "), (k % 4).cast("int")))
    return corpora.prose(spark, sf_dir).select("file_id", book.centred(heading, 60.0).alias("line"))


@query("""
SELECT event_id, round(a * (1 - 2 * 0.075) / (1 - 0.09 - 0.03) * (n + 3 + 2), 6)::DOUBLE AS width, floor(170 / (11 * a))::BIGINT AS panel, round((event_id % 50) / 100.0 * (1 - (event_id % 7) / 10.0) / 0.7, 3)::DOUBLE AS bar, round((event_id % 50) / 100.0 / 0.7, 3)::DOUBLE AS block
FROM (SELECT event_id, 0.5 + (event_id % 6) / 10.0 AS a, event_id % 60 + 20 AS n FROM events)
""")
def p_page_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text width of pages, characters of a result row, and ink of bars and blocks."""
    e = F.col("event_id")
    aspect = 0.5 + e % 6 / 10.0
    bar, block = P.ink_levels(e % 50 / 100.0, e % 7 / 10.0)
    return corpora.table(spark, sf_dir, "events").select("event_id", F.round(P.letter_width(e % 60 + 20, aspect), 6).alias("width"), P.panel_chars(aspect).alias("panel"), bar.alias("bar"), block.alias("block"))


@query(f"""
WITH {CURVES}, b AS (SELECT glyph, n, unnest(range(least(greatest(floor(low * n)::BIGINT, 0), n - 1), least(greatest(floor(high * n)::BIGINT, 0), n - 1) + 1)) AS band FROM curves, range(1, 33) AS r(n)),
w AS (SELECT glyph, n, max(c) AS most FROM (SELECT glyph, n, band, count(*) AS c FROM b GROUP BY ALL) GROUP BY glyph, n),
k AS (SELECT *, row_number() OVER (PARTITION BY glyph ORDER BY most, n) AS k FROM w)
SELECT count(*) AS glyphs, sum(n)::BIGINT AS bands, max(most) AS fullest, (SELECT count(*) FROM curves) AS curves FROM k WHERE k = 1
""")
def a_band_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs, bands and curves in all, and the fullest band."""
    return long(export.band_totals(curves(spark, sf_dir)))


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a book file: a header, the text between its marks, and what comes after."""
    k = F.col("file_id").cast("string")
    head = F.array(F.concat(F.lit("Title:  Book "), k, F.lit(" ")), F.concat(F.when(F.col("file_id") % 2 == 0, F.lit("Author: graf Leo  von ")).otherwise(F.lit("Author: Ann ")), k), F.lit(""), F.lit("*** START OF THIS BOOK ***"))
    tail = F.array(F.lit("*** END OF IT ***"), F.lit("licence"), F.lit("Title: another"))
    return corpora.prose(spark, sf_dir).select(F.col("file_id").alias("book"), F.posexplode(F.concat(head, F.split("text", "\n", -1), tail)).alias("line_no", "text"))


@query("SELECT doc_id AS book, generate_subscripts(l, 1) + 3 AS line_no, unnest(l) AS text, 'Book ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'Leo von ' ELSE 'Ann ' END || doc_id AS author FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)")
def b_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of each book between its marks, its title and its author."""
    rows = framed(spark, sf_dir)
    return long(book.body(rows).join(book.header_field(rows, "Title"), "book").join(book.author(rows), "book"))


@query("""
WITH h AS (SELECT doc_id, doc_id % 3 = 0 AS chapter, list_filter(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g'), ' '), lambda w: w <> '') AS w FROM documents)
SELECT doc_id AS book, CASE WHEN chapter THEN 'Chapter X' || repeat('I', (doc_id % 4)::INT) ELSE array_to_string(list_transform(w, lambda x: upper(x[1:1]) || lower(x[2:])), ' ') END AS title FROM h WHERE chapter OR len(w) > 0
""")
def b_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of chapters, and the words of documents as headings of parts, as titles."""
    k = F.col("file_id")
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]+", ""), " "), lambda w: w != "")
    named = corpora.prose(spark, sf_dir).where((k % 3 == 0) | F.col("text").rlike("[A-Za-z]"))  # others have no words; a test of the heading would make it twice
    heading = F.when(k % 3 == 0, F.concat(F.lit("CHAPTER X"), F.repeat(F.lit("I"), (k % 4).cast("int")))).otherwise(F.upper(F.array_join(words, "  ")))
    return named.select(k.alias("book"), heading.alias("heading")).select("book", T.heading_title(F.col("heading")).alias("title"))
