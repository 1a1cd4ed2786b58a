"""Queries over files, lines and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import lines as L
from textloom.operators import tokens as K
from textloom.plans.registry import query
from textloom.sources import corpora, trees

#: SQL of the same lines, for the oracles.
LINES = """
texts AS (SELECT doc_id AS file_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
split_lines AS (SELECT file_id, CASE WHEN t = '' THEN [] WHEN right(t, 1) = chr(10) THEN string_split(left(t, length(t) - 1), chr(10)) ELSE string_split(t, chr(10)) END AS l FROM texts),
lines AS (SELECT file_id, line_no, text, length(text) AS len, length(text) - length(ltrim(text, ' ')) AS indent, length(replace(text, ' ', '')) AS nonspace
  FROM (SELECT file_id, generate_subscripts(l, 1) - 1 AS line_no, left(rtrim(unnest(l), ' '), 4096) AS text FROM split_lines))
"""


def long(df: DataFrame) -> DataFrame:
    """Integers as long, floats as double: the types of the oracle."""
    casts = {f.name: "long" if f.dataType.simpleString() in ("int", "smallint", "tinyint") else "double" for f in df.schema if f.dataType.simpleString() in ("int", "smallint", "tinyint", "float")}
    return df.withColumns({n: F.col(n).cast(t) for n, t in casts.items()})


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lines(corpora.prose(spark, sf_dir).select("file_id", "text"))


@query(f"WITH {LINES} SELECT file_id, line_no, len, indent, nonspace, md5(text) AS digest FROM lines")
def p_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(doc_lines(spark, sf_dir).select("file_id", "line_no", "len", "indent", "nonspace", F.md5("text").alias("digest")))


@query(f"WITH {LINES} SELECT doc_id AS file_id, count(line_no) AS lines, coalesce(sum(len), 0)::BIGINT AS chars, coalesce(sum(nonspace), 0)::BIGINT AS nonspace, coalesce(max(indent), 0) AS deepest FROM documents LEFT JOIN lines ON file_id = doc_id GROUP BY doc_id")
def a_lines_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, files = doc_lines(spark, sf_dir), corpora.prose(spark, sf_dir)
    deepest = rows.groupBy("file_id").agg(F.max("indent").alias("deepest"))
    return long(L.file_metrics(rows, files).join(deepest, "file_id", "left").fillna(0, ["deepest"]))


@query("""
SELECT doc_id AS file_id, octet_length(encode(coalesce(text, ''))) AS bytes, CASE WHEN octet_length(encode(coalesce(text, ''))) > 4194304 THEN 'large'
  WHEN contains(left(coalesce(text, ''), 8192), chr(0)) OR (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(65533), ''))) / greatest(length(coalesce(text, '')), 1) > 0.01 THEN 'binary' ELSE 'ok' END AS status
FROM documents
UNION ALL SELECT * FROM (VALUES (-1, 8192, 'binary'), (-2, 8193, 'ok'), (-3, 102, 'ok'), (-4, 100, 'binary'), (-5, 0, 'ok')) AS t
""")
def s_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, and five literal ones: a NUL at either side of the sniffed part, replacement characters at and over the limit."""
    docs = corpora.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    cases = [(-1, b"a" * 8191 + b"\0"), (-2, b"a" * 8192 + b"\0"), (-3, b"a" * 99 + "�".encode()), (-4, b"a" * 97 + "�".encode()), (-5, b"")]
    both = docs.unionByName(spark.createDataFrame(cases, "file_id long, content binary"))
    return long(trees.gated(both.withColumn("bytes", F.octet_length("content"))).select("file_id", "bytes", "status"))


@query("""
SELECT path FROM (SELECT lang || '/' || source || '/' || doc_id AS path FROM documents)
WHERE NOT regexp_matches(path, '^fr/') AND NOT regexp_matches(path, '/[^/]*7$')
""")
def s_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpora.prose(spark, sf_dir).select("path")
    return files.where(~trees.has_skipped_part(F.col("path")) & ~trees.excluded(F.col("path"), ["fr/*", "*7"]))


@query("SELECT path, min(source_no) AS source_no FROM (SELECT lang || '/' || source AS path, 0::BIGINT AS source_no FROM documents WHERE lang = 'en' UNION ALL SELECT lang || '/' || source, 1 FROM documents WHERE source <> 'src0') GROUP BY path")
def u_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.prose(spark, sf_dir).select(F.concat_ws("/", "lang", "source").alias("path"), "lang", "source")
    first, second = docs.where("lang = 'en'").select("path").distinct(), docs.where("source <> 'src0'").select("path").distinct()
    return trees.unite([first.withColumn("source_no", F.lit(0).cast("long")), second.withColumn("source_no", F.lit(1).cast("long"))])


@query("""
SELECT d.doc_id, lang || '/' || source || '/' || d.doc_id AS path, row_number() OVER (ORDER BY d.doc_id) - 1 AS file_id
FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
""")
def u_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without the skipped ones, numbered anew in two steps."""
    files = corpora.prose(spark, sf_dir).select("file_id", "path")
    skipped = corpora.table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("file_id"))
    kept = files.join(skipped, "file_id", "left_anti").withColumn("one", F.lit(1))
    return L.running(kept, "file_id", "one", "new").select(F.col("file_id").alias("doc_id"), "path", F.col("new").cast("long").alias("file_id"))


@query(f"""
WITH {LINES} SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(DISTINCT lang || '/' || source) + count(DISTINCT lang) + 1 FROM documents) AS dirs,
  count(*) AS lines, sum(len)::BIGINT AS chars, sum(nonspace)::BIGINT AS nonspace, max(len) AS longest FROM lines
""")
def a_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpora.prose(spark, sf_dir)
    rows = L.lines(files.select("file_id", "text")).agg(F.count("*").alias("lines"), F.sum("len").alias("chars"), F.sum("nonspace").alias("nonspace"), F.max("len").alias("longest"))
    heads = files.agg(F.count("*").alias("files"), (F.count_distinct("lang", "source") + F.count_distinct("lang") + 1).alias("dirs"))
    return long(heads.crossJoin(rows))  # one row each


@query("SELECT lang, count(*) AS files, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def a_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.prose(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {LINES} SELECT file_id, line_no, len, coalesce(sum(len) OVER (ORDER BY file_id, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM lines")
def w_line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(L.line_offsets(doc_lines(spark, sf_dir)))


@query(f"WITH {LINES}, files AS (SELECT doc_id AS file_id, count(line_no) AS lines FROM documents LEFT JOIN lines ON file_id = doc_id GROUP BY doc_id) SELECT file_id, lines, coalesce(sum(lines) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line0 FROM files")
def w_file_line0(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = L.file_metrics(doc_lines(spark, sf_dir), corpora.prose(spark, sf_dir)).select("file_id", "lines")
    return L.running(files, "file_id", "lines", "line0").select("file_id", "lines", F.col("line0").cast("long"))


@query(f"""
WITH {LINES} SELECT file_id, line_no, CASE WHEN lead(len) OVER w > 0 THEN 1 ELSE 0 END::BIGINT AS next_inked, CASE WHEN lead(len) OVER w IS NULL THEN 1 ELSE 0 END::BIGINT AS last_line FROM lines WINDOW w AS (PARTITION BY file_id ORDER BY line_no)
""")
def w_next_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.lead("len").over(Window.partitionBy("file_id").orderBy("line_no"))
    return doc_lines(spark, sf_dir).select("file_id", F.col("line_no").cast("long"), F.when(following > 0, 1).otherwise(0).cast("long").alias("next_inked"), following.isNull().cast("long").alias("last_line"))


def _tile_sql(pattern: str, kinds: str, table: str, key: str, text: str) -> str:
    return f"""
tiled AS (SELECT {key} AS file_id, regexp_extract_all({text}, '{pattern}') AS found FROM {table}),
tiles AS (SELECT file_id, pos, t, {kinds} AS kind FROM (SELECT file_id, generate_subscripts(found, 1) AS pos, unnest(found) AS t, unnest(list_append(found[2:], '')) AS f FROM tiled))
"""


PROSE_TILES = _tile_sql(
    r"\b[0-9]+(?:\.[0-9]+)?\b|[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*|[0-9]+| +|\n|[\s\S]",
    r"CASE WHEN regexp_full_match(t, ' *') OR t = chr(10) THEN 0 WHEN regexp_matches(t, '^[0-9]') AND NOT regexp_matches(f, '^[A-Za-z_]') THEN 6 WHEN regexp_matches(t, '^[A-Za-z_\x{80}-\x{10FFFF}]') THEN 1 ELSE 7 END",
    "documents", "doc_id", "coalesce(text, '')",
)
XML_TILES = _tile_sql(
    r'<!--[\s\S]*?-->|"(?:[^"\\\n]|\\.)*"|\b[0-9]+(?:\.[0-9]+)?\b|[A-Za-z_][A-Za-z0-9_]*|[0-9]+| +|\n|[\s\S]',
    r"""CASE WHEN regexp_full_match(t, ' *') OR t = chr(10) THEN 0 WHEN starts_with(t, '<!--') THEN 5 WHEN length(t) > 1 AND starts_with(t, '"') THEN 4 WHEN regexp_matches(t, '^[0-9]') AND NOT regexp_matches(f, '^[A-Za-z_]') THEN 6 WHEN regexp_matches(t, '^[A-Za-z_]') THEN 1 ELSE 7 END""",
    "pages", "page_id", r"regexp_replace(coalesce(html, ''), '[^\x00-\x7F]', '?', 'g')",
)


def ascii_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.markup(spark, sf_dir).select("file_id", "path", T.ascii_fold(F.col("text")).alias("text"))


@query(f"WITH {PROSE_TILES} SELECT file_id, kind::BIGINT AS kind, count(*) AS tokens, sum(length(t))::BIGINT AS chars FROM tiles GROUP BY file_id, kind")
def t_prose_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(K.prose_counts(corpora.prose(spark, sf_dir).select("file_id", "text")))


@query(f"WITH {XML_TILES} SELECT kind::BIGINT AS kind, count(*) AS tokens, sum(length(t))::BIGINT AS chars FROM tiles GROUP BY kind")
def t_markup_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = K.kind_counts(ascii_pages(spark, sf_dir).select("file_id", "text"), ["text-xml"])
    return long(counts.groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars")))


@query(f"WITH {PROSE_TILES}, runs AS (SELECT file_id, kind, lag(kind, 1, 0) OVER (PARTITION BY file_id ORDER BY pos) AS before FROM tiles) SELECT doc_id AS file_id, coalesce(n, 0)::BIGINT AS tokens FROM documents LEFT JOIN (SELECT file_id, count(*) AS n FROM runs WHERE kind <> 0 AND kind <> before GROUP BY file_id) r ON r.file_id = doc_id")
def a_tokens_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(corpora.prose(spark, sf_dir).select("file_id", K.prose_runs(F.col("text")).alias("tokens")))


@query("SELECT c AS letter, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> chr(10) GROUP BY c")
def a_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each character occurs: per task first, so only the alphabet is shuffled."""
    letters = corpora.prose(spark, sf_dir).select(F.explode(F.split("text", "")).alias("letter"))
    return letters.where("letter <> '\\n' AND letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))


#: A glyph's mean coverage stands in for a font's table: a fixed rule over code points.
@query("""
WITH n AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> chr(10) GROUP BY c)
SELECT round(sum(n * CASE WHEN c = ' ' THEN 0 ELSE 0.1 + (ascii(c) % 16) / 64.0 END) / sum(n), 6)::DOUBLE AS ink, round(sum(CASE WHEN c = ' ' THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS space FROM n
""")
def a_mean_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = a_letters(spark, sf_dir)
    coverage = F.when(F.col("letter") == " ", 0.0).otherwise(0.1 + (F.ascii("letter") % 16) / 64.0)
    total = F.sum("n")
    return letters.agg(F.round(F.sum(F.col("n") * coverage) / total, 6).alias("ink"), F.round(F.sum(F.when(F.col("letter") == " ", F.col("n")).otherwise(0)) / total, 6).alias("space"))


@query("SELECT doc_id AS file_id, CASE WHEN length(p) > 9 THEN '…' || right(p, 8) ELSE p END AS shown, CASE WHEN length(p) > 9 THEN 1 ELSE 0 END::BIGINT AS cut FROM (SELECT doc_id, lang || '/' || source || '/' || doc_id AS p FROM documents)")
def p_short_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpora.prose(spark, sf_dir)
    return files.select("file_id", T.short_path(F.col("path"), 9).alias("shown"), (F.length("path") > 9).cast("long").alias("cut"))


@query("""
SELECT event_id, round_even(least(greatest((value / 1000 + 0.5) / 2, 0), 1) * 65535, 0)::BIGINT AS q, format('{:,}', (event_id * 7919)::BIGINT) AS shown FROM events
""")
def p_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = corpora.table(spark, sf_dir, "events")
    return events.select("event_id", T.quantised(F.col("value") / 1000).alias("q"), T.thousands(F.col("event_id") * 7919).alias("shown"))


@query("""
WITH p AS (SELECT conv_id, list(role || ' ' || turn ORDER BY turn) AS parts FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_reduce(list_transform(parts, lambda x: [x]), lambda a, x: CASE WHEN length(a[len(a)]) + 3 + length(x[1]) <= 30 THEN list_append(a[1:len(a) - 1], a[len(a)] || ' · ' || x[1]) ELSE list_append(a, x[1]) END), chr(10)) AS rows FROM p
""")
def p_filled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = corpora.dialogue(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("part")))).alias("turns"))
    return turns.select("conv_id", F.array_join(T.filled(F.transform("turns", lambda t: t["part"]), 30, " · "), "\n").alias("rows"))
