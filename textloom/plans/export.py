"""Queries over compact columns, glyph bands and braces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import code, export
from textloom.plans.registry import query
from textloom.plans.text import long
from textloom.sources import corpora

#: Rising positions of each vector: running sums of absolute values.
XS = "xs AS (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: list_sum(list_transform(embedding[1:i], lambda v: abs(v)::DOUBLE))) AS xs FROM embeddings)"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = corpora.table(spark, sf_dir, "embeddings")
    steps = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    sums = F.aggregate(steps, F.array().cast("array<double>"), lambda a, d: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + d)))
    return vectors.select("vec_id", sums.alias("xs"))


@query(f"""
WITH {XS}, s AS (SELECT max(list_max(list_transform(range(1, len(xs) + 1), lambda i: xs[i] - CASE WHEN i = 1 THEN 0 ELSE xs[i - 1] END))) AS most FROM xs),
scale AS (SELECT max(2 ** k) AS scale FROM s, range(0, 14) AS r(k) WHERE most * 2 ** k < 65535 OR k = 0),
q AS (SELECT vec_id, scale, list_transform(xs, lambda x: round_even(x * scale, 0)::BIGINT) AS q FROM xs, scale)
SELECT vec_id, scale::DOUBLE AS scale, list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - CASE WHEN i = 1 THEN 0 ELSE q[i - 1] END) * i))::BIGINT AS checksum, q[len(q)]::BIGINT AS last FROM q
""")
def k_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-wise deltas of positions: the scale, a weighted sum of the steps, and the last position they lead back to."""
    rows = positions(spark, sf_dir)
    scaled = rows.crossJoin(F.broadcast(export.delta_scale(rows)))  # one row
    steps = scaled.select("vec_id", "scale", export.deltas(F.col("xs"), F.col("scale")).alias("d"))
    back = export.undone(F.col("d"), F.col("scale"))
    weighed = F.aggregate(F.zip_with("d", F.sequence(F.lit(1), F.size("d")), lambda d, i: d * i), F.lit(0).cast("long"), lambda a, x: a + x)
    return steps.select("vec_id", "scale", weighed.alias("checksum"), F.round(F.element_at(back, -1) * F.col("scale")).cast("long").alias("last"))


@query("SELECT doc_id, lang || '/' || source || '/' || doc_id AS path, coalesce(sum(length(lang || '/' || source || '/' || doc_id)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM documents")
def k_string_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpora.prose(spark, sf_dir).select(F.col("file_id").alias("doc_id"), "path")
    return export.string_offsets(files, "doc_id", "path").select("doc_id", "path", F.col("off").cast("long").alias("off"))


CURVES = "curves AS (SELECT event_id AS curve, user_id % 50 AS glyph, (event_id % 83) / 100.0 AS low, (event_id % 83 + event_id % 17) / 100.0 AS high FROM events)"


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return corpora.table(spark, sf_dir, "events").select(e.alias("curve"), (F.col("user_id") % 50).alias("glyph"), (e % 83 / 100.0).alias("low"), ((e % 83 + e % 17) / 100.0).alias("high"))


@query(f"""
WITH {CURVES}, b AS (SELECT glyph, n, unnest(range(least(greatest(floor(low * n)::BIGINT, 0), n - 1), least(greatest(floor(high * n)::BIGINT, 0), n - 1) + 1)) AS band FROM curves, range(1, 33) AS r(n)),
w AS (SELECT glyph, n, max(c) AS most FROM (SELECT glyph, n, band, count(*) AS c FROM b GROUP BY ALL) GROUP BY glyph, n)
SELECT glyph, n, most AS fullest FROM (SELECT *, row_number() OVER (PARTITION BY glyph ORDER BY most, n) AS k FROM w) WHERE k = 1
""")
def a_choose_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(export.bands(curves(spark, sf_dir)))


@query(f"""
WITH {CURVES}, b AS (SELECT glyph, curve, high, unnest(range(least(greatest(floor(low * 8)::BIGINT, 0), 7), least(greatest(floor(high * 8)::BIGINT, 0), 7) + 1)) AS band FROM curves)
SELECT glyph, band, count(*) AS members, string_agg(curve::VARCHAR, ' ' ORDER BY high DESC, curve) AS curves FROM b GROUP BY glyph, band
""")
def j_band_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = export.band_lists(curves(spark, sf_dir), 8)
    return lists.select("glyph", "band", F.size("list").cast("long").alias("members"), F.array_join(F.transform("list", lambda c: c.cast("string")), " ").alias("curves"))


@query("SELECT user_id % 50 AS face, mode(advance) AS advance, count(DISTINCT advance) > 1 AS proportional FROM (SELECT user_id, CASE WHEN user_id % 50 < 25 THEN 5 ELSE CASE WHEN event_id % 5 < 3 THEN 4 ELSE 4 + event_id % 5 END END::BIGINT AS advance FROM events) GROUP BY face")
def a_advances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent advance of each face, and whether it has several."""
    e = F.col("event_id")
    advance = F.when(F.col("user_id") % 50 < 25, 5).otherwise(F.when(e % 5 < 3, 4).otherwise(4 + e % 5)).cast("long")
    faces = corpora.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("face"), advance.alias("advance"))
    return faces.groupBy("face").agg(F.mode("advance").alias("advance"), (F.count_distinct("advance") > 1).alias("proportional"))


#: Brackets of the pages' markup stand for braces: "<" opens and ">" closes.
@query("""
WITH c AS (SELECT page_id AS file_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS c FROM (SELECT page_id, string_split(html, '') AS l FROM pages)),
b AS (SELECT file_id, pos, CASE WHEN c = '<' THEN 1 ELSE -1 END AS d FROM c WHERE c IN ('<', '>')),
s AS (SELECT *, sum(d) OVER (PARTITION BY file_id ORDER BY pos) AS s FROM b),
m AS (SELECT *, least(min(s) OVER (PARTITION BY file_id ORDER BY pos), 0) AS low FROM s),
l AS (SELECT file_id, pos, d, (s - low)::BIGINT AS depth, CASE WHEN d = 1 THEN s - low ELSE s - low + 1 END AS level, d = -1 AND s = low AND s < coalesce(lag(low) OVER (PARTITION BY file_id ORDER BY pos), 0) AS stray FROM m),
n AS (SELECT file_id, pos, d, lead(pos) OVER (PARTITION BY file_id, level ORDER BY pos) AS close FROM l WHERE NOT stray)
SELECT file_id, pos, close FROM n WHERE d = 1 AND close IS NOT NULL
""")
def t_braces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching pairs of angle brackets of each page: depths by a reflected running sum, then the next of the same level."""
    return code.matched(angles(spark, sf_dir))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, pos, opens of every angle bracket of the pages."""
    pages = corpora.markup(spark, sf_dir).select("file_id", F.posexplode(F.split("text", "")).alias("pos", "c")).where("c IN ('<', '>')")
    return pages.select("file_id", F.col("pos").cast("long").alias("pos"), (F.col("c") == "<").alias("opens"))


@query("""
WITH c AS (SELECT page_id AS file_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS c FROM (SELECT page_id, string_split(html, '') AS l FROM pages))
SELECT file_id, pos, sum(CASE WHEN c = '<' THEN 1 ELSE -1 END) OVER (PARTITION BY file_id ORDER BY pos)::BIGINT AS depth FROM c WHERE c IN ('<', '>')
""")
def w_bracket_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth behind every angle bracket of the pages."""
    return code.depths(angles(spark, sf_dir)).select("file_id", "pos", "depth")
