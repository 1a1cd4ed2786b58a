"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, collocations, embedding_dedup, exact_dedup, html_text, mixing, near_dedup, quality_classifier, quality_rules, token_counts, toxicity, url_filter, vector_codes
from textloom.llm.common import fold, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).drop("row")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents")).drop("row")


OP4_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_classifier.score(docs, labels.where(fold("doc_id", 3) != 1))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


_PRIME = "CASE WHEN {of} % 134217689 <> 0 THEN 134217689 WHEN {of} % 134217649 <> 0 THEN 134217649 ELSE 134217617 END"


def _round(r: int) -> str:
    """One round of the permutation of a source's blocks, in SQL."""
    key = lambda k: f"('0x' || substr(md5('mix:' || sid || ':' || turn || ':{r}'), {k}, 8))::BIGINT"
    return f"""
p{r} AS (SELECT sid, n, turn, ({_PRIME.format(of="n")} * x + {key(1)}) % n AS x, n - {key(9)} % (n // 2 + 1) AS part, {key(17)} AS c FROM x{r}),
x{r + 1} AS (SELECT sid, n, turn, n - 1 - CASE WHEN x < part THEN ({_PRIME.format(of="part")} * x + c) % part ELSE x END AS x FROM p{r})"""


OP5_SQL = rf"""
WITH keyed AS (SELECT *, row_number() OVER (PARTITION BY h) AS k FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat_ws(':', doc_id::VARCHAR, source, md5(coalesce(text, '')))) AS h FROM documents)),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM totals),
weighed AS (SELECT *, ((sid - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size / ((sid - 1) % 3 + 1)::DOUBLE AS fills FROM ranked),
upto AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER () AS weights, sum(source_size) OVER w::BIGINT AS filled, sum(weight) OVER w AS gone FROM weighed WINDOW w AS (ORDER BY fills, sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
levels AS (SELECT *, (total - 3 * (filled - source_size))::DOUBLE / (weights - (gone - weight)) AS level FROM upto),
level AS (SELECT level FROM levels WHERE level <= fills ORDER BY gone LIMIT 1),
names AS (SELECT sid, source, source_size, round(least(3.0::DOUBLE * source_size, coalesce((SELECT level FROM level), 0) * weight), 6) AS target FROM weighed),
expected AS (SELECT sid, (source_size + 255) // 256 AS n, target * ((source_size + 255) // 256) / source_size AS slots FROM names WHERE source_size > 0),
shares AS (SELECT sid, n, slots / sum(slots) OVER () AS p, round(sum(slots) OVER ())::BIGINT AS total FROM expected),
shards AS (SELECT *, least(4096, total - shard * 4096) AS width FROM (SELECT *, unnest(range(0, (total - 1) // 4096 + 1)) AS shard FROM shares WHERE total > 0)),
parts AS (SELECT *, floor(p * width)::BIGINT AS whole, p * width - floor(p * width) AS part FROM shards),
lines AS (SELECT *, sum(part) OVER (PARTITION BY shard ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high, sum(part) OVER (PARTITION BY shard) AS parts, (width - sum(whole) OVER (PARTITION BY shard))::BIGINT AS open FROM parts),
spans AS (SELECT sid, n, shard, whole, lag(high, 1, 0) OVER w AS low, CASE WHEN lead(sid) OVER w IS NULL THEN 'inf'::DOUBLE ELSE high END AS high FROM lines WINDOW w AS (PARTITION BY shard ORDER BY sid)),
draws AS (SELECT shard, ('0x' || substr(md5('mix:draw:' || shard || ':' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE * parts AS at_ FROM (SELECT shard, parts, unnest(range(1, open + 1)) AS k FROM (SELECT shard, max(parts) AS parts, max(open) AS open FROM lines GROUP BY shard))),
drawn AS (SELECT s.shard, sid, count(*) AS drawn FROM spans s JOIN draws d ON s.shard = d.shard AND at_ >= low AND at_ < high GROUP BY ALL),
counts AS (SELECT sid, n, shard, whole + coalesce(drawn, 0) AS slots FROM spans LEFT JOIN drawn USING (shard, sid)),
slots AS (SELECT sid, n, unnest(range(first, first + slots)) AS slot FROM (SELECT *, coalesce(sum(slots) OVER (PARTITION BY sid ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM counts)),
x0 AS (SELECT sid, n, slot // n AS turn, slot % n AS x FROM slots WHERE slot < 3 * n),{_round(0)},{_round(1)},{_round(2)},
uses AS (SELECT sid, x AS index, count(*) AS uses FROM x3 GROUP BY ALL),
placed AS (SELECT d.*, sid, source_size, target, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY h, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM keyed d JOIN names ON d.source IS NOT DISTINCT FROM names.source),
pieces AS (SELECT h, k, sid, start, size, unnest(range(start // 256, (start + size - 1) // 256 + 1)) AS index FROM placed WHERE size > 0),
took AS (SELECT h, k, sum((least((index + 1) * 256, start + size) - greatest(index * 256, start)) * coalesce(uses, 0))::BIGINT AS taken FROM pieces LEFT JOIN uses USING (sid, index) GROUP BY h, k)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN took USING (h, k)
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


OP9_SQL = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
urls AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hits AS (
  SELECT r, rhost || rpath AS rule, rules.verdict, row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (r)
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 5) AS t(k) WHERE len(w) >= k)),
counts AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS p FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, k AS size, phrase, p, f AS a, unnest(range(1, k)) AS k FROM counts WHERE k > 1),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.p, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.p[1:c.k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.p[c.k + 1:], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored) WHERE place = 1),
parts AS (
  SELECT lang, array_to_string(p[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, p, a, m, unnest(range(1, size - m + 2)) AS i FROM best, range(2, 4) AS t(m) WHERE m < size) GROUP BY ALL),
left_over AS (SELECT best.* FROM best LEFT JOIN parts USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def _fitted(r: int) -> str:
    """One round of the codebooks: every part's nearest entry, and the means of the entries' parts."""
    return f"""
a{r} AS (
  SELECT rid, p, min((list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c))::BIGINT * 256 + e) AS best
  FROM parts JOIN b{r} USING (p) GROUP BY rid, p),
m{r} AS (
  SELECT p, e, list(total ORDER BY k) AS mean
  FROM (SELECT p, e, k, floor(sum(x)::BIGINT / count(*))::DOUBLE AS total FROM (SELECT p, best % 256 AS e, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM a{r} JOIN parts USING (rid, p)) GROUP BY p, e, k)
  GROUP BY p, e),
b{r + 1} AS (SELECT p, e, coalesce(mean, c) AS c FROM b{r} LEFT JOIN m{r} USING (p, e))"""


OP12_SQL = rf"""
WITH sound AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, p, x[p * (len(x) // 4) + 1:(p + 1) * (len(x) // 4)] AS v FROM sound, range(4) AS t(p)),
b0 AS (SELECT p, rid - 1 AS e, v AS c FROM parts WHERE rid <= 256),{_fitted(0)},{_fitted(1)},{_fitted(2)},{_fitted(3)},
a4 AS (
  SELECT rid, p, min((list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c))::BIGINT * 256 + e) AS best
  FROM parts JOIN b4 USING (p) GROUP BY rid, p),
digest AS (
  SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, k)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS k FROM b4)),
found AS (SELECT rid, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM a4 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM found JOIN sound USING (rid), digest
"""


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"))


OP13_SQL = r"""
WITH RECURSIVE
sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS one, b.vec_id AS two FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM sound
  UNION SELECT reach.vec_id, two FROM reach JOIN links ON other = one),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degrees AS (SELECT one AS vec_id, count(*) AS n_links FROM links GROUP BY one)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN least USING (vec_id) LEFT JOIN degrees USING (vec_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_counts": op7_token_counts,
    "op8_html_text": op8_html_text,
    "op9_url_filter": op9_url_filter,
    "op10_bpe": op10_bpe,
    "op11_collocations": op11_collocations,
    "op12_vector_codes": op12_vector_codes,
    "op13_embedding_dedup": op13_embedding_dedup,
}
ORACLE_SQL: dict[str, str] = {"op4_exact_dedup": OP4_SQL, "op5_mixing": OP5_SQL, "op9_url_filter": OP9_SQL, "op11_collocations": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_embedding_dedup": OP13_SQL}
