"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of BLOCK bytes. Equal blocks get one integer name and different blocks different
ones; then the names of adjacent blocks are paired and the pairs named in the same way, until one name is left of each
text. Together with the number of rounds it is the text's identity, without collisions.

* Names are integers in sorted order: distinct keys are range-partitioned, sorted and numbered, so a hot key is one row.
* A block is sorted by its fingerprint first. Fingerprints that recur are counted, then the contents of their blocks are
  aggregated by fingerprint (map-side first): the smallest and largest of each are compared, and a fingerprint of several
  contents is named by content. Contents of blocks that occur once are not moved.
* A text with a block that occurs once is equal to no other: its identity is settled, and only texts all of whose blocks
  recur take part in the rounds.

Defined cases: null texts equal empty ones and blank runs equal one space. The row of least doc_id stays, null ids last;
of repeated rows of that id one stays. Rows are never merged: each row has its result row. An empty table gives an empty
result. Other columns are ignored by ``groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SPACE, cut, maybe_in, settled, tidy, without

BLOCK = 8192


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _blocks(norm: Column, block: int) -> Column:
    data = norm.cast("binary")
    last = F.greatest(F.ceil(F.octet_length(norm) / F.lit(block)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * block + 1, F.lit(block)))


def integer_names(keys: DataFrame) -> DataFrame:
    """The distinct rows in sorted order, each with an integer of its own as ``name``."""
    columns = keys.columns
    ordered = keys.distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    return cut(ordered.withColumn("name", F.monotonically_increasing_id()))


def _block_names(docs: DataFrame, rows: DataFrame, block: int, fingerprint: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame | None]:
    """Names of the blocks that recur, by fingerprint; and by content, where contents share one."""
    again = cut(rows.select(F.explode("fps").alias("fp")).groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))
    pieces = docs.select(normalised(F.col("text")).alias("norm")).select(F.explode(_blocks(F.col("norm"), block)).alias("block")).withColumn("fp", fingerprint(F.col("block")))
    seen = maybe_in(pieces, again, "fp").groupBy("fp").agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high"))
    seen = cut(seen.where("n > 1").select("fp", (F.col("low") != F.col("high")).alias("several")))
    clashes = seen.where("several").select("fp")
    if clashes.isEmpty():
        return integer_names(seen.where("NOT several").select("fp")), None
    contents = pieces.join(clashes, "fp").groupBy("fp", "block").count().where("count > 1").select("fp", "block")
    apart = integer_names(contents).withColumn("name", -F.col("name") - 1)
    return integer_names(seen.where("NOT several").select("fp")), apart


def identities(docs: DataFrame, block: int = BLOCK, fingerprint: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """All rows (row, doc_id, sha); and the rows that may have equals, with their identity (row, round, name)."""
    norm = normalised(F.col("text"))
    base = docs.select("doc_id", norm.alias("norm")).select("doc_id", F.sha2(F.col("norm"), 256).alias("sha"), F.transform(_blocks(F.col("norm"), block), lambda b: fingerprint(b)).alias("fps"))
    rows = cut(base.withColumn("row", F.monotonically_increasing_id()))
    names, apart = _block_names(docs, rows, block, fingerprint)
    pieces = rows.select("row", F.size("fps").alias("of"), F.posexplode("fps").alias("at", "fp"))
    named = pieces.join(names, "fp").select("row", "of", "at", "name")
    if apart is not None:
        rich = docs.select("doc_id", norm.alias("norm")).withColumn("row", F.monotonically_increasing_id())
        rich = rich.select("row", F.posexplode(_blocks(F.col("norm"), block)).alias("at", "block")).withColumn("fp", fingerprint(F.col("block")))
        again = rich.join(apart, ["fp", "block"]).select("row", "at", "name")
        named = named.unionByName(pieces.select("row", "of", "at").join(again, ["row", "at"]).select("row", "of", "at", "name"))
    whole = named.groupBy("row").agg(F.count("*").alias("found"), F.first("of").alias("of")).where("found = of").select("row")
    level = cut(named.join(whole, "row", "left_semi").select("row", "of", "at", "name"))
    done, rounds = [], 0
    while True:
        done.append(level.where("of = 1").select("row", F.lit(rounds).alias("round"), "name"))
        rest = level.where("of > 1")
        if rest.isEmpty():
            break
        halves = (F.min(F.when(F.col("at") % 2 == side, F.col("name"))) for side in (0, 1))
        left, right = halves
        pairs = rest.groupBy("row", "of", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(left.alias("a"), F.coalesce(right, F.lit(-(1 << 62))).alias("b"))
        pairs = cut(pairs)
        level = cut(pairs.join(integer_names(pairs.select("a", "b")), ["a", "b"]).select("row", F.ceil(F.col("of") / 2).cast("int").alias("of"), "at", "name"))
        rounds += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return rows, out


def groups(docs: DataFrame, block: int = BLOCK, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """row (an integer of its own), doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    with tidy(docs.sparkSession) as steps:
        return steps.done(_groups(settled(docs.select("doc_id", "text")), block, fingerprint))


def _groups(docs: DataFrame, block: int, fingerprint: Callable[[Column], Column]) -> DataFrame:
    rows, same = identities(docs, block, fingerprint)
    known = same.join(rows.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row").alias("row"))).alias("first")
    sizes = known.groupBy("round", "name").agg(first, F.count("*").alias("n")).where("n > 1")
    members = known.select("row", "round", "name").join(sizes, ["round", "name"]).select("row", "first", "n")
    return rows.join(members, "row", "left").select(
        "row",
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each group of equal texts, with all columns."""
    with tidy(docs.sparkSession) as steps:
        docs = settled(docs)
        return steps.done(without(docs, groups(docs, block).where("NOT kept")))
