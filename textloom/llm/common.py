"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import cut, sweep, thin, tidy

__all__ = ["SPACE", "cut", "fold", "maybe_in", "settled", "sweep", "table", "thin", "tidy", "without"]

#: Numbers of rows that are broadcast at most: 4 MB.
FEW = 1 << 19
#: Slots of a filter in front of a join.
SLOTS = 1 << 20

#: White space of the contracts: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(docs: DataFrame) -> DataFrame:
    """docs, stored first unless its rows have their places for good: files or a checkpoint, projected and filtered.

    Operators number rows by place in more than one plan; rows of a shuffle could come in another order each time.
    """
    plan = docs._jdf.queryExecution().optimizedPlan()
    sure = plan.deterministic()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRDD":
        sure = sure and plan.rdd().isCheckpointed()
    else:
        sure = sure and plan.nodeName().startswith("LogicalRelation")
    return docs if sure else cut(docs)


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in keys, and few others: what goes to all executors has at most SLOTS numbers."""

    def slot(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(SLOTS))

    asked = keys.select(slot(F.col(key)).alias("slot")).distinct()
    return rows.withColumn("slot", slot(F.col(key))).join(F.broadcast(asked), "slot", "left_semi").drop("slot")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, which is settled, but those whose place is in gone (row), with all columns whatever their names.

    Up to FEW places go to all executors; more are joined, which moves the rows.
    """
    gone = cut(gone.select("row"))
    places = F.broadcast(gone) if gone.count() <= FEW else gone
    placed = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    return placed.join(places, "row", "left_anti").select("doc.*")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null for a null doc_id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))
