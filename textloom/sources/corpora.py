"""Corpus adapters: tables as files of a tree (file_id, path, lang, text), with an optional tint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents under lang/source/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "lang", "source", F.coalesce("text", F.lit("")).alias("text"))


def url_path(url: Column) -> Column:
    """Host and path segments of a URL, as a path."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[^:]*://", ""), r"[?#].*$", "")
    return F.regexp_replace(bare, r"/+$", "")


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages under their URL's host and segments; the markup is the text."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("file_id"), url_path(F.col("url")).alias("path"), F.lit("text-xml").alias("lang"), F.coalesce("html", F.lit("")).alias("text"))


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a book: a part for each conversation, a chapter for each turn."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
