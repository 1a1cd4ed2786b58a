"""The search over files that keep arriving: the batch operators on a streaming source.

Nothing in the search spans files, so each micro-batch is final: hits are appended, and counts by file need no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textloom.operators import lines, search


def arriving(spark: SparkSession, path: str, schema: StructType, per_batch: int = 1000) -> DataFrame:
    """Rows of Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def hits(files: DataFrame, word: str) -> DataFrame:
    """file_id, line_no, col of each whole-word hit; files: a stream of file_id, text."""
    return search.hits(lines.lines(files.select("file_id", "text")), word)


def append(found: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, each input once; stops when what has arrived is done."""
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
