"""Files to lines, and running offsets that need no single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.session import cut


def code_text(text: Column) -> Column:
    """Text of a code corpus: newlines made one, ASCII only. Tabs widen per line, see ``lines``."""
    return T.newlines(text)


def cleaned(line: Column, charset: str = "raw", cut: bool = True) -> Column:
    """A line as it is stored, or not yet cut at MAX_COLUMNS. charset: raw keeps the characters, ascii and book fold them as code and
    book corpora do (tabs widened, controls replaced)."""
    if charset == "book":
        line = T.book_charset(line)
    if charset != "raw":
        line = T.tab_stops(line)
    if charset == "ascii":
        line = T.code_charset(line)
    elif charset != "raw":
        line = T.control_fold(line)
    return T.stored_line(line) if cut else F.rtrim(line)


def lines(files: DataFrame, charset: str = "raw") -> DataFrame:
    """file_id, line_no, text, len, indent, nonspace of every line; files: file_id, text; charset: see ``cleaned``."""
    # a column of its own: inside the generator, each use of a text's parts would part it anew
    each = files.select("file_id", T.line_array(T.newlines(F.col("text"))).alias("__lines"))
    parts = each.select("file_id", F.posexplode("__lines").alias("line_no", "line"))
    return measured(parts.select("file_id", "line_no", cleaned(F.col("line"), charset).alias("text")))


def measured(parts: DataFrame) -> DataFrame:
    """Lines (file_id, line_no, text, ...) with len, indent and nonspace."""
    more = [c for c in parts.columns if c not in ("file_id", "line_no", "text")]
    return parts.select("file_id", "line_no", "text", F.length("text").alias("len"), T.indent(F.col("text")).alias("indent"), T.nonspace(F.col("text")).alias("nonspace"), *more)


def file_metrics(lines_: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Lines, characters and ink of each file; those of files (file_id) that have no lines are 0."""
    found = lines_.groupBy("file_id").agg(F.count("*").alias("lines"), F.sum("len").alias("chars"), F.sum("nonspace").alias("nonspace"))
    return found if files is None else files.select("file_id").join(found, "file_id", "left").fillna(0, ["lines", "chars", "nonspace"])


def running(df: DataFrame, order: str, value: str, name: str, width: int = 4096, by: Sequence[str] = ()) -> DataFrame:
    """The sum of value over the rows before each row, in the order of a unique integer column.

    Two levels: a window within every run of ``width`` order values, and one over the runs' sums. Only the sums of the runs
    (one row for each width values) share a task; nothing is ordered globally.
    """
    run = F.floor(F.col(order) / width)
    rows = df.withColumn("__run", run)
    inside = Window.partitionBy(*by, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    totals = rows.groupBy(*by, "__run").agg(F.sum(value).alias("__total"))
    before = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "__run", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    return rows.join(starts, [*by, "__run"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__run", "__inside", "__before")


def ranked(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Rows with their place, from 0, in an order over all of them.

    Rows are dealt to ranges of the order, sorted there and stored, then numbered by range: only the ranges' sizes share a task.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.select("*", *(c.alias(f"__o{k}") for k, c in enumerate(columns)))
    keys = [f"__o{k}" for k in range(len(columns))]
    sorted_ = cut(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__k")).drop(*keys))
    sizes = sorted_.groupBy("__p").agg(F.count("*").alias("n"), F.min("__k").alias("__first"))
    starts = sizes.select("__p", "__first", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return sorted_.join(F.broadcast(starts), "__p").withColumn(name, F.col("__before") + F.col("__k") - F.col("__first")).drop("__p", "__k", "__first", "__before")


def line_offsets(lines_: DataFrame) -> DataFrame:
    """off of every line: characters before it in its file and in all files before, by file_id."""
    inside = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    own = lines_.select("file_id", "line_no", "len", F.coalesce(F.sum("len").over(inside), F.lit(0)).alias("inside"))
    files = running(file_metrics(lines_).select("file_id", "lines", "chars"), "file_id", "chars", "base")
    return own.join(files.select("file_id", "base"), "file_id").select("file_id", "line_no", "len", (F.col("base") + F.col("inside")).alias("off"))


def as_of(points: DataFrame, marks: DataFrame, key: str, at: str, carry: str) -> DataFrame:
    """Each point's last mark at or before it, within key; points: key, at, ...; marks: key, at, carry.

    A union and a running last value: one sort, no range join.
    """
    both = points.withColumns({"__point": F.lit(1), carry: F.lit(None).cast(marks.schema[carry].dataType)}).unionByName(marks.select(key, at, carry, F.lit(0).alias("__point")), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(at, "__point").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(carry, F.last(carry, ignorenulls=True).over(order)).where("__point = 1").drop("__point")
