"""Books: body, parts and chapters, pages, reflowed paragraphs, footers.

A book's lines are rows (book, line_no, text). What runs along a book runs in windows by book; the two greedy fills (pages of a
chapter, lines of a paragraph) are folds over arrays of one chapter or paragraph.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

PAGE_LINES = 40
REFLOW_FROM = 60


def composed(lines: DataFrame) -> DataFrame:
    """Lines in composed form (NFC). Only lines with combining marks go through Python."""

    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t))

    marked = F.col("text").rlike(r"\p{M}")
    return lines.where(~marked).unionByName(lines.where(marked).withColumn("text", nfc("text")))


def header_field(lines: DataFrame, key: str) -> DataFrame:
    """The value of ``key: value`` among a book's first 200 lines, the first one."""
    value = F.regexp_extract("text", rf"^{key}:\s*(.+?)\s*$", 1)
    found = lines.where("line_no < 200").select("book", "line_no", value.alias("value")).where("value <> ''")
    return found.groupBy("book").agg(F.min_by("value", "line_no").alias(key.lower()))


def author(lines: DataFrame) -> DataFrame:
    """The author of each book; a first word in small letters, as a title of rank is written, is no part of the name."""
    words = F.split("author", r"\s+")
    first = F.element_at(words, 1)
    ranked = first.rlike(r"\p{Ll}") & (first == F.lower(first))
    return header_field(lines, "Author").select("book", F.array_join(F.when(ranked, F.slice(words, F.lit(2), F.size(words))).otherwise(words), " ").alias("author"))


def body(lines: DataFrame) -> DataFrame:
    """Lines after the first start mark and before the first end mark, wherever these are."""
    marks = lines.groupBy("book").agg(F.min(F.when(F.col("text").rlike(T.BODY_START), F.col("line_no"))).alias("__a"), F.min(F.when(F.col("text").rlike(T.BODY_END), F.col("line_no"))).alias("__b"))
    return lines.join(marks, "book").where((F.col("line_no") > F.coalesce("__a", F.lit(-1))) & (F.col("line_no") < F.coalesce("__b", F.lit(1 << 62)))).drop("__a", "__b")


def split(lines: DataFrame, front: str = "Front") -> DataFrame:
    """part_no, part, chapter_no and chapter of every line of a book.

    A heading opens a part or a chapter. A part's lead-in (its chapter without a name) belongs to the first chapter if all it
    holds is blank or the part's heading. Parts and chapters without an inked line are dropped.
    """
    stripped = F.rtrim("text")
    is_part = stripped.rlike(T.PART)
    kind = F.when(is_part, "part").when(stripped.rlike(T.CHAPTER), "chapter")
    along = Window.partitionBy("book").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("kind", kind)
    rows = rows.withColumns({"part_no": F.count_if(F.col("kind") == "part").over(along), "head_no": F.count("kind").over(along)})
    rows = rows.withColumn("part", F.coalesce(F.last(F.when(F.col("kind") == "part", stripped), ignorenulls=True).over(along), F.lit(front)))
    rows = rows.withColumn("inked", (F.trim("text") != "") & (F.trim("text") != F.col("part")))
    # the lead-in of each part, and whether it melts into the chapter after it
    spans = rows.groupBy("book", "part_no", "head_no").agg(F.max("inked").alias("own"), F.max(F.when(F.col("kind") == "chapter", stripped)).alias("chapter"), F.max(F.trim("text") != "").alias("any"))
    following = Window.partitionBy("book", "part_no").orderBy("head_no")
    spans = spans.withColumn("melts", F.col("chapter").isNull() & ~F.col("own") & F.lead("chapter").over(following).isNotNull())
    spans = spans.withColumn("chapter", F.when(F.col("melts"), F.lead("chapter").over(following)).otherwise(F.coalesce("chapter", F.lit(""))))
    spans = spans.withColumn("chapter_no", F.when(F.col("melts"), F.col("head_no") + 1).otherwise(F.col("head_no")))
    rows = rows.join(spans.select("book", "part_no", "head_no", "chapter", "chapter_no"), ["book", "part_no", "head_no"])
    kept = rows.groupBy("book", "part_no", "chapter_no").agg(F.max(F.trim("text") != "").alias("inked_any")).where("inked_any").drop("inked_any")
    return rows.join(kept, ["book", "part_no", "chapter_no"], "left_semi").select("book", "line_no", "text", "part_no", "part", "chapter_no", "chapter")


def squeezed(lines: DataFrame, by: list[str]) -> DataFrame:
    """Lines of each group without leading and trailing blank ones, and with one blank line for each run of them."""
    order = Window.partitionBy(*by).orderBy("line_no")
    rows = lines.withColumn("blank", F.trim("text") == "")
    rows = rows.withColumn("before", F.lag("blank").over(order)).where("NOT blank OR NOT coalesce(before, true)")
    last = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("inked_after", F.max(~F.col("blank")).over(last)).where("inked_after")
    return rows.withColumn("text", F.when(F.col("blank"), "").otherwise(F.col("text"))).drop("blank", "before", "inked_after")


def pages(lines: DataFrame, by: list[str], size: int = PAGE_LINES) -> DataFrame:
    """Pages of squeezed lines: page, and place (from 0) of every line that stands on one.

    A page begins at the first inked line at or after its start, and the next one ``size`` lines after that. As blank lines
    stand alone, only a start on a blank line moves, by one; the fold over a group's blank places gives the starts.
    """
    order = Window.partitionBy(*by).orderBy("line_no")
    rows = lines.withColumn("i", (F.row_number().over(order) - 1).cast("long"))
    shape = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.trim("text") == "", F.col("i")))).alias("blanks"))
    many = F.sequence(F.lit(1).cast("long"), F.greatest(F.floor((F.col("n") - 1) / size), F.lit(0)) + 1)

    def add(starts: Column, _: Column) -> Column:
        at = F.coalesce(F.try_element_at(starts, F.lit(-1)) + size, F.lit(0).cast("long"))
        at = F.when(F.array_contains("blanks", at), at + 1).otherwise(at)
        return F.concat(starts, F.array(at))

    starts = shape.withColumn("start", F.explode(F.filter(F.aggregate(many, F.array().cast("array<bigint>"), add), lambda s: s < F.col("n"))))
    starts = starts.select(*by, "start").withColumn("page", (F.row_number().over(Window.partitionBy(*by).orderBy("start")) - 1).cast("long"))
    placed = rows.join(starts, by).where((F.col("i") >= F.col("start")) & (F.col("i") < F.col("start") + size)).withColumn("place", F.col("i") - F.col("start"))
    tail = Window.partitionBy(*by, "page").orderBy("place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return placed.withColumn("__ink", F.max(F.trim("text") != "").over(tail)).where("__ink").drop("__ink", "i", "start")


def page_numbers(pages_: DataFrame) -> DataFrame:
    """number (from 1 through the book) of each page: book, part_no, chapter_no, page."""
    keys = pages_.select("book", "part_no", "chapter_no", "page").distinct()
    return keys.withColumn("number", F.row_number().over(Window.partitionBy("book").orderBy("part_no", "chapter_no", "page")).cast("long"))


def greedy(words: Column, width: float, advance: float) -> Column:
    """Words filled into lines of at most width, each as full as it gets; a fold that carries the open line's width."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("line"), F.lit(0.0).alias("w"))

    def step(s: Column, word: Column) -> Column:
        ww = F.length(word) * F.lit(advance)
        full = (F.size(s["line"]) > 0) & (s["w"] + F.lit(advance) + ww > width)
        return F.when(full, F.struct(F.concat(s["done"], F.array(F.array_join(s["line"], " "))).alias("done"), F.array(word).alias("line"), ww.alias("w"))).otherwise(
            F.struct(s["done"].alias("done"), F.concat(s["line"], F.array(word)).alias("line"), (s["w"] + F.when(F.size(s["line"]) > 0, advance).otherwise(0.0) + ww).alias("w"))
        )

    return F.aggregate(words, zero, step, lambda s: F.when(F.size(s["line"]) > 0, F.concat(s["done"], F.array(F.array_join(s["line"], " ")))).otherwise(s["done"]))


def reflowed(lines: DataFrame, width: float, advance: float = 0.571) -> DataFrame:
    """book, para (first line), k, text: paragraphs with a line of REFLOW_FROM characters are filled anew, others keep their
    lines, blank lines stay blank."""
    order = Window.partitionBy("book").orderBy("line_no")
    rows = lines.withColumn("blank", F.trim("text") == "")
    rows = rows.withColumn("opens", F.when(F.col("blank") | F.coalesce(F.lag("blank").over(order), F.lit(True)), F.col("line_no")))
    rows = rows.withColumn("para", F.last("opens", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    paras = rows.groupBy("book", "para").agg(F.array_sort(F.collect_list(F.struct("line_no", F.rtrim("text").alias("text")))).alias("own"), F.max(F.length(F.rtrim("text"))).alias("longest"))
    own = F.transform("own", lambda x: x["text"])
    words = F.filter(F.split(F.array_join(F.transform(own, lambda t: F.trim(t)), " "), r"\s+"), lambda w: w != "")
    done = F.when(F.col("longest") < REFLOW_FROM, own).otherwise(greedy(words, width, advance))
    return paras.select("book", "para", F.posexplode(done).alias("k", "text"))


def footer(author: Column, number: Column, title: Column, width: float, advance: float = 0.571) -> Column:
    """Author at the left, page number in the middle, title at the right, parted by spaces of the face."""

    def wide(t: Column) -> Column:
        return F.length(t) * F.lit(advance)

    first = F.greatest(F.bround((width / 2 - wide(author) - wide(number) / 2) / advance).cast("int"), F.lit(1))
    second = F.greatest(((F.lit(width) - wide(author) - first * advance - wide(number) - wide(title)) / advance).cast("int"), F.lit(1))
    return F.concat(author, F.repeat(F.lit(" "), first), number, F.repeat(F.lit(" "), second), title)


def centred(line: Column, width: float, advance: float = 0.571) -> Column:
    """A chapter heading in the middle of the page."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.bround((width - F.length(line) * F.lit(advance)) / 2 / advance).cast("int"), F.lit(1))), F.trim(line))
