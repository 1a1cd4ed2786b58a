"""The stages end to end: files to an index, an index to a layout, tables to storage and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import book, code, layout, lines, order, proportional, tokens, tree
from textloom.session import cut, settings
from textloom.sources import trees

#: Tables of a stored index; all must be there for one to be complete.
TABLES = ("files", "dirs", "lines", "items")

#: Rows that a worker is given at once while tables are written: files, whose texts are read, copied and given back as lines.
BATCH_ROWS = 256

#: Names of item kinds by language, from 1 (fixed values).
ITEM_WORDS = {"rust": ("fn", "struct", "enum", "impl", "item"), "python": ("def", "class", "enum", "class", "item"), "clike": ("function", "struct", "enum", "interface", "item")}
_KEYWORD = r"\b(fn|struct|enum|trait|impl|mod|macro_rules!|type|const|static|union|def|class|interface|namespace|protocol|extension|function|func)\b"


def code_index(files: DataFrame) -> dict[str, DataFrame]:
    """Index of source files (path, bytes, content): files, dirs, lines, items, and skipped ones by reason.

    A line has the kinds of its characters beside it, as runs, so that what asks for them reads no text again.
    """
    judged = trees.gated(files)
    skipped = judged.where("status <> 'ok'").groupBy("status").agg(F.count("*").alias("n"))
    kept = trees.with_language(judged.where("status = 'ok'").withColumn("head", F.substring("text", 1, 256))).drop("content", "head", "status")
    numbered = kept.join(tree.pre_order(kept.select("path")), "path").withColumnRenamed("file_no", "file_id")
    texts = stored_texts(numbered)
    rows = kinded_lines(texts)
    found = code.items(texts.select("file_id", "lang", "text"))
    heads = numbered.select("file_id", "path", "lang", "variant", "bytes").join(lines.file_metrics(rows, numbered), "file_id")
    return {"files": heads, "dirs": tree.directories(heads.select("path", "lines"), ["lines"]), "lines": rows, "items": found, "skipped": skipped}


def stored_texts(files: DataFrame, charset: str = "ascii", whole: bool = False) -> DataFrame:
    """files (file_id, lang, variant, text) with their lines as they are stored, and the text that these make; whole: the text that the
    lines make before they are cut at MAX_COLUMNS, so that a string or comment that is closed behind the cut ends where the file ends it."""
    if not whole:
        kept = F.transform(T.line_array(T.newlines(F.col("text"))), lambda line: lines.cleaned(line, charset))
        return files.select("file_id", "lang", "variant", kept.alias("kept")).withColumn("text", F.array_join("kept", "\n"))
    full = F.transform(T.line_array(T.newlines(F.col("text"))), lambda line: lines.cleaned(line, charset, cut=False))
    read = files.select("file_id", "lang", "variant", full.alias("__full"))
    kept = F.transform("__full", lambda line: F.substring(line, 1, T.MAX_COLUMNS))
    return read.select("file_id", "lang", "variant", kept.alias("kept"), F.array_join("__full", "\n").alias("text"))


def kinded_lines(texts: DataFrame) -> DataFrame:
    """file_id, line_no, text, its measures and kinds, the runs (n, kind) that cover the line; texts: see ``stored_texts``.

    A token of several lines gives each of them its kind. Runs of a text with longer lines than are stored end with the stored line.
    Lines are in the order of their files.
    """
    return lines.measured(code.kinded(texts, T.MAX_COLUMNS))


def item_words(items: DataFrame, rows: DataFrame, files: DataFrame) -> DataFrame:
    """The word that each item's first line is introduced by; without one, the name of its kind in its language."""
    heads = items.join(rows.select("file_id", F.col("line_no").cast("long").alias("first"), F.col("text").alias("head")), ["file_id", "first"]).join(files.select("file_id", "lang"), "file_id")
    return head_words(heads)


def head_words(heads: DataFrame) -> DataFrame:
    """The same of items that have lang and head, the text of their first line, beside them."""
    names = F.create_map(*(x for lang, words in ITEM_WORDS.items() for x in (F.lit(lang), F.array(*map(F.lit, words)))))
    fallback = F.coalesce(F.get(F.try_element_at(names, F.col("lang")), F.col("kind").cast("int") - 1), F.lit("item"))
    word = F.regexp_extract("head", _KEYWORD, 1)
    return heads.select("file_id", "first", "past", "kind", "name", F.when(word != "", word).otherwise(fallback).alias("word"))


def layout_of(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Box, columns, rows and pitch of each file (file_id, path, weight, lines) in the treemap; rows: its lines."""
    boxes = layout.treemap(files.select("path", F.greatest("weight", F.lit(1.0)).alias("weight"), "lines")).where("NOT is_dir").select("path", "x0", "y0", "x1", "y1")
    return _settled(files, boxes, rows)


def layout_tables(indexed: dict[str, DataFrame], weights: DataFrame | None = None) -> dict[str, DataFrame]:
    """The layout of an index (files, lines, items) as tables: dirs, files, rows and item_rects.

    weights: file_id, weight; files without one weigh as many as they have lines. Directories and files have boxes, hues by their
    directory below the root, and files their columns; rows are the visual rows of all lines with their places, item_rects the
    boxes of items, one for each column that an item spans.
    """
    files, lines_ = indexed["files"], indexed["lines"]
    if weights is not None:
        files = files.join(weights, "file_id", "left")
    own = F.coalesce("weight", F.col("lines").cast("double")) if weights is not None else F.col("lines").cast("double")
    weighed = cut(files.select("file_id", "path", F.greatest(own, F.lit(1.0)).alias("weight"), F.col("lines").cast("long").alias("lines")))
    boxes = cut(layout.treemap(weighed.select("path", "weight", "lines")))
    hues = tree.hues(tree.directories(weighed.select("path"))).withColumnRenamed("path", "dir")
    dirs = boxes.where("is_dir").withColumnRenamed("path", "dir").join(hues, "dir").select(F.col("dir").alias("path"), "depth", "weight", "pad", "x0", "y0", "x1", "y1", "hue")
    placed = _settled(weighed, boxes.where("NOT is_dir").select("path", "x0", "y0", "x1", "y1"), lines_)
    placed = cut(placed.withColumn("dir", tree.parent_path(F.col("path"))).join(hues, "dir").drop("dir"))
    shape = placed.select("file_id", "cap", "rows", "pitch", (F.col("colw") * (1 + layout.GAP)).alias("colw"), "x0", "y0")
    visual = cut(layout.numbered(layout.wrapped(lines_.drop("text").join(shape, "file_id"))))
    x, y = layout.row_position(F.col("x0"), F.col("y0"), F.col("row_in_file"), F.col("rows"), F.col("pitch"), F.col("colw"), F.col("row_in_line") == 0)
    rows = visual.select("file_id", F.col("line_no").cast("long").alias("line_no"), "row_in_line", "row_in_file", "col0", "row_len", x.alias("x"), y.alias("y"))
    begins = rows.where("row_in_line = 0").select("file_id", "line_no", F.col("row_in_file").alias("row"))
    totals = rows.groupBy("file_id").agg(F.count("*").alias("total"))
    items = indexed["items"].join(begins.select("file_id", F.col("line_no").alias("first"), F.col("row").alias("s")), ["file_id", "first"]).join(totals, "file_id")
    items = items.join(begins.select("file_id", F.col("line_no").alias("past"), F.col("row").alias("after")), ["file_id", "past"], "left").withColumn("e", F.coalesce("after", "total"))
    items = items.join(shape.drop("cap"), "file_id").withColumn("item_id", F.concat_ws(":", "file_id", "first", "past", "name"))
    rects = layout.item_boxes(items).withColumn("file_id", F.split("item_id", ":")[0].cast("long"))
    return {"dirs": dirs, "files": placed, "rows": rows, "item_rects": rects}


def book_layout_tables(indexed: dict[str, DataFrame], parts: bool = False, page_lines: int | None = None, advances: Mapping[str, float] | None = None, hang: float = 1.0, justify: bool = False) -> dict[str, DataFrame]:
    """The layout of a book's index (files in reading order, lines) as tables: dirs, files and rows, as ``layout_tables`` gives them.

    Pages are cells of one size, all on one grid, or in a band for each part (the first name of their paths). Every page is laid out
    as a full one of page_lines lines (those of the longest page, if none are given) and the book's line width, in a text block inside
    its margins: tx0, ty0, tx1, ty1. With advances the face has characters of different widths: lines wrap by width, rows have char_x
    and row_width, and justify stretches the rows that the next line of a paragraph follows, and the footers.
    """
    lines_ = cut(indexed["lines"].select("file_id", F.col("line_no").cast("long").alias("line_no"), "text", "len", "indent"))
    width = F.col("len") * layout.CHAR if advances is None else proportional.line_width(F.col("text"), advances)
    measured = cut(lines_.select("file_id", width.alias("width"), F.col("len")))
    line_width = order.quantiles(measured, "width", [0.995])[0] or 40.0
    counts = measured.groupBy("file_id").agg(F.count("*").alias("n"))
    if page_lines is None:
        page_lines = counts.agg(F.max("n")).first()[0] or 1
    shape = layout.page_shape(page_lines, line_width)

    pages = lines.running(indexed["files"].select("file_id", "path").withColumn("one", F.lit(1)), "file_id", "one", "page_no").drop("one").withColumn("page_no", F.col("page_no").cast("long"))
    world = (F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), *(F.lit(v).alias(n) for v, n in zip(layout.world(), ("x1", "y1"), strict=True)))
    root = pages.groupBy().agg(F.lit("").alias("path"), F.lit(0).alias("depth")).select("path", "depth", *world)
    if parts:
        named = cut(pages.withColumn("part", F.element_at(F.split("path", "/"), 1)))
        spans = named.groupBy("part").agg(F.min("page_no").alias("begin"), F.count("*").alias("pages"))
        spans = cut(spans.withColumn("part_no", F.row_number().over(Window.orderBy("begin")) - 1))  # one row a part
        bands = layout.part_bands(spans.select("part_no", "pages"), shape)
        placed = layout.in_bands(named.join(spans.select("part", "part_no", "begin"), "part").withColumn("k", F.col("page_no") - F.col("begin")), bands).drop("part", "part_no", "begin", "k")
        edge = layout.padding(*(F.lit(v) for v in layout.world()))
        banded = bands.join(spans.select("part_no", "part"), "part_no").select(F.col("part").alias("path"), F.lit(1).alias("depth"), edge.alias("x0"), "y0", (F.lit(layout.world()[0]) - edge).alias("x1"), "y1")
        dirs = root.unionByName(banded)
    else:
        placed, dirs = layout.flow(pages, shape), root
    dirs = dirs.withColumns({"pad": layout.padding(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), "hue": F.lit(0)})

    inner = layout.text_block(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    placed = placed.withColumns(dict(zip(("tx0", "ty0", "tx1", "ty1"), inner, strict=True))).withColumns({"w": F.col("tx1") - F.col("tx0"), "h": F.col("ty1") - F.col("ty0")})
    size = F.col("len").cast("long").alias("len") if advances is None else F.col("width")
    groups = measured.groupBy("file_id", size).agg(F.count("*").alias("count")).groupBy("file_id").agg(F.sum("count").alias("n"), F.collect_list(F.struct("len" if advances is None else "width", "count")).alias("hist"))
    none = F.array().cast(f"array<struct<{'len:bigint' if advances is None else 'width:double'},count:bigint>>")
    sized = placed.join(groups, "file_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "hist": F.coalesce("hist", none), "target": F.lit(float(line_width))})
    page = (page_lines, line_width)
    if advances is None:
        files = cut(layout.settled(sized, page=page).drop("hist", "target"))
        fitted = files.select("file_id", "cap", "rows", "pitch", (F.col("colw") * (1 + layout.GAP)).alias("colw"), "tx0", "ty0")
        visual, step = layout.numbered(layout.wrapped(lines_.drop("text").join(fitted, "file_id"))), layout.HANG * layout.CHAR
    else:
        first = cut(proportional.settled(sized, hang, page=page).drop("hist", "target"))
        exact = proportional.repaired(first.select("file_id", "h", "k", "rows", "pitch", "colw", "capw"), lines_.select("file_id", "text"), advances, hang)
        files = cut(first.drop("h", "k", "rows", "pitch", "colw", "capw").join(exact, "file_id"))
        fitted = files.select("file_id", F.col("capw").alias("cap"), "rows", "pitch", (F.col("colw") * (1 + layout.GAP)).alias("colw"), "tx0", "ty0")
        following = F.lead("len").over(Window.partitionBy("file_id").orderBy("line_no"))
        flush = (F.col("len") > 0) & (following.isNull() | (following > 0) & (F.col("indent") == 0))
        visual = layout.numbered(proportional.wrapped(lines_.withColumn("flush", flush).join(fitted, "file_id"), advances, hang))
        visual = visual.withColumn("stretch", F.lit(justify) & (~F.col("last_row") | F.col("flush")))
        visual, step = proportional.justified(visual, F.when(F.col("row_in_line") == 0, F.col("cap")).otherwise(F.col("cap") - hang), advances), hang
    x, y = layout.row_position(F.col("tx0"), F.col("ty0"), F.col("row_in_file"), F.col("rows"), F.col("pitch"), F.col("colw"), F.col("row_in_line") == 0, step)
    more = [] if advances is None else ["char_x", "row_width"]
    rows = visual.select("file_id", "line_no", "row_in_line", "row_in_file", "col0", "row_len", x.alias("x"), y.alias("y"), *more)
    return {"dirs": dirs, "files": files.drop("w", "h", "page_no").withColumn("hue", F.lit(0)), "rows": rows}


def build_layout(indexed: dict[str, DataFrame], corpus: str = "code", weights: DataFrame | None = None, **book_options: object) -> dict[str, DataFrame]:
    """The layout of an index in one call: a treemap weighed by weights (or lines) for code, pages of one size for a book; book_options:
    see ``book_layout_tables``."""
    if corpus == "book":
        return book_layout_tables(indexed, **book_options)
    return layout_tables(indexed, weights)


def _settled(files: DataFrame, boxes: DataFrame, rows: DataFrame) -> DataFrame:
    """files (file_id, path, ...) in their boxes (path, x0, y0, x1, y1), with their columns; rows: their lines."""
    placed = files.select("file_id", "path").join(boxes, "path").join(layout.length_histogram(rows), "file_id", "left")
    none = F.array().cast("array<struct<len:bigint,count:bigint>>")
    sized = placed.withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0"), "n": F.coalesce("n", F.lit(0)), "hist": F.coalesce("hist", none), "target": layout.target_width(F.coalesce("p90", F.lit(0.0)))})
    return layout.settled(sized).drop("hist", "p90", "target", "w", "h")


def book_index(text_lines: DataFrame, page_lines: int = book.PAGE_LINES, width: float | None = None, author: str = "", title: str = "") -> DataFrame:
    """Pages of books (book, line_no, text): path, number and every line of each page, padded and with its footer, as stored in the
    charset of books, with the kinds of its characters as runs.

    Chapter headings are centred, and all of the last line, the footer, but its spaces is in the comment kind.
    """
    parts = book.split(text_lines)
    if width is None:
        found = order.quantiles(parts.where(F.trim("text") != "").select((F.length("text") * layout.CHAR).alias("width")), "width", [0.995])[0]
        width = found if found is not None else 40.0
    by = ["book", "part_no", "chapter_no"]
    placed = book.pages(book.squeezed(parts, by), by, page_lines)
    numbers = book.page_numbers(placed)
    heads = placed.groupBy(*by, "page").agg(F.first("part").alias("part"), F.first("chapter").alias("chapter")).join(numbers, [*by, "page"])
    path = F.concat_ws("/", T.heading_title(F.col("part")), F.when(F.col("chapter") != "", T.heading_title(F.col("chapter"))).otherwise("Contents"), F.concat(F.lit("p. "), F.col("number").cast("string")))
    shown = F.when(F.rtrim("text").rlike(T.CHAPTER), book.centred(F.col("text"), width)).otherwise(F.col("text"))
    own = placed.join(numbers, [*by, "page"]).select("book", "number", F.col("place").cast("int").alias("place"), shown.alias("text"))
    filler = heads.select("book", "number", F.explode(F.sequence(F.lit(0), F.lit(page_lines + 2))).alias("place"))
    footer = book.footer(F.lit(author), F.col("number").cast("string"), F.lit(title), width)
    lines_ = filler.join(own, ["book", "number", "place"], "left").join(heads.select("book", "number", path.alias("path")), ["book", "number"])
    text = F.when(F.col("place") == page_lines + 2, footer).otherwise(F.coalesce("text", F.lit("")))
    stored = lines_.select("book", "number", "path", F.col("place").alias("line_no"), lines.cleaned(text, "book").alias("text"))
    last = F.col("line_no") == page_lines + 2
    own = F.get(tokens.line_kinds(F.col("text"), "prose"), F.lit(0))
    kinds = F.when(last, F.transform(own, lambda r: F.struct(r["n"].alias("n"), F.when(r["kind"] == tokens.SPACE, r["kind"]).otherwise(tokens.COMMENT).alias("kind")))).otherwise(own)
    return stored.select("book", "number", "path", "line_no", "text", F.when(last, tokens.COMMENT).alias("kind"), kinds.alias("kinds"))


def by_file(frame: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows dealt to ranges of a key and sorted there. Dealing samples its input, so it is done before what is costly, not after."""
    return frame.repartitionByRange(key).sortWithinPartitions(key)


def save(frames: dict[str, DataFrame], path: str, compression: str = "zstd", dealt: bool = False) -> None:
    """Writes tables as Parquet, clustered by file so that a view reads few row groups; dealt: they are made from files that were dealt
    by ``by_file``. Python workers get no more than BATCH_ROWS rows at once."""
    for name, frame in frames.items():
        key = next((c for c in ("file_id", "path", "status") if c in frame.columns), None)
        rows = int(frame.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        with settings(frame.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows if 0 < rows < BATCH_ROWS else BATCH_ROWS)):
            (by_file(frame, key) if key and not dealt else frame).write.mode("overwrite").option("compression", compression).parquet(f"{path}/{name}")


def complete(spark: SparkSession, path: str, names: Sequence[str] = TABLES) -> bool:
    """Are all tables of an index there?"""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return all(store.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")) for n in names)


def load(spark: SparkSession, path: str, names: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    """The tables of a stored index; an incomplete one is an error."""
    if not complete(spark, path, names):
        raise FileNotFoundError(f"{path} has not all of {', '.join(names)}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
