"""Whole-word search, hit reports, path jumps."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import tokens
from textloom.operators.lines import running
from textloom.session import cut

_EDGE = "[A-Za-z0-9_]"


def word_pattern(word: str) -> str:
    """The word with ASCII word boundaries: letters outside ASCII are no word characters."""

    def edge(c: str, back: bool) -> str:
        inside = bool(re.fullmatch(_EDGE, c))
        return f"(?{'<' if back else ''}{'!' if inside else '='}{_EDGE})"

    return f"{edge(word[0], True)}{re.escape(word)}{edge(word[-1], False)}"


def hit_columns(line: Column, word: str) -> Column:
    """Array of the columns at which a line has the word."""
    between = F.split(line, word_pattern(word), -1)
    sizes = F.transform(F.slice(between, 1, F.size(between) - 1), lambda p: F.length(p))
    return F.aggregate(sizes, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + len(word), F.lit(0)) + n)))


def hits(lines: DataFrame, word: str, keep: Sequence[str] = ()) -> DataFrame:
    """file_id, line_no, col of every whole-word occurrence, and columns of its line to keep. Words of under two characters filter
    nothing: no hits."""
    found = lines.where(F.col("text").contains(word)) if len(word) >= 2 else lines.where(F.lit(False))
    if len(word) < 2:
        return found.select("file_id", "line_no", F.lit(0).alias("col"), *keep)
    return found.select("file_id", "line_no", F.explode(hit_columns(F.col("text"), word)).alias("col"), *keep)


def hits_outside(files: DataFrame, word: str, spec: str, without: tuple[int, ...] = (tokens.STRING, tokens.COMMENT)) -> DataFrame:
    """Hits whose first character is in no token of the given kinds; files: file_id, text.

    Words are found in the text with the excluded tiles blanked, so no position is joined; a word that touches such a tile
    keeps its boundary because the blank has the tile's last characters' class.
    """
    blank = F.transform("tiles", lambda t: F.when(t["kind"].isin(*without), F.regexp_replace(t["text"], _EDGE, "\x01")).otherwise(t["text"]))
    # \x01 stands for a word character of a blanked tile
    inside = word_pattern(word).replace(_EDGE, r"[A-Za-z0-9_\x01]")
    lines = tokens.with_tiles(files, spec).select("file_id", F.posexplode(T.line_array(F.array_join(blank, ""))).alias("line_no", "text"))
    between = F.split("text", inside, -1)
    sizes = F.transform(F.slice(between, 1, F.size(between) - 1), lambda p: F.length(p))
    cols = F.aggregate(sizes, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + len(word), F.lit(0)) + n)))
    return lines.where(F.col("text").contains(word)).select("file_id", "line_no", F.explode(cols).alias("col"))


def hits_without(lines: DataFrame, word: str, without: tuple[int, ...] = (tokens.STRING, tokens.COMMENT)) -> DataFrame:
    """The same from lines that have their kinds beside them (an index's): hits whose first character is in none of the given
    kinds. No token is found again; a line's runs are spelt out once, and its hits look their kinds up there."""
    found = lines.where(F.col("text").contains(word)) if len(word) >= 2 else lines.where(F.lit(False))
    columns = hit_columns(F.col("text"), word) if len(word) >= 2 else F.array(F.lit(0))
    spelt = found.select("file_id", "line_no", "text", tokens.spelt(F.col("kinds")).alias("marks"))
    each = spelt.select("file_id", "line_no", "marks", F.explode(columns).alias("col"))
    own = F.substring("marks", F.col("col") + 1, F.lit(1))
    return each.where(~F.coalesce(own.isin(*map(str, without)), F.lit(False))).select("file_id", "line_no", "col")


def per_file(hits_: DataFrame) -> DataFrame:
    return hits_.groupBy("file_id").agg(F.count("*").alias("hits"))


def ranked(hits_: DataFrame) -> DataFrame:
    """Hits with their place in the report: by file, line and column."""
    inside = Window.partitionBy("file_id").orderBy("line_no", "col")
    bases = running(per_file(hits_), "file_id", "hits", "base").select("file_id", "base")
    return hits_.withColumn("k", F.row_number().over(inside) - 1).join(bases, "file_id").select("file_id", "line_no", "col", (F.col("base") + F.col("k")).alias("hit"))


def report(hits_: DataFrame, files: DataFrame, size: int, chars: int) -> DataFrame:
    """Report rows in order: a head with the number of hits, a row for each file, a row for each hit (file_id, line_no, col, text of its
    line). What a row shows is cut out of the line before hits are ranked, so no line is moved; a file's first hit is as many hits on
    as the files before it have."""
    shown = T.hit_window(F.col("text"), F.col("col"), F.lit(size), chars - 6)
    each = hits_.select("file_id", "line_no", "col", shown.alias("shown"))
    bases = cut(running(per_file(hits_), "file_id", "hits", "base").select("file_id", "hits", F.col("base").cast("long").alias("base")))
    head = bases.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("n")).select(F.lit(-1).cast("long").alias("hit"), F.lit(0).alias("level"), F.concat(F.lit("Hits ("), F.col("n").cast("string"), F.lit(")")).alias("row"))
    heads = bases.join(files.select("file_id", "path"), "file_id").select(F.col("base").alias("hit"), F.lit(1).alias("level"), T.short_path(F.col("path"), chars).alias("row"))
    inside = Window.partitionBy("file_id").orderBy("line_no", "col")
    placed = each.withColumn("k", F.row_number().over(inside) - 1).join(bases, "file_id")
    rows = placed.select((F.col("base") + F.col("k")).alias("hit"), F.lit(2).alias("level"), F.concat(F.lpad((F.col("line_no") + 1).cast("string"), 5, " "), F.lit(" "), F.col("shown")).alias("row"))
    return head.unionByName(heads).unionByName(rows)


def step(hit: Column, by: int, count: Column) -> Column:
    """The hit by places further on, around the end."""
    return F.pmod(hit + by, count)


def goto(files: DataFrame, spec: str) -> DataFrame:
    """The file a path or its tail names, and the line after the last colon (from 0); shortest path first."""
    named, _, number = spec.rpartition(":")
    wanted, line = (named, int(number) - 1) if named and number.isdigit() else (spec, 0)
    fits = (F.col("path") == wanted) | F.endswith("path", F.lit("/" + wanted))
    best = files.where(fits).orderBy(F.length("path"), "file_id").limit(1)
    return best.select("file_id", "path", F.greatest(F.least(F.lit(line).cast("long"), F.col("lines") - 1), F.lit(0)).alias("line_no"))
