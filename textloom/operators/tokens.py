"""Token runs of text files, by one tiling pattern per language.

A tiling pattern matches every character of a text, so ``regexp_extract_all`` gives the tokens in order with no gap. What a
tile is follows from its text and the tile after it. No token is ever moved: a file's tiles are an array of its row, and only
what a query asks for is exploded. Languages with state across tokens are in ``code``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token kinds and item kinds (fixed values).
KINDS = ("space", "ident", "keyword", "type", "string", "comment", "number", "punct", "macro", "call")
SPACE, IDENT, KEYWORD, TYPE, STRING, COMMENT, NUMBER, PUNCT, MACRO, CALL = range(10)

_STRING = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'  # possessive, so that long strings need no stack
_NUMBER = r"(?<![A-Za-z0-9_])[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9_])"
_COMMENTS = {"text": None, "prose": None, "text-hash": r"#[^\n]*", "text-xml": r"<!--[\s\S]*?-->", "text-css": r"/\*[\s\S]*?\*/", "text-slash": r"//[^\n]*|/\*[\s\S]*?\*/|/\*[\s\S]*"}
_WORDS = {"prose": r"[A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*"}
_WORD = r"[A-Za-z_][A-Za-z0-9_]*"


def tiling(spec: str) -> str:
    """The pattern of a text variant: comment, string, number, word, then spaces, line feed and any character."""
    alternatives = [_COMMENTS[spec], None if spec == "prose" else _STRING, _NUMBER, _WORDS.get(spec, _WORD), r"[0-9]+", " +", "\n", r"[\s\S]"]
    return "|".join(a for a in alternatives if a)


def kind(tile: Column, following: Column, spec: str) -> Column:
    """The kind of a tile; digits that a letter follows are no number."""
    out = F.when(tile.rlike("^ *$") | (tile == "\n"), SPACE)
    if _COMMENTS[spec]:
        starts = {"text-hash": tile.startswith("#"), "text-xml": tile.startswith("<!--"), "text-css": (F.length(tile) > 1) & tile.startswith("/*"), "text-slash": (F.length(tile) > 1) & (tile.startswith("//") | tile.startswith("/*"))}
        out = out.when(starts[spec], COMMENT)
    if spec != "prose":
        out = out.when((F.length(tile) > 1) & tile.startswith('"'), STRING)
    out = out.when(tile.rlike("^[0-9]") & ~F.coalesce(following, F.lit("")).rlike("^[A-Za-z_]"), NUMBER)
    return out.when(tile.rlike("^" + _WORDS.get(spec, _WORD)), IDENT).otherwise(PUNCT)


def with_tiles(files: DataFrame, spec: str) -> DataFrame:
    """files (file_id, text) with tiles, an array of (kind, text); a token of several lines is cut at its line feeds."""
    found = F.regexp_extract_all("text", F.lit(tiling(spec)), F.lit(0))
    cut = files.withColumn("__found", found)
    kinds = F.transform("__found", lambda t, i: F.struct(kind(t, F.get("__found", i + 1), spec).alias("kind"), t.alias("text")))
    parts = F.transform("__kinds", lambda k: F.when((F.instr(k["text"], "\n") > 0) & (F.length(k["text"]) > 1), F.transform(F.regexp_extract_all(k["text"], F.lit(r"[^\n]+|\n"), F.lit(0)), lambda part: F.struct(F.when(part == "\n", SPACE).otherwise(k["kind"]).alias("kind"), part.alias("text")))).otherwise(F.array(k)))
    return cut.withColumn("__kinds", kinds).withColumn("tiles", F.flatten(parts)).drop("__found", "__kinds")


def line_kinds(text: Column, spec: str) -> Column:
    """Of each line of a text (parted at line feeds), the runs of one kind that it is made of: an array of (n, kind) for each line,
    which cover it. Runs of prose, markup and the like; nothing is exploded."""
    found = F.regexp_extract_all(text, F.lit(tiling(spec)), F.lit(0))
    following = F.concat(F.slice(found, 2, 1 << 30), F.array(F.lit("")))
    marks = F.zip_with(found, following, lambda t, f: F.when(t.contains("\n"), F.array_join(F.transform(F.split(t, "\n", -1), lambda part: F.repeat(kind(t, f, spec).cast("string"), F.length(part))), "\n")).otherwise(F.repeat(kind(t, f, spec).cast("string"), F.length(t))))
    return F.transform(F.split(F.array_join(marks, ""), "\n", -1), _counted)


def _counted(marks: Column) -> Column:
    """A line's kinds, one digit a character, as runs (n, kind)."""
    return F.transform(F.regexp_extract_all(marks, F.lit(r"(.)\1*+"), F.lit(0)), lambda r: F.struct(F.length(r).alias("n"), F.substring(r, 1, 1).cast("int").alias("kind")))


def kind_at(kinds: Column, col: Column) -> Column:
    """The kind of a line's character, by its runs; null behind them."""
    start = F.struct(F.lit(0).alias("past"), F.lit(None).cast("int").alias("kind"))
    step = lambda at, r: F.when(at["past"] > col, at).otherwise(F.struct((at["past"] + r["n"]).alias("past"), r["kind"].alias("kind")))
    return F.aggregate(kinds, start, step, lambda at: F.when(at["past"] > col, at["kind"]))


def spelt(kinds: Column) -> Column:
    """A line's runs as its characters' kinds, one digit a character."""
    return F.array_join(F.transform(kinds, lambda r: F.repeat(r["kind"].cast("string"), r["n"])), "")


def exploded(files: DataFrame, spec: str) -> DataFrame:
    """file_id, pos, kind, text of every tile."""
    return with_tiles(files, spec).select("file_id", F.posexplode("tiles").alias("pos", "tile")).select("file_id", "pos", "tile.kind", "tile.text")


def run_count(tiles_: Column) -> Column:
    """How many runs of one kind other than space; adjacent tiles of a kind are one run, a line feed parts them."""
    kinds = F.transform(tiles_, lambda t: t["kind"])
    starts = F.zip_with(kinds, F.concat(F.array(F.lit(SPACE)), kinds), lambda k, before: F.when((k != SPACE) & (k != before), 1).otherwise(0))
    return F.aggregate(starts, F.lit(0), lambda n, one: n + F.coalesce(one, F.lit(0)))


#: Prose by whole matches: a number, a word, a run of anything else that is not white. Digits before a letter are in the last.
_LETTERS = r"A-Za-z_\x{80}-\x{10FFFF}"
PROSE_NUMBER = rf"(?<![0-9{_LETTERS}])[0-9]++(?:\.[0-9]++)?+(?![A-Za-z0-9_])|(?<![0-9{_LETTERS}])[0-9]++(?![A-Za-z0-9_])"
PROSE_WORD = _WORDS["prose"]
PROSE_DIGITS = rf"(?<![0-9{_LETTERS}])[0-9]++(?=[A-Za-z_])"


def prose_runs(text: Column) -> Column:
    """``run_count`` of a prose text, by one pass over its characters: every match of the pattern is a run."""
    return F.regexp_count(text, F.lit(rf"{PROSE_NUMBER}|{PROSE_WORD}|(?:[^0-9{_LETTERS} \n]++|{PROSE_DIGITS})++"))


def prose_counts(files: DataFrame) -> DataFrame:
    """file_id, kind, tokens, chars of prose (file_id, text), for the kinds that a text has. Nothing is taken apart but words and
    numbers: what is left is punctuation."""
    found = {name: F.regexp_extract_all("text", F.lit(pattern), F.lit(0)) for name, pattern in (("words", PROSE_WORD), ("numbers", PROSE_NUMBER), ("digits", PROSE_DIGITS))}
    # a column for each pass: as one expression the passes would be made for every use
    rows = files.select("file_id", F.length("text").cast("long").alias("all"), *(a.alias(n) for n, a in found.items()), F.regexp_count("text", F.lit(" +")).alias("gaps"), *((F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("long").alias(n) for c, n in ((" ", "spaces"), ("\n", "feeds"))))
    rows = rows.select("file_id", "all", "gaps", "spaces", "feeds", *(x for n in found for x in (F.size(n).cast("long").alias(n), F.length(F.array_join(n, "")).cast("long").alias(f"{n}_chars"))))
    rest = F.col("all") - F.col("spaces") - F.col("feeds") - F.col("words_chars") - F.col("numbers_chars")
    rows = rows.withColumn("rest", rest)
    counts = ((SPACE, F.col("gaps") + F.col("feeds"), F.col("spaces") + F.col("feeds")), (IDENT, F.col("words"), F.col("words_chars")), (NUMBER, F.col("numbers"), F.col("numbers_chars")), (PUNCT, F.col("rest") - F.col("digits_chars") + F.col("digits"), F.col("rest")))
    each = F.array(*(F.struct(F.lit(k).alias("kind"), n.cast("long").alias("tokens"), c.cast("long").alias("chars")) for k, n, c in counts))
    return rows.select("file_id", F.inline(each)).where("tokens > 0")


#: Classes of characters: letters, digits, spaces, line feeds; then those inside strings and comments. The last of the table is all others.
_OTHER, _LETTER, _DIGIT, _BLANK, _FEED, _QUOTED, _NOTED = range(7)
_CLASSES = np.array([_LETTER if chr(c).isalpha() or c == 95 else _DIGIT if chr(c).isdigit() else _BLANK if c == 32 else _FEED if c == 10 else _OTHER for c in range(128)] + [_OTHER], np.uint8)


@lru_cache(maxsize=None)
def _enclosed(spec: str) -> re.Pattern:
    """Comments (a group) and strings of a variant; no other tile has a character that one of them begins with inside it."""
    return re.compile("|".join(p for p in (_COMMENTS[spec] and f"({_COMMENTS[spec]})", _STRING) if p))


def _classes(texts: Sequence[str], spec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of texts, a line feed behind each text, their classes, and where comments and strings begin, which a pattern finds."""
    chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _CLASSES[np.minimum(chars, 128)]
    found, at = [], 0
    for t in texts:
        found += [(at + m.start(), at + m.end(), _QUOTED if m.lastindex is None else _NOTED) for m in _enclosed(spec).finditer(t)]
        at += len(t) + 1
    first, past, kind = np.array(found, np.int64).reshape(-1, 3).T
    size = past - first
    inside = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    kinds[inside] = np.where(chars[inside] == 10, _FEED, np.repeat(kind, size))
    return chars, kinds, first


def _words(chars: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """begin, end of the runs of letters and digits, the digits that each begins with, and of those without letters which are one number
    with the next, behind a dot. Digits that letters follow are no number."""
    word = np.append((kinds == _LETTER) | (kinds == _DIGIT), False)
    turns = np.flatnonzero(np.diff(word, prepend=False))
    begin, end = turns[::2], turns[1::2]
    letters = np.append(np.flatnonzero(kinds == _LETTER), len(chars))
    lead = np.minimum(letters[np.searchsorted(letters, begin)], end) - begin
    number = lead == end - begin
    low, high = begin[number], end[number]
    dotted = np.append((low[1:] == high[:-1] + 1) & (chars[high[:-1]] == 46) & (kinds[high[:-1]] == _OTHER), False)[: len(low)]
    place = np.arange(len(low))
    joined = dotted & ((place - np.maximum.accumulate(np.where(np.append(True, ~dotted)[: len(low)], place, 0))) % 2 == 0)
    return begin, end, lead, joined


_KIND_OF = np.array([PUNCT, IDENT, IDENT, SPACE, SPACE, STRING, COMMENT], np.uint8)  # by class
_PROSE = re.compile(rf"({PROSE_NUMBER})|{PROSE_WORD}".replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010FFFF"))


def kernel_kinds(texts: Sequence[str], spec: str) -> np.ndarray:
    """The kind of each character of texts under a variant, as ``tiling`` parts them; line feeds, one of which is behind each text, are space."""
    if spec == "prose":
        return _prose_kinds(texts)
    chars, classes, _ = _classes(texts, spec)
    begin, end, lead, joined = _words(chars, classes)
    out = _KIND_OF[classes]
    number = lead == end - begin
    inside = np.repeat(begin - np.cumsum(lead) + lead, lead) + np.arange(lead.sum())
    out[inside] = np.repeat(np.where(number, np.uint8(NUMBER), np.uint8(PUNCT)), lead)
    out[end[number][joined]] = NUMBER
    return out


def _prose_kinds(texts: Sequence[str]) -> np.ndarray:
    text = "\n".join([*texts, ""])
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((chars == 10) | (chars == 32), np.uint8(SPACE), np.uint8(PUNCT))
    for m in _PROSE.finditer(text):
        out[m.start() : m.end()] = IDENT if m.lastindex is None else NUMBER
    return out


def kernel_counts(texts: Sequence[str], spec: str) -> tuple[np.ndarray, np.ndarray]:
    """Tiles and characters of each text by kind (as columns), of a variant with words of ASCII letters, as ``tiling`` parts them.

    A line feed, not counted, parts texts. See ``_classes`` and ``_words``.
    """
    begins = np.append(0, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))
    chars, kinds, first = _classes(texts, spec)
    new = np.append(True, kinds[1:] != kinds[:-1])
    new[first] = True

    def of(mask: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(mask))
        return upto[begins[1:]] - upto[begins[:-1]]

    def at(places: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(np.searchsorted(begins, places, "right") - 1, sizes, len(texts)).astype(np.int64)

    begin, end, lead, joined = _words(chars, kinds)
    number = lead == end - begin
    low, high = begin[number], end[number]
    mixed, named = (lead > 0) & ~number, ~number
    tokens, sizes = np.zeros((2, len(texts), len(KINDS)), np.int64)
    tokens[:, SPACE], sizes[:, SPACE] = of(new & (kinds == _BLANK)) + of(kinds == _FEED) - 1, of((kinds == _BLANK) | (kinds == _FEED)) - 1
    tokens[:, IDENT], sizes[:, IDENT] = at(begin[named]), at(begin[named], (end - begin - lead)[named])
    tokens[:, NUMBER], sizes[:, NUMBER] = at(low) - at(low[joined]), at(low, high - low) + at(low[joined])
    tokens[:, PUNCT], sizes[:, PUNCT] = (of(kinds == _OTHER) - at(low[joined]) + x for x in (at(begin[mixed]), at(begin[mixed], lead[mixed])))
    for name, c in ((STRING, _QUOTED), (COMMENT, _NOTED)):
        tokens[:, name], sizes[:, name] = of(new & (kinds == c)), of(kinds == c)
    return tokens, sizes


def kind_counts(files: DataFrame, specs: Sequence[str]) -> DataFrame:
    """file_id, spec, kind, tokens, chars of texts (file_id, text) under variants other than prose, for the kinds that a text has; tokens
    of several lines are cut at their line feeds. No tile is made: a text's are counted where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for spec in specs if texts else ():
                counts, sizes = kernel_counts(texts, spec)
                file, kind = np.nonzero(counts)
                yield pa.record_batch([batch.column(0).take(pa.array(file)), pa.array([spec] * len(file), pa.string()), pa.array(kind, pa.int32()), pa.array(counts[file, kind]), pa.array(sizes[file, kind])], names=["file_id", "spec", "kind", "tokens", "chars"])

    key = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "text").mapInArrow(run, f"file_id {key}, spec string, kind int, tokens long, chars long")
