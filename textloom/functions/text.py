"""Column functions over text: normalisation, measures, formatting. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAB, MAX_COLUMNS = 4, 4096
MAX_BYTES, SNIFF = 4 << 20, 8192

#: Respellings of characters outside the book charset, then the 27 extras of Windows-1252 (fixed values).
RESPELL_FROM, RESPELL_TO = " ‐‑−′″ſ", " ---'\"s"
CP1252_EXTRAS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def newlines(text: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def tab_stops(line: Column, stop: int = TAB) -> Column:
    """Tabs of one line widened to the next tab stop."""

    def step(done: Column, part: Column) -> Column:
        return F.when(done.isNull(), part).otherwise(F.concat(F.rpad(done, (F.floor(F.length(done) / stop) + 1).cast("int") * stop, " "), part))

    folded = F.aggregate(F.split(line, "\t", -1), F.lit(None).cast("string"), step)
    return F.when(F.instr(line, "\t") > 0, folded).otherwise(line)


def ascii_fold(text: Column) -> Column:
    """Each code point outside ASCII becomes one question mark."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def control_fold(text: Column) -> Column:
    """Control characters but LF become question marks."""
    return F.regexp_replace(text, r"[\x00-\x09\x0B-\x1F\x7F]", "?")


def code_charset(text: Column) -> Column:
    """``control_fold`` of ``ascii_fold`` in one pass: two patterns side by side take several times as long as one."""
    return F.regexp_replace(text, r"[^\x0A\x20-\x7E]", "?")


def book_charset(text: Column) -> Column:
    """Composed text in Windows-1252: a few respellings, anything else a question mark.

    A replacement for each respelling looks for bytes, where translate would look every character up; and ASCII characters leave the
    pattern at its first range.
    """
    for a, b in zip(RESPELL_FROM, RESPELL_TO, strict=True):
        text = F.replace(text, F.lit(a), F.lit(b)) if a != b else text
    return F.regexp_replace(text, rf"[[^\x00-\x7F]&&[^\u00A0-ÿ{CP1252_EXTRAS}]]", "?")


def line_array(text: Column) -> Column:
    """Lines parted by LF; a last empty one doesn't count."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def stored_line(line: Column) -> Column:
    """Trailing spaces gone, then cut at MAX_COLUMNS."""
    return F.substring(F.rtrim(line), 1, MAX_COLUMNS)


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


def nonspace(line: Column) -> Column:
    return F.length(F.replace(line, F.lit(" "), F.lit("")))


def replaced_share(text: Column) -> Column:
    """Share of replacement characters in decoded text."""
    return (F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))) / F.greatest(F.length(text), F.lit(1))


def is_binary(content: Column) -> Column:
    """A NUL in the first SNIFF bytes, or over 1 % replacement characters."""
    return (F.position(F.lit(b"\x00"), F.substring(content, 1, SNIFF)) > 0) | (replaced_share(decoded(content)) > 0.01)


def decoded(content: Column) -> Column:
    """UTF-8 with replacement characters for malformed bytes."""
    return F.make_valid_utf8(content.cast("string"))


def short_path(path: Column, width: int) -> Column:
    """The path's tail with an ellipsis in front, if it is longer than width."""
    return F.when(F.length(path) > width, F.concat(F.lit("…"), F.right(path, F.lit(width - 1)))).otherwise(path)


def hit_window(line: Column, col: Column, size: Column, chars: int) -> Column:
    """The line as a result row shows it: from its indent on, or from eight columns before a hit that would not fit."""
    lead = indent(line)
    at = F.when(col - lead + size > chars, F.greatest(col - 8, F.lit(0))).otherwise(lead)
    return F.substring(line, (at + 1).cast("int"), F.lit(chars))


def heading_title(heading: Column) -> Column:
    """Words capitalised; the numeral of a chapter stays."""
    words = F.split(F.trim(F.regexp_replace(heading, r"\s+", " ")), " ")
    first = F.initcap(F.lower(F.element_at(words, 1)))
    chapter = F.concat_ws(" ", F.array(first), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))
    return F.when(heading.rlike(CHAPTER), chapter).otherwise(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), " "))


#: Headings that open a part and a chapter of a book, and the markers around its body (fixed patterns).
PART = r"^(?:(?:BOOK|PART|VOLUME)\s+[A-Z0-9]+\b|(?:FIRST|SECOND|THIRD)\s+EPILOGUE\b|EPILOGUE\b|PROLOGUE\b)(.*)$"
CHAPTER = r"^CHAPTER\s+[IVXLCDM0-9]+\.?\s*$"
BODY_START, BODY_END = r"^\*\*\* ?START OF", r"^\*\*\* ?END OF"


def aspect(text: Column) -> Column:
    """W:H or a number."""
    parts = F.split(text, ":")
    return F.when(F.size(parts) == 2, parts[0].cast("double") / parts[1].cast("double")).otherwise(text.cast("double"))


def channel(hex_colour: Column, k: int) -> Column:
    """Red, green or blue (k = 0, 1, 2) of rrggbb, in 0 to 1."""
    return F.conv(F.substring(F.ltrim(hex_colour, F.lit("#")), 2 * k + 1, 2), 16, 10).cast("int") / 255.0


def blend(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def quantised(v: Column) -> Column:
    """16-bit fixed point over -0.5 to 1.5, half to even."""
    return F.bround(F.least(F.greatest((v + 0.5) / 2, F.lit(0.0)), F.lit(1.0)) * 65535).cast("long")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def filled(parts: Column, width: int, gap: str) -> Column:
    """Parts joined by gap into rows of at most width characters, each row as full as it gets (greedy)."""

    def step(rows: Column, part: Column) -> Column:
        last = F.try_element_at(rows, F.lit(-1))
        fits = (F.size(rows) > 0) & (F.length(last) + len(gap) + F.length(part) <= width)
        return F.when(fits, F.concat(F.slice(rows, 1, F.size(rows) - 1), F.array(F.concat(last, F.lit(gap), part)))).otherwise(F.concat(rows, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def hue_rgb(hue: Column, count: int = 12, saturation: float = 0.55, value: float = 0.9) -> tuple[Column, Column, Column]:
    """Red, green and blue (0 to 255) of a place on the colour circle of count hues."""

    def channel(offset: int) -> Column:
        k = (F.lit(float(offset)) + hue % count * (6.0 / count)) % 6
        return F.floor(255 * (value * (1 - saturation * F.greatest(F.lit(0.0), F.least(F.lit(1.0), k, 4 - k)))))

    return channel(5), channel(3), channel(1)


def status(files: Column, lines: Column, chars: Column) -> Column:
    """The status line of a corpus."""
    return F.concat(thousands(files), F.lit(" files · "), thousands(lines), F.lit(" lines · "), thousands(chars), F.lit(" chars"))


def search_status(hits: Column, files: Column, current: Column) -> Column:
    """The status line of a search; current counts from 0."""
    return F.concat(thousands(hits), F.lit(" hits · "), thousands(files), F.lit(" files · "), thousands(current + 1), F.lit("/"), thousands(hits))
