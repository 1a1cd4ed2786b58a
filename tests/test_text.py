import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import lines as L
from textloom.operators import search as S
from textloom.operators import tokens as K


def values(spark, rows, column, name="x"):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string").orderBy("i").select(column).collect()]


def test_tab_stops(spark):
    texts = ["\ta\tbcde\tf", "a\t", "\t\t", "abcd\te", "plain", ""]
    assert values(spark, texts, T.tab_stops(F.col("x"))) == [t.expandtabs(4) for t in texts]


def test_line_array(spark):
    texts = ["", "\n", "a", "a\n", "a\n\n", "\na"]
    got = values(spark, texts, F.size(T.line_array(F.col("x"))))
    assert got == [0, 1, 1, 1, 2, 2]


def test_book_charset(spark):
    texts = ["été “x” —…", "日本", "a‐b", "\x7f"]
    respell = str.maketrans(dict(zip(T.RESPELL_FROM, T.RESPELL_TO, strict=True)))
    expected = [t.translate(respell).encode("cp1252", "replace").decode("cp1252") for t in texts]
    assert values(spark, texts, T.book_charset(F.col("x"))) == expected


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \t\r\né", max_size=20), min_size=1, max_size=8))
def test_lines_like_python(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "file_id int, text string")
    got = {(r.file_id, r.line_no): (r.text, r.len, r.indent, r.nonspace) for r in L.lines(frame, "ascii").collect()}
    want = {}
    for i, t in enumerate(texts):
        parts = t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if parts[-1] == "":
            parts.pop()
        for n, line in enumerate(parts):
            line = line.expandtabs(4).encode("ascii", "replace").decode().rstrip(" ")[:4096]
            want[i, n] = (line, len(line), len(line) - len(line.lstrip(" ")), len(line.replace(" ", "")))
    assert got == want


def test_running(spark):
    frame = spark.createDataFrame([(i * 3, i % 7) for i in range(500)], "k long, v long")
    got = {r.k: r.before for r in L.running(frame, "k", "v", "before", width=64).collect()}
    total = 0
    for i in range(500):
        assert got[i * 3] == total
        total += i % 7


def test_word_boundaries(spark):
    lines = spark.createDataFrame([(0, 0, "xéthe the"), (1, 0, "café cafés caf"), (2, 0, "the_ the."), (3, 0, "théthe")], "file_id int, line_no int, text string")
    at = lambda word: [(r.file_id, r.col) for r in S.hits(lines, word).orderBy("file_id", "col").collect()]
    assert at("the") == [(0, 2), (0, 6), (2, 5), (3, 3)]
    assert at("caf") == [(1, 0), (1, 5), (1, 11)]
    assert at("t") == []


def test_goto(spark):
    files = spark.createDataFrame([(0, "a/b.c", 9), (1, "a/x/b.c", 3), (2, "ab.c", 5)], "file_id int, path string, lines long")
    assert [tuple(r) for r in S.goto(files, "b.c:4").collect()] == [(0, "a/b.c", 3)]
    assert [tuple(r) for r in S.goto(files, "x/b.c:99").collect()] == [(1, "a/x/b.c", 2)]
    assert S.goto(files, "none").count() == 0


def test_numbers_and_words(spark):
    frame = spark.createDataFrame([(0, "12abc 3.14 x1 1.2.3 é9 7")], "file_id int, text string")
    got = [(r.kind, r.text) for r in K.exploded(frame, "prose").orderBy("pos").collect() if r.kind != K.SPACE]
    assert got == [(K.PUNCT, "12"), (K.IDENT, "abc"), (K.NUMBER, "3.14"), (K.IDENT, "x1"), (K.NUMBER, "1.2"), (K.PUNCT, "."), (K.NUMBER, "3"), (K.IDENT, "é9"), (K.NUMBER, "7")]


def test_runs_restart_at_lines(spark):
    frame = spark.createDataFrame([(0, "<!-- a\nb --> x!!\n\n\"s t\" y"), (1, ""), (2, "\n\n")], "file_id int, text string")
    got = {r.file_id: r.n for r in K.with_tiles(frame, "text-xml").select("file_id", K.run_count(F.col("tiles")).alias("n")).collect()}
    assert got == {0: 6, 1: 0, 2: 0}  # two comment lines, x, !!, the string, y


@pytest.mark.parametrize("spec", ["text", "text-hash", "text-xml", "text-css", "text-slash"])
def test_kinds_are_counted_as_tiles_are(spark, spec):
    """Odd texts, counted whole and tile by tile."""
    r = random.Random(spec)
    pieces = ["a1", "1a", "12", "1.5", ".", '"', "\\", "/*", "*/", "//", "<!--", "-->", "#", "\n", " ", "  ", "_", "é", "7", "x"]
    texts = ["", "1.2.3.4.5a 6.7", '/* a\n\n b */"c\\"d" "e', "/* open\n"] + ["".join(r.choices(pieces, k=r.randint(1, 40))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "file_id int, text string")
    want = {}
    for row in K.exploded(frame, spec).collect():
        n, size = want.get((row.file_id, row.kind), (0, 0))
        want[row.file_id, row.kind] = (n + 1, size + len(row.text))
    assert {(x.file_id, x.kind): (x.tokens, x.chars) for x in K.kind_counts(frame, [spec]).collect()} == want


def test_report_moves_no_lines(spark):
    """The hits of a file are sorted with what is shown of their lines, which are not joined to them again."""
    frame = spark.createDataFrame([(1, "the " + "x" * 200 + " the\nno\n  the"), (2, "no"), (3, "the")], "file_id long, text string")
    files = frame.select("file_id", F.concat(F.lit("p"), "file_id").alias("path"))
    got = S.report(S.hits(L.lines(frame), "the", ["text"]), files, 3, 60)
    rows = [r["row"] for r in got.orderBy("hit", "level").collect()]
    assert rows == ["Hits (4)", "p1", "    1 the " + "x" * 50, "    1 " + "x" * 7 + " the", "    3 the", "p3", "    1 the"]
    assert S.report(S.hits(L.lines(frame), "none", ["text"]), files, 3, 60).collect()[0]["row"] == "Hits (0)"
    joins = [j for j in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in j]
    assert len(joins) == 2 and not any("line_no" in j for j in joins)


def test_code_charset_in_one_pass(spark):
    chars = [chr(c) for c in (*range(0x300), 0x2028, 0x20AC, 0xFEFF, 0xFFFD, 0x1F600)]
    df = spark.createDataFrame([(c + "a" + c + c,) for c in chars], "t string")
    assert df.where(T.code_charset(F.col("t")) != T.control_fold(T.ascii_fold(F.col("t")))).count() == 0 and df.count() == len(chars)
    assert df.where(T.code_charset(F.col("t")) == F.col("t")).count() == 96
