"""The small rules on literal rows."""

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import book as B
from textloom.sources import trees


#: Literal inputs of the normalisation rules, and what they become.
RULES = (
    ("tabs", "\ta\tbcde\tf", "    a   bcde    f"),
    ("crlf", "a\r\nb\rc", "a\nb\nc"),
    ("folds", "é\x01", "??"),
    ("pair", "日本", "??"),
    ("trail", "ab   ", "ab"),
    ("cap", "x" * 5000, "x" * 4096),
    ("strip then cap", "y" * 4095 + " " * 50, "y" * 4095),
)


def test_normalisation(spark):
    rows = spark.createDataFrame([(n, i) for n, i, _ in RULES], "rule string, text string")
    one = F.transform(T.line_array(T.newlines(F.col("text"))), lambda line: T.stored_line(T.control_fold(T.ascii_fold(T.tab_stops(line)))))
    assert {r.rule: r.text for r in rows.select("rule", F.array_join(one, "\n").alias("text")).collect()} == {n: out for n, _, out in RULES}


PATHS = (
    ("a/x.rs", "", "rust", "rust"), ("b/Makefile", "", "text", "text-hash"), (".gitignore", "", "text", "text"), ("x.gitignore", "", "text", "text-hash"),
    ("bin/run", "#!/bin/sh", "shell", "shell"), ("bin/tool", "#!/usr/bin/env python3", "python", "python"), ("m.MD", "", "text", "text-xml"),
    ("s.tar.scss", "", "text", "text-css"), ("q.proto", "", "text", "text-slash"), ("w.GLSL", "", "clike", "clike"), ("note", "", "text", "text"), ("v.pyi", "#!/bin/sh", "python", "python"),
)


def test_languages(spark):
    rows = spark.createDataFrame([(p, h) for p, h, _, _ in PATHS], "path string, head string")
    assert {(r.path, r.lang, r.variant) for r in trees.with_language(rows).collect()} == {(p, lang, v) for p, _, lang, v in PATHS}


def test_colours(spark):
    rows = spark.createDataFrame([("#ff8000", "3:2"), ("102030", "1.5")], "hex string, aspect string")
    got = rows.select(*(F.round(T.channel(F.col("hex"), k) * 255) for k in range(3)), T.aspect(F.col("aspect"))).collect()
    assert [tuple(r) for r in got] == [(255, 128, 0, 1.5), (16, 32, 48, 1.5)]


def test_hues(spark):
    import colorsys

    got = spark.range(15).select("id", *(c.alias(n) for c, n in zip(T.hue_rgb(F.col("id")), "rgb", strict=True))).collect()
    for r in got:
        assert (r.r, r.g, r.b) == tuple(int(c * 255) for c in colorsys.hsv_to_rgb(r.id % 12 / 12, 0.55, 0.9))


HEADINGS = (("BOOK ONE: 1805", "Book One: 1805"), ("CHAPTER XII", "Chapter XII"), ("FIRST EPILOGUE: 1813 - 20", "First Epilogue: 1813 - 20"), ("chapter of odds", "Chapter Of Odds"))


def test_titles(spark):
    rows = spark.createDataFrame([(h,) for h, _ in HEADINGS], "heading string")
    assert dict(map(tuple, rows.select("heading", T.heading_title(F.col("heading"))).collect())) == dict(HEADINGS)


CHARSET = (("e\u0301te\u0301", "été"), ("“quoted” – …", "“quoted” – …"), ("a‐b−c ′″ ſ x", "a-b-c '\" s x"), ("日本 Ж", "?? ?"), ("plain", "plain"))


def test_book_charset(spark):
    rows = spark.createDataFrame([(k, 0, t) for k, (t, _) in enumerate(CHARSET)], "book long, line_no long, text string")
    assert dict(map(tuple, B.composed(rows).select("book", T.book_charset(F.col("text"))).collect())) == {k: out for k, (_, out) in enumerate(CHARSET)}


def test_sources_below_one_folder(tmp_path):
    one, two = tmp_path / "a" / "x", tmp_path / "a" / "y" / "z"
    assert trees.rooted([str(one), str(two), str(one)]) == (str(tmp_path / "a"), ["x", "y/z"])
    assert trees.rooted([str(one)]) == (str(one), [""])


def test_what_is_left_out_is_counted(tmp_path):
    for n in ("a.py", "node_modules/b.js", "keep/c.rs", "inner/d.c"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    (tmp_path / "link").symlink_to(tmp_path / "a.py")
    assert trees.survey(str(tmp_path), git=False, exclude=["*.rs"]) == (["a.py", "inner/d.c"], {"link": 1, "excluded": 1})


def test_headings_and_charset_in_one_pass(spark, small):
    """A heading is made once, not again for the test whether there is one; no character of a book is looked up in a table."""
    from textloom import plans

    plan = lambda name: plans.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("b_titles").count("[^A-Za-z ]") == 1
    assert "translate(" not in plan("p_book_charset")
