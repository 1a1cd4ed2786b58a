import random

import pytest

#: Columns whose names operators use themselves: they must not matter.
CLASH = "row long, n long, keys string, score double, kept boolean, name string, at int, fp string, `__row` string, `__h` string, size string, target string, doc string, plan string, k string, h string, copy string, `a.b` string"
CLASHING = (7, 7, "k", 0.5, False, "x", 1, "f", "r", "h", "s", "t", "doc", "plan", "kk", "hh", "copy", "dot")


def unharmed(df):
    """All columns of the fixture are there with their values."""
    names = [c.strip().split(" ")[0].strip("`") for c in CLASH.split(",")]
    assert df.columns[-len(names) :] == names
    rows = df.select(*(f"`{c}`" for c in names)).distinct().collect()
    return all(tuple(r) == CLASHING for r in rows)


@pytest.fixture(scope="session")
def make(spark):
    """documents (doc_id, text, lang, source, n_chars) with clashing columns, from (doc_id, text, source) rows."""

    def build(rows, clash=True, slices=3):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        data = [(i, t, None, s, None if t is None else len(t)) for i, t, s in rows]
        extra = [CLASHING] if clash else [()]
        return spark.createDataFrame([(*r, *extra[0]) for r in data], schema + (", " + CLASH if clash else "")).repartition(slices)

    return build


@pytest.fixture(scope="session")
def stored(make, tmp_path_factory):
    """The same, written to Parquet and read again."""
    base = tmp_path_factory.mktemp("stored")
    count = iter(range(10_000))

    def build(rows, **kw):
        path = str(base / str(next(count)))
        df = make(rows, **kw)
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)

    return build


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
    return [
        (1, "Alpha beta gamma", "a"), (1, "Alpha beta gamma", "a"), (2, "Alpha  beta\tgamma", "b"), (3, None, "a"), (4, "", None), (5, " \n\t ", "b"),
        (None, "Alpha beta gamma", None), (None, None, None), (6, long, "c"), (7, long + " end", "c"), (8, "été ½ 日本 \u2003x \x1c y", "a"), (9, "!!! ### $$$", "b"), (10, "a" * 70_000, "b"),
    ]


@pytest.fixture(scope="session")
def prose():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeinorst") for _ in range(r.randint(2, 9))) for _ in range(3000)]

    def text(n, seed):
        q = random.Random(seed)
        return " ".join(q.choice(words) for _ in range(n))

    return text
