import random

from pyspark.sql import functions as F

from helpers import SAMPLES
from textloom.operators import index, lines
from textloom.operators import proportional as P
from textloom.sources import trees
from textloom.streaming import hits


def test_code_index_round_trip(spark, tmp_path):
    src = tmp_path / "src"
    names = {"one.py": SAMPLES[0][2], "lib/two.rs": SAMPLES[1][2], "lib/three.c": SAMPLES[2][2], "lib/z.bin": "\0", "note.txt": ""}
    for n, text in names.items():
        (src / n).parent.mkdir(parents=True, exist_ok=True)
        (src / n).write_text(text)
    found = trees.discover(str(src), git=False)
    made = index.code_index(trees.read(spark, str(src), found))
    assert {r.status: r.n for r in made["skipped"].collect()} == {"binary": 1}
    files = {r.path: r for r in made["files"].collect()}
    assert [files[p].file_id for p in ("note.txt", "one.py", "lib/three.c", "lib/two.rs")] == [0, 1, 2, 3]
    assert files["note.txt"].lines == 0 and files["one.py"].lines == 13
    assert {r.name for r in made["items"].collect()} == {"one", "Two", "three", "area", "P", "Shape for P", "side", "S", "main"}
    out = str(tmp_path / "index")
    assert not index.complete(spark, out)
    index.save({k: made[k] for k in index.TABLES}, out)
    back = index.load(spark, out)
    assert sorted(map(tuple, back["lines"].select("file_id", "line_no", "text").collect())) == sorted(map(tuple, made["lines"].select("file_id", "line_no", "text").collect()))
    boxes = index.layout_of(back["files"].select("file_id", "path", F.col("nonspace").cast("double").alias("weight"), F.col("lines").cast("long").alias("lines")), back["lines"])
    assert boxes.count() == 4 and boxes.where("pitch <= 0").count() == 0


def test_book_index(spark):
    text = ["PROLOGUE", "", "CHAPTER I", "It begins.", "", "BOOK ONE: 1805", "CHAPTER I", *(f"line {i}" for i in range(12)), "CHAPTER II", "The end."]
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(text)], "book long, line_no long, text string")
    pages = index.book_index(rows, page_lines=10, width=30.0, author="A", title="T")
    by = {}
    for r in pages.orderBy("number", "line_no").collect():
        by.setdefault((r.number, r.path), []).append(r.text)
    assert [p for _, p in by] == ["Prologue/Chapter I/p. 1", "Book One: 1805/Chapter I/p. 2", "Book One: 1805/Chapter I/p. 3", "Book One: 1805/Chapter II/p. 4"]
    assert all(len(v) == 13 and v[-1].startswith("A ") and v[-1].endswith(" T") for v in by.values())
    first = by[1, "Prologue/Chapter I/p. 1"]
    assert first[0] == "PROLOGUE" and first[2].strip() == "CHAPTER I" and first[2].startswith("     ")
    assert pages.where("kind IS NOT NULL").count() == 4


def test_wrap_by_width(spark):
    adv = P.advances()
    texts = ["", "short", "WWWWWWWWWW iiiiiiiiii " * 5, "x" * 200]
    rows = spark.createDataFrame([(0, i, t, 12.0) for i, t in enumerate(texts)], "file_id int, line_no int, text string, cap double")
    got = {}
    for r in P.wrapped(rows, adv, 1.0).orderBy("line_no", "row_in_line").collect():
        got.setdefault(r.line_no, []).append((r.col0, r.row_len))
    for i, t in enumerate(texts):
        cols, start, room, acc = [0], 0, 12.0, 0.0
        if sum(adv[c] for c in t) > 12.0:
            for j, c in enumerate(t):
                if acc + adv[c] > room + 1e-9 and j > start:
                    cols.append(j)
                    start, acc, room = j, 0.0, 11.0
                acc += adv[c]
        ends = [*cols[1:], len(t)]
        assert got[i] == [(a, b - a) for a, b in zip(cols, ends, strict=True)]


def test_justified(spark):
    adv = P.advances()
    rows = spark.createDataFrame([("ab cd ef", True), ("ab cd ef", False), ("abcdef", True)], "row_text string, stretch boolean").withColumn("widths", P.char_widths(F.col("row_text"), adv))
    got = P.justified(rows, F.lit(4.5), adv).collect()
    assert abs(got[0].row_width - 4.5) < 1e-9 and abs(got[0].char_x[-1] + adv["f"] - 4.5) < 1e-9
    assert got[1].add == 0 and got[2].add == 0
    plain = P.positions(F.col("widths"))
    assert [round(x, 6) for x in rows.select(plain.alias("x")).collect()[2].x] == [round(sum(adv[c] for c in "abcdef"[:i]), 6) for i in range(6)]


def test_rows_by_kernels(spark):
    """Rows and places of characters as the SQL adds them up: the advances before, in order, and then the spaces' share."""
    adv, rng = P.advances(), random.Random(5)
    texts = ["", "W", "é日" * 40, None, *("".join(rng.choice("iW a.日") for _ in range(rng.randrange(120))) for _ in range(300))]
    caps = [rng.choice((0.1, 3.0, 7.35, 12.0)) for _ in texts]
    frame = spark.createDataFrame([(0, i, t, c) for i, (t, c) in enumerate(zip(texts, caps, strict=True))], "file_id int, line_no int, text string, cap double")
    rows = P.wrapped(frame, adv, 1.0).withColumn("stretch", ~F.col("last_row"))
    done = P.justified(rows, F.when(F.col("row_in_line") == 0, F.col("cap")).otherwise(F.col("cap") - 1.0), adv)
    assert "aggregate(" not in done._jdf.queryExecution().optimizedPlan().toString()  # no fold that is interpreted for each character
    found = {}
    for r in done.orderBy("line_no", "row_in_line").collect():
        found.setdefault(r.line_no, []).append(r)
    for i, (t, cap) in enumerate(zip(texts, caps, strict=True)):
        if t is None:
            continue
        cols, acc = [0], 0.0
        if sum(adv.get(c, adv["?"]) for c in t) > cap + 1e-9:
            for j, c in enumerate(t):
                w = adv.get(c, adv["?"])
                if j and acc + w > (cap if len(cols) == 1 else cap - 1.0) + 1e-9:
                    cols.append(j)
                    acc = 0.0
                acc += w
        assert [r.col0 for r in found[i]] == cols and "".join(r.row_text for r in found[i]) == t
        for r in found[i]:
            before, x = [], 0.0
            for c in r.row_text:
                before.append(x)
                x += adv.get(c, adv["?"])
            assert r.char_x == [b + r.add * r.row_text[:k].count(" ") for k, b in enumerate(before)]
            assert r.row_width == (x if r.add == 0 else cap if r.row_in_line == 0 else cap - 1.0)


def test_letter_width():
    assert abs(P.letter_width(40, 612 / 792) - 612 / 792 * 0.85 / 0.88 * 45) < 1e-9
    assert P.ink_levels(0.14, 0.2) == (0.16, 0.2)


def test_stream_is_the_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the cat {i}\nsat on the mat" if i % 2 else "other") for i in range(20)], "file_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = hits.arriving(spark, str(tmp_path / "in"), docs.schema, 1)
    hits.append(hits.hits(stream, "the"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    from textloom.operators import search

    want = search.hits(lines.lines(docs), "the").collect()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want)) and len(want) == 20


def test_kinds_beside_lines(spark, tmp_path):
    """Runs cover every line, and give each character the kind that its token has, in all languages."""
    import numpy as np

    from textloom.operators import code, search, tokens

    texts = [*((i, lang, lang, text) for i, lang, text in SAMPLES), (9, "text", "text-xml", '<a href="the x">the <!-- the\nthe --> the</a>\n\n  9 the'), (10, "text", "text-hash", "the # the\nx\tthe"), (11, "text", "text", ""), (12, "shell", "shell", 'echo "the\nthe" the # the\n')]
    frame = spark.createDataFrame(texts, "file_id long, lang string, variant string, text string")
    rows = index.kinded_lines(index.stored_texts(frame))
    for r in rows.collect():
        assert sum(k.n for k in r.kinds) == r.len == len(r.text)
    plain = sorted(map(tuple, lines.lines(frame.select("file_id", "text"), "ascii").collect()))
    assert sorted(tuple(r)[:6] for r in rows.collect()) == plain
    by = {(r.file_id, r.line_no): r for r in rows.collect()}
    for i, lang, text in SAMPLES:
        begin, length, kind, _ = code.all_runs(text, lang)
        each = np.repeat(kind, length)
        at = 0
        for n, line in enumerate(text.rstrip("\n").split("\n")):
            got = [k.kind for k in by[i, n].kinds for _ in range(k.n)]
            assert got == each[at : at + len(line)].tolist()
            at += len(line) + 1
    index.save({"lines": rows}, str(tmp_path / "i"))
    stored = index.load(spark, str(tmp_path / "i"), ("lines",))["lines"]
    got = sorted(map(tuple, search.hits_without(stored.where("file_id >= 9"), "the").collect()))
    assert got == [(9, 0, 16), (9, 1, 8), (9, 3, 4), (10, 0, 0), (10, 1, 4), (12, 1, 5)]
    xml = frame.where("file_id = 9").select("file_id", "text")
    assert sorted(map(tuple, search.hits_outside(xml, "the", "text-xml").collect())) == [g for g in got if g[0] == 9]
    assert search.hits_without(stored, "t").count() == 0
    edge = stored.where("file_id = 9 AND line_no = 0").select(tokens.kind_at(F.col("kinds"), F.lit(10**6)).alias("k")).first()
    assert edge.k is None


def test_kinds_of_pages(spark):
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(["CHAPTER I", "It is 1805, ‘so’ — 3 men.", "naïve"])], "book long, line_no long, text string")
    pages = index.book_index(rows, page_lines=5, width=30.0, author="A B", title="T").orderBy("line_no").collect()
    for p in pages:
        assert sum(k.n for k in p.kinds) == len(p.text)
    kinds = lambda p: [(k.kind, p.text[sum(x.n for x in p.kinds[:j]) :][: k.n]) for j, k in enumerate(p.kinds)]
    assert {k for k, t in kinds(pages[-1]) if t.strip()} == {5} and {k for k, t in kinds(pages[-1]) if not t.strip()} == {0}
    told = kinds(pages[1])
    assert (1, "It") in told and (6, "1805") in told and (6, "3") in told and (7, ",") in told


def test_items_in_order(spark):
    from textloom.operators import code

    rows = [(1, 5, 9, 1, "b"), (1, 5, 7, 2, "z"), (1, 5, 7, 1, "y"), (1, 5, 7, 1, "x"), (1, 0, 20, 4, "a")]
    got = code.ordered(spark.createDataFrame(rows, "file_id long, first long, past long, kind long, name string")).orderBy("item_no").collect()
    assert [r.name for r in got] == ["a", "x", "y", "z", "b"]
    deep = "impl<" + "A<" * 12 + "B" + ">" * 12 + "> Deep for C {\n}\n"
    assert [i[3] for i in code.find_items(deep, "rust")] == ["Deep for C"]


def test_whole_atlas_as_a_flat_file(spark, tmp_path):
    """An index and its layout in one file, read back by one process: the arrays fit together as a viewer needs them."""
    import numpy as np

    from textloom.operators import atlas, code
    from textloom.operators import export as X

    src = tmp_path / "src"
    names = {"one.py": SAMPLES[0][2], "lib/two.rs": SAMPLES[1][2], "lib/deep/three.c": SAMPLES[2][2] + "int x; // " + "y" * 300, "é.txt": "", "lib/a.txt": "a\n\nb"}
    for n, text in names.items():
        (src / n).parent.mkdir(parents=True, exist_ok=True)
        (src / n).write_text(text)
    made = index.code_index(trees.read(spark, str(src), trees.discover(str(src), git=False)))
    done = index.layout_tables(made)
    laid = atlas.export(made, done, f"file://{tmp_path}/viewer.bin", "corpus", {"kinds": ["ff0000"] * 10, "ground": ["000080"]})
    a = X.unbundle((tmp_path / "viewer.bin").read_bytes())
    assert set(atlas.ARRAYS) <= set(a) == {e.name for e in laid}

    def texts(name):
        off = a[f"{name}_off"].tolist()
        return [a[name].tobytes()[i:j].decode("cp1252") for i, j in zip(off, off[1:])]

    files = sorted(made["files"].collect(), key=lambda r: r.file_id)
    assert texts("s_paths") == [f.path for f in files] and texts("s_name") == ["corpus"]
    assert texts("s_dir_labels") == ["corpus", "lib", "deep"] and a["dir_parent"].tolist() == [-1, 0, 1]
    owner = {"": 0, "lib": 1, "lib/deep": 2}
    assert a["file_dir"].tolist() == [owner[f.path.rpartition("/")[0]] for f in files]
    assert np.diff(a["file_line0"]).tolist() == [f.lines for f in files] and a["file_chars"].tolist() == [f.nonspace for f in files]
    rows = sorted(made["lines"].collect(), key=lambda r: (r.file_id, r.line_no))
    assert a["chars"].tobytes().decode() == "".join(r.text for r in rows) and len(a["kinds"]) == len(a["chars"]) == a["line_off"][-1]
    assert a["kinds"].tolist() == [k.kind for r in rows for k in r.kinds for _ in range(k.n)]
    assert a["line_len"].tolist() == [r.len for r in rows] and a["line_indent"].tolist() == [r.indent for r in rows]
    assert a["line_file"].tolist() == np.repeat(np.arange(len(files)), np.diff(a["file_line0"])).tolist()
    covered = np.zeros(len(rows), int)
    np.add.at(covered, a["row_line"], a["row_len"])
    assert covered.tolist() == a["line_len"].tolist() and np.diff(a["line_row0"]).tolist() == np.bincount(a["row_line"], minlength=len(rows)).tolist()
    of = np.repeat(np.arange(len(files)), np.diff(a["file_row0"]))
    rect = a["file_rect"][of]
    assert len(of) == len(a["row_pos"]) and ((a["row_pos"] >= rect[:, :2] - 1e-3) & (a["row_pos"] <= rect[:, 2:] + 1e-3)).all()
    assert (np.diff(a["row_line"].astype(int)) >= 0).all() and a["row_col0"][a["line_row0"][:-1]].tolist() == [0] * len(rows)
    found = sorted((f.file_id, *i) for f in files for i in code.find_items("\n".join(r.text for r in rows if r.file_id == f.file_id), f.lang))
    assert list(zip(a["item_file"].tolist(), a["item_start"].tolist(), a["item_end"].tolist(), a["item_kind"].tolist(), texts("s_item_names"), strict=True)) == found and len(texts("s_item_kws")) == len(found)
    inner = a["file_rect"][a["item_file"][a["item_rect_item"]]]
    assert set(a["item_rect_item"].tolist()) == set(range(len(found))) and (a["item_rect"][:, :2] >= inner[:, :2] - 1e-3).all() and (a["item_rect"][:, 2:] <= inner[:, 2:] + 1e-3).all()
    assert a["sc_kinds"].tolist() == [[1.0, 0.0, 0.0]] * 10 and a["world"].tolist() == [1600.0, 900.0]
    order = np.argsort(a["file_pitch"], kind="stable")
    upto = np.cumsum(np.diff(a["file_line0"])[order])
    assert a["median_pitch"][0] == a["file_pitch"][order[np.searchsorted(upto, upto[-1] / 2)]]


def book(spark, pages=23, lines_=12):
    """files and lines of a book of three parts, its last pages short; lines of all lengths, one far too long."""
    import random

    r = random.Random(6)
    files, rows = [], []
    for p in range(pages):
        files.append((p, f"{'ABC'[min(p // 8, 2)]} part/Chapter {p // 3}/p. {p + 1}"))
        for i in range(lines_ if p % 8 != 7 else 4):
            text = "" if r.random() < 0.2 and (p, i) != (5, 3) else " ".join("word"[: r.randint(1, 4)] for _ in range(60 if (p, i) == (5, 3) else r.choice((3, 8, 9, 10, 9, 9))))
            rows.append((p, i, ("   " if r.random() < 0.1 else "") + text))
    frame = spark.createDataFrame(rows, "file_id long, line_no int, text string")
    return {"files": spark.createDataFrame(files, "file_id long, path string"), "lines": lines.measured(frame)}, rows


def inside(rows, files):
    """Rows begin in their files' text blocks and no two share a place."""
    by, seen = {f.file_id: f for f in files}, set()
    for x in rows:
        f = by[x.file_id]
        assert f.tx0 - 1e-6 <= x.x <= f.tx1 and f.ty0 + f.pitch - 1e-6 <= x.y <= f.ty1 - f.pitch + 1e-6
        assert (x.file_id, round(x.x, 6), round(x.y, 6)) not in seen
        seen.add((x.file_id, round(x.x, 6), round(x.y, 6)))
        assert x.row_in_file < f.k * f.rows


def covered(rows, wanted):
    got = {}
    for x in rows:
        got[x.file_id, x.line_no] = got.get((x.file_id, x.line_no), 0) + x.row_len
    assert got == {(p, i): len(t) for p, i, t in wanted}


def test_book_on_one_grid(spark):
    made, wanted = book(spark)
    done = index.build_layout(made, "book")
    files, rows = done["files"].orderBy("file_id").collect(), done["rows"].collect()
    inside(rows, files)
    covered(rows, wanted)
    assert [r.path for r in done["dirs"].collect()] == [""] and {f.k for f in files} == {1}
    plain = [f for f in files if not any(len(t) > f.cap for p, _, t in wanted if p == f.file_id)]
    assert len({round(f.pitch, 9) for f in plain}) == 1  # short pages keep the size of full ones
    assert all((a.y0, a.x0) < (b.y0, b.x0) for a, b in zip(files, files[1:], strict=False))
    sizes = {(round(f.x1 - f.x0, 6), round(f.y1 - f.y0, 6)) for f in files}
    assert len(sizes) == 1


def test_book_in_parts(spark):
    made, wanted = book(spark)
    done = index.build_layout(made, "book", parts=True)
    files, rows = done["files"].orderBy("file_id").collect(), done["rows"].collect()
    inside(rows, files)
    covered(rows, wanted)
    dirs = {d.path: d for d in done["dirs"].collect()}
    assert list(sorted(dirs)) == ["", "A part", "B part", "C part"]
    bands = [dirs[n] for n in ("A part", "B part", "C part")]
    assert all(abs(a.y1 - b.y0) < 1e-9 for a, b in zip(bands, bands[1:], strict=False))
    for f in files:
        d = dirs[f.path.split("/")[0]]
        assert d.x0 + d.pad - 1e-9 <= f.x0 < f.x1 <= d.x1 - d.pad + 1e-9 and d.y0 + d.pad - 1e-9 <= f.y0 < f.y1 <= d.y1 - d.pad + 1e-9
    for name in ("A part", "B part", "C part"):  # rows filled from the left, in reading order
        own = [f for f in files if f.path.startswith(name)]
        assert all((round(a.y0, 6), a.x0) < (round(b.y0, 6), b.x0) for a, b in zip(own, own[1:], strict=False))


def test_book_in_a_face_of_its_own(spark):
    made, wanted = book(spark)
    adv = P.advances()
    done = index.build_layout(made, "book", advances=adv, justify=True, page_lines=14)
    files, rows = done["files"].orderBy("file_id").collect(), done["rows"].orderBy("file_id", "row_in_file").collect()
    inside(rows, files)
    covered(rows, wanted)
    by, text = {f.file_id: f for f in files}, {(p, i): t for p, i, t in wanted}
    last = {}
    for p, i, _ in wanted:
        last[p] = max(last.get(p, 0), i)
    stretched = 0
    for x in rows:
        t = text[x.file_id, x.line_no]
        part = t[x.col0 : x.col0 + x.row_len]
        width = sum(adv[c] for c in part)
        target = by[x.file_id].capw - (1.0 if x.row_in_line else 0.0)
        ends = x.col0 + x.row_len == len(t)
        follows = x.line_no == last[x.file_id] or bool(text.get((x.file_id, x.line_no + 1))) and not t.startswith(" ")
        flush = (not ends or bool(t) and follows) and " " in part and 0 < target - width < 0.35 * target
        stretched += flush
        assert abs(x.row_width - (target if flush else width)) < 1e-6 and len(x.char_x) == len(part)
        if flush:
            assert abs(x.char_x[-1] + adv[part[-1]] - target) < 1e-6
    assert stretched > 3


def test_code_in_the_same_call(spark):
    files = spark.createDataFrame([(0, "a/x", 2), (1, "b", 1)], "file_id long, path string, lines long")
    rows = lines.measured(spark.createDataFrame([(0, 0, "abc"), (0, 1, "d"), (1, 0, "e")], "file_id long, line_no int, text string"))
    none = spark.createDataFrame([], "file_id long, first long, past long, kind long, name string")
    done = index.build_layout({"files": files, "lines": rows, "items": none})
    assert done["files"].count() == 2 and done["rows"].count() == 3 and done["item_rects"].count() == 0


def test_string_closed_behind_the_cut(spark):
    from textloom.operators import search as S

    text = 'impl X {\n    fn a(&self) { let s = "' + "y" * 5000 + ' }"; }\n    fn b(&self) { let s = "z"; }\n}'
    files = spark.createDataFrame([(1, "rust", "rust", text)], "file_id long, lang string, variant string, text string")
    rows = index.kinded_lines(index.stored_texts(files, whole=True))
    assert sorted((r.line_no, r.col) for r in S.hits_without(rows, "self").collect()) == [(1, 10), (2, 10)]
    assert all(len(r.text) == sum(k.n for k in r.kinds) <= 4096 for r in rows.collect())
    short = index.kinded_lines(index.stored_texts(files.withColumn("text", F.replace("text", F.lit("y" * 5000), F.lit("y")))))
    assert sorted(tuple(r) for r in short.where("line_no <> 1").collect()) == sorted(tuple(r) for r in rows.where("line_no <> 1").collect())


def test_source_files_are_built_once(spark, small, monkeypatch):
    """An index that is written by ranges of files deals documents, not what is made of them: dealing reads its input twice."""
    from textloom.plans import sources, stored

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    monkeypatch.setattr(sources, "_plain", counted)
    rows = stored.stored_index(spark, small).where("corpus = 'code'")
    assert seen.value == spark.read.parquet(f"{small}/documents.parquet").count()
    ranges = rows.groupBy(F.input_file_name()).agg(F.min("file_id").alias("low"), F.max("file_id").alias("high")).orderBy("low").collect()
    assert all(a.high < b.low for a, b in zip(ranges, ranges[1:], strict=False))


def test_dense_lines(spark):
    """Kinds of lines of up to 4096 runs, in less time than it takes to add runs one by one to a copy of those before."""
    import time

    text = "a " * 2048 + "tail\n" + '"on" on 1.2.3 4a\n<!-- on\non -->'
    files = spark.range(400).select(F.col("id").alias("file_id"), F.lit("text").alias("lang"), F.lit("text-xml").alias("variant"), F.concat(F.lit(text), F.lit("\n"), F.col("id").cast("string")).alias("text"))
    rows = index.kinded_lines(index.stored_texts(files))
    began = time.time()
    got = rows.groupBy("line_no").agg(F.count("*").alias("n"), F.min(F.size("kinds")).alias("low"), F.max(F.size("kinds")).alias("high"), F.first("kinds").alias("kinds")).orderBy("line_no").collect()
    assert time.time() - began < 10
    assert [(r.n, r.low, r.high) for r in got] == [(400, n, n) for n in (4096, 10, 1, 1, 1)]
    assert [tuple(k) for k in got[1].kinds] == [(4, 4), (1, 0), (2, 1), (1, 0), (3, 6), (1, 7), (1, 6), (1, 0), (1, 7), (1, 1)]


def test_kinds_equal_tiles(spark):
    """The kernel's kinds are those of ``tokens.line_kinds``, which parts texts by the whole pattern, for all variants."""
    from textloom.operators import code, tokens

    rng = random.Random(7)
    parts = ["a", "_", "Z", "0", "12", ".", "1.2", "x1", " ", "  ", "\n", '"', "\\", "<!--", "-->", "/*", "*/", "//", "#", "<", "é", "日"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for spec in (*code.VARIANTS, "text"):
        want = [[tuple(k) for k in line] for r in df.select("i", tokens.line_kinds(F.col("t"), spec).alias("k")).orderBy("i").collect() for line in r.k]
        sizes, runs = code.line_runs(texts, [None] * len(texts), [spec] * len(texts), 4096)
        assert [[(k["n"], k["kind"]) for k in line] for line in runs.to_pylist()] == want and sizes.sum() == len(want)


def test_hits_by_kinds_of_any_line(spark):
    """Hits behind a line's runs or beside none are kept; lines without hits give no rows."""
    from textloom.operators import search as S

    kind = "array<struct<n:int,kind:int>>"
    rows = spark.createDataFrame([(1, 0, "on on on", [(3, 4), (2, 1)]), (1, 1, "on", None), (2, 0, "xon only", []), (3, 0, "on", []), (4, 0, "on.on", [(2, 5), (1, 7), (2, 1)])], f"file_id long, line_no int, text string, kinds {kind}")
    assert sorted(map(tuple, S.hits_without(rows, "on").collect())) == [(1, 0, 3), (1, 0, 6), (1, 1, 0), (3, 0, 0), (4, 0, 3)]
    assert S.hits_without(rows.limit(0), "on").count() == 0
