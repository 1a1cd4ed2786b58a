import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import layout as Y
from textloom.operators import proportional as P
from textloom.operators import spatial, view


def laid(weights, x0, y0, x1, y1):
    """Boxes of falling weights, one by one, from the strips of their runs."""
    runs = [(w, len(list(g))) for w, g in itertools.groupby(weights)]
    found = Y.strips([w for w, _ in runs], [n for _, n in runs], x0, y0, x1, y1)
    out = []
    for first, past, before, upto, a, b, c, d, across in found:
        at = before
        for w in weights[first:past]:
            low, high = (at - before) / (upto - before), (at + w - before) / (upto - before)
            out.append((a, b + (d - b) * low, c, b + (d - b) * high) if across else (a + (c - a) * low, b, a + (c - a) * high, d))
            at += w
    return np.array(out).reshape(-1, 4)


def one_by_one(weights, x0, y0, x1, y1):
    """The same rule, child by child: a strip takes the next one while the longest shape in it gets no worse."""
    total, scale, out = sum(weights), (x1 - x0) * (y1 - y0) / sum(weights), []
    rest = list(weights)
    while rest:
        w, h = x1 - x0, y1 - y0
        q = min(w, h) ** 2 / scale

        def shape(row):
            s = sum(row)
            return max(q * row[0] / (s * s), s * s / (q * row[-1]))

        n = 1
        while n < len(rest) and shape(rest[: n + 1]) <= shape(rest[:n]):
            n += 1
        row, rest = rest[:n], rest[n:]
        size, at = sum(row), 0.0
        thick = (w if w >= h else h) if not rest else size * scale / (h if w >= h else w)
        for x in row:
            low, high = at / size, (at + x) / size
            out.append((x0, y0 + h * low, x0 + thick, y0 + h * high) if w >= h else (x0 + w * low, y0, x0 + w * high, y0 + thick))
            at += x
        x0, y0 = (x0 + thick, y0) if w >= h else (x0, y0 + thick)
    assert abs(total - sum(weights)) < 1e-9
    return np.array(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=200), st.floats(1, 50), st.floats(1, 50))
def test_strips_fill_the_box(weights, w, h):
    weights = sorted(map(float, weights), reverse=True)
    out = laid(weights, 2.0, 3.0, 2.0 + w, 3.0 + h)
    area = (out[:, 2] - out[:, 0]) * (out[:, 3] - out[:, 1])
    assert np.allclose(area, np.array(weights) / sum(weights) * w * h, rtol=1e-6, atol=1e-9)
    assert (out[:, 0] >= 2 - 1e-9).all() and (out[:, 2] <= 2 + w + 1e-6).all() and (out[:, 1] >= 3 - 1e-9).all() and (out[:, 3] <= 3 + h + 1e-6).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=150), st.floats(1, 50), st.floats(1, 50))
def test_strips_are_those_of_single_children(weights, w, h):
    weights = sorted(map(float, weights), reverse=True)
    assert np.allclose(laid(weights, 0.0, 0.0, w, h), one_by_one(weights, 0.0, 0.0, w, h), atol=1e-9)


def test_strips_of_nothing():
    assert Y.strips([], [], 0, 0, 1, 1) == []
    assert (laid([2.0, 1.0], 1, 1, 1, 5) == (1, 1, 1, 1)).all()


def test_known_strips():
    """The published example: areas 6, 6, 4, 3, 2, 2, 1 in a box of 6 by 4."""
    out = laid([6, 6, 4, 3, 2, 2, 1.0], 0, 0, 6, 4)
    assert np.allclose(out[0], (0, 0, 3, 2)) and np.allclose(out[1], (0, 2, 3, 4))
    assert np.allclose(out[2], (3, 0, 3 + 12 / 7, 7 / 3))


def test_treemap_against_single_children(spark):
    """The whole tree against the rule child by child, with one directory that holds most files."""
    r = random.Random(2)
    files = [(f"hot/{i:05d}", float(min(int(r.paretovariate(0.8)), 500)), r.randint(0, 50)) for i in range(3000)]
    files += [(f"a/b{i % 7}/c{i}", float(r.randint(1, 9)), i) for i in range(90)] + [("top", 5.0, 3), ("a/x", 5.0, 3)]
    got = {(x.path, x.is_dir): x for x in Y.treemap(spark.createDataFrame(files, "path string, weight double, lines long").repartition(5)).collect()}
    assert len(got) == len(files) + 10
    sums = {}
    for path, weight, lines in files:
        parts = path.split("/")
        for k in range(len(parts)):
            d = sums.setdefault("/".join(parts[:k]), [0.0, 0])
            d[0] += weight
            d[1] += lines

    def check(path, box):
        x = got[path, True]
        assert np.allclose((x.x0, x.y0, x.x1, x.y1), box, atol=1e-6)
        w, h = box[2] - box[0], box[3] - box[1]
        pad = min(max(2 * math.sqrt(max(w * h, 1e-9) / (34 * max(sums[path][1], 1))), 0.01), 4.0, 0.25 * min(w, h))
        assert math.isclose(x.pad, pad, rel_tol=1e-9) and x.weight == sums[path][0]
        inside = lambda p: (p.rpartition("/")[0] if "/" in p else "") == path
        children = sorted([(-wt, False, p) for p, wt, _ in files if inside(p)] + [(-v[0], True, p) for p, v in sums.items() if p and inside(p)], key=lambda c: (c[0], c[1], c[2]))
        for (_, is_dir, p), b in zip(children, one_by_one([-c[0] for c in children], box[0] + pad, box[1] + pad, box[2] - pad, box[3] - pad), strict=True):
            if is_dir:
                check(p, b)
            else:
                y = got[p, False]
                assert np.allclose((y.x0, y.y0, y.x1, y.y1), b, atol=1e-6) and y.depth == len(p.split("/"))

    check("", (0, 0, *Y.world()))


def test_treemap_of_nothing(spark):
    assert Y.treemap(spark.createDataFrame([], "path string, weight double, lines long")).count() == 0


@pytest.mark.parametrize(("length", "cap", "rows"), [(25, 20, [20, 5]), (39, 20, [20, 18, 1]), (10, 20, [10]), (0, 20, [0]), (500, 15, [500])])
def test_wrapped(spark, length, cap, rows):
    frame = spark.createDataFrame([(0, 0, length, cap)], "file_id long, line_no long, len long, cap long")
    assert [r.row_len for r in Y.wrapped(frame).orderBy("row_in_line").collect()] == rows


def test_flights(spark):
    targets = spark.createDataFrame([("far", 300.0, 400.0, 20.0), ("here", 0.0, 0.0, 25.0), ("wide", -50.0, 10.0, 900.0)], "name string, x double, y double, width double")
    rows = view.flights(targets, (0.0, 0.0, 100.0), 10).orderBy("step").collect()
    for t in targets.collect():
        path = [r for r in rows if r.name == t.name]
        assert len(path) == 11 and math.isclose(path[0].width, 100, rel_tol=1e-9) and math.isclose(path[-1].width, t.width, rel_tol=1e-6)
        assert math.isclose(path[0].x, 0, abs_tol=1e-6) and math.isclose(path[-1].x, t.x, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(path[-1].y, t.y, rel_tol=1e-6, abs_tol=1e-9)
    assert [round(r.width / 100, 9) for r in rows if r.name == "here"] == [round(0.25 ** (k / 10), 9) for k in range(11)]
    assert max(r.width for r in rows if r.name == "far") > 100  # it backs off on the way


def test_runs(spark):
    seen = [0, 1, 2, 7, 8, 4095, 4096, 4097, 9000]
    frame = spark.createDataFrame([(i, i in seen) for i in range(9001)], "file_no long, seen boolean")
    assert sorted(map(tuple, view.runs(frame).collect())) == [(0, 2), (7, 8), (4095, 4097), (9000, 9000)]


def test_enclosing(spark):
    spans = spark.createDataFrame([(1, 0, 100, 10), (1, 20, 30, 11), (1, 20, 30, 12), (2, 5, 6, 13)], "k long, first long, past long, item long")
    points = spark.createDataFrame([(1, 25, 0), (1, 30, 1), (1, 99, 2), (1, 100, 3), (2, 5, 4), (3, 5, 5)], "k long, at long, p long")
    got = {r.p: r.item for r in spatial.enclosing(points, spans, "k", "at", "p", "item", width=8).collect()}
    assert got == {0: 11, 1: 10, 2: 10, 4: 13}


def test_heights_of_equal_files(spark):
    got = view.heights(spark.createDataFrame([(1, 4.0, 2), (2, 1.0, 0)], "f long, weight double, depth int")).orderBy("f").collect()
    assert [(r.base, r.height) for r in got] == [(10.0, 90.0), (0.0, 45.0)]


def test_detail(spark):
    rows = spark.createDataFrame([(0.5,), (1.0,), (3.0,), (6.0,)], "p double").select(view.detail(F.col("p")).alias("d")).collect()
    assert [r.d for r in rows] == [0, 1, 2, 3]


def test_flow_columns_against_all_columns(spark):
    """Only columns around a root are tried; none of the others would be better."""
    w, h = Y.world()
    pad = 4.0
    for aspect in (Y.PAGE_ASPECT, 0.2, 3.0):
        counts = [*range(1, 60), 97, 100, 101, 360, 999, 1000, 5000]
        got = {}
        for n in counts:
            r = Y.flow_columns(spark.createDataFrame([(n,)], "n long"), aspect).first()
            got[n] = None if r is None else (r.cols, r.rows)
        for n in counts:
            best = None
            for cols in range(1, n + 1):
                rows = -(-n // cols)
                cw, ch = (w - 2 * pad) / cols, (h - 2 * pad) / rows
                if ch > Y.PAGE_GAP * cw:
                    ratio = (cw - Y.PAGE_GAP * cw) / (ch - Y.PAGE_GAP * cw) / aspect
                    best = min(best or (2,), (ratio < 1, abs(math.log(ratio)), cols, rows))
            assert got[n] == (best and best[2:]), (n, aspect)


def test_part_bands_against_all_columns(spark):
    w, h = Y.world()
    r = random.Random(3)
    for trial in range(25):
        pages = [r.randint(1, r.choice((3, 40, 400))) for _ in range(r.randint(1, 30))]
        aspect = r.choice((Y.PAGE_ASPECT, 0.3, 2.0))
        got = Y.part_bands(spark.createDataFrame(list(enumerate(pages)), "part_no long, pages long"), aspect).first().cols
        best = min((((w - 8) / c / ((h - 8) / (rows := sum(-(-p // c) for p in pages))) / aspect < 1), abs(math.log((w - 8) / c / ((h - 8) / rows) / aspect)), c) for c in range(1, max(pages) + 1))
        assert got == best[2], (pages, aspect)


def test_ranked_and_runs(spark):
    from textloom.operators import lines, view

    r = random.Random(8)
    numbers = [(r.randrange(10**6), i) for i in range(3000)]
    got = lines.ranked(spark.createDataFrame(numbers, "a long, b long").repartition(9), ["a", "b"], "place").collect()
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.place)] == sorted(numbers) and sorted(x.place for x in got) == list(range(3000))
    shown = [r.random() < 0.8 for _ in range(500)] + [True] * 60
    want, at = [], 0
    for k, s in enumerate([*shown, False]):
        if not s:
            if k > at:
                want.append((at, k - 1))
            at = k + 1
    files = spark.createDataFrame(list(enumerate(shown)), "file_no long, seen boolean")
    for width in (1, 2, 7, 4096):
        assert sorted(map(tuple, view.runs(files, width=width).collect())) == want


def test_walked_by_ids(spark):
    from textloom.operators import tree

    dirs = spark.createDataFrame([(0, None, ""), (5, 0, "a"), (2, 5, "b"), (9, 2, "c"), (7, 0, "d"), (30, 31, "lost"), (31, 30, "loop")], "id long, parent long, label string")
    got = {r.id: (r.depth, r.path, r.crumb) for r in tree.walked(dirs).collect()}
    assert got == {0: (0, "", ""), 5: (1, "a", "a"), 2: (2, "a/b", "a › b"), 9: (3, "a/b/c", "a › b › c"), 7: (1, "d", "d")}
    deep = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(104)], "id long, parent long, label string")
    assert tree.walked(deep).agg(F.max("depth")).first()[0] == 103
    assert spark.conf.get("spark.sql.cteRecursionLevelLimit") == "100"


def test_order_statistics(spark):
    from textloom.operators import order

    r = random.Random(4)
    values = [r.choice((r.gauss(0, 1), r.paretovariate(0.3), -1e300 * r.random(), 7.0, 1e-300)) for _ in range(9000)]
    frame = spark.createDataFrame([(v, r.randint(0, 3)) for v in values] + [(None, 2), (float("nan"), 2)], "v double, w int").repartition(3).cache()
    few = order.FEW
    try:
        for order.FEW in (few, 10):
            assert order.quantiles(frame, "v", [0, 0.25, 0.5, 0.99, 1]) == pytest.approx([float(np.quantile(values, q)) for q in (0, 0.25, 0.5, 0.99, 1)], rel=1e-12)
            spread = sorted(x.v for x in frame.collect() if x.v is not None and x.v == x.v for _ in range(x.w))
            assert order.nth(frame, "v", [0, 17, len(spread) - 1, len(spread)], "w") == [spread[0], spread[17], spread[-1], None]
            assert order.weighted_median(frame, "v", "w") in (spread[len(spread) // 2], spread[(len(spread) - 1) // 2])
    finally:
        order.FEW = few
    none = frame.where("v IS NULL")
    assert order.quantiles(none, "v", [0.5]) == [None] and order.weighted_median(none.limit(0), "v", "w") is None


def sequential_tags(tags, gap, slides=8):
    placed = []
    for place, x0, y0, x1, y1, w, h in sorted(tags):
        if x1 - x0 < w or y1 - y0 < h:
            continue
        sx, sy, free = x0, y0, False
        for _ in range(slides):
            way = [b for b in placed if sx < b[3] and sx + w > b[1] and sy < b[4] and sy + h > b[2]]
            if not way:
                free = True
                break
            sx = way[0][3] + gap
            if sx + w > x1:
                sx, sy = x0, sy + h + gap
        if free and sy + h <= y1:
            placed.append((place, sx, sy, sx + w, sy + h))
    return [(p, x, y) for p, x, y, _, _ in placed]


@pytest.mark.parametrize("seed", [1])
def test_placed_tags(spark, seed):
    """Nested boxes, boxes that cross, and one place that many want: as one after the other would do it."""
    r = random.Random(seed)
    tags = []

    def nest(x0, y0, x1, y1, depth):
        tags.append((len(tags), x0, y0, x1, y1, r.uniform(20, 80), r.choice((10.0, 14.0))))
        if depth and x1 - x0 > 60:
            for k in range(r.randint(1, 3)):
                nest(x0 + 3 + k * (x1 - x0) / 3, y0 + 3, x0 + (k + 1) * (x1 - x0) / 3, y1 - 3, depth - 1)

    nest(0.0, 0.0, 900.0, 500.0, 4)
    for _ in range(40):
        x, y = r.uniform(-50, 700), r.uniform(-50, 400)
        tags.append((len(tags), x, y, x + r.uniform(10, 300), y + r.uniform(5, 200), r.uniform(5, 60), 12.0))
    tags += [(len(tags) + k, 100.0, 100.0, 260.0, 180.0, 70.0, 12.0) for k in range(14)]
    places = list(range(len(tags)))
    r.shuffle(places)
    tags = [(p, *t[1:]) for p, t in zip(places, tags, strict=True)]
    frame = spark.createDataFrame(tags, "place long, x0 double, y0 double, x1 double, y1 double, w double, h double")
    got = sorted(map(tuple, view.placed_tags(frame, 2.0).collect()))
    want = sequential_tags(tags, 2.0)
    assert len(got) > 30 and [g[0] for g in got] == [w[0] for w in sorted(want)]
    assert np.allclose(got, sorted(want))


def test_no_tags(spark):
    frame = spark.createDataFrame([], "place long, x0 double, y0 double, x1 double, y1 double, w double, h double")
    assert view.placed_tags(frame, 2.0).count() == 0


def test_fitted_camera():
    from textloom.operators.camera import INSIDE, Camera

    for tilt, yaw, width, height in ((0.0, 0.0, 1280, 720), (55.0, 25.0, 1280, 720), (70.0, -40.0, 500, 900), (20.0, 90.0, 900, 300)):
        world = (1600.0, 900.0)
        c = Camera(1.0, 2.0, 3.0, width, height, 24.0, tilt, yaw, 5.0).fitted(world)
        corners = [c.clip(x, y) for x in (0.0, world[0]) for y in (0.0, world[1])]
        over = max(max(abs(a), abs(b)) / w for a, b, w in corners)
        assert over <= INSIDE + 1e-9 and (c.cx, c.cy, c.focus) == (800, 450, 0)
        flat = Camera(0.0, 0.0, 1.0, width, height).fitted(world)
        assert math.isclose(over, INSIDE, rel_tol=1e-9) or math.isclose(c.zoom, flat.zoom, rel_tol=1e-9)


def test_tilted_view_holds_what_rays_meet():
    from textloom.operators.camera import Camera

    c = Camera(700.0, 420.0, 1.75, 1280.0, 720.0, 24.0, 50.0, 25.0, 12.0)
    x0, y0, x1, y1 = c.view((1600.0, 900.0))
    r = random.Random(1)
    for _ in range(300):
        eye, d = c.ray(r.uniform(0, 1280), r.uniform(24, 744))
        deep = (r.choice((0.0, 12.0, 102.0)) - eye[2]) / d[2]
        if deep >= c.near:
            assert x0 - 1e-6 <= eye[0] + deep * d[0] <= x1 + 1e-6 and y0 - 1e-6 <= eye[1] + deep * d[1] <= y1 + 1e-6
    level = Camera(700.0, 420.0, 1.75, 1280.0, 720.0, 24.0, 85.0, 0.0, 0.0).view((1600.0, 900.0))
    assert level == (-4100.0, -4380.0, 5500.0, 5220.0)


def test_stored_rectangles(spark, tmp_path):
    """A view and a point read few row groups, and find what a full scan finds."""
    n = 200
    rects = spark.range(n * n).withColumn("cx", F.col("id") % n).withColumn("cy", F.floor(F.col("id") / n))
    rects = rects.select("id", (F.col("cx") * 5.0).alias("x0"), (F.col("cy") * 4.0).alias("y0"), (F.col("cx") * 5.0 + 4.5).alias("x1"), (F.col("cy") * 4.0 + 3.5).alias("y1"))
    path = f"file://{tmp_path}/boxes"
    spatial.store(rects, path, 1000.0, 800.0, group_bytes=20_000)
    for found, want in ((spatial.in_view(spark, path, 100, 100, 160, 140), rects.where(view.visible(100, 100, 160, 140))), (spatial.around(spark, path, 501.0, 401.0), rects.where("x0 <= 501 AND x1 > 501 AND y0 <= 401 AND y1 > 401"))):
        assert sorted(x.id for x in found.collect()) == sorted(x.id for x in want.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "LessThan" in plan.partition("PushedFilters: [")[2]
        read = _scanned(found)
        assert 0 < read < n * n / 4, read


def _scanned(df):
    """Rows that the scan of a plan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_curve(spark):
    def interleaved(x, y):
        return sum(((x >> k) & 1) << (2 * k) | ((y >> k) & 1) << (2 * k + 1) for k in range(16))

    points = [(0.0, 0.0), (1.0, 1.0), (0.5, 0.25), (0.123, 0.987), (2.0, -1.0)]
    got = spark.createDataFrame(points, "x double, y double").select(spatial.curve(F.col("x"), F.col("y"), 1.0, 1.0).alias("k")).collect()
    fix = lambda v: min(max(int(math.floor(v * 65536)), 0), 65535)
    assert [g.k for g in got] == [interleaved(fix(x), fix(y)) for x, y in points]


def test_last_at_most(spark):
    r = random.Random(5)
    rows = [(sorted(r.sample(range(1000), n)), r.uniform(-5, 1005)) for n in (1, 2, 3, 7, 100, 999) for _ in range(5)]
    frame = spark.createDataFrame([([float(x) for x in xs], v) for xs, v in rows], "xs array<double>, v double")
    got = [x.k for x in frame.select(view.last_at_most(F.col("xs"), F.col("v")).alias("k")).collect()]
    assert got == [max(0, sum(x <= v for x in xs) - 1) for xs, v in rows]


def test_padded_pages(spark):
    rows = spark.createDataFrame([(i, i % 3, (1 << 33) + i, 4, 0 if i % 2 else 9, 10 + i) for i in range(11)], "row long, file_id long, off long, indent long, col0 long, row_len long")
    texels = view.texels(rows, 4)
    assert sorted((t.page, t.place, t.low, t.file, t.packed, t.high) for t in texels.collect()) == [(i // 4, i % 4, i, i % 3, (4 if i % 2 else 0) | (10 + i) << 16, 2) for i in range(11)]
    pages = {p.page: p.words for p in view.padded_pages(texels, 4).collect()}
    assert set(pages) == {0, 1, 2} and all(len(w) == 16 for w in pages.values())
    assert pages[2][12:] == [0, 0, 0, 0] and pages[1][4:8] == [5, 2, 4 | 15 << 16, 2]


def test_overlaps_are_merged_and_found_once(spark, tmp_path):
    rng = random.Random(3)
    boxes = [(i, i % 3, x, y, x + rng.choice((0.5, 12.0, 60.0)), y + rng.choice((0.5, 9.0, 40.0))) for i in range(300) for x, y in [(rng.uniform(-5, 150), rng.uniform(-5, 90))]]
    boxes += [(1000 + k, 0, 10.0, 10.0, 22.0, 19.0) for k in range(40)]
    spark.createDataFrame(boxes, "id long, g int, x0 double, y0 double, x1 double, y1 double").write.parquet(str(tmp_path / "boxes"))
    frame = spark.read.parquet(str(tmp_path / "boxes"))  # small enough to be broadcast, were it not for its cells
    found = spatial.overlaps(frame, "g", "id", 160.0, 90.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    want = [(a[0], b[0]) for a in boxes for b in boxes if a[1] == b[1] and a[0] < b[0] and a[2] < b[4] - 1e-6 and b[2] < a[4] - 1e-6 and a[3] < b[5] - 1e-6 and b[3] < a[5] - 1e-6]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_flight_to_the_middle_is_the_sqls(spark, tmp_path):
    import duckdb

    from helpers import rows
    from textloom import plans

    spark.createDataFrame([(7, "a", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(plans.QUERIES["f_flight"](spark, str(tmp_path)).toPandas()) == rows(con.sql(plans.SQL["f_flight"]).df())


def test_a_settled_column_is_as_wide_as_its_step_says(spark):
    """Not as colw / pitch rounds it: a point on the edge of a stretched row's character would find another one than the SQL."""
    files = [(i, 40.0, 30.0, 5 + i, 13.7, [(90.0 + i, 5 + i)]) for i in range(40)]
    frame = spark.createDataFrame(files, "file_id int, w double, h double, n long, target double, hist array<struct<width:double,count:bigint>>")
    got = P.settled(frame).where("rows > ceil(n / k)").collect()
    assert len(got) == 40
    assert [r.file_id for r in got if r.capw != r.colw * (r.rows + 2) / r.h] == []


def test_points_meet_rectangles_of_tall_worlds_in_few_cells(spark):
    """A rectangle is in as many cells in a world of many rows of them as in one of few."""

    def copies(n):
        rects = spark.range(n).select("id", (F.col("id") % 4 * 40.0).alias("x0"), (F.floor(F.col("id") / 4) * 30.0).alias("y0"))
        rects = rects.withColumns({"x1": F.col("x0") + 40, "y1": F.col("y0") + 30})
        return spatial.grid(rects, 160.0, n / 4 * 30.0, spatial.resolution(rects, 160.0, n / 4 * 30.0)).count() / n

    assert copies(40000) <= 9 and copies(40000) <= 1.5 * copies(400)
