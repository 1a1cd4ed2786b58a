import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import unharmed
from textloom.llm import kernels as K
from textloom.llm import near_dedup as N
from textloom.llm.components import components


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Classes of (doc_id, text) rows by all pairs at a Jaccard similarity of 0.8."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
            root[find(i)] = find(j)
    groups = defaultdict(set)
    for i, r in enumerate(rows):
        groups[find(i)].add(r[0])
    return {frozenset(g) for g in groups.values()}


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_against_all_pairs(stored, prose):
    rows = [(i, prose(120 + i % 200, i), "s") for i in range(120)]
    passage = prose(60, 999)
    rows += [(200 + i, f"{prose(150, 500 + i)} {passage} {prose(40, 700 + i)}", "s") for i in range(30)]  # a passage is no copy
    rows += [(300 + i, edited(rows[i % 40][1], 1 + i % 3, i), "s") for i in range(90)]
    rows += [(400 + i, rows[i][1], "s") for i in range(20)]
    rows += [(500 + i, edited(prose(200, 42), i % 4, i), "s") for i in range(60)]  # one large group
    rows += [(600, "one two three four five six", "s"), (601, "one two three four five six seven", "s"), (602, "one two", "s"), (603, "two one", "s")]
    got = N.classes(stored(rows)).toPandas()
    assert len(got) == len(rows)
    groups = {frozenset(g) for g in got.groupby("class_id").doc_id.agg(set)}
    assert groups == brute(rows)
    assert (got.groupby("class_id").kept.sum() == 1).all() and (got[got.kept].doc_id == got[got.kept].class_id).all()
    assert (got.groupby("class_id").size() == got.groupby("class_id").class_size.first()).all()


def test_edges(stored, edge_rows, make):
    got = N.classes(stored(edge_rows)).toPandas()
    assert len(got) == len(edge_rows)
    by = {(None if i != i else int(i), k): c for i, k, c in zip(got.doc_id, got.row, got.class_id, strict=True)}
    classes = {i: c for (i, _), c in by.items() if i is not None}
    assert classes[1] == classes[2] == 1 and classes[3] == classes[4] == classes[5] == 3 and classes[6] == classes[7] == 6
    assert got.kept.sum() == got.class_id.nunique()
    assert unharmed(N.keep_one(stored(edge_rows)))
    kept = N.keep_one(stored(edge_rows)).toPandas()
    assert len(kept) == got.class_id.nunique() and kept.columns.tolist() == make(edge_rows).columns
    assert N.classes(stored([(1, "x", "s")]).limit(0).checkpoint()).count() == 0


def test_alignment_keeps_order():
    def seq(text):
        return N._split(next(K.chunks(pa.array([text]))))[0]

    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words), " ".join(words[:60] + ["new"] + words[60:])
    assert N.similar(seq(a), seq(b))
    halves = " ".join(words[100:] + words[:100])  # the same runs of words, far apart
    assert N.aligned(seq(a).items, seq(halves).items) < 0.8 * 196
    assert not N.similar(seq(a), seq(" ".join(words[:120] + [f"x{i}" for i in range(80)])))


def test_alignment_against_dynamic_programming():
    r = random.Random(3)
    for _ in range(50):
        a = r.sample(range(60), 40)
        b = [x for x in a if r.random() > 0.05] + r.sample(range(60, 99), 2)
        b[5:7] = b[5:7][::-1]
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        enough = lambda n: n >= 0.8 * (len(a) + len(b) - n)
        got = N.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == best[-1, -1] if enough(best[-1, -1]) else not enough(got)


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 300)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {n: n for pair in links for n in pair}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in root if any(n in p and p[0] != p[1] for p in links)}


def one_bucket(docs):
    """joined() where all texts share one sketch only: what it finds is what the bucket's members are compared for."""
    rows = N._place(N.described(docs)).select("doc_id", "row", "n", "sig", F.array(F.lit(1).cast("long")).alias("keys")).checkpoint()
    name = {r.row: r.doc_id for r in rows.collect()}
    groups = defaultdict(set)
    for r in N.joined(docs, rows).collect():
        groups[r.root].add(name[r.node])
    return {frozenset(g) for g in groups.values()}


def test_members_unlike_their_leader_are_compared(stored, prose):
    """The leader (the last row) is like no other text, so no link is found with it."""
    text = prose(100, 2)
    rows = [(0, text, "s"), (1, edited(text, 1, 3), "s"), (2, prose(100, 4), "s"), (3, prose(100, 5), "s")]
    assert one_bucket(stored(rows, slices=1).orderBy("doc_id").coalesce(1).checkpoint()) == {frozenset({0, 1})}


def test_hot_bucket_against_all_pairs(stored, prose, monkeypatch):
    """Texts of one origin at 0.6 to 0.8 with few near copies among them, some of joined members; blocks smaller than the bucket."""
    monkeypatch.setattr(N, "BLOCK", 16)
    origin = prose(200, 77)
    rows = [(i, edited(origin, 4 + i % 2, i), "s") for i in range(140)]
    rows += [(200 + i, edited(rows[3 * i][1], 1, 200 + i), "s") for i in range(30)]
    rows += [(300 + i, edited(rows[140 + 2 * i][1], 2, 300 + i), "s") for i in range(10)]
    expected = {g for g in brute(rows) if len(g) > 1}
    assert len(expected) > 15
    assert one_bucket(stored(rows, clash=False)) == expected


def test_hot_template_with_own_sketches(stored, prose):
    origin = prose(200, 78)
    rows = [(i, edited(origin, 4 + i % 2, i), "s") for i in range(300)]
    rows += [(400 + i, edited(rows[5 * i][1], 1 + i % 2, 400 + i), "s") for i in range(50)]
    got = N.classes(stored(rows, clash=False)).toPandas()
    assert {frozenset(g) for g in got.groupby("class_id").doc_id.agg(set)} == brute(rows)


def test_settled_members_meet_those_that_led_before_them(stored, prose):
    """M (17) is like X (0) only, and X is joined with the leader L (18) at once; twins give links in the meantime."""
    leader = prose(200, 60)
    x = edited(leader, 4, 61)
    rows = [(0, x, "s"), *((i, prose(150, 700 + i % 8), "s") for i in range(1, 9)), *((i, edited(prose(150, 700 + i % 8), 1, i), "s") for i in range(9, 17))]
    rows += [(17, edited(x, 4, 62), "s"), (18, leader, "s")]
    expected = {g for g in brute(rows) if len(g) > 1}
    assert frozenset({0, 17, 18}) in expected and len(expected) == 9
    assert one_bucket(stored(rows, slices=1).orderBy("doc_id").coalesce(1).checkpoint()) == expected


def test_shared_sketches_of_short_texts():
    """The share of pairs of few items that have a common sketch is what picking without putting back gives."""
    for common, extra in ((4, 1), (5, 1), (8, 2), (16, 4)):
        hits = 0
        for seed in range(400):
            r = np.random.default_rng(seed * 31 + common)
            both = r.integers(1, 1 << 63, common, dtype=np.uint64)
            one = np.concatenate([both, r.integers(1, 1 << 63, extra, dtype=np.uint64)])
            offs = np.array([0, len(one), len(one) + common])
            a, b = N.sketches(np.concatenate([one, both]), offs)
            hits += bool(set(a) & set(b))
        p = np.prod([(common - k) / (common + extra - k) for k in range(4)])
        assert hits / 400 >= 1 - (1 - p) ** 16 - 0.03


def test_rows_without_a_place_of_their_own(make, prose):
    rows = [(i, prose(40, i // 3), "s") for i in range(30)]
    got = N.classes(make(rows, slices=7)).toPandas()
    assert {frozenset(g) for g in got.groupby("class_id").doc_id.agg(set)} == {frozenset(range(i, i + 3)) for i in range(0, 30, 3)}
