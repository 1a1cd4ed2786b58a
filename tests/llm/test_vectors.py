import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import embedding_dedup as E
from textloom.llm import vector_codes as V
from textloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, x long, row long, n long, code string, `a.b` string, signs string, keys string"
CLASH = (1, 2, 3, "c", "d", "s", "k")


@pytest.fixture(scope="module")
def table(spark):
    def build(rows, slices=3):
        """rows: vec_id, vector, label."""
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, *CLASH) for i, v, lab in rows], SCHEMA).repartition(slices)

    return build


def kept(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


# -- codes ------------------------------------------------------------------------------------------------------------


def brute_codes(rows, rounds=4, entries=256):
    """The contract with plain integers."""
    rows = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if kept(v) and len(v) % 4 == 0]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    d = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == d]
    parts = [[tuple(v[p * d // 4 : (p + 1) * d // 4]) for _, v, _ in rows] for p in range(4)]
    books = [[list(x) for x in part[:entries]] for part in parts]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            members = [[] for _ in books[p]]
            for x in parts[p]:
                members[nearest(p, x)[1]].append(x)
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(members, books[p], strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = []
    for k, (i, _, lab) in enumerate(rows):
        best = [nearest(p, parts[p][k]) for p in range(4)]
        found.append((i, "".join(f"{e:02x}" for _, e in best), sum(s for s, _ in best), lab))
    totals = {}
    for _, _, error, lab in found:
        totals[lab] = totals.get(lab, 0) + error
    return sorted(((i, code, error, totals[lab], digest) for i, code, error, lab in found), key=repr)


def codes_of(df):
    return sorted(map(tuple, V.codes(df).collect()), key=repr)


def random_rows(seed, n, d, scale=1.0):
    r = np.random.Generator(np.random.PCG64(seed))
    middle = r.normal(size=(7, d))
    return [(int(i), (middle[k % 7] * scale + r.normal(size=d) * 0.2).tolist(), None if k % 5 == 0 else k % 3) for k, i in enumerate(r.permutation(n * 2)[:n])]


def test_codes_against_integers(table):
    rows = random_rows(1, 420, 8)
    got = codes_of(table(rows))
    assert got == brute_codes(rows) and len(got) == 420


def test_codes_with_ties(table):
    """Vectors of few values: many entries are equal, and the lowest index wins."""
    r = np.random.Generator(np.random.PCG64(4))
    rows = [(i, r.integers(-1, 2, 12).tolist(), 1) for i in range(330)]
    assert codes_of(table(rows, 5)) == brute_codes(rows)


@pytest.mark.parametrize("n", [1, 3, 256])
def test_codes_of_few_vectors(table, n):
    rows = random_rows(n, n, 4)
    assert codes_of(table(rows)) == brute_codes(rows)


def test_codes_edges(spark, table):
    assert V.codes(spark.createDataFrame([], SCHEMA)).count() == 0
    bad = [(1, None, 1), (2, [], 1), (3, [1.0, None, 0.0, 0.0], 1), (4, [math.inf, 0, 0, 0], 2), (5, [math.nan] * 4, 2), (6, [1.0, 2.0, 3.0], 1)]
    assert V.codes(table(bad)).count() == 0
    rows = [*bad, (9, [0.5, -0.5, 0.25, 1e-9], None), (9, [0.5, -0.5, 0.25, 1e-9], None), (None, [0.1, 0.2, 0.3, 0.4], 1), (10, [-0.0, 0.0, -1e-9, 0.0], 1), (11, [1.0] * 8, 1)]
    assert codes_of(table(rows)) == brute_codes(rows) and len(codes_of(table(rows))) == 4
    large = [(1, [3e38, -3e38, 1.0, 0.0], 1), (2, [1.0, 2.0, 3.0, 4.0], 1), (3, [-3e38, 3e38, 1.0, 0.0], 1)]
    assert [r.error for r in V.codes(table(large)).collect()] == [0, 0, 0]


def test_nearest_is_exact():
    r = np.random.Generator(np.random.PCG64(3))
    for n, w, most in ((1, 3, 9), (17, 2, 2), (256, 16, 400), (256, 4, 3)):
        entries, points = r.integers(-most, most, (n, w)), r.integers(-most, most, (300, w))
        index, distance = V.Tree.of(entries).nearest(points)
        every = ((points[:, None, :] - entries[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_bounds_hold_and_prune():
    """Each node's bound is under the distances of its entries, and a search leaves most leaves out where entries are apart."""
    entries = np.array([(1000 * i, 0) for i in range(256)], np.int64)
    tree, seen = V.Tree.of(entries), []
    points = entries + 3
    for node, items in enumerate(tree.items):
        for p in points[::40]:
            assert tree.bound(node, p[None])[0] <= ((entries[items] - p) ** 2).sum(1).min()
    tree.items = [_Counted(i, seen) for i in tree.items]
    assert (tree.nearest(points)[0] == np.arange(256)).all()
    assert sum(seen) < 256 * 256 / 4


class _Counted(np.ndarray):
    def __new__(cls, items, seen):
        out = np.asarray(items).view(cls)
        out.seen = seen
        return out

    def __getitem__(self, at):
        self.seen.append(len(at) * len(self) if hasattr(at, "__len__") else 0)
        return np.asarray(self)[at]


# -- near copies ------------------------------------------------------------------------------------------------------


def brute_links(rows, least=0.9):
    sound = [kept(v) and any(x != 0 for x in v) for _, v, _ in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if s else None for (_, v, _), s in zip(rows, sound, strict=True)]
    n, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sound[a] and sound[b] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= least:
                n[a] += 1
                n[b] += 1
                up[find(a)] = find(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((i, n[k], c, i is not None and i == c))
    return sorted(out, key=repr)


def links_of(df):
    return sorted(map(tuple, E.links(df).collect()), key=repr)


def near(r, middle, cosine):
    """A vector at that cosine from middle."""
    aside = r.normal(size=len(middle))
    aside -= middle * (aside @ middle) / (middle @ middle)
    unit = middle / np.linalg.norm(middle)
    return (cosine * unit + math.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)) * r.uniform(0.1, 9)


def test_links_against_all_pairs(table):
    r = np.random.Generator(np.random.PCG64(11))
    rows = [(i, r.normal(size=32).tolist(), i % 3) for i in range(120)]
    for k in range(60):
        rows.append((1000 + k, near(r, np.array(rows[k % 20][1]), r.uniform(0.93, 1)).tolist(), None))
    rows += [(2000 + k, rows[k][1], 1) for k in range(10)] + [(2000, rows[0][1], 5)]
    got, want = links_of(table(rows)), brute_links(rows)
    assert got == want and sum(x[1] for x in got) > 150


def test_recall_near_the_bound(table):
    """Pairs at a cosine just over 0.9: nearly all are found, and none under it."""
    r = np.random.Generator(np.random.PCG64(12))
    rows = []
    for k in range(400):
        v = r.normal(size=64)
        rows += [(2 * k, v.tolist(), 0), (2 * k + 1, near(r, v, 0.9005 if k < 300 else 0.8995).tolist(), 0)]
    got = {i: n for i, n, _, _ in links_of(table(rows))}
    assert sum(got[2 * k] == 1 for k in range(300)) >= 294
    assert sum(got[2 * k] for k in range(300, 400)) == 0


def test_large_cells(table, monkeypatch):
    """Groups of near copies in cells of many members, whole and mixed with others: balls and blocks lose no link and count none twice."""
    r = np.random.Generator(np.random.PCG64(13))
    middle, rows = r.normal(size=16), []
    other = near(r, middle, 0.93)
    for k in range(260):
        rows.append((k, near(r, middle, r.uniform(0.96, 1)).tolist(), 0))
    for k in range(90):
        rows.append((500 + k, near(r, other, r.uniform(0.9, 1)).tolist(), 0))
    rows += [(700 + k, r.normal(size=16).tolist(), 0) for k in range(50)] + [(800 + k, rows[3][1], 0) for k in range(120)]
    want = brute_links(rows)
    for block in (16, 512):
        monkeypatch.setattr(E, "BLOCK", block)
        got = links_of(table(rows))
        exact = sum(a == b for a, b in zip(got, want, strict=True))
        assert sum(x[1] for x in got) >= 0.999 * sum(x[1] for x in want) and exact >= 0.9 * len(want)
        assert all(a[1] <= b[1] for a, b in zip(sorted(got, key=lambda x: x[0]), sorted(want, key=lambda x: x[0]), strict=True))


def test_large_groups_make_few_rows(table, monkeypatch):
    """A ball of near copies is counted, not compared: no pair of it comes up."""
    monkeypatch.setattr(E, "BLOCK", 32)
    r = np.random.Generator(np.random.PCG64(14))
    middle = r.normal(size=24)
    rows = [(k, near(r, middle, 0.995).tolist(), 0) for k in range(600)]
    met = []
    real = E._met
    monkeypatch.setattr(E, "_met", lambda *a: met.append(real(*a)) or met[-1])
    got = links_of(table(rows))
    assert {x[1] for x in got} == {599} and {x[2] for x in got} == {0}
    cells = met[0].groupBy("key").count()
    assert cells.where("count > 64").count() == 0


def test_links_edges(spark, table):
    assert E.links(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [
        (1, None, 0), (1, None, 0), (2, [], 0), (3, [0.0, -0.0, 0.0], 0), (4, [1.0, None, 0.0], 0), (5, [math.nan, 1.0, 0.0], 0), (6, [math.inf, 1.0, 0.0], 0),
        (7, [1.0, 0.0, 0.0], 0), (8, [5.0, 0.01, -0.0], 0), (9, [-1.0, 0.0, 0.0], 0), (None, [1.0, 0.0, 0.0], None), (None, None, None), (10, [1.0, 0.0, 0.0, 0.0], 0), (11, [1e-30, 1e-32, 0.0], 0), (8, [5.0, 0.01, 0.0], 1), (12, [3e38, 3e36, 0.0], 0),
    ]
    assert links_of(table(rows)) == brute_links(rows)
    alone = [(None, [1.0, 2.0], 0), (None, [2.0, 4.0], 0)]
    assert links_of(table(alone)) == [(None, 1, None, False)] * 2


def test_decode_is_nearest():
    """Of all lattice points around, none is nearer than the decoded one."""
    r = np.random.Generator(np.random.PCG64(5))
    points = r.normal(size=(400, 8)) * 2
    found = E.decode(points)
    assert ((np.rint(2 * found) - 2 * found) == 0).all() and (found.sum(1) % 2 == 0).all()
    least = ((points - found) ** 2).sum(1)
    around = ((points[:, None, :] - (found[:, None, :] + E.ROOTS[None])) ** 2).sum(2).min(1)
    assert (least <= around + 1e-9).all() and (least <= 1 + 1e-9).all()  # the covering radius is 1
    assert len(E.ROOTS) == 240 and np.allclose((E.ROOTS**2).sum(1), 2)


def test_cells_do_not_depend_on_company():
    """A vector's cells are the same alone and among others: pairs are counted by them."""
    r = np.random.Generator(np.random.PCG64(6))
    x = r.normal(size=(700, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    whole = E.cells(x)
    assert whole.shape == (700, E.TABLES, 1 + E.PROBES)
    assert (np.concatenate([E.cells(x[k : k + 100]) for k in range(0, 700, 100)])[:, :, 0] == whole[:, :, 0]).mean() > 0.9999
    assert all(len(set(row)) == row.size for row in whole[:50].reshape(50, -1))


def test_helpers():
    column = pa.array([[1.0, 2.0], None, [3.0], [], [float("nan"), 1.0], [4.0, None], [5.0, 6.0]], pa.list_(pa.float32()))
    found = {v.shape[1]: (rows.tolist(), v.tolist()) for rows, v in vectors.matrices(column)}
    assert found == {1: ([2], [[3.0]]), 2: ([0, 6], [[1.0, 2.0], [5.0, 6.0]])}
    group = np.array([0, 0, 0, 1, 2, 2])
    pairs = {(int(a), int(b)) for one, two in vectors.pairs_within(group) for a, b in zip(one, two, strict=True)}
    assert pairs == {(0, 1), (1, 2), (0, 2), (4, 5)}
    batches = [pa.record_batch({"k": [1, 1]}), pa.record_batch({"k": [1, 2]}), pa.record_batch({"k": pa.array([], pa.int64())}), pa.record_batch({"k": [2, 2, 3]})]
    for most in (1, 2, 4, 100):
        tables = [t.column(0).to_pylist() for t in vectors.whole_groups(iter(batches), 1, most)]
        assert sum(tables, []) == [1, 1, 1, 2, 2, 2, 3]
        ends = [t[-1] for t in tables]
        assert all(x[0] != e for x, e in zip(tables[1:], ends, strict=False))


def test_queries(spark, small):
    from textloom.llm import queries

    assert queries.op12_vector_codes(spark, small).dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    assert queries.op13_embedding_dedup(spark, small).dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
