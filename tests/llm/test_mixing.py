import re
from collections import Counter

import pytest

from conftest import unharmed
from textloom.llm import mixing as M


def size(t):
    return len(re.findall("[^ \t-\r]+", t or ""))


def targets(sizes, repeat=3):
    """Shares by weight, the excess over the limit shared again until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, rest = {}, sum(sizes.values())
    while True:
        left = [s for s in order if s not in full]
        if not left:
            return full
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] >= repeat * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = repeat * sizes[s]
            rest -= full[s]


@pytest.fixture(scope="module")
def corpus(prose):
    rows = [(i, prose(40 + 7 * (i % 23), i), "big") for i in range(300)]
    rows += [(1000 + i, prose(60, i), f"s{i % 5}") for i in range(200)]
    return rows + [(2000 + i, prose(30, i), None) for i in range(30)] + [(3000, "one two three", "tiny"), (3001, None, "tiny"), (3002, "", "none")]


def test_targets(spark, corpus):
    sizes = Counter()
    for _, t, s in corpus:
        sizes[s] += size(t)
    got = {r.source: r.target for r in M.sources(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-5 for s in want)
    assert got["none"] == 0 and got["tiny"] == 9


def test_mixture(make, corpus):
    docs = make(corpus)
    got = M.mixture(docs, block=16, shard=64).toPandas()
    assert len(got) == len(corpus)
    want = {i: size(t) for i, t, _ in corpus}
    assert all(want[r.doc_id] == r["size"] for _, r in got.iterrows())
    assert (got.taken <= 3 * got["size"]).all()
    source = {i: s for i, _, s in corpus}
    got["source"] = got.doc_id.map(source).fillna("null")
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.1 * g.target.iloc[0] + 32
    again = M.mixture(make(corpus, slices=5), block=16, shard=64).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_permutations(spark):
    """Every pass over a source takes each of its blocks once."""
    for n in (1, 2, 3, 7, 64, 1000):
        names = spark.createDataFrame([(5, n)], "sid int, n long").withColumn("keys", M.turn_keys(M.F.col("sid"), M.F.col("n")))
        slots = names.withColumn("x", M.F.explode(M.F.sequence(M.F.lit(0).cast("long"), M.F.col("n") - 1))).withColumn("turn", M.F.explode(M.F.array(*map(M.F.lit, range(3)))))
        seen = M.permuted(slots).groupBy("turn").agg(M.F.sort_array(M.F.collect_list("x")).alias("x"), M.F.collect_list("x").alias("order")).collect()
        assert all(r.x == list(range(n)) for r in seen)
        if n == 1000:
            assert len({tuple(r.order) for r in seen}) == 3


def test_mixed_texts(make, corpus):
    docs = make(corpus)
    took = {r.doc_id: r.taken for r in M.mixture(docs, block=16, shard=64).collect()}
    out = M.mixed(docs, block=16, shard=64)
    assert out.columns == docs.columns and unharmed(out)
    words, text = Counter(), {i: t for i, t, _ in corpus}
    for r in out.collect():
        words[r.doc_id] += size(r.text)
        assert r.n_chars == len(r.text) and r.text
        it = iter(text[r.doc_id].split())
        assert all(w in it for w in r.text.split())  # its words, in order
    assert words == Counter({i: n for i, n in took.items() if n})


def test_edges(make, edge_rows):
    got = M.mixture(make(edge_rows)).toPandas()
    assert len(got) == len(edge_rows) and (got[got["size"] == 0].taken == 0).all() and (got.taken <= 3 * got["size"]).all()
    assert M.mixture(make(edge_rows).limit(0)).count() == 0
    blank = M.mixture(make([(1, "", "a"), (2, None, None)])).toPandas()
    assert blank.target.tolist() == [0, 0] and blank.taken.tolist() == [0, 0]


def test_sql(spark, small, duck):
    from helpers import rows
    from textloom.llm import queries as Q

    assert rows(Q.op5_mixing(spark, small).toPandas()) == rows(duck.sql(Q.ORACLE_SQL["op5_mixing"]).df())


def test_plain_draws_fill_every_shard_and_scatter_more(spark):
    names = spark.createDataFrame([(1, "a", 40_000, 30_000.0), (2, "b", 30_000, 40_000.0), (3, "c", 1000, 1000.0)], "sid int, source string, source_size long, target double")
    total, off = {}, {}
    for stratified in (True, False):
        got = M.shard_counts(names, block=10, shard=64, stratified=stratified).toPandas()
        per = got.groupby("shard").slots.sum()
        assert (per.iloc[:-1] == 64).all() and per.sum() == 7100 and (got.slots >= 0).all()
        total[stratified] = got.groupby("sid").slots.sum()
        expected = {1: 3000, 2: 4000, 3: 100}
        off[stratified] = sum(abs(total[stratified][k] - v) for k, v in expected.items())
        if not stratified:  # a multinomial draw's variance over shards
            share = got[(got.sid == 1) & (got.shard < per.index[-1])].slots
            p = 3000 / 7100
            assert 0.6 < share.var() / (64 * p * (1 - p)) < 1.5
    assert off[True] <= off[False]


def test_spans_of_shards(spark, monkeypatch):
    """Counts don't depend on how many shards one window adds up."""
    names = spark.createDataFrame([(1, "a", 4000, 3000.0), (2, "b", 3000, 4000.0)], "sid int, source string, source_size long, target double")
    want = sorted(map(tuple, M.block_uses(names, block=10, shard=8).collect()))
    monkeypatch.setattr(M, "SPAN", 3)
    assert sorted(map(tuple, M.block_uses(names, block=10, shard=8).collect())) == want
