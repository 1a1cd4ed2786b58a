import random
from collections import Counter
from math import log, sqrt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm import queries as Q
from textloom.llm import toxicity as X


def plain_model(train, labels, corpus, chance):
    """The log ratio of each word of a text, from dictionaries and sets: a function of the text."""
    words = [t.split() for t in train]
    pairs = [[("<" if i == 0 else w[i - 1], w[i]) for i in range(len(w))] for w in words]
    smaller = min(labels.count(0), labels.count(1))
    every = Counter(w for t in corpus for w in t.split())
    total = sum(every.values())

    def tilts(items):
        texts = [set(x) for x in items]
        count = [Counter(i for t, y in zip(texts, labels, strict=True) if y == c for i in t) for c in (0, 1)]
        both = count[0] + count[1]
        out = {}
        for i, n in both.items():
            out[i] = []
            for c in (0, 1):
                part = n * sum(count[c].values()) / sum(both.values())
                more = count[c][i] - part
                rest = max(abs(more) - chance * sqrt(log(max(2, smaller))) * sqrt(part + 1), 0)
                out[i].append((part + (rest if more > 0 else -rest)) / part)
        return both, out

    of_words, word_tilt = tilts(words)
    of_pairs, pair_tilt = tilts(pairs)
    told = {p for p, t in pair_tilt.items() if t != [1, 1]}
    known = {w for w, t in word_tilt.items() if t != [1, 1]} | {w for p in told for w in p if w != "<"}
    ones, twos = (sum(n == k for n in of_pairs.values()) for k in (1, 2))
    discount = ones / (ones + 2 * twos) if ones else 0
    context = Counter()
    for (u, _), n in of_pairs.items():
        context[u] += n
    share = {p: max(of_pairs[p] - discount, 0) / context[p[0]] for p in told}
    base = {w: max(every[w] / total, of_words[w] / sum(of_words.values()) * 1e-3) for w in known}
    whole = [1 - sum(base.values()) + sum(base[w] * word_tilt[w][c] for w in known) for c in (0, 1)]

    def probability(c, u, w):
        word = base[w] * word_tilt[w][c] / whole[c] if w in known else 1 / whole[c]
        left = 1 - sum(x for p, x in share.items() if p[0] == u)
        tilt = pair_tilt[u, w][c] / (word_tilt[u][c] if u in word_tilt else 1) if (u, w) in told else 0
        return share.get((u, w), 0) * tilt + left * word

    def ratios(text):
        w = text.split()
        before = ["<" if i == 0 else w[i - 1] if w[i - 1] in known else "?" for i in range(len(w))]
        return [log(probability(1, u, x) / probability(0, u, x)) for u, x in zip(before, w, strict=True)]

    return ratios, known, told


@pytest.mark.parametrize("chance", [0.05, 0.4, 1.0])
def test_whole_score_against_plain_counts(chance):
    r = random.Random(int(chance * 100))
    vocabulary = "a b c d e f".split()
    texts = [" ".join(r.choice(vocabulary + ["vile"] * (2 * (i % 3 == 0))) for _ in range(r.randint(1, 12))) for i in range(30)]
    texts[0] = "foul vile a foul vile b"
    labels = [int(i % 3 == 0) for i in range(30)]
    more = texts + ["a a b", "f vile q"]
    corpus = np.unique(X._hashed(pa.array(more))[0], return_counts=True)
    model = X.fit(pa.array(texts), np.array(labels), corpus, int(corpus[1].sum()), chance)
    ratios, known, told = plain_model(texts, labels, more, chance)
    assert (len(model.vocab), len(model.bigrams)) == (len(known), len(told)) and known
    model.weights = np.arange(1.0, 8.0) / 3
    tests = ["vile a b vile c q d", "q", "a", "b vile " * 40, "", "vile q vile", *texts[:9]]
    got = X.features(model, next(K.chunks(pa.array(tests))))
    scores = X.batch_scores(model, pa.array(tests))
    for row, score, t in zip(got, scores, tests, strict=True):
        v = ratios(t)
        n, span = len(v), X.PASSAGE
        want = [sum(v) / n if n else 0, max((sum(v[i : i + span]) / span for i in range(max(1, n - span + 1))), default=0) if n else 0]
        assert np.allclose(row, want)
        w = model.weights
        z = sum(w[i] * (x - w[3 + i]) / w[5 + i] for i, x in enumerate(want)) + w[2]
        assert np.isclose(score, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_probabilities_sum_to_one():
    """After any context, those of all words; and both classes agree on words that neither has more often than chance."""
    r = random.Random(3)
    texts = [" ".join(r.choice("a b c d".split() + ["vile"] * (i % 2)) for _ in range(9)) for i in range(60)]
    labels = [i % 2 for i in range(60)]
    model = X.fit(pa.array(texts), np.array(labels), chance=0.5)
    own = [w[:-1] for w in model.words]
    names = np.unique(X._hashed(pa.array(texts))[0])
    every, total = np.unique(X._hashed(pa.array(texts))[0], return_counts=True)
    for c in (0, 1):
        others = total[~np.isin(every, model.vocab)].sum() / total.sum() * model.words[c][-1]
        assert np.isclose(own[c].sum() + others, 1, atol=1e-3)
    assert len(names) == 5 and np.isclose(X.ratios(model, X._hashed(pa.array(["unseen words here"]))[0], np.array([0, 3])), np.log(model.words[1][-1] / model.words[0][-1])).all()


def test_words_without_their_marks():
    one, _ = X.word_hashes(next(K.chunks(pa.array(['word """word"""! (((((word))))) WORD, ... é! -é-']))))
    assert len(set(one[:4].tolist())) == 1 and one[5] == one[6] and one[4] not in (one[0], one[5])


@pytest.fixture(scope="module")
def corpus(prose):
    bad = ["foul", "vile", "rotten"]
    rows, labels = [], []
    for i in range(400):
        w = prose(60 + i % 50, i).split()
        toxic = i % 4 == 0
        if toxic:
            for k in range(3):
                w[7 * k + i % 5] = bad[(i + k) % 3]
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out(spark, make, corpus):
    rows, labels = corpus
    docs, known = make(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = X.train(docs, known.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    held = [(i, y) for i, y in labels if i % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(y) for i, y in held) >= 0.95 * len(held)
    pairs = [(got[i], got[j]) for i, y in held if y for j, z in held if not z]
    assert sum(a > b for a, b in pairs) >= 0.95 * len(pairs)  # toxic ones come first
    kept = {r.doc_id for r in X.drop_toxic(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}
    assert X.drop_toxic(docs, model).columns == docs.columns


def test_held_out_toxic_documents_are_caught_at_the_threshold(spark, make, corpus):
    rows, labels = corpus
    docs, known = make(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = {r.doc_id for r in X.drop_toxic(docs, X.train(docs, known.where("doc_id % 5 <> 0"))).collect()}
    toxic = [i for i, y in labels if i % 5 == 0 and y]
    assert sum(i not in kept for i in toxic) >= 0.95 * len(toxic)


@pytest.mark.parametrize(("size", "least_right", "most_false"), [("sf0.001", 18, 0), ("sf0.01", 67, 1), ("sf0.1", 812, 4)])
def test_held_out_rows_of_the_tables(size, least_right, most_false):
    """Held-out labelled rows at every size; the whole text's ratio has most of the weight once there are texts enough to learn from."""
    import zlib

    import pyarrow.parquet as pq

    docs, labels = (pq.read_table(f"/root/testdata/{size}/{n}.parquet").to_pandas() for n in ("documents", "labels"))
    rows = labels[labels.toxic.isin([0, 1])].merge(docs, on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id])
    own = rows[~held]
    sample = pa.table({"text": pa.array(own.text.fillna("").tolist()), "toxic": pa.array(own.toxic.astype(int).tolist()), "known": pa.array([int((own.toxic == t).sum()) for t in own.toxic])})
    corpus = np.unique(X._hashed(pa.array(docs.text.fillna("").tolist()))[0], return_counts=True)
    model = X._trained(sample, corpus, int(corpus[1].sum()))
    got = X.batch_scores(model, pa.array(rows[held].text.fillna("").tolist())) >= 0.5
    wanted = rows[held].toxic.to_numpy() == 1
    assert (got == wanted).sum() >= least_right and (got & ~wanted).sum() <= most_false
    if size == "sf0.1":
        assert model.weights[0] > model.weights[1] > 0 and (got & wanted).sum() >= 0.9 * wanted.sum()


def test_labels_of_held_out_rows_are_never_learned(spark, make, corpus):
    rows, labels = corpus
    docs = make(rows)
    known = spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id % 5 <> 0")
    again = known.unionByName(spark.createDataFrame([(i, 1 - y) for i, y in labels if i % 5 == 0], "doc_id long, toxic int")).where("doc_id % 5 <> 0")
    one, two = (X.train(docs, k) for k in (known, again))
    assert np.array_equal(one.weights, two.weights)


def test_an_overlong_text_leaves_the_others_in_the_sample(spark, make):
    first = spark.range(40).orderBy(F.xxhash64("id")).first().id
    rows = [(i, "word " * (2000 if i == first else 10 + i % 3), "s") for i in range(40)]
    docs = make(rows)
    for toxic in (0, 1):
        known = spark.createDataFrame([(i, toxic) for i in range(40)], "doc_id long, toxic int")
        got = {r.doc_id: r.text for r in X.sample(docs, known, (100, 100), (4000, 4000)).collect()}
        assert {i: t for i, t in got.items() if i != first} == {i: t for i, t, _ in rows if i != first}
        assert got[first] and sum(len(t) for t in got.values()) <= 4000
        alone = X.sample(docs, known.where(F.col("doc_id") == first), (100, 100), (4000, 4000)).collect()
        assert len(alone) == 1 and 0 < len(alone[0].text) <= 4000


def test_edges(spark, make, edge_rows, corpus):
    rows, labels = corpus
    model = X.train(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = X.score(make(edge_rows), model).toPandas()
    assert len(got) == len(edge_rows) and got.score.between(0, 1).all()
    empty = got[got.doc_id.isin([3, 4, 5])].score
    assert empty.nunique() == 1
    assert X.score(make(edge_rows).limit(0), model).count() == 0
    none = X.train(make(rows), spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert none is None and set(X.score(make(edge_rows), none).toPandas().score) == {0.0}
    assert X.train(make(edge_rows).limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")) is None


def test_query(spark, small):
    got = Q.op2_toxicity(spark, small)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert got.where((F.col("score") >= 0.5) != (F.col("predicted") == 1)).count() == 0
