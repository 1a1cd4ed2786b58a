import re
from collections import Counter

import numpy as np
import pyarrow as pa

from textloom.llm import kernels as K
from textloom.llm import quality_classifier as C
from textloom.llm import quality_rules as R
from textloom.llm import queries as Q

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = re.findall(rf"[^{SPACE}]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(rf"[^{SPACE}]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts(make, edge_rows, prose):
    rows = edge_rows + [(100 + i, t, "s") for i, t in enumerate(["a b c d e a b c d e f", "x\nx\n\n x\nx", "\n\n", "é é\né é", "\u00a0 no break", prose(300, 1) + "\n" + prose(300, 1), "a b c d e\na b c d e\na"])]
    got = R.judge(make(rows)).toPandas()
    assert len(got) == len(rows)
    have = Counter((None if i != i else int(i), *map(int, r)) for i, *r in got[["doc_id", *R.BASE]].itertuples(index=False))
    assert have == Counter((i, *brute(t)) for i, t, _ in rows)
    failed = (got.n_words < 10) | (100 * got.n_repeat_words > 20 * got.n_words)
    assert (got.base_failed == failed).all() and not (got.kept & failed).any()
    assert R.judge(make(rows).limit(0)).count() == 0


def test_base_counts_of_chunks():
    """Counts don't depend on how texts are cut into chunks."""
    texts = [f"w{i % 7} " * (i % 50) + "\nline\nline" for i in range(200)]
    whole = [R.measure(t) for t in K.chunks(pa.array(texts))]
    parts = [R.measure(t) for t in K.chunks(pa.array(texts), most=64)]
    assert len(whole) == 1 and len(parts) > 50
    for k in whole[0]:
        assert np.array_equal(whole[0][k], np.concatenate([p[k] for p in parts])), k


def test_expectation_maximisation_against_plain_loops():
    r = np.random.default_rng(2)
    good = r.random(3000) < 0.8
    v = np.where(r.random((3000, len(R.RULES))) < 0.3, 1, np.where(r.random((3000, len(R.RULES))) < np.where(good, 0.95, 0.25)[:, None], 2, 0))
    patterns, counts = np.unique(v @ 3 ** np.arange(len(R.RULES)), return_counts=True)
    posterior = R.estimate(patterns, counts.astype(float))
    judged = posterior[np.searchsorted(patterns, v @ 3 ** np.arange(len(R.RULES)))] >= 0.5
    assert (judged == good).mean() > 0.97
    # a fixed point: one plain round over rows changes nothing
    p = posterior[np.searchsorted(patterns, v @ 3 ** np.arange(len(R.RULES)))]
    tables = np.zeros((2, len(R.RULES), 3))
    for c, w in ((0, 1 - p), (1, p)):
        for k in range(len(R.RULES)):
            for value in range(3):
                tables[c, k, value] = w[v[:, k] == value].sum() + R.PRIOR_WEIGHT * len(v) * R.PRIOR[c][value] + 1e-3
    tables /= tables.sum(2, keepdims=True)
    log = [np.log(w.mean()) + sum(np.log(tables[c, k, v[:, k]]) for k in range(len(R.RULES))) for c, w in ((0, 1 - p), (1, p))]
    assert np.abs(1 / (1 + np.exp(log[0] - log[1])) - p).max() < 1e-6


def test_rules_on_labels(spark, small):
    judged = Q.op3_quality_rules(spark, small)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    both = judged.join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert (both.kept == (both.quality == 1)).mean() > 0.97


def test_isotonic():
    r = np.random.default_rng(0)
    for _ in range(20):
        y, w = r.random(30), r.random(30) + 0.1
        out = C.isotonic(y, w)
        assert (np.diff(out) >= -1e-12).all() and np.isclose((out * w).sum(), (y * w).sum())
        other = np.sort(y)
        assert (w * (out - y) ** 2).sum() <= (w * (other - y) ** 2).sum() + 1e-9
    assert len(C.isotonic(np.zeros(0), np.zeros(0))) == 0


def test_normal_equations_against_one_matrix(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(500, len(C.NAMES)))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.7).astype(int)
    rows = spark.createDataFrame([(i % 2, x[i].tolist(), int(y[i])) for i in range(500)], "half int, x array<double>, y int").repartition(7)
    model = C.fit(rows, 32)
    f = C.Fourier(x.mean(0), x.std(0) + 1e-6, 32)
    z = f(x)
    w = np.linalg.solve(z.T @ z + C.RIDGE * 500 * np.eye(33), z.T @ y)
    assert np.allclose(model.weights, w, atol=1e-6)
    s = model.score(x)
    assert ((s >= 0) & (s <= 1)).all() and ((s >= 0.5) == y).mean() > 0.65


def test_kernel_approximation():
    x = np.random.default_rng(3).normal(size=(40, len(C.NAMES)))
    z = C.Fourier(np.zeros(len(C.NAMES)), np.ones(len(C.NAMES)), 8192)(x)[:, :-1]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-d / 2 / len(C.NAMES))).max() < 0.08


def test_classifier_held_out(spark, small):
    got = Q.op6_quality_classifier(spark, small)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    both = got.join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (both.predicted == both.quality).mean() > 0.9


def test_classifier_edges(spark, make, edge_rows):
    labels = spark.createDataFrame([(1, 1), (9, 0), (6, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    got = C.score(make(edge_rows), labels).toPandas()
    assert len(got) == len(edge_rows) and got.score.between(0, 1).all()
    assert set(C.score(make(edge_rows), labels.where("false")).toPandas().score) == {0.0}
    assert set(C.score(make(edge_rows), labels.where("quality = 1")).toPandas().score) == {1.0}
    assert C.score(make(edge_rows).limit(0), labels).count() == 0


ODD = [None, "", "  ", "Alpha, BETA: gamma! the the of 12 4x é日 don't e-mail the; a\u00a0b ??", "x" * 70, "The\nThe\nthe end.\n\n# $ % | <b>", "a b c d e a b c d e f\na b c d e", "...", ".", "A.", "1.5, 2;"]


def by_hand(text):
    """Counts of the rules and statistics of the classifier, in plain Python."""
    text = text or ""
    words = re.findall(rf"[^{SPACE}]+", text)
    n_words, word_chars, n_symbols, n_dup, n_repeat = brute(text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    bare = [w[:-1] if len(w) > 1 and w[-1] in ".,;:!?" else w for w in words]
    lower = "".join(c.lower() if c.isascii() else c for c in "\n".join(bare)).split("\n") if bare else []
    stops = set(" ".join(R.STOP_WORDS).split())
    letters = lambda c: c.isascii() and c.isalpha()
    m = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "n_lines": len(lines),
        "n_upper": sum(letters(c) and c.isupper() for c in text), "n_letters": sum(map(letters, text)), "n_shouts": text.count("!") + text.count("?"),
        "n_spelt": sum(all(letters(c) or not c.isascii() or c in "'-" for c in w) for w in bare), "n_stop": sum(w in stops for w in lower),
    }
    data, n = text.encode(), max(1, n_words)
    x = [
        np.log1p(n_words), np.log1p(m["n_letters"]), word_chars / n, n_symbols / n, len(lines) / n, n_dup / max(1, len(lines)), n_repeat / n, m["n_upper"] / max(1, m["n_letters"]),
        m["n_shouts"] / n, m["n_spelt"] / n, m["n_stop"] / n, np.log1p(max((len(w.encode()) for w in words), default=0)), sum(48 <= b < 58 for b in data) / max(1, len(data)),
        sum(b > 127 for b in data) / max(1, len(data)), sum(text.count(c) for c in ".,;:") / n, len(set(words)) / n,
    ]
    return m, x


def test_measures_and_statistics_by_hand(prose, edge_rows):
    texts = ODD + [t for _, t, _ in edge_rows] + [prose(50 + i, i) for i in range(20)]
    for most in (1 << 20, 40):
        got, x = {}, []
        for t in K.chunks(pa.array(texts, pa.string()), most=most):
            for k, v in R.measure(t).items():
                got.setdefault(k, []).extend(v.tolist())
            x.append(C.statistics(t))
        want = [by_hand(t) for t in texts]
        for k in got:
            assert got[k] == [m[k] for m, _ in want], k
        assert np.allclose(np.concatenate(x), [v for _, v in want])


def test_votes_by_hand():
    r = np.random.default_rng(4)
    m = {k: r.integers(0, 60, 400) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_spelt", "n_stop")}
    got = R.votes(m)
    for i in range(400):
        for k, (name, what, of, good, bad) in enumerate(R.RULES):
            whole = m[of][i] if of else 1
            share = m[what][i] / max(whole, 1)
            if name in ("spelling", "stop words", "length"):  # more is better
                vote = 0 if share < bad else 2 if share >= good else 1
            else:
                vote = 0 if share >= bad else 2 if good is not None and share <= good else 1
            assert got[i, k] == (1 if whole == 0 else vote), name


def test_sums_as_a_tree(spark):
    rows = spark.createDataFrame([(i % 2, [float(i)] * len(C.NAMES), 1) for i in range(300)], "half int, x array<double>, y int").repartition(70)
    got = C._sums(rows, lambda x, y: np.array([len(x), x[:, 0].sum()]))
    assert {k: v.tolist() for k, v in got.items()} == {k: [150, float(sum(range(k, 300, 2)))] for k in (0, 1)}
