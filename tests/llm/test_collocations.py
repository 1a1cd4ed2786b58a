import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import collocations as C


def brute(rows, least=30, share=80, top=2000):
    """The whole contract on plain counters; rows: text, lang."""
    words, counts = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in wanted.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    most[p[i : i + n]] = max(most[p[i : i + n]], a)
        rows_ = []
        for p, a in wanted.items():
            if 100 * most[p] >= share * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, phrase.decode(), -a, left, right, words[lang], -score) for r, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts(spark):
    def build(rows, slices=4):
        schema = "text string, lang string, n long, gram long, path string, `a.b` string, rank int"
        return spark.createDataFrame([(t, lang, 1, 2, "p", "d", 3) for t, lang in rows], schema).repartition(slices)

    return build


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def prose(seed, n, words=40, lines=True):
    r = random.Random(seed)
    vocabulary = ["The", "of", "é\x01", "x", "New", "york", "city", "hall", "#tag", "a.b", "日本", "l'été", "\x00z", *(f"w{i}" for i in range(30))]
    marks = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "; ", "\x0b", "!", " ? "]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(r.randint(0, words)):
            text += "new york city hall" if r.random() < 0.1 else r.choice(vocabulary) if r.random() < 0.7 else vocabulary[min(int(r.expovariate(0.5)), 42)]
            text += r.choice(marks)
        out.append((text, r.choice(["en", "fr", None, "und", ""])))
    return out


@pytest.mark.parametrize("least", [2, 5, 30])
def test_against_counters(texts, least):
    rows = prose(least, 400)
    got = rows_of(C.collocations(texts(rows), least))
    assert got == brute(rows, least) and len(got) >= 4


def test_long_texts_and_many_parts(spark, monkeypatch):
    rows = prose(9, 200) + [("the city hall of " * 3000, "en"), ("q" * 70_000, "en")]
    frame = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert rows_of(C.collocations(frame, 5)) == brute(rows, 5)
    monkeypatch.setattr(C, "PARTS", 1)
    assert rows_of(C.collocations(frame.repartition(40), 5, top=7)) == brute(rows, 5, top=7)


def test_shards_hold_all_texts():
    texts = [f"word{i} of text {i}" * (40 if i == 5 else 1) for i in range(60)] + [None, ""]
    batches = [pa.record_batch({"text": pa.array(texts[k : k + 7]), "lang": pa.array(["en"] * len(texts[k : k + 7]))}) for k in range(0, len(texts), 7)]
    found = list(C.shards(iter(batches), 300))
    assert len(found) > 5 and sum(len(s.texts) for s in found) == len(texts)
    assert sum(len(s.words.starts) for s in found) == sum(len((t or "").split()) for t in texts)


def test_tries_are_merged_whole():
    """Blocks of many shards, merged in steps, hold every path with its count."""
    bits = np.full(C.FILTER_BITS // 8, 255, np.uint8)
    rows, held = prose(3, 120), []
    for k in range(0, len(rows), 10):
        batch = pa.record_batch({"text": pa.array([t for t, _ in rows[k : k + 10]]), "lang": pa.array([x for _, x in rows[k : k + 10]], pa.string())})
        for shard in C.shards(iter([batch])):
            alive = list(shard.alive(bits, C.DEPTH))
            trie, hashes = C._trie(shard, [at for _, at in alive], [h for h, _ in alive[:2]])
            parts = list(C._blocks(trie, hashes, 5))
            assert [k for k, _ in parts] == sorted({int(h % np.uint64(5)) for h in hashes})
            held += [pa.ipc.open_stream(block).read_all() for _, block in parts]
    half = len(held) // 2
    for merged in (C._merge(held), C._merge([C._serial(C._merge(held[:half])), *held[half:]])):
        names = merged.names.to_pylist()
        got = {tuple(names[x] for x in path if x >= 0): n for path, n in zip(merged.paths.tolist(), merged.counts.tolist(), strict=True)}
        want = Counter()
        for text, lang in rows:
            folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
                w = re.findall(r"[^ \t]+", piece)
                for n in range(1, 5):
                    want.update(("und" if lang is None else lang, *w[i : i + n]) for i in range(len(w) - n + 1))
        assert got == want


def test_one_first_word_in_many_ranges(spark):
    """Phrases of one first word are in several ranges: its count is looked up."""
    rows = [(f"the a{i % 60} b{j} c{j}", "en") for i in range(240) for j in range(2)]
    assert rows_of(C.collocations(spark.createDataFrame(rows, "text string, lang string"), 2)) == brute(rows, 2)


def test_scores_beyond_64_bits(spark):
    nodes = spark.createDataFrame([("en", ["a", "b"], 10**14, [10**14 + 7], [10**14 + 3])], "lang string, path array<string>, n long, lefts array<long>, rights array<long>")
    assert C._scored(nodes).first().score == 2000000 * 10**14 // (2 * 10**14 + 10)


def test_edges(spark, texts):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    blank = [(None, None), ("", "en"), (" \t. ,", None), (None, "en")]
    assert C.collocations(texts(blank)).count() == 0
    same = [("Big Red Dog", "en")] * 40 + blank
    assert rows_of(C.collocations(texts(same))) == brute(same) == [("en", 1, "big red dog", 40, 40, 40, 120, 1000000)]
    exactly = [("aa bb", None)] * 30 + [("aa cc", "und")] * 29
    assert rows_of(C.collocations(texts(exactly))) == brute(exactly)
    ties = [(f"k{i} m{i}", "en") for i in range(50)] * 30
    got = C.collocations(texts(ties), top=20).orderBy("rank").collect()
    assert [r.phrase for r in got] == sorted(f"k{i} m{i}" for i in range(50))[:20]


def test_query_columns(spark, small):
    from textloom.llm import queries

    df = queries.op11_collocations(spark, small)
    assert df.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
