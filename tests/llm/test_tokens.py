import hashlib
import json
import random
import unicodedata

import numpy as np
import pytest
from tokenizers import Tokenizer

from textloom.llm import bpe, token_counts
from textloom.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def texts():
    r = random.Random(8)
    some = "aaabcdeehinorst'lm! .\n<|>ÉéüßñΣ日0 1\t"
    out = ["".join(r.choice(some) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    out += ["Hello  world's ÉTÉ 123 <|endoftext|>x", "a<|startoftext|>B İ", "ét\u0085\u00a0x \ufeffy\u2028 ΑΣ ΑΣΑ", "'S don'T ſ", "日本語 ½²x_y", "\x1c\x1d\x00 a", "e\u0301", "a" * 500, "=" * 100, "Straße ǅ"]
    return out


def test_against_the_library(library):
    codec = bpe.Codec(vocabulary("word_bpe_49k.json"))
    for t, got in zip(texts(), codec.encode(texts()), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert list(got) == want, t
        assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


def test_automaton_against_merging():
    """Every word over a small alphabet, against merges applied one by one."""
    r = random.Random(4)
    for _ in range(15):
        merges, known = [], ["a", "b", "c"]
        while len(merges) < 12:
            pair = (r.choice(known), r.choice(known))
            if "".join(pair) not in known:
                merges.append(pair)
                known.append("".join(pair))
        machine = bpe.Automaton(["a", "b", "c"], merges)
        together = []
        for _ in range(300):
            word = [r.choice("abc") for _ in range(r.randint(1, 12))]
            parts = list(word)
            for u, v in merges:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (u, v):
                        parts[i : i + 2] = [u + v]
                    i += 1
            symbols = ["abc".index(c) for c in word]
            assert [machine.labels[t] for t in machine.read_one(symbols)] == parts, (merges, word)
            together.append((symbols, parts))
        together.append(([], []))
        offs = np.concatenate([[0], np.cumsum([len(x) for x, _ in together])])
        tokens, first = machine.read(np.array([c for x, _ in together for c in x]), offs)
        for k, (_, parts) in enumerate(together):
            assert [machine.labels[t] for t in tokens[first[k] : first[k + 1]]] == parts


def test_bounded_tables(library, monkeypatch):
    monkeypatch.setattr(bpe, "ARCS", 16)
    monkeypatch.setattr(bpe, "MOST_WORDS", 5)
    monkeypatch.setattr(bpe, "LONG", 9)
    codec = bpe.Codec(vocabulary("word_bpe_49k.json"))
    for t in texts()[:300]:
        assert list(codec.encode([t])[0]) == library.encode(t, add_special_tokens=False).ids
        assert len(codec.words) <= 5 + len(t) and len(codec.older) <= 5 + 60


def test_combining_marks_like_the_library(library):
    """Marks of all ages, in orders and beside letters that some of them are composed with."""
    r = random.Random(12)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    assert len(marks) > 900
    out = []
    for k in range(4000):
        some = [r.choice(marks), r.choice(sorted(bpe.NEWER_MARKS)), r.choice("\u0301\u0327\u0316\u0345\u0334"), r.choice("aeqo\u11935 \U00011935")]
        r.shuffle(some)
        out.append("e" + "".join(some) + r.choice(marks))
    out += ["a" + m + "\u0301" for m in marks] + ["a\u0301" + m for m in marks]
    codec = bpe.Codec(vocabulary("word_bpe_49k.json"))
    for t, got in zip(out, codec.encode(out), strict=True):
        assert list(got) == library.encode(t, add_special_tokens=False).ids, ascii(t)


def test_hash_tables():
    r = np.random.default_rng(3)
    for n in (0, 1, 5, 1000, 40_000):
        keys = np.unique(r.integers(0, 1 << 40, n))
        table = bpe.Table(keys, np.arange(len(keys)))
        assert (table.find(keys) == np.arange(len(keys))).all()
        others = np.setdiff1d(r.integers(0, 1 << 40, n + 3), keys)
        assert (table.find(others) == -1).all()


def test_digests(make, edge_rows, library):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(make(edge_rows), vocabulary("word_bpe_49k.json")).collect()}
    want = set()
    for i, t, _ in edge_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.digests(make(edge_rows).limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_encode_keeps_columns(make, edge_rows, library):
    docs = make(edge_rows)
    out = bpe.encode(docs, vocabulary("word_bpe_49k.json"))
    assert out.columns == [c for c in docs.columns if c not in ("text",)] + ["n_tokens", "ids"]
    assert sorted((r.doc_id or -1, r.ids) for r in out.collect()) == sorted((i or -1, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in edge_rows)


def greedy(word, vocab, most):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(min(len(word), at + most), at, -1) if word[at:e] in vocab), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_token_counts(make, edge_rows):
    path = vocabulary("byte_bpe_50k.json")
    byte = {c: b for b, c in enumerate(bpe.byte_symbols())}
    vocab = {bytes(byte[c] for c in label) for label in json.load(open(path, encoding="utf-8"))["model"]["vocab"]}
    most = max(map(len, vocab))
    got = sorted((r.doc_id or -1, r.n_words, r.n_tokens) for r in token_counts.counts(make(edge_rows), path).collect())
    want = sorted((i or -1, len((t or "").encode().split()), sum(greedy(b" " + w, vocab, most) for w in (t or "").encode().split())) for i, t, _ in edge_rows)
    assert got == want
    assert token_counts.counts(make(edge_rows).limit(0), path).count() == 0


def test_longest_match_on_small_vocabularies():
    r = random.Random(6)
    for _ in range(60):
        vocab = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(12)} | {b"_"}
        if r.random() < 0.7:
            vocab |= {b"a", b"b", b"c"}
        machine = token_counts.LongestMatch(sorted(vocab), b"_")
        for _ in range(200):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(0, 14)))
            assert machine.pieces(word) == greedy(b"_" + word, vocab, 5), (vocab, word)


def test_pieces_of_ascii_words():
    """The shorter pattern parts ASCII words as the one of all characters does."""
    codec, r = bpe.Codec(vocabulary("word_bpe_49k.json")), random.Random(5)
    for _ in range(20_000):
        word = "".join(r.choice("'''strevmld01a-.,_\x00\x1c~!") for _ in range(r.randint(1, 12)))
        assert bpe._ASCII_PIECES.findall(word) == codec.split.findall(word), word
