"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens: a state is the last token read, an arc the next one. It starts with one state for every base
symbol and all arcs. Each merge (u, v) -> w, in order, is a gadget: the arc v leaves state u; a new state w gets the arcs
that state v had; every state with an arc u gets an arc w. After the last merge the only path that spells a string is its
encoding, so after each prefix of a word exactly one state is reached: the automaton is deterministic.

It is compiled into arrays: the trie that spells the tokens (its edges in a hash table), and for each state the gadget that
made it, what that copied its arcs from, and which arc it removed. Arcs are quadratic in number, so a gadget's copies are not
written out: the transition table holds the arcs that texts have asked for, each computed once from the gadgets and kept in
a table of fixed size. Encoding reads the words of a batch at the same time, symbol by symbol: of the tokens that end here,
found by the trie, the one whose arc leaves the state before it is the new state. Decoding emits the labels of the arcs.

Defined cases: null texts are empty, and an empty text has no tokens and the empty decoding. Texts are processed whole;
memory follows the chunk of texts and the bounded tables. Special tokens in a text are single tokens, as in the tokenizer
file. Null doc_ids and repeated rows are rows like others; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textloom.llm import kernels as K

MOST_WORDS = 100_000
#: Places of the transition table, and characters of text that are read at a time.
ARCS, SLICE = 1 << 18, 1 << 20
#: Words of more symbols are read one by one.
LONG = 256
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


#: Letters and numbers that Unicode 16 has beyond 15.1, as ranges; and letters whose small forms Python doesn't know yet.
NEWER = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
_CASES = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_CASES |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}


@lru_cache(maxsize=1)
def unknown() -> str:
    """Code points that are no letters or numbers in Unicode 16, though a newer table may say so, as a character class."""
    newer = {c for a, b in NEWER for c in range(a, b + 1)}
    out, first = [], -1
    for c in range(0x110001):
        free = c < 0x110000 and unicodedata.category(chr(c)) == "Cn" and c not in newer
        if free and first < 0:
            first = c
        elif not free and first >= 0:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = -1
    return "".join(out)


_U = np.uint64
_SPREAD = _U(0x9E3779B97F4A7C15)
_NEVER = 1 << 40


class Table:
    """A hash table from integers to integers as two arrays, made once; what it doesn't have is -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 2.5).bit_length())
        self.shift = _U(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several keys for one place one stays
            mine = self.keys[at] == keys[left]
            self.values[at[mine]] = values[left[mine]]
            at, left = (at[~mine] + 1) & ((1 << bits) - 1), left[~mine]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(_U) * _SPREAD >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Automaton:
    """Compiled from base symbols and merges, each of which makes a string of its own; tokens are positions in ``labels``."""

    def __init__(self, base: list[str], merges: list[tuple[str, str]], end: str = "") -> None:
        self.labels = list(base)
        number = {s: i for i, s in enumerate(base)}
        made, left, right = [-1] * len(base), [0] * len(base), [0] * len(base)
        gone: dict[int, int] = {}
        for k, (u, v) in enumerate(merges):
            if u not in number or v not in number:  # a part that no path ever has
                continue
            a, b = number[u], number[v]
            if not _arc(a, b, k, made, left, right, gone):  # no path has this pair any more
                continue
            gone[a << 20 | b] = k
            number.setdefault(u + v, len(self.labels))
            self.labels.append(u + v)
            made.append(k)
            left.append(a)
            right.append(b)
        # twice the number of the merge, so that a gadget's own removal can count for its copies
        self.made, self.left, self.right = 2 * np.array(made), np.array(left), np.array(right)
        self.gone = Table(np.array(list(gone), np.int64), 2 * np.array(list(gone.values()), np.int64))
        place = {c: i for i, c in enumerate(base)}
        edges, tokens = {}, [-1]
        for i, label in enumerate(self.labels):
            node = 0
            for c in label if not (end and label.endswith(end)) else [*label[: -len(end) - 1], label[-len(end) - 1 :]]:
                edge = node << 10 | place[c]
                if edge not in edges:
                    edges[edge] = len(tokens)
                    tokens.append(-1)
                node = edges[edge]
            tokens[node] = i
        self.edges = Table(np.array(list(edges), np.int64), np.array(list(edges.values())))
        self.token = np.array(tokens, np.int32)
        self.asked = np.full(ARCS, -1, np.int64)  # state and token of the arcs in the transition table
        self.open = np.zeros(ARCS, bool)

    def arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Which of the tokens the states have an arc for."""
        keys = states << 20 | tokens
        at = (keys.astype(_U) * _SPREAD >> _U(64 - ARCS.bit_length() + 1)).astype(np.int64)
        out = self.open[at]
        new = np.flatnonzero(self.asked[at] != keys)
        if len(new):
            out[new] = self._computed(states[new], tokens[new])
            self.asked[at[new]] = keys[new]  # of several for one place the last one stays, here
            self.open[at[new]] = out[new]  # and here
        return out

    def _computed(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The arcs, from the gadgets: back from what was copied to what it was copied from, as long as none removed it."""
        out = np.zeros(len(states), bool)
        p, t, upto, left = states.copy(), tokens.copy(), np.full(len(states), _NEVER), np.arange(len(states))
        while len(left):
            removed = self.gone.find(p << 20 | t)
            stays = (removed < 0) | (removed >= upto)
            p, t, upto, left = p[stays], t[stays], upto[stays], left[stays]
            by_state = self.made[p] > self.made[t]  # the state is newer: its arcs are those of its second part then
            first = ~by_state & (self.made[t] < 0)
            out[left[first]] = True
            upto = np.where(by_state, self.made[p], self.made[t] + 1)
            p, t = np.where(by_state, self.right[p], p), np.where(by_state, t, self.left[t])
            p, t, upto, left = p[~first], t[~first], upto[~first], left[~first]
        return out

    def read(self, symbols: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the paths that spell the words, and the first token of each word; symbols of all words, and where each begins."""
        n = np.diff(offs)
        order = np.argsort(-n, kind="stable")  # longer words first, so that those still read are a prefix
        begin, size = offs[:-1][order], n[order]
        states = np.full((len(symbols) + len(n)), -1, np.int64)  # after each prefix: place of the word plus its number
        come = np.zeros(len(states), np.int64)  # the prefix before that token
        where = begin + order
        word = start = node = np.zeros(0, np.int64)
        for i in range(int(size[0]) if len(size) else 0):
            reading = int(np.searchsorted(-size, -i, "left"))
            keep = word < reading
            word, start, node = word[keep], start[keep], node[keep]
            fresh = np.arange(reading)
            word, start, node = np.concatenate([word, fresh]), np.concatenate([start, np.full(reading, i)]), np.concatenate([node, np.zeros(reading, np.int64)])
            node = self.edges.find(node << 10 | symbols[begin[word] + i]).astype(np.int64)
            alive = node >= 0
            word, start, node = word[alive], start[alive], node[alive]
            ends = np.flatnonzero(self.token[node] >= 0)
            token, of, since = self.token[node[ends]].astype(np.int64), word[ends], start[ends]
            fits = since == 0
            ask = np.flatnonzero(~fits)
            fits[ask] = self.arcs(states[where[of[ask]] + since[ask]], token[ask])
            at = where[of[fits]] + i + 1
            states[at], come[at] = token[fits], since[fits]
        # back along the paths
        at, alive, found, owner = size.copy(), np.flatnonzero(size > 0), [], []
        while len(alive):
            place = where[alive] + at[alive]
            found.append(states[place])
            owner.append(order[alive])
            at[alive] = come[place]
            alive = alive[at[alive] > 0]
        if not found:
            return np.zeros(0, np.int64), np.zeros(len(n) + 1, np.int64)
        owners = np.concatenate(owner)[::-1]
        by = np.argsort(owners, kind="stable")
        return np.concatenate(found)[::-1][by], np.searchsorted(owners[by], np.arange(len(n) + 1))

    @cached_property
    def _plain(self) -> tuple[dict[int, int], list[int]]:
        """The trie's edges and tokens, for words that are read one by one."""
        there = self.edges.keys >= 0
        return dict(zip(self.edges.keys[there].tolist(), self.edges.values[there].tolist(), strict=True)), self.token.tolist()

    def read_one(self, symbols: list[int]) -> list[int]:
        """Tokens of the path that spells one word, for words that are long; the same steps as those of read."""
        edges, token = self._plain
        states, come = [-1] * (len(symbols) + 1), [0] * (len(symbols) + 1)
        alive: list[tuple[int, int]] = []
        known: dict[int, bool] = {}
        for i, c in enumerate(symbols):
            steps = [(since, edges.get(node << 10 | c, -1)) for since, node in (*alive, (i, 0))]
            alive = [x for x in steps if x[1] >= 0]
            for since, node in alive:
                t = token[node]
                if t < 0:
                    continue
                key = states[since] << 20 | t
                if since and key not in known:
                    if len(known) >= ARCS:
                        known.clear()
                    known[key] = bool(self.arcs(np.array([states[since]]), np.array([t]))[0])
                if not since or known[key]:
                    states[i + 1], come[i + 1] = t, since
        out, at = [], len(symbols)
        while at:
            out.append(states[at])
            at = come[at]
        return out[::-1]


def _arc(p: int, t: int, upto: float, made: list[int], left: list[int], right: list[int], gone: dict[int, int]) -> bool:
    """May t follow p, counting the gadgets before ``upto``?"""
    while True:
        if gone.get(p << 20 | t, upto) < upto:
            return False
        if made[p] > made[t]:
            upto = made[p]
            p = right[p]
        elif made[t] < 0:
            return True
        else:
            upto = made[t] + 0.5  # the gadget's own removal counts for what it copies to the other states
            t = left[t]


class Codec:
    """A tokenizer file's normaliser, pre-splitting and vocabulary around the automaton of its merges."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
            raise ValueError("a BPE vocabulary with word ends is needed")
        end = model["end_of_word_suffix"]
        self.byte = byte_symbols()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton([*self.byte, *(c + end for c in self.byte)], merges, end)
        self.ids = np.array([model["vocab"][label] for label in self.automaton.labels], "<u4")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label_of = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letter, number = (rf"[\p{{{kind}}}--[{unknown()}]]" for kind in "LN")
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|(?:(?![{_WHITE}])(?!{letter})(?!{number}).)+", regex.V1 | regex.DOTALL)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pieces(self, word: str) -> list[str]:
        """What lies between white space and isn't of letters only, pre-split."""
        if word[:-1].isalpha() and word[-1] in _MARKS:  # no contraction, so the mark is a piece of its own
            return [word[:-1], word[-1]]
        return _ASCII_PIECES.findall(word) if word.isascii() else self.split.findall(word)

    def _learn(self, words: set[str]) -> None:
        """Encodes new words into the table."""
        table = self.words
        whole = [w for w in words if w.isalpha()]
        parts = {w: self._pieces(w) for w in words.difference(whole)}
        pieces = list({*whole, *chain.from_iterable(parts.values())}.difference(table))
        # pieces have no spaces, so all of them are read as one text
        data = np.frombuffer(" ".join(pieces).encode("utf-8", "surrogatepass"), np.uint8)
        ends = (np.append(np.flatnonzero(data == 32), len(data)) - np.arange(len(pieces)))[: len(pieces)]
        offs = np.append(0, ends)
        symbols = data[data != 32].astype(np.int64)
        symbols[ends - 1] += 256  # the same byte at the end of a word
        table.update(zip(pieces, self._ids(symbols, offs), strict=True))
        table.update([(w, b"".join([table[p] for p in found])) for w, found in parts.items()])

    def _ids(self, symbols: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Ids of each piece, as bytes."""
        long = np.flatnonzero(np.diff(offs) > LONG)
        short = np.diff(offs) <= LONG
        if len(long):
            inside = np.repeat(short, np.diff(offs))
            tokens, first = self.automaton.read(symbols[inside], np.append(0, np.cumsum(np.diff(offs) * short)))
        else:
            tokens, first = self.automaton.read(symbols, offs)
        ids, ends = self.ids[tokens].tobytes(), (4 * first).tolist()
        out = [ids[lo:hi] for lo, hi in pairwise(ends)]
        for k in long.tolist():
            out[k] = self.ids[self.automaton.read_one(symbols[offs[k] : offs[k + 1]].tolist())].tobytes()
        return out

    def _spoken(self, text: str) -> list[str]:
        """The words of a text as the normaliser leaves them."""
        if not text.isascii():
            if _FAR.search(text):
                text = "".join(p if p in NEWER_MARKS else unicodedata.normalize("NFC", p) for p in _NEWER.split(text)).translate(_CASES)
            else:
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # small sigma everywhere: letters are lowered one by one
                text = text.replace("Σ", "σ")
        text = text.lower()
        return text.split() if not _SEPARATORS.search(text) else [w for w in _SPACES.split(text) if w]

    def encode(self, texts: list[str | None]) -> list[array]:
        """Ids of the whole texts."""
        parts = [[] if not t else [t] if self.parts is None or "<|" not in t else self.parts.split(t) for t in texts]
        spoken = [[self.special[p] if p in self.special else self._spoken(p) for p in found] for found in parts]
        seen: set[str] = set().union(*(words for found in spoken for words in found if isinstance(words, list)))
        if len(self.words) > MOST_WORDS:  # two generations; the words of a chunk fit whatever their number
            self.older, self.words = self.words, {}
        new = seen - self.words.keys()
        again = new & self.older.keys()
        self.words.update(zip(again, map(self.older.__getitem__, again), strict=True))
        if new := new - again:
            self._learn(new)
        out = []
        for found in spoken:
            ids = array("I")
            for words in found:
                if isinstance(words, list):
                    ids.frombytes(b"".join(map(self.words.__getitem__, words)))
                else:
                    ids.append(words)
            if sys.byteorder == "big" and len(ids):
                ids.byteswap()
            out.append(ids)
        return out

    def decode(self, ids: array) -> str:
        """The labels of the arcs, parted by spaces as the file names no decoder."""
        return " ".join(map(self.label_of.__getitem__, ids))


_MARKS = frozenset(".,;:!?")
#: The pre-split of words of small ASCII letters, without tables of other characters.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to Python, marks to the tokenizer
_SPACES = re.compile(f"[{_WHITE}]+")
#: Combining marks, and one second half, that Unicode has since version 10: to the tokenizer, whose normaliser has the tables
#: of version 9, nothing is composed with them or moved past them (fixed values).
NEWER_MARKS = frozenset(
    chr(c)
    for a, b in (
        (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE),
        (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070),
        (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
        (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
        (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
    )
    for c in range(a, b + 1)
)
_NEWER = re.compile("([" + "".join(sorted(NEWER_MARKS)) + "])")
_FAR = re.compile("[\u07fd-\U0010ffff]")  # all of those, and of the letters in _CASES, are there


OWNER = "bpe"


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """One for each process, while it encodes; built from the file, which every executor has at the same place."""
    K.keeps(OWNER, codec.cache_clear)
    return Codec(path)


def little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Runs of rows of about SLICE characters, and their texts."""
    lo, held, size = 0, [], 0
    for k, value in enumerate(batch.column(column)):
        held.append(value.as_py())
        size += len(held[-1] or "")
        if size >= SLICE or k == batch.num_rows - 1:
            yield batch.slice(lo, k + 1 - lo), held
            lo, held, size = k + 1, [], 0


def encode(docs: DataFrame, path: str) -> DataFrame:
    """All columns of docs but text, then n_tokens and the ids of the whole text; clashing columns give way."""
    keep = [c for c in docs.columns if c not in ("text", "n_tokens", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for part, texts in slices(batch, batch.num_columns - 1):
                ids = bpe.encode(texts)
                flat = array("I")
                offsets = array("i", [0])
                for x in ids:
                    flat.extend(x)
                    offsets.append(len(flat))
                values = pa.array(memoryview(flat).cast("B").cast("i") if len(flat) else [], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.record_batch([*(part.column(c) for c in keep), pa.array([len(x) for x in ids], pa.int64()), lists], names=[*keep, "n_tokens", "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return K.arrow(docs.select(*(f"`{c}`" for c in keep), "text"), run, f"{fields}{', ' if fields else ''}n_tokens long, ids array<int>", OWNER)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for part, texts in slices(batch, 1):
                n, first, second = [], [], []
                for ids in bpe.encode(texts):
                    n.append(len(ids))
                    first.append(hashlib.sha256(little_endian(ids)).hexdigest())
                    second.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                yield pa.record_batch({"doc_id": part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return K.arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", OWNER)
