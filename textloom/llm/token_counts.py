"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest vocabulary entry at each place. The automaton is the vocabulary's trie. A
node's failure link leads to the node of what is left of its string once the greedy pieces are popped, and the number of
popped pieces is stored with it; so one pass over a word's bytes adds stored counts and never builds a piece. The pieces
of a word that ends at a node are stored as well.

The vocabulary is that of a byte-level file: entries with the leading mark begin a word, the others go on, and every byte
is an entry, so no word is unknown. Words are maximal runs outside space and tab to carriage return.

Defined cases: null, empty and blank texts have no words and no tokens. Texts are counted whole; memory follows the batch
and the bounded word table. Null doc_ids and repeated rows are rows like others; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import kernels as K
from textloom.llm.bpe import byte_symbols

MOST_WORDS = 200_000


class LongestMatch:
    """entries: the vocabulary as bytes. A word is matched after ``begin``."""

    def __init__(self, entries: list[bytes], begin: bytes = b" ") -> None:
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for entry in entries:
            node = 0
            for byte in entry:
                to = self.next[node].get(byte)
                if to is None:
                    to = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = to
            ends[node] = node > 0
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        level = [0]
        while level:  # by depth, so that shorter strings come first
            deeper = []
            for u in level:
                for byte, v in self.next[u].items():
                    deeper.append(v)
                    if ends[v]:
                        self.fail[v], self.popped[v] = 0, 1
                        continue
                    z, pops = self.fail[u], self.popped[u]
                    while z >= 0 and byte not in self.next[z]:
                        pops += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][byte], pops
            level = deeper
        #: Pieces of a string that ends at the node; -1 if it has none.
        self.rest = [0] * n
        for v in range(1, n):
            u, pieces = v, 0
            while u > 0:
                pieces += self.popped[u]
                u = self.fail[u]
            self.rest[v] = pieces if u == 0 else -1
        self.begin = begin

    def pieces(self, word: bytes) -> int:
        """How many pieces the word has; 1 (the unknown one) if it can't be split."""
        steps, fail, popped = self.next, self.fail, self.popped
        node, count = 0, 0
        for byte in self.begin + word:
            to = steps[node].get(byte)
            while to is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                to = steps[node].get(byte)
                if to is None and node == 0:
                    return 1
            node = to
        rest = self.rest[node]
        return count + rest if rest >= 0 else 1


class Counter(dict):
    """Word to pieces, in two generations of bounded size."""

    def __init__(self, automaton: LongestMatch) -> None:
        self.automaton, self.older = automaton, {}

    def __missing__(self, word: bytes) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.automaton.pieces(word)
        if len(self) >= MOST_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = n
        return n


OWNER = "token_counts"


@lru_cache(maxsize=1)
def automaton(path: str) -> LongestMatch:
    """One for each process, of a byte-level vocabulary file."""
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    vocab = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    return LongestMatch([bytes(byte_of[c] for c in label) for label in vocab])


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    K.keeps(OWNER, _drop)
    return Counter(automaton(path))


def _drop() -> None:
    counter.cache_clear()
    automaton.cache_clear()


def counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).cast(pa.large_binary()):
                found = (text.as_py() or b"").split()
                words.append(len(found))
                tokens.append(sum(map(known.__getitem__, found)))
            yield pa.record_batch({"doc_id": batch.column(0), "n_words": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return K.arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, n_tokens long", OWNER)
