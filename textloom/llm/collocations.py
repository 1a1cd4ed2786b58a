"""Phrase collocations from count tries.

Texts are cut into pieces at PIECES and pieces into words; everything is counted per language. A shard is the texts of a task, up
to TRIE_BYTES at a time. It counts its phrases of up to DEPTH words in a trie: a node is its parent and one more word. A trie is
serialised in the order of its paths, a node as its depth, its last word and its count, in one block for each prefix range: nodes of
two words and more are in the range of a hash of their first two, words in that of their own. A task merges the blocks of all shards
for its ranges, walks along the merged trie, where ancestors come first, and so gives each phrase the counts of its left parts. Links
from each phrase to the one without its first word give the right parts, and the count of a first word is looked up.

Most phrases of a corpus are rare, and no part of a frequent phrase is. So three passes come first that count hashes of words, of
pairs of frequent words, and of longer runs of frequent pairs. Hashes with LEAST occurrences or more set bits of a filter of
FILTER_BITS, whatever the corpus; a shard's trie has no nodes outside it. A hash counts at least what its phrases do, so no
frequent phrase is ever left out, and a filter too small for a corpus lets rare phrases through, which are dropped when merged.

Defined cases: null texts are empty and have no phrases; a null language is UNKNOWN, together with rows that say so. Texts are
taken whole, those longer than a shard alone. Repeated rows count as often as they come. Scores are floors of exact quotients; of
equal scores the cut of fewer words counts, and the higher count, then the lesser phrase, comes first. A table without words gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.common import cut, tidy

DEPTH, LEAST, WHOLE, TOP = 4, 30, 80, 2000
UNKNOWN = "und"
PIECES = b".,;:!?\n\x0b\x0c\r"
#: Bytes of text of a shard that counts hashes, and of one that makes a trie, which takes more memory.
SHARD_BYTES, TRIE_BYTES = 8 << 20, 4 << 20
#: Bits of the filter, and those of one row of it on its way to the driver.
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 16
#: Parts of a language's candidates that are ranked apart first, prefix ranges at least, and nodes that a merging task holds
#: unmerged.
PARTS, RANGES, HELD = 64, 128, 1 << 19
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[list(PIECES)] = 10


@dataclass
class Shard:
    """The words of some texts: their hashes, which with the one before in a piece, and each one's language."""

    texts: K.Texts
    words: K.Words
    langs: list[str]
    lang_of: np.ndarray  # of each word
    follows: np.ndarray  # the word before is of the same piece

    @classmethod
    def of(cls, texts: K.Texts, langs: pa.Array) -> Shard:
        texts = K.Texts(texts.first, _FOLD[texts.data], texts.offs)
        words = K.words(texts)
        named = langs.fill_null(UNKNOWN).dictionary_encode()
        breaks = np.cumsum(texts.data == 10, dtype=np.int32)[words.starts]
        text_of = words.text_of
        follows = np.zeros(len(words.starts), bool)
        follows[1:] = (breaks[1:] == breaks[:-1]) & (text_of[1:] == text_of[:-1])
        return cls(texts, words, named.dictionary.to_pylist(), named.indices.to_numpy()[text_of], follows)

    def hashes(self) -> Iterator[np.ndarray]:
        """Of each word and its next ones, a hash of the phrase of 1, 2, ... words that begins there (whether it is one or not)."""
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs] or [0], _U)
        word = self.texts.span_hash(self.words.starts, self.words.ends)
        found = K.mix(word ^ seeds[self.lang_of])
        yield found
        for d in range(1, DEPTH):
            found = K.mix(found[: max(0, len(word) - d)] * _U(0xD6E8FEB86659FD93) + word[d:])
            yield found

    def alive(self, bits: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2, ... depth words: the phrases' hashes, and the places of those whose hashes and whose parts' the filter has."""
        there: np.ndarray | None = None
        for d, found in zip(range(depth), self.hashes(), strict=False):
            at = np.arange(len(found)) if there is None else _both(there, len(found), self.follows if d == 1 else None)
            slot = found[at] & _U(FILTER_BITS - 1)
            at = at[(bits[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1 == 1]
            there = np.zeros(len(found), bool)
            there[at] = True
            yield found, at


def _both(there: np.ndarray, n: int, follows: np.ndarray | None) -> np.ndarray:
    """Places whose part without the last word and part without the first are there."""
    ok = there[:n] & there[1 : n + 1]
    if follows is not None:
        ok &= follows[1 : n + 1]
    return np.flatnonzero(ok)


def shards(batches: Iterator[pa.RecordBatch], most: int = SHARD_BYTES) -> Iterator[Shard]:
    """Batches of text, lang as shards of most bytes, or of one text that is longer."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut_up() -> Iterator[Shard]:
        table = pa.Table.from_batches(held).combine_chunks()
        langs = table.column(1).combine_chunks() if len(table) else pa.array([], pa.string())
        for texts in K.chunks(table.column(0), most):
            yield Shard.of(texts, langs.slice(texts.first, len(texts)))

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from cut_up()
            held, size = [], 0
    if held:
        yield from cut_up()


def _counted(docs: DataFrame, bits: Broadcast | None, depths: tuple[int, ...]) -> DataFrame:
    """gram, n: hashes of a shard's phrases of so many words that the filter leaves open, and how often they come.

    Without a filter, of words; then rows of lang, n say how many words a language has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            found = []
            if bits is None:
                found.append(next(shard.hashes()))
                n = np.bincount(shard.lang_of, minlength=len(shard.langs))
                yield pa.record_batch({"gram": pa.nulls(len(n), pa.int64()), "lang": pa.array(shard.langs, pa.string()), "n": pa.array(n, pa.int64())})
            else:
                there = None
                hashes = shard.hashes()
                for d, (_, at) in enumerate(shard.alive(bits.value, min(depths) - 1), 1):
                    there, last = at, d
                for _ in range(last):
                    next(hashes)
                kept = np.zeros(len(shard.words.starts), bool)
                kept[there] = True
                for d, grams in zip(depths, hashes, strict=False):
                    at = _both(kept, len(grams), shard.follows if d == 2 else None)
                    found.append(grams[at])
                    kept = np.zeros(len(grams), bool)
                    kept[at] = True
            grams, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch({"gram": pa.array(grams.view(np.int64)), "lang": pa.nulls(len(grams), pa.string()), "n": pa.array(n, pa.int64())})

    return K.arrow(docs, run, "gram long, lang string, n long")


def _mark(counted: DataFrame, bits: np.ndarray, least: int) -> None:
    """Sets the bits of all hashes that come often enough. They reach the driver as rows of ROW_BITS, FILTER_BITS in all at most."""
    often = counted.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    slots = often.select(F.col("gram").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("slot")).withColumn("place", F.floor(F.col("slot") / ROW_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            slot, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(place).tolist():
                rows.setdefault(p, np.zeros(ROW_BITS, bool))[slot[place == p] % ROW_BITS] = True
        yield pa.record_batch({"place": pa.array(list(rows), pa.int64()), "bits": pa.array([np.packbits(r, bitorder="little").tobytes() for r in rows.values()], pa.binary())})

    for row in K.arrow(slots.repartition("place"), run, "place long, bits binary").toArrow().to_pylist():
        at = row["place"] * ROW_BITS // 8
        bits[at : at + ROW_BITS // 8] |= np.frombuffer(row["bits"], np.uint8)


def _tries(docs: DataFrame, bits: Broadcast, ranges: int) -> DataFrame:
    """range, block: the nodes of every shard's trie, serialised, a block for each prefix range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, TRIE_BYTES):
            alive = list(shard.alive(bits.value, DEPTH))
            if len(alive[0][1]):
                for k, block in _blocks(*_trie(shard, [at for _, at in alive], [hashes for hashes, _ in alive[:2]]), ranges):
                    yield pa.record_batch({"range": pa.array([k], pa.int64()), "block": pa.array([block], pa.binary())})

    return K.arrow(docs, run, "range long, block binary")


@dataclass
class Trie:
    """The nodes of a count trie in the order of their paths: names of languages (level 0) and words, by number, -1 behind a path's end."""

    names: pa.Array
    paths: np.ndarray  # (node, DEPTH + 1)
    counts: np.ndarray

    @property
    def depth(self) -> np.ndarray:
        return (self.paths >= 0).sum(1) - 1

    def __getitem__(self, at: np.ndarray) -> Trie:
        return Trie(self.names, self.paths[at], self.counts[at])


def _trie(shard: Shard, places: list[np.ndarray], hashes: list[np.ndarray]) -> tuple[Trie, np.ndarray]:
    """The count trie of the phrases that begin at the places, by number of words, and the hash that each node's prefix range goes by;
    hashes: of words and of pairs."""
    w, single = shard.words, places[0]
    ink = np.zeros(len(shard.texts.data) + 1, np.int8)
    ink[w.starts[single]] += 1
    ink[w.ends[single]] -= 1
    letters = shard.texts.data[np.cumsum(ink[:-1], dtype=np.int8).astype(bool)]
    ends = np.concatenate([[0], np.cumsum(w.ends[single] - w.starts[single])]).astype(np.int64)
    spelt = pa.LargeStringArray.from_buffers(len(single), pa.py_buffer(ends), pa.py_buffer(letters)).cast(pa.string()).dictionary_encode()
    names, first_word = pa.concat_arrays([pa.array(shard.langs, pa.string()), spelt.dictionary]), len(shard.langs)
    word = np.full(len(w.starts), -1, np.int64)
    word[single] = spelt.indices.to_numpy() + first_word

    node = shard.lang_of.astype(np.int64)  # of the phrase that begins at each word, one word longer each time
    paths, counts, ranges = [], [], []
    for d, at in enumerate(places, 1):
        _, first, which, n = np.unique(node[at] * len(names) + word[at + d - 1], return_index=True, return_inverse=True, return_counts=True)
        node = np.full(len(word), -1, np.int64)
        node[at] = which
        begins = at[first]
        full = np.full((len(first), DEPTH + 1), -1, np.int32)
        full[:, 0] = shard.lang_of[begins]
        for k in range(d):
            full[:, k + 1] = word[begins + k]
        paths.append(full)
        counts.append(n)
        ranges.append(hashes[min(d, 2) - 1][begins])
    trie, order = _sorted(Trie(names, np.concatenate(paths), np.concatenate(counts)))
    return trie, np.concatenate(ranges)[order]


def _sorted(trie: Trie) -> tuple[Trie, np.ndarray]:
    """The nodes by their paths, word by word in the order of their bytes, and where they were."""
    order = np.array(pa.compute.sort_indices(trie.names.cast(pa.binary())))
    rank = np.full(len(order) + 1, -1, np.int32)
    rank[order] = np.arange(len(order))
    # the last rank, which -1 takes, comes before all words
    at = np.lexsort(tuple(rank[trie.paths[:, k]] for k in reversed(range(DEPTH + 1))))
    return trie[at], at


def _blocks(trie: Trie, hashes: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """The trie's nodes by prefix range, serialised: depth, last word and count, where paths part. A node that is in another range but
    above one of these comes without a count."""
    which = (hashes % _U(ranges)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    cuts = np.flatnonzero(np.diff(which[order])) + 1
    for at in np.split(order, cuts):
        own = trie[at]
        depth, parts = own.depth, np.zeros(len(at), np.int64)
        same = np.ones(len(at) - 1, bool)
        for k in range(DEPTH + 1):  # levels that a path has in common with the one before
            same &= own.paths[1:, k] == own.paths[:-1, k]
            parts[1:] += same
        n = depth + 1 - parts
        of = np.repeat(np.arange(len(at)), n)
        level = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + parts[of]
        table = pa.table({"depth": pa.array(level, pa.uint8()), "word": trie.names.take(pa.array(own.paths[of, level])), "n": pa.array(np.where(level == depth[of], own.counts[of], 0), pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        yield int(which[at[0]]), sink.getvalue().to_pybytes()


def _merge(tables: list[pa.Table]) -> Trie:
    """One trie of serialised ones: nodes of equal path become one, with their counts added."""
    table = pa.concat_tables(tables).combine_chunks()
    named = table.column("word").combine_chunks().dictionary_encode()
    level, n, word = table.column("depth").to_numpy(), table.column("n").to_numpy(), named.indices.to_numpy()
    own, places = np.flatnonzero(n > 0), np.arange(len(level))
    paths = np.full((len(own), DEPTH + 1), -1, np.int32)
    key = np.zeros(len(own), np.int64)
    for k in range(DEPTH + 1):
        last = np.maximum.accumulate(np.where(level == k, places, 0))[own]
        paths[:, k] = np.where(level[own] >= k, word[last], -1)
        _, key = np.unique(key * (len(named.dictionary) + 1) + (paths[:, k] + 1), return_inverse=True)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0])) if len(order) else order
    return Trie(named.dictionary, paths[order[first]], np.add.reduceat(n[own][order], first) if len(order) else n[own])


def _serial(trie: Trie) -> pa.Table:
    """A trie as one that ``_merge`` takes, every path from its language on."""
    depth = trie.depth
    of = np.repeat(np.arange(len(depth)), depth + 1)
    level = np.arange(len(of)) - np.repeat(np.cumsum(depth + 1) - depth - 1, depth + 1)
    return pa.table({"depth": pa.array(level, pa.uint8()), "word": trie.names.take(pa.array(trie.paths[of, level])), "n": pa.array(np.where(level == depth[of], trie.counts[of], 0), pa.int64())})


def _merged(tries: DataFrame, ranges: int, least: int) -> DataFrame:
    """lang, path, n, lefts of the nodes that come often enough in all shards' tries; lefts: the counts of the first 2, 3, ... words of
    each path, by a walk along the merged trie. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, most = 0, HELD
        for batch in batches:
            for block in batch.column(1):
                held.append(pa.ipc.open_stream(block.as_buffer()).read_all())
                rows += len(held[-1])
                if rows >= most:  # what is merged stays, and as much again may come
                    held = [_serial(_merge(held))]
                    rows = len(held[0])
                    most = max(HELD, 2 * rows)
        if held:
            yield from _walked(_merge(held), least).to_batches(max_chunksize=1 << 14)

    return cut(K.arrow(tries.repartition(ranges, "range"), run, "lang string, path array<string>, n long, lefts array<long>"))


def _walked(trie: Trie, least: int) -> pa.Table:
    trie, _ = _sorted(trie[trie.counts >= least])
    depth, n, places = trie.depth, trie.counts, np.arange(len(trie.counts))
    lefts = np.zeros((len(n), DEPTH - 2), np.int64)
    for d in range(2, DEPTH):  # the last node of each depth is the ancestor of what follows
        lefts[:, d - 2] = n[np.maximum.accumulate(np.where(depth == d, places, 0))]
    mine = np.arange(2, DEPTH)[None, :] < depth[:, None]
    lists = lambda size, flat: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat)
    words = trie.paths[:, 1:]
    return pa.table({"lang": trie.names.take(pa.array(trie.paths[:, 0])), "path": lists(depth, trie.names.take(pa.array(words[words >= 0]))), "n": pa.array(n, pa.int64()), "lefts": lists(mine.sum(1), pa.array(lefts[mine]))})


def _lefts(merged: DataFrame) -> DataFrame:
    """lefts with the count of the first word in front."""
    words = merged.where(F.size("path") == 1).select("lang", F.col("path")[0].alias("first"), F.col("n").alias("one"))
    longer = merged.where(F.size("path") > 1).withColumn("first", F.col("path")[0]).join(words, ["lang", "first"])
    whole = longer.select("lang", "path", "n", F.concat(F.array("one"), "lefts").alias("lefts"))
    return whole.unionByName(merged.where(F.size("path") == 1))


def _rights(nodes: DataFrame) -> DataFrame:
    """rights of every node: the counts of what follows its first 1, 2, ... words, by links to the path without the first word."""
    out = [nodes.where(F.size("path") == 1).withColumn("rights", F.array().cast("array<long>"))]
    for d in range(2, DEPTH + 1):
        own = nodes.where(F.size("path") == d).withColumn("suffix", F.slice("path", 2, d - 1))
        linked = out[-1].select("lang", F.col("path").alias("suffix"), F.concat(F.array("n"), "rights").alias("rights"))
        out.append(own.join(linked, ["lang", "suffix"]).drop("suffix").select(*nodes.columns, "rights"))
    whole = out[1]
    for part in out[2:]:
        whole = whole.unionByName(part)
    return whole


def _scored(nodes: DataFrame) -> DataFrame:
    """lang, path, a, l, r, score: each phrase's lowest-scoring cut."""
    cuts = F.expr("""
        transform(sequence(1, size(path) - 1), k -> named_struct(
            'score', CAST(CAST(n AS DECIMAL(20, 0)) * 2000000BD div CAST(lefts[k - 1] + rights[k - 1] AS DECIMAL(20, 0)) AS LONG),
            'k', k, 'l', lefts[k - 1], 'r', rights[k - 1]))""")
    return nodes.withColumn("cut", F.array_min(cuts)).select("lang", "path", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")


def _without_parts(phrases: DataFrame, share: int) -> DataFrame:
    """The phrases that no longer phrase holds with ``share`` hundredths of their count or more."""
    parts = F.expr("flatten(transform(sequence(2, size(path) - 1), k -> transform(sequence(1, size(path) - k + 1), i -> slice(path, i, k))))")
    held = phrases.where(F.size("path") > 2).select("lang", F.explode(parts).alias("path"), "a").groupBy("lang", "path").agg(F.max("a").alias("most"))
    return phrases.join(held, ["lang", "path"], "left").where(F.coalesce(100 * F.col("most") < share * F.col("a"), F.lit(True))).drop("most")


def _first(phrases: DataFrame, top: int) -> DataFrame:
    """The first phrases of each language, by rank: those of parts of a language first, so no task ranks a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = phrases.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, share: int = WHOLE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first phrases of each language; docs: text, lang."""
    with tidy(docs.sparkSession) as steps:
        texts = docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
        context, bits = docs.sparkSession.sparkContext, np.zeros(FILTER_BITS // 8, np.uint8)
        words = _counted(texts, None, (1,)).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
        words = cut(words.where((F.col("n") >= least) | F.col("lang").isNotNull()))
        sizes = words.where("lang IS NOT NULL").select("lang", F.col("n").alias("size"))
        _mark(words, bits, least)
        for depths in ((2,), tuple(range(3, DEPTH + 1))):
            shared = context.broadcast(bits)
            _mark(_counted(texts, shared, depths), bits, least)
            shared.destroy()
        shared = context.broadcast(bits)
        ranges = max(RANGES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        merged = _merged(_tries(texts, shared, ranges), ranges, least)
        shared.destroy()
        nodes = cut(_lefts(merged))
        phrases = _without_parts(_scored(_rights(nodes)), share).withColumn("phrase", F.array_join("path", " "))
        found = _first(phrases, top).join(sizes, "lang")
        return steps.done(found.select("lang", "rank", "phrase", "a", "l", "r", F.col("size").alias("n"), "score"))
