"""Near-dedup by Order MinHash with verified links.

1. Texts with the same words are one text (a 128-bit hash of the word sequence); what follows works on different texts.
2. The items of a text are its runs of SHINGLE words, each with the number of its earlier occurrences in the text. Each of
   SKETCHES hash functions picks the LEAST least items and keeps them in text order: two texts share the sketch if the same
   items are least and stand in the same order. Texts of fewer than LEAST items have no sketch: one that shares k items with
   another text is at most k / (k + 1) like it, so at 0.8 it is like none.
3. Texts with a common sketch form a bucket. Every member is first compared with the bucket's leader, the member whose
   buckets are largest, as the text that copies were made from is. Where links then don't join the whole bucket, all pairs
   of members that they don't join are compared, whatever the bucket's size: members that aren't joined with the leader form
   blocks, which meet each other and the blocks of those that are. A pair meets in the first of its common buckets only.
4. Pairs whose signatures (the least item of each of BINS parts of the hash range, one byte each) are further from
   SIMILARITY than chance allows (SPREAD standard deviations) are not compared, which spares fetching their texts. A
   comparison is a banded alignment of the two item sequences: matches further off the diagonal than SIMILARITY allows
   can't be in an alignment that reaches it; the longest increasing run of the others is the alignment, exact as items are
   different within a text. Linked texts have aligned / (all items - aligned) of at least SIMILARITY, and so has the plain
   Jaccard similarity of their sets of word runs.
5. Classes are the connected components of the links.

A pair of similarity s shares a sketch with probability 1 - (1 - s ** LEAST) ** SKETCHES: 0.9998 at 0.8, more above. Least
items are picked without putting back, so texts of a few items fall a little short of that: of five items in all, four of them
common, 1 / 5 of the sketches are, and the probability is 0.97.

Defined cases: null, empty and blank texts are equal. Texts of fewer than SHINGLE words have one item, all their words. A
class's id is its least doc_id (null only if it has no other); its row of least doc_id stays, null ids last, one of repeated
rows. Rows are never merged: each has its result row. An empty table gives an empty result. Other columns are ignored by
``classes`` and kept by ``keep_one``. Rows are told by their place, so docs that come from no files or checkpoint are stored first.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.common import cut, maybe_in, settled, sweep, thin, tidy, without
from textloom.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, LEAST = 16, 4
BINS, SPREAD = 256, 4.0
#: Members of a block at most, and items that they may have together, so that two blocks fit a task.
BLOCK, WEIGHT = 512, 1 << 21
_U = np.uint64
_ODD = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, (SKETCHES, 2), dtype=np.uint64) | _U(1)


def items(texts: K.Texts, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, K.Words]:
    """Items of all texts in order, which of them are no repeats, the first of each text (one more than texts), the words' hashes and places."""
    w = K.words(texts)
    hashes = texts.span_hash(w.starts, w.ends)
    n = np.diff(w.offs)
    window, at = K.windows(hashes, w.offs, shingle)
    of = w.text_of[at]
    del at
    few = np.flatnonzero((n > 0) & (n < shingle))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for k in range(shingle - 1):
            there = n[few] > k
            whole[there] = K.mix(whole[there] * _U(31) + hashes[w.offs[few[there]] + k])
        window, of = np.concatenate([window, whole]), np.concatenate([of, few])
        order = np.argsort(of, kind="stable")
        window, of = window[order], of[order]
    offs = np.searchsorted(of, np.arange(len(texts) + 1))
    key = K.mix(of.astype(np.uint64) + _U(1))
    del of
    key ^= window
    again = K.occurrences(None, key)
    del key
    window += again.astype(np.uint64) * _U(0xA24BAED4963EE407)
    return K.mix(window), again == 0, offs, hashes, w


def identity(hashes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's word sequence."""
    place = (np.arange(len(hashes)) - np.repeat(offs[:-1], np.diff(offs))).astype(np.uint64)
    out = []
    for seed in (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(hashes ^ K.mix(place * seed + seed)))])
        out.append(K.mix(sums[offs[1:]] - sums[offs[:-1]] + np.diff(offs).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def sketches(item: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The bucket keys of each text. Texts of under LEAST items are like no other text, so they have none."""
    n = np.diff(offs)
    wide = np.flatnonzero(n >= LEAST)
    if not len(wide):
        return [np.zeros(0, np.int64)] * len(n)
    begin = offs[:-1][wide]
    span = np.concatenate([np.arange(a, b) for a, b in zip(begin, offs[1:][wide], strict=True)]) if len(wide) < len(n) else np.arange(offs[0], offs[-1])
    values, size = item[span], n[wide]
    first = np.cumsum(size) - size
    keys = np.zeros((len(wide), SKETCHES), np.uint64)
    none = _U(0xFFFFFFFFFFFFFFFF)
    for s in range(SKETCHES):
        v = values * _ODD[s, 0]
        v ^= v >> _U(32)
        v *= _ODD[s, 1]
        places = np.zeros((len(wide), LEAST), np.int64)
        for k in range(LEAST):
            low = np.minimum.reduceat(v, first)
            hit = np.flatnonzero(v == np.repeat(low, size))
            text = np.searchsorted(first, hit, "right") - 1
            place = np.full(len(wide), -1)
            place[text[::-1]] = hit[::-1]  # the first of each text
            places[:, k] = place
            v[place] = none
        places.sort(axis=1)
        key = np.full(len(wide), _U(2 * s), np.uint64)
        for k in range(LEAST):
            key = K.mix(key * _U(0xD6E8FEB86659FD93) + values[places[:, k]])
        keys[:, s] = key
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(n)
    for i, t in enumerate(wide):
        out[t] = keys[i].view(np.int64)
    return out


def signatures(item: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """BINS bytes for each text: of each part of the hash range, some bits of its least item; 0 if it has none."""
    out = np.zeros((len(offs) - 1, BINS), np.uint8)
    for lo in range(0, len(offs) - 1, 1 << 20):
        hi = min(lo + (1 << 20), len(offs) - 1)
        part = item[offs[lo] : offs[hi]]
        text = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(offs[lo : hi + 1]))
        both = np.sort(text << _U(44) | K.mix(part * _ODD[0, 0]) >> _U(20))
        place = both >> _U(36)
        first = np.ones(len(both), bool)
        first[1:] = place[1:] != place[:-1]
        least = both[first]
        out[lo + (least >> _U(44)).astype(np.int64), (least >> _U(36)).astype(np.int64) % BINS] = K.mix(least & _U((1 << 36) - 1)) % _U(255) + _U(1)
    return out


def may_match(one: np.ndarray, two: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Of rows of signatures, which may be of texts of that similarity."""
    used = np.maximum(((one | two) != 0).sum(1), 1)
    equal = ((one == two) & (one != 0)).sum(1)
    return equal >= used * similarity - SPREAD * np.sqrt(used * similarity * (1 - similarity))


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> int:
    """Length of the best alignment of two sequences of different items, within the band that similarity allows."""
    short, most = min(len(a), len(b)), max(len(a), len(b))
    if not short or short < similarity * most:
        return 0
    total = len(a) + len(b)
    band = int(total - 2 * similarity / (1 + similarity) * total + 1e-9)
    order = np.argsort(b)
    at = np.searchsorted(b, a, sorter=order)
    at[at == len(b)] = 0
    place = order[at]
    i = np.flatnonzero((b[place] == a) & (np.abs(place - np.arange(len(a))) <= band))
    j = place[i]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails)


@dataclass
class Sequence:
    """The items of a text in order, and the sorted ones that are no repeats."""

    items: np.ndarray
    kinds: np.ndarray


def similar(a: Sequence, b: Sequence, similarity: float = SIMILARITY) -> bool:
    n = aligned(a.items, b.items, similarity)
    if not n or n < similarity * (len(a.items) + len(b.items) - n) - 1e-9:
        return False
    common = len(np.intersect1d(a.kinds, b.kinds, assume_unique=True))
    return common >= similarity * (len(a.kinds) + len(b.kinds) - common) - 1e-9


def described(docs: DataFrame) -> DataFrame:
    """doc_id, the two identity numbers, n (items) and keys of every row; rows in the order of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in K.chunks(batch.column(1)):
                item, _, offs, hashes, w = items(texts)
                one, two = identity(hashes, w.offs)
                yield pa.record_batch({
                    "doc_id": batch.column(0).slice(texts.first, len(texts)), "one": pa.array(one), "two": pa.array(two),
                    "n": pa.array(np.diff(offs).astype(np.int64)), "sig": _bytes(signatures(item, offs)), "keys": pa.array(sketches(item, offs), pa.list_(pa.int64())),
                })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return K.arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, one long, two long, n long, sig binary, keys array<long>")


def _bytes(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _agreeing(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, one, two) of rows whose signatures leave it open that they match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(may_match(one, two)))

    return K.arrow(pairs.select("a", "b", "one", "two"), run, "a long, b long")


def _place(df: DataFrame) -> DataFrame:
    return df.withColumn("row", F.monotonically_increasing_id())


def _texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """row, text of the given rows, and of few others."""
    texts = _place(docs.select("text")).select("row", F.coalesce("text", F.lit("")).alias("text"))
    return maybe_in(texts, rows, "row")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose texts are similar."""
    texts = _texts(docs, pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))))
    both = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("second")), "b").join(texts.select(F.col("row").alias("a"), F.col("text").alias("first")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, Sequence | None] = (None, None)
        for batch in batches:
            a = batch.column(0).to_numpy()
            for lo in range(0, len(a), 128):
                part = batch.slice(lo, 128)
                leaders = part.column(0).to_numpy()
                new = np.flatnonzero(np.concatenate([[leaders[0] != known[0]], leaders[1:] != leaders[:-1]]))
                firsts = [x for t in K.chunks(part.column(2).take(pa.array(new, pa.int64()))) for x in _split(t)]
                own, k, out = [], -1, []
                for t in K.chunks(part.column(3)):
                    own.extend(_split(t))
                starts = set(new.tolist())
                for i in range(len(leaders)):
                    if i in starts:
                        k += 1
                        known = (int(leaders[i]), firsts[k])
                    out.append(similar(known[1], own[i]))
                yield pa.record_batch({"a": part.column(0), "b": part.column(1)}).filter(pa.array(out, pa.bool_()))

    return K.arrow(both.select("a", "b", "first", "second"), run, "a long, b long")


def _split(texts: K.Texts) -> list[Sequence]:
    item, first, offs, _, _ = items(texts)
    parts = (slice(offs[i], offs[i + 1]) for i in range(len(texts)))
    return [Sequence(item[p], np.sort(item[p][first[p]])) for p in parts]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each run of equal key, i, j, the first three columns."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        named = np.column_stack([batch.column(c).to_numpy() for c in range(3)])
        cuts = np.flatnonzero((named[1:] != named[:-1]).any(1)) + 1
        for lo, hi in pairwise([0, *cuts.tolist(), len(named)]):
            name = tuple(named[lo].tolist())
            if held and name != at:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            at = name
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _blocks(members: DataFrame, led: DataFrame, roots: DataFrame) -> DataFrame:
    """key, i, j, block, row, n, root: members of buckets that links don't join as a whole, once for each pair (i, j) of blocks
    that meet. Pairs of blocks of members that are joined with the leader are left out."""
    top = led.select("key", F.col("leader").alias("node")).join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("top"))
    named = members.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row")).select("key", "row", "n", "root")
    named = cut(named.join(top, "key").withColumn("other", F.col("root") != F.col("top")).drop("top"))
    sizes = named.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.col("other").cast("long")).alias("rest"), F.max("n").alias("most")).where("rest > 0")
    per = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.floor(F.lit(WEIGHT) / F.greatest("most", F.lit(1)))))
    sizes = sizes.withColumn("per", per).withColumn("whole", F.col("size") <= F.col("per"))
    sizes = sizes.withColumn("others", F.when(F.col("whole"), F.lit(1)).otherwise(F.ceil(F.col("rest") / F.col("per"))))
    sizes = sizes.withColumn("mains", F.when(F.col("whole"), F.lit(0)).otherwise(F.ceil((F.col("size") - F.col("rest")) / F.col("per"))))
    dealt = named.join(sizes.select("key", "whole", "others", "mains"), "key")
    spot = F.xxhash64("row")
    block = F.when(F.col("whole"), F.lit(0)).when(F.col("other"), F.pmod(spot, "others")).otherwise(F.col("others") + F.pmod(spot, F.greatest("mains", F.lit(1)))).cast("long")
    dealt = dealt.withColumn("block", block)
    last = F.when(F.col("block") < F.col("others"), F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return dealt.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "row", "n", "root")


def _candidates(met: DataFrame) -> DataFrame:
    """Of the members of each pair of blocks (with n, root, sig and keys), those with pairs that may match: key, i, j, row, root, partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            if g.num_rows < 2:
                continue
            key, i, j = (g.column(c)[0].as_py() for c in range(3))
            block, row, n, root = (g.column(c).to_numpy() for c in range(3, 7))
            sig = np.frombuffer(b"".join(g.column(7).to_pylist()), np.uint8).reshape(-1, BINS)
            keys = pc.list_flatten(g.column(8)).to_numpy().reshape(len(row), -1)  # each row has as many
            partners: list[list[int]] = [[] for _ in row]
            involved = np.zeros(len(row), bool)
            later = np.arange(len(row))
            for a in np.flatnonzero(block == i):
                at = np.flatnonzero(((later > a) if i == j else (block == j)) & (root != root[a]) & (np.minimum(n, n[a]) >= SIMILARITY * np.maximum(n, n[a]) - 1e-9))
                first = (keys[at] == keys[a]).argmax(1)
                at = at[keys[a][first] == key]
                if len(at):
                    at = at[may_match(sig[a][None], sig[at])]
                if len(at):
                    partners[a] = row[at].tolist()
                    involved[at] = involved[a] = True
            at = np.flatnonzero(involved)
            if len(at):
                yield pa.record_batch({
                    "key": pa.array(np.full(len(at), key)), "i": pa.array(np.full(len(at), i)), "j": pa.array(np.full(len(at), j)),
                    "row": pa.array(row[at]), "root": pa.array(root[at]), "partners": pa.array([partners[k] for k in at], pa.list_(pa.int64())),
                })

    return K.arrow(_together(met.select("key", "i", "j", "block", "row", "n", "root", "sig", "keys")), run, "key long, i long, j long, row long, root long, partners array<long>")


def _together(df: DataFrame) -> DataFrame:
    return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _links(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs (a, b) of similar texts that join what the candidates' partners join, none between rows that others join already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            row, roots = g.column(3).to_pylist(), g.column(4).to_pylist()
            own = [x for t in K.chunks(g.column(6)) for x in _split(t)]
            size = np.array([len(x.kinds) for x in own])
            _, ids = np.unique(np.concatenate([x.kinds for x in own]), return_inverse=True)
            ids = np.split(ids.reshape(-1), np.cumsum(size)[:-1])
            mark = np.zeros(max(int(x.max()) for x in ids if len(x)) + 1, bool)
            at = {r: k for k, r in enumerate(row)}
            up = {r: r for r in roots}

            def find(x: int) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            out = []
            for a, partners in enumerate(g.column(5).to_pylist()):
                them = np.array([b for b in (at[r] for r in partners) if find(roots[b]) != find(roots[a])], np.int64)
                if not len(them):
                    continue
                mark[ids[a]] = True
                counts = np.concatenate([[0], np.cumsum(mark[np.concatenate([ids[b] for b in them])])])
                ends = np.cumsum(size[them])
                mark[ids[a]] = False
                common = counts[ends] - counts[ends - size[them]]
                likely = common >= SIMILARITY * (size[a] + size[them] - common) - 1e-9
                for b in them[likely].tolist():
                    one, two = find(roots[a]), find(roots[b])
                    if one != two and similar(own[a], own[b]):
                        up[one] = two
                        out.append((row[a], row[b]))
            if out:
                yield pa.record_batch({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    told = candidates.join(_texts(docs, candidates.select("row")), "row")
    return K.arrow(_together(told.select("key", "i", "j", "row", "root", "partners", "text")), run, "a long, b long")


def joined(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, root of every row with a verified link; rows: row, n, sig, keys of one row for each different text, stored."""
    members = rows.select("row", "n", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(members.join(sizes, "key"))
    weight = members.groupBy("row").agg(F.sum("size").alias("rank"))
    members = cut(members.join(weight, "row").select("key", "row", "n", "rank"))
    led = members.groupBy("key").agg(F.max(F.struct("rank", "row", "n")).alias("top")).select("key", F.col("top.row").alias("leader"), F.col("top.n").alias("m"))
    met = members.join(led, "key").where("row <> leader")
    pairs = met.groupBy("leader", "row").agg(F.first("n").alias("n"), F.first("m").alias("m"))
    pairs = pairs.where(F.least("n", "m") >= SIMILARITY * F.greatest("n", "m") - 1e-9)
    signed = pairs.select(F.col("leader").alias("a"), F.col("row").alias("b")).join(rows.select(F.col("row").alias("b"), F.col("sig").alias("two")), "b").join(rows.select(F.col("row").alias("a"), F.col("sig").alias("one")), "a")
    found = thin(cut(_verified(docs, thin(cut(_agreeing(signed.select("a", "b", "one", "two")))))))
    roots = thin(cut(components(found)))
    sweep(docs.sparkSession)
    rest = _blocks(members, led, roots).join(rows.select("row", "sig", "keys"), "row")
    more = thin(cut(_links(docs, thin(cut(_candidates(rest))))))
    return roots if more.isEmpty() else components(found.unionByName(more))


def classes(docs: DataFrame) -> DataFrame:
    """row, doc_id, class_id, class_size and kept of every row."""
    with tidy(docs.sparkSession) as steps:
        return steps.done(_classes(settled(docs.select("doc_id", "text"))))


def _classes(docs: DataFrame) -> DataFrame:
    rows = cut(_place(described(docs)))
    texts = cut(rows.groupBy("one", "two").agg(F.min("row").alias("text")))
    own = rows.join(texts.select(F.col("text").alias("row")), "row", "left_semi").select("row", "n", "sig", "keys").where(F.size("keys") > 0)
    own = cut(own)
    roots = joined(docs, own)
    named = rows.select("row", "doc_id", "one", "two").join(texts, ["one", "two"]).join(roots.select(F.col("node").alias("text"), "root"), "text", "left")
    named = cut(named.select("row", "doc_id", F.coalesce("root", "text").alias("class")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row").alias("row"))).alias("first")
    sizes = named.groupBy("class").agg(first, F.count("*").alias("class_size"))
    return named.join(sizes, "class").select("row", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("first.row") == F.col("row")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns."""
    with tidy(docs.sparkSession) as steps:
        docs = settled(docs)
        return steps.done(without(docs, classes(docs).where("NOT kept")))
