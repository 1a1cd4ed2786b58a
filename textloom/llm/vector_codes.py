"""Vector code compression: product codes whose codebooks are fitted in integers, with a kd-tree for each codebook.

Components become integers (floor of SCALE times the component) and vectors are cut into PARTS equal parts. Each part has a
codebook of ENTRIES entries, at first those of the least ids. In every round the codebooks go to all tasks as kd-trees; a
branch-and-bound search finds each part's nearest entry, and visits nodes whose bound equals the best distance so far, so of
entries at the same distance the one of lowest index wins. Tasks add up the integers of each entry's parts; Spark adds the
tasks' sums, and the driver gets PARTS x ENTRIES rows of them, whatever the table's size. All arithmetic is in integers.

Defined cases: vectors that are null or empty, or hold null or non-finite components, are dropped, and so are those of another
length than the vector of least id among those whose length PARTS divides. Null ids come last, repeated ids in the order of
their components. Components beyond LIMIT / SCALE count as that, so that distances fit 64 bits. With fewer than ENTRIES
vectors a codebook has as many entries. Equal labels, nulls together, share label_error, which is null beyond 64 bits. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.common import cut, tidy
from textloom.llm.vectors import gathered, matrices

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers are this at most: squares of differences of 1024 components fit 64 bits.
LIMIT = 1 << 25
LEAF, ROWS = 16, 8192


def integers(values: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(values, -LIMIT / SCALE, LIMIT / SCALE) * SCALE).astype(np.int64)


@dataclass
class Tree:
    """A kd-tree over the entries of a codebook; nodes hold the box of their entries."""

    entries: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: list[tuple[int, int] | None]
    items: list[np.ndarray]

    @classmethod
    def of(cls, entries: np.ndarray) -> Tree:
        tree = cls(entries, *(np.zeros((0, entries.shape[1]), np.int64) for _ in range(2)), [], [])
        boxes: list[tuple[np.ndarray, np.ndarray]] = []

        def grow(items: np.ndarray) -> int:
            node, own = len(boxes), entries[items]
            boxes.append((own.min(0), own.max(0)))
            tree.items.append(items)
            tree.children.append(None)
            if len(items) > LEAF:
                axis = int((boxes[node][1] - boxes[node][0]).argmax())
                order = items[np.argsort(own[:, axis], kind="stable")]
                half = len(items) // 2
                tree.children[node] = (grow(np.sort(order[:half])), grow(np.sort(order[half:])))
            return node

        grow(np.arange(len(entries)))
        tree.low, tree.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
        return tree

    def bound(self, node: int, points: np.ndarray) -> np.ndarray:
        """The least squared distance that any point of the node's box has."""
        off = np.maximum(np.maximum(self.low[node] - points, points - self.high[node]), 0)
        return np.einsum("nw,nw->n", off, off)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each point, the nearest entry and its squared distance; the lowest index of several."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), len(self.entries))
        open_ = [(0, np.arange(len(points)), self.bound(0, points))]
        while open_:
            node, rows, bound = open_.pop()
            rows = rows[bound <= best[rows]]  # an equal bound may hide an entry of lower index
            if not len(rows):
                continue
            if (below := self.children[node]) is None:
                items = self.items[node]
                off = points[rows][:, None, :] - self.entries[items][None]
                distance = np.einsum("nkw,nkw->nk", off, off)
                at = distance.argmin(1)  # items are in order: the first is of lowest index
                found, item = distance[np.arange(len(rows)), at], items[at]
                better = (found < best[rows]) | ((found == best[rows]) & (item < index[rows]))
                best[rows[better]], index[rows[better]] = found[better], item[better]
                continue
            bounds = [self.bound(child, points[rows]) for child in below]
            first = bounds[0] <= bounds[1]
            for side, near in ((first, 0), (~first, 1)):
                if side.any():
                    open_.append((below[1 - near], rows[side], bounds[1 - near][side]))
                    open_.append((below[near], rows[side], bounds[near][side]))
        return index, best


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of rows, and their integers as (part, row, component)."""
    for table in gathered(batches, ROWS):
        column = table.column(at).combine_chunks()
        flat = column.flatten().to_numpy().astype(np.int64).reshape(len(table), PARTS, -1)
        yield table, flat.transpose(1, 0, 2)


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x of the rows that are coded; x: integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in matrices(batch.column(2)):
                if values.shape[1] % PARTS == 0:
                    whole = integers(values).astype(np.int32)
                    x = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * whole.shape[1]), pa.array(whole.reshape(-1)))
                    taken = batch.take(pa.array(rows))
                    yield pa.record_batch({"vec_id": taken.column(0), "label": taken.column(1), "x": x})

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return K.arrow(vectors.select("vec_id", "label", "embedding"), run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<int>")


def _sums(rows: DataFrame, trees) -> DataFrame:
    """part, entry, place, total and n: what the parts of each entry add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = None
        for _, parts in _blocks(batches, 0):
            if total is None:
                total, count = np.zeros((PARTS, ENTRIES, parts.shape[2]), np.int64), np.zeros((PARTS, ENTRIES), np.int64)
            for p, points in enumerate(parts):
                entry, _ = trees.value[p].nearest(points)
                np.add.at(total[p], entry, points)
                count[p] += np.bincount(entry, minlength=ENTRIES)
        if total is not None:
            p, e = np.nonzero(count)
            yield pa.record_batch({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(count[p, e]), "totals": pa.array(list(total[p, e]), pa.list_(pa.int64()))})

    found = K.arrow(rows.select("x"), run, "part int, entry int, n long, totals array<long>")
    each = found.select("part", "entry", "n", F.posexplode("totals").alias("place", "total"))
    return each.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks, as (part, entry, place); rows: vec_id, x of one length, stored."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").toArrow().column(0).combine_chunks()
    books = first.flatten().to_numpy().astype(np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        trees = rows.sparkSession.sparkContext.broadcast([Tree.of(b) for b in books])
        sums = _sums(rows, trees).toArrow()
        trees.destroy()
        part, entry, place, total, n = (sums.column(c).to_numpy() for c in ("part", "entry", "place", "total", "n"))
        books[part, entry, place] = total // n
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (one byte a part, in hex) and error of each row, stored."""
    trees = rows.sparkSession.sparkContext.broadcast([Tree.of(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, parts in _blocks(batches, 2):
            found = [trees.value[p].nearest(points) for p, points in enumerate(parts)]
            codes = np.column_stack([index for index, _ in found]).astype(np.uint8).tobytes().hex()
            error = sum(distance for _, distance in found)
            code = [codes[k : k + 2 * PARTS] for k in range(0, len(codes), 2 * PARTS)]
            yield pa.record_batch({"vec_id": table.column(0).combine_chunks(), "label": table.column(1).combine_chunks(), "code": pa.array(code, pa.string()), "error": pa.array(error, pa.int64())})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = cut(K.arrow(rows.select("vec_id", "label", "x"), run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    trees.destroy()
    return out


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is coded; vectors: vec_id, embedding, label."""
    with tidy(vectors.sparkSession) as steps:
        rows = cut(kept(vectors))
        least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x").alias("n")).head()
        if least is None:
            return steps.done(rows).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        rows = rows.where(F.size("x") == least.n)
        books = fit(rows)
        digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
        found = coded(rows, books)
        totals = found.groupBy(F.col("label").alias("__label")).agg(F.try_sum("error").alias("label_error"))
        shared = found.join(totals, F.col("label").eqNullSafe(F.col("__label")))
        return steps.done(shared.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
