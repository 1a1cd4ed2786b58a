"""Embedding near-dedup by lattice hashing with verified links.

1. Equal vectors are one vector (a 128-bit hash of its doubles); what follows works on different ones, with their copies.
2. Each of TABLES tables projects a vector by random normal directions, SCALE apart from the unit, to 16 numbers: two points of
   8 dimensions, each decoded to the nearest point of the lattice E8. The pair of lattice points is the vector's home cell;
   the PROBES next best pairs, of the home points and their nearest neighbours in the lattice, are its probes.
3. A pair of vectors meets in a cell that is the home of one and the home or a probe of the other. It meets in several, and
   counts in the first table where it meets, in the lesser cell of that table.
4. In cells of more than BLOCK members, members within half the permitted angle of one vector form a ball: all of them are
   linked with each other, as angles add up, so their links are counted and not compared. The ball's vector is the member of
   the cell whose cells have most members, if it is that in all its cells. A cell's largest ball meets the cell's other members,
   and these meet each other, in blocks: a cell of one ball meets in no pair.
5. Pairs whose sketches (signs of SIGNS projections) differ by more than chance allows at the permitted angle are not compared.
   Others are linked if their cosine, in doubles, is at least SIMILARITY. Tasks give each vector's number of links and a
   spanning forest of the links of each block, never the pairs.
6. Classes are the connected components of the links and balls.

A pair at a cosine of exactly 0.9 meets with probability 0.99, one at 0.95 with 0.99999 (measured, whatever the dimension).
Random vectors meet in a cell of a table with probability 5e-4: their sketches are compared, 16 bytes each.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and vectors of different lengths
are linked with nothing. Repeated rows and ids are rows of their own, linked as copies. Null ids have no component id but that of
the ids they are linked with, and are not kept. An empty table gives an empty result. Other columns are ignored.
Rows are told by their place, so vectors that come from no files or checkpoint are stored first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.common import FEW, cut, maybe_in, settled, thin, tidy
from textloom.llm.components import components
from textloom.llm.vectors import gathered, group_numbers, matrices, pairs_within, whole_groups

SIMILARITY = 0.9
TABLES, PROBES, SCALE, SEED = 14, 4, 0.5, 4096
SIGNS, SPREAD = 128, 5.0
#: Members of a block at most, and rows that a kernel works on at a time.
BLOCK, ROWS, SLICE = 512, 1 << 15, 256
_CELLS = 1 + PROBES
_U = np.uint64


def _roots() -> np.ndarray:
    """The 240 least vectors of E8."""
    pairs = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            pairs.append(np.zeros(8))
            pairs[-1][[i, j]] = a, b
    halves = [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


ROOTS = _roots()


def _even(points: np.ndarray) -> np.ndarray:
    """The nearest integer points of even sum: where rounding gives an odd one, the coordinate rounded furthest goes the other way."""
    out = np.rint(points)
    odd = np.flatnonzero(out.sum(1) % 2)
    off = points[odd] - out[odd]
    worst = np.abs(off).argmax(1)
    out[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return out


def decode(points: np.ndarray) -> np.ndarray:
    """The nearest points of E8: integer points of even sum, or such points moved by a half in all coordinates."""
    whole, half = _even(points), _even(points - 0.5) + 0.5
    nearer = ((points - whole) ** 2).sum(1) <= ((points - half) ** 2).sum(1)
    return np.where(nearer[:, None], whole, half)


@lru_cache(maxsize=8)
def _directions(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64([SEED, length]))
    return r.normal(size=(length, TABLES * 16)) * SCALE, r.uniform(0, 2, TABLES * 16), r.normal(size=(length, SIGNS))


def cells(unit: np.ndarray) -> np.ndarray:
    """The cells of unit vectors, as (vector, table, home and probes) numbers."""
    directions, shift, _ = _directions(unit.shape[1])
    n, near = len(unit), PROBES
    points = (unit @ directions + shift).reshape(-1, 8)
    home = decode(points)
    gain = 2 - 2 * (points - home) @ ROOTS.T  # how much further a neighbour is, squared
    next_ = np.argpartition(gain, near, axis=1)[:, :near]
    cost = np.column_stack([np.zeros(len(points)), np.take_along_axis(gain, next_, 1)]).reshape(n * TABLES, 2, 1 + near)
    spots = np.concatenate([home[:, None, :], home[:, None, :] + ROOTS[next_]], 1)
    codes = np.zeros(spots.shape[:2], _U)
    for k in range(8):
        codes = K.mix(codes * _U(0x9E3779B97F4A7C15) + np.rint(2 * spots[:, :, k]).astype(np.int64).view(_U))
    codes = codes.reshape(n * TABLES, 2, 1 + near)
    both = (cost[:, 0, :, None] + cost[:, 1, None, :]).reshape(n * TABLES, -1)
    both[:, 0] = -1  # home first, whatever the rounding
    best = np.argsort(both, axis=1, kind="stable")[:, :_CELLS]
    rows = np.arange(n * TABLES)[:, None]
    seed = K.mix(np.tile(np.arange(TABLES), n).astype(_U) * _U(1 << 32) + _U(unit.shape[1]))
    key = K.mix(codes[rows, 0, best // (1 + near)] ^ K.mix(codes[rows, 1, best % (1 + near)] + seed[:, None]))
    return key.view(np.int64).reshape(n, TABLES, _CELLS)


def units(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors aren't zero, and those scaled to length 1."""
    top = np.abs(values).max(1)
    some = np.flatnonzero(top > 0)
    scaled = values[some] / top[some, None]
    return some, scaled / np.sqrt(np.einsum("nw,nw->n", scaled, scaled))[:, None]


def _identity(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.ascontiguousarray(values + 0.0).view(_U)  # -0.0 is 0.0
    out = []
    for seed in (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)):
        place = K.mix(np.arange(values.shape[1], dtype=_U) * seed + seed)
        out.append(K.mix(K.mix(bits ^ place).sum(1) + _U(values.shape[1])).view(np.int64))
    return out[0], out[1]


def identified(vectors: DataFrame) -> DataFrame:
    """vec_id, one, two (null for a vector that is linked with nothing) of each row, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, sound = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), np.zeros(len(batch), bool)
            for rows, values in matrices(batch.column(1)):
                some = (values != 0).any(1)
                at = rows[some]
                one[at], two[at] = _identity(values[some])
                sound[at] = True
            yield pa.record_batch({"vec_id": batch.column(0), "one": pa.array(one, mask=~sound), "two": pa.array(two, mask=~sound)})

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return K.arrow(vectors.select("vec_id", "embedding"), run, f"vec_id {kind}, one long, two long")


def described(vectors: DataFrame) -> DataFrame:
    """row, embedding, signs and keys (all tables' cells, home first) of the vectors that can have links; vectors: row, embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in matrices(batch.column(1)):
                some, unit = units(values)
                for lo in range(0, len(some), SLICE):
                    part = unit[lo : lo + SLICE]
                    keys = cells(part).reshape(len(part), -1)
                    signs = np.packbits(part @ _directions(part.shape[1])[2] >= 0, axis=1)
                    taken = batch.take(pa.array(rows[some[lo : lo + SLICE]]))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
                    yield pa.record_batch({"row": taken.column(0), "embedding": taken.column(1), "signs": pa.array([s.tobytes() for s in signs], pa.binary()), "keys": lists})

    kind = vectors.schema["embedding"].dataType.simpleString()
    return K.arrow(vectors.select("row", "embedding"), run, f"row long, embedding {kind}, signs binary, keys array<long>")


def _unit_rows(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of sound vectors; shorter ones are filled up with zeros, which leaves cosines as they are."""
    found = [(rows, units(values)[1]) for rows, values in matrices(column)]
    out = np.zeros((len(column), max(u.shape[1] for _, u in found)))
    for rows, unit in found:
        out[rows, : unit.shape[1]] = unit
    return out


def _few(df: DataFrame, most: int = FEW) -> DataFrame:
    """The stored rows, to be sent to all executors if they are few."""
    return F.broadcast(df) if df.count() <= most else df


def _placed(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("row", F.monotonically_increasing_id())


def _members(own: DataFrame) -> DataFrame:
    """A row for each cell of each vector: key, home, and own's columns but its keys."""
    rest = [c for c in own.columns if c != "keys"]
    return own.select(*rest, F.posexplode("keys").alias("at", "key")).withColumn("home", F.col("at") % _CELLS == 0).drop("at")


def _leaders(own: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: key, leader of the large cells; row, center of their members, center being the leader of highest rank of their cells."""
    inside = cut(_members(own.select("row", "keys")).join(_few(large), "key").select("key", "row", "n"))
    ranks = inside.groupBy("row").agg(F.sum("n").alias("rank"))
    ranked = inside.join(ranks, "row")
    led = cut(ranked.groupBy("key").agg(F.max(F.struct("rank", "row")).alias("top")).select("key", F.col("top.rank").alias("rank"), F.col("top.row").alias("leader")))
    best = inside.join(_few(led), "key").groupBy("row").agg(F.max(F.struct("rank", "leader")).alias("top"))
    return led.select("key", "leader"), best.select("row", F.col("top.leader").alias("center"))


def _balls(own: DataFrame, best: DataFrame, similarity: float) -> DataFrame:
    """row, ball: the vectors that are within half the angle of a center, and the centers."""
    sure = float(np.sqrt((1 + similarity) / 2)) + 1e-9
    centers = cut(best.where("row = center").select("center").join(own.select(F.col("row").alias("center"), F.col("embedding").alias("there")), "center"))
    asked = best.where("row <> center").join(_few(centers, FEW >> 6), "center").join(own.select("row", "embedding"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, ROWS >> 2):
            one, two = _unit_rows(table.column(2)), _unit_rows(table.column(3))
            width = min(one.shape[1], two.shape[1])  # vectors of a cell are of one length
            near = np.einsum("nw,nw->n", one[:, :width], two[:, :width]) >= sure
            yield from pa.table({"row": table.column(0), "ball": table.column(1)}).filter(pa.array(near)).to_batches()

    near = K.arrow(asked.select("row", "center", "embedding", "there"), run, "row long, ball long")
    return near.unionByName(centers.select(F.col("center").alias("row"), F.col("center").alias("ball")))


def _met(own: DataFrame, large: DataFrame, led: DataFrame) -> DataFrame:
    """key, i, j, block, row, home, ball, signs: members of cells, once for each pair (i, j) of blocks that meet; own has ball."""
    members = _members(own)
    main = led.join(own.select(F.col("row").alias("leader"), F.col("ball").alias("main")), "leader").select("key", "main")
    inside = members.select("key", "ball").join(_few(cut(main)), "key")
    rest = inside.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("ball") != F.col("main")).alias("rest"), F.max("main").alias("main"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    plan = cut(rest.select("key", "main", "rest", blocks(F.col("rest")).alias("others"), blocks(F.col("n") - F.col("rest")).alias("mains")))
    dealt = members.join(_few(plan), "key", "left").where("rest IS NULL OR rest > 0")
    spot = F.xxhash64("row")
    block = F.when(F.col("rest").isNull(), F.lit(0)).when(F.col("ball") != F.col("main"), F.pmod(spot, "others")).otherwise(F.col("others") + F.pmod(spot, F.greatest("mains", F.lit(1)))).cast("long")
    dealt = dealt.withColumn("block", block)
    last = F.when(F.col("rest").isNull(), F.lit(0)).when(F.col("block") < F.col("others"), F.col("others") + F.col("mains") - 1).otherwise(F.col("others") - 1).cast("long")
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return dealt.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "row", "home", "ball", "signs")


def _together(df: DataFrame) -> DataFrame:
    return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows that begin with key, i, j, block, row, home, ball, the pairs that meet: not of one ball nor of one of two blocks."""
    key, i, j, block, _, home, ball = (table.column(c).to_numpy() for c in range(7))
    for a, b in pairs_within(group_numbers([key, i, j])):
        meet = (home[a] | home[b]) & (ball[a] != ball[b]) & ((i[a] == j[a]) | (block[a] != block[b]))
        if meet.any():
            yield a[meet], b[meet]


def _candidates(met: DataFrame, similarity: float) -> DataFrame:
    """key, i, j, block, row, home, ball of the members with pairs whose sketches leave a link open."""
    chance = np.arccos(similarity) / np.pi
    most = SIGNS * chance + SPREAD * np.sqrt(SIGNS * chance * (1 - chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3, ROWS):
            signs = np.frombuffer(b"".join(table.column(7).to_pylist()), _U).reshape(len(table), -1)
            involved = np.zeros(len(table), bool)
            for a, b in _pairs(table):
                close = np.bitwise_count(signs[a] ^ signs[b]).sum(1) <= most
                involved[a[close]] = involved[b[close]] = True
            yield from table.select(range(7)).filter(pa.array(involved)).to_batches()

    return K.arrow(_together(met), run, "key long, i long, j long, block long, row long, home boolean, ball long")


def _first_meeting(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cell in which each pair of vectors counts; keys: (vector, table, home and probes)."""
    out = np.zeros(len(a), np.int64)
    open_ = np.ones(len(a), bool)
    for t in range(keys.shape[1]):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        one, two = keys[a[at], t], keys[b[at], t]
        in_one, in_two = (two == one[:, :1]).any(1), (one == two[:, :1]).any(1)
        out[at] = np.where(in_one & in_two, np.minimum(one[:, 0], two[:, 0]), np.where(in_one, one[:, 0], two[:, 0]))
        open_[at] = ~(in_one | in_two)
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n places joined by pairs, the least place of each one's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(own: DataFrame, candidates: DataFrame, similarity: float) -> DataFrame:
    """row, n, root: links (copies of the other vector counted) of each vector with some in a block, and a row that links join it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3, ROWS >> 3):
            key, row, copies = (table.column(c).to_numpy() for c in (0, 4, 7))
            unit = _unit_rows(table.column(8))
            keys = table.column(9).combine_chunks().flatten().to_numpy().reshape(len(table), TABLES, _CELLS)
            count = np.zeros(len(table), np.int64)
            one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in _pairs(table):
                near = np.einsum("nw,nw->n", unit[a], unit[b]) >= similarity
                a, b = a[near], b[near]
                here = _first_meeting(keys, a, b) == key[a]
                a, b = a[here], b[here]
                np.add.at(count, a, copies[b])
                np.add.at(count, b, copies[a])
                one.append(a)
                two.append(b)
            label = _forest(len(table), np.concatenate(one), np.concatenate(two))
            linked = np.flatnonzero(count)
            yield pa.record_batch({"row": pa.array(row[linked]), "n": pa.array(count[linked]), "root": pa.array(row[label[linked]])})

    told = candidates.join(maybe_in(own, candidates, "row").select("row", "copies", "embedding", "keys"), "row")
    return K.arrow(_together(told.select("key", "i", "j", "block", "row", "home", "ball", "copies", "embedding", "keys")), run, "row long, n long, root long")


def _linked(own: DataFrame, similarity: float) -> DataFrame:
    """row, links, root of every vector that is linked with a different one; own: row, copies, embedding, signs, keys, stored."""
    sizes = _members(own.select("row", "keys")).groupBy("key").agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > BLOCK))
    led, best = _leaders(own, large)
    balls = cut(_balls(own, best, similarity))
    named = cut(own.select("row", "copies", "signs", "keys").join(balls, "row", "left").withColumn("ball", F.coalesce("ball", "row")))
    met = _met(named.select("row", "ball", "signs", "keys"), large, led)
    found = thin(cut(_links(own, thin(cut(_candidates(met, similarity))), similarity)))
    totals = named.join(balls.select("row"), "row", "left_semi").select("row", "copies", "ball")
    whole = totals.groupBy("ball").agg(F.sum("copies").alias("all"))
    shared = totals.join(whole, "ball").select("row", (F.col("all") - F.col("copies")).alias("n"), F.col("ball").alias("root"))
    every = cut(found.unionByName(shared))
    roots = components(every.select(F.col("row").alias("a"), F.col("root").alias("b")))
    links = every.groupBy("row").agg(F.sum("n").alias("links"))
    return links.where("links > 0").join(roots.select(F.col("node").alias("row"), "root"), "row")


def links(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; vectors: vec_id, embedding."""
    with tidy(vectors.sparkSession) as steps:
        return steps.done(_result(settled(vectors.select("vec_id", "embedding")), similarity))


def _result(vectors: DataFrame, similarity: float) -> DataFrame:
    rows = cut(_placed(identified(vectors)))
    several = cut(rows.where("one IS NOT NULL").groupBy("one", "two").agg(F.min("row").alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    copied = several.select("one", "two", "first", "copies")
    named = cut(rows.join(_few(copied), ["one", "two"], "left").select("vec_id", "row", F.coalesce("first", "row").alias("as"), F.coalesce("copies", F.lit(1)).alias("copies")))
    gone = _few(cut(named.where("row <> as").select("row")))
    own = described(_placed(vectors.select("embedding")).join(gone, "row", "left_anti"))
    own = cut(own.join(_few(cut(several.select(F.col("first").alias("row"), "copies"))), "row", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long"))))
    linked = cut(_linked(own, similarity))
    told = named.join(linked.select(F.col("row").alias("as"), "links", "root"), "as", "left")
    told = cut(told.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "as").alias("root")))
    least: Column = F.min("vec_id").alias("component_id")
    shared = told.where("n_links > 0").groupBy("root").agg(least)
    out = told.join(shared, "root", "left").withColumn("component_id", F.when(F.col("n_links") > 0, F.col("component_id")).otherwise(F.col("vec_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
