"""Quality classifier: kernel ridge scores by random Fourier features, calibrated by isotonic regression.

Each text is described by document statistics (``NAMES``); random Fourier features approximate the Gaussian kernel of the
standardised statistics. Every partition sums its part of the normal equations, of constant size (FEATURES + 1) squared;
the sums are added in two steps, so the driver gets FAN of them at most. Labelled rows are dealt to two halves by hash:
the calibration sees scores that the other half's equations gave, as counts and labels in BINS bins.

Defined cases: null, empty and blank texts have statistics of 0 and get the score that these earn. A null doc_id is never
learned from. Repeated rows are scored alike; a label of a repeated doc_id counts for each of its rows. With no labels all
scores are 0, with labels of one kind all scores are that label. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.common import cut
from textloom.llm.quality_rules import measure

FEATURES, RIDGE, SEED = 256, 1e-3, 11
FAN, BINS = 8, 1024
LOW, HIGH = -0.5, 1.5
NAMES = ("words", "letters", "word length", "symbols", "lines", "repeated lines", "repeated words", "capitals", "shouts", "spelling", "stop words", "longest word", "digits", "wide bytes", "marks", "different words")
_DIGIT, _WIDE, _MARKS = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58] = True
_WIDE[128:] = True
_MARKS[[ord(c) for c in ".,;:"]] = True


def statistics(texts: K.Texts) -> np.ndarray:
    """One row of NAMES for each text."""
    w = K.words(texts)
    hashes = texts.span_hash(w.starts, w.ends)
    m = measure(texts, w, hashes)
    n, size = np.maximum(m["n_words"], 1), np.maximum(np.diff(texts.offs), 1)
    longest = np.zeros(len(texts), np.int64)
    some = np.diff(w.offs) > 0
    if some.any():
        longest[some] = np.maximum.reduceat(w.ends - w.starts, w.offs[:-1][some])
    text_of = w.text_of
    _, first = np.unique(hashes ^ K.mix(text_of.astype(np.uint64) + np.uint64(1)), return_index=True)
    kinds = np.bincount(text_of[first], minlength=len(texts))
    return np.column_stack([
        np.log1p(m["n_words"]), np.log1p(m["n_letters"]), m["word_chars"] / n, m["n_symbols"] / n, m["n_lines"] / n,
        m["n_dup_lines"] / np.maximum(m["n_lines"], 1), m["n_repeat_words"] / n, m["n_upper"] / np.maximum(m["n_letters"], 1), m["n_shouts"] / n,
        m["n_spelt"] / n, m["n_stop"] / n, np.log1p(longest), texts.count(_DIGIT[texts.data]) / size, texts.count(_WIDE[texts.data]) / size,
        texts.count(_MARKS[texts.data]) / n, kinds / n,
    ]).astype(float)


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.concatenate([np.zeros((0, len(NAMES))), *(statistics(t) for t in K.chunks(batch.column(1)))])
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.record_batch({"doc_id": batch.column(0), "x": values})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return K.arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, x array<double>")


@dataclass
class Fourier:
    shift: np.ndarray
    scale: np.ndarray
    features: int = FEATURES

    def __post_init__(self) -> None:
        r = np.random.Generator(np.random.PCG64(SEED))
        self.w = r.normal(size=(len(self.shift), self.features)) * np.sqrt(1.0 / len(self.shift))
        self.b = r.uniform(0, 2 * np.pi, self.features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.shift) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / self.features) * np.cos(z @ self.w + self.b), np.ones(len(x))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Adds (half, sums as bytes) by half, as a tree: every FAN partitions become one, until FAN are left for the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for half, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(data.as_py(), float)
                total[half] = total[half] + part if half in total else part
        yield pa.record_batch({"half": pa.array(list(total), pa.int32()), "sums": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    left = parts._jdf.rdd().getNumPartitions()
    while left > FAN:
        left = max(FAN, -(-left // FAN))
        parts = K.arrow(parts.repartition(left), add, "half int, sums binary")
    out: dict[int, np.ndarray] = {}
    for row in parts.toArrow().to_pylist():
        part = np.frombuffer(row["sums"], float)
        out[row["half"]] = out[row["half"]] + part if row["half"] in out else part
    return out


def _sums(rows: DataFrame, of) -> dict[int, np.ndarray]:
    """of(x, y) gives an array for some rows; rows: half, x, y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            half, x, y = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy().astype(float)
            for k in np.unique(half):
                for lo in range(0, int((half == k).sum()), 2048):
                    part = of(x[half == k][lo : lo + 2048], y[half == k][lo : lo + 2048])
                    total[int(k)] = total[int(k)] + part if int(k) in total else part
        yield pa.record_batch({"half": pa.array(list(total), pa.int32()), "sums": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    return _summed(K.arrow(rows.select("half", "x", "y"), run, "half int, sums binary"))


def _solve(equations: np.ndarray, size: int) -> np.ndarray:
    n = equations[-1]
    a, b = equations[: size * size].reshape(size, size), equations[size * size : size * size + size]
    return np.linalg.solve(a + RIDGE * max(n, 1) * np.eye(size), b)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing means nearest to value, by pooling adjacent violators."""
    level: list[list[float]] = []  # mean, weight, how many
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        level.append([v, w, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            v2, w2, n2 = level.pop()
            v1, w1, n1 = level[-1]
            level[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.zeros(0), *(np.full(n, v) for v, _, n in level)])


@dataclass
class Model:
    map: Fourier
    weights: np.ndarray
    at: np.ndarray  # scores and what they are worth
    worth: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(np.clip(self.map(x) @ self.weights, LOW, HIGH), self.at, self.worth), 0, 1)


def fit(rows: DataFrame, features: int = FEATURES) -> Model | float:
    """rows: half (0 or 1), x, y (0 or 1). A number if one score serves all."""
    moments = _sums(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0), [y.sum()]]))
    total = sum(moments.values(), np.zeros(2 * len(NAMES) + 2))
    n, positive = total[0], total[-1]
    if positive in (0, n):
        return float(positive > 0)
    mean, square = total[1 : len(NAMES) + 1] / n, total[len(NAMES) + 1 : -1] / n
    fourier = Fourier(mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-6, features)
    size = features + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier(x)
        return np.concatenate([(z.T @ z).reshape(-1), z.T @ y, [len(y)]])

    halves = _sums(rows, equations)
    both = sum(halves.values(), np.zeros(size * size + size + 1))
    weights = _solve(both, size)
    other = {k: _solve(halves[1 - k], size) if 1 - k in halves else weights for k in (0, 1)}

    def binned(k: int):
        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            at = ((np.clip(fourier(x) @ other[k], LOW, HIGH) - LOW) / (HIGH - LOW) * (BINS - 1)).round().astype(int)
            return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)]).astype(float)

        return of

    bins = np.zeros(2 * BINS)
    for k in halves:
        bins = bins + _sums(rows.where(F.col("half") == k), binned(k))[k]
    count, good = bins[:BINS], bins[BINS:]
    used = count > 0
    return Model(fourier, weights, (LOW + (HIGH - LOW) * np.arange(BINS) / (BINS - 1))[used], isotonic(good[used] / count[used], count[used]))


def score(docs: DataFrame, labels: DataFrame, features: int = FEATURES) -> DataFrame:
    """doc_id and score of every row. labels: doc_id, quality, of the rows that may be learned from."""
    rows = cut(described(docs))
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    labelled = cut(rows.join(known, "doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"), "x", "y"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled, features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, len(NAMES)))
            out = np.full(batch.num_rows, model) if isinstance(model, float) else model.score(x)
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(out, pa.float64())})

    return K.arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
