"""Toxicity by two class-conditional Kneser-Ney bigram models.

* The fit takes a bounded sample of labelled rows (``max_rows`` rows and ``max_bytes`` of text of each class, the rows of
  least hash), so the model that is broadcast has a proven size: at most a word and a bigram for every two bytes.
* Counts are Kneser-Ney's: not how often an expression comes but in how many texts. Both classes share the counts of all texts:
  a class would have its part of them by chance. From what a class has more or less than that, as much is discounted as chance
  brings (CHANCE standard deviations of the shared count, more in larger samples), and backs off to the shared counts. So a rare
  expression, or one that is as common in both classes, is as likely under either.
* A word after another has its discounted share of the bigrams (the discount is that of the counts of counts), as far as the class
  tells it from the shared one; what is left goes to the class's words, and these back off to the words of the whole corpus.
* The corpus counts grow with the input: how often each word of the model occurs in all documents. Only their restriction to
  the model's words is broadcast.
* A score is a logistic function of the length-normalised log-likelihood ratio of the whole text, and of that of its best passage
  of PASSAGE words, about a sentence. It is fitted to ratios from models that have not seen the text.

Defined cases: a null, empty or blank text has no words, so all ratios are 0 and the score is that of a text without
evidence. A null doc_id is kept, is not held out and is never sampled. Repeated rows are scored alike, one row each; of rows of
one doc_id the sample takes all, within its bounds. With no labelled rows of one class all scores are 0. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.common import cut, tidy

#: Standard deviations that chance brings in a sample of e texts of the smaller class (their square grows with the log); words of a passage.
CHANCE, PASSAGE = 1.1, 16
FOLDS = 3
#: Bounds of the labelled sample, of each class: rows, and bytes of text.
MAX_ROWS = (6144, 2048)
MAX_BYTES = (8 << 20, 4 << 20)
#: A text of more than this part of MAX_BYTES comes after all others.
LONG = 8
CLASSES = ("ordinary", "toxic")
_U = np.uint64


@dataclass
class Model:
    vocab: np.ndarray  # sorted word hashes
    bigrams: np.ndarray  # sorted keys, see _pairs
    share: np.ndarray  # of each bigram, its discounted share of its context
    left: np.ndarray  # of each context, what is left for the words
    words: tuple[np.ndarray, np.ndarray]  # of each class, each word's probability
    tilts: tuple[np.ndarray, np.ndarray]  # of each class, how much likelier a bigram is after its context than in both
    weights: np.ndarray | None = None  # of the logistic function


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key in the sorted table, or len(table)."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, len(table))


def word_hashes(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without outer ASCII punctuation and case, and the first word of each text."""
    lower = texts.data.copy()
    upper = (lower >= 65) & (lower <= 90)
    lower[upper] += 32
    folded = K.Texts(texts.first, lower, texts.offs)
    w = K.words(folded)
    # from the first to the last byte of each word that is no mark; a word of marks alone stays
    plain = np.flatnonzero(~_MARK[lower])
    low, high = np.searchsorted(plain, w.starts), np.searchsorted(plain, w.ends) - 1
    some = high >= low
    starts, ends = w.starts.copy(), w.ends.copy()
    starts[some], ends[some] = plain[low[some]], plain[high[some]] + 1
    return folded.span_hash(starts, ends), w.offs


_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def _pairs(ids: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Context of every word (size: a text begins; size + 1: a word that is not in the model), and the key of the bigram."""
    left = np.empty(len(ids), np.int64)
    left[1:] = ids[:-1]
    left[left == size] = size + 1
    left[offs[:-1][np.diff(offs) > 0]] = size
    return left, left * (size + 1) + ids


def _distinct(items: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each item once for every text that has it, and that text; doc rises."""
    order = np.argsort(items, kind="stable")
    item, of = items[order], doc[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (of[1:] != of[:-1])
    return item[new], of[new]


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the first word of each."""
    hashes, offs = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for chunk in K.chunks(texts):
        h, o = word_hashes(chunk)
        hashes.append(h)
        offs.append(o[1:] + offs[-1][-1])
    return np.concatenate(hashes), np.concatenate(offs)


def fit(texts: pa.Array, labels: np.ndarray, corpus: tuple[np.ndarray, np.ndarray] | None = None, total: int = 0, chance: float = CHANCE) -> Model:
    """The two models of the texts; corpus: sorted words and how often all documents have them, of ``total`` words. Without
    corpus its counts are those of the texts."""
    return _fit(*_hashed(texts), labels, corpus, total, chance)


def _tilts(items: np.ndarray, doc: np.ndarray, labels: np.ndarray, size: int, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """How many texts have each item, and of each class how much of its chance part it has once chance is discounted; doc rises."""
    item, of = _distinct(items, doc)
    count = np.array([np.bincount(item[labels[of] == c], minlength=size) for c in (0, 1)], float)
    every = count.sum(0)
    part = every * (count.sum(1) / max(1, len(item)))[:, None]
    more = count - part
    smaller = np.bincount(labels, minlength=2).min()
    discount = chance * np.sqrt(np.log(max(2, smaller))) * np.sqrt(part + 1)
    kept = part + np.sign(more) * np.maximum(np.abs(more) - discount, 0)
    return every, np.divide(kept, part, out=np.ones_like(part), where=part > 0)


def _selected(hashes: np.ndarray, offs: np.ndarray, labels: np.ndarray, chance: float = CHANCE) -> tuple:
    """Words and bigrams of the texts, with their counts and tilts, and which of them the model has: those that a class tells apart."""
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    words, ids = np.unique(hashes, return_inverse=True)
    size = len(words)
    ids = ids.reshape(-1).astype(np.int64)
    _, key = _pairs(ids, offs, size)
    bigrams, which = np.unique(key, return_inverse=True)
    every, tilt = _tilts(ids, doc, labels, size, chance)
    pairs, pair_tilt = _tilts(which.reshape(-1), doc, labels, len(bigrams), chance)
    told = (pair_tilt != 1).any(0)
    used = (tilt != 1).any(0)
    context, after = bigrams // (size + 1), bigrams % (size + 1)
    used[after[told]] = True
    used[context[told & (context < size)]] = True
    return words, every, tilt, bigrams, pairs, pair_tilt, told, used


def common_words(hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The sorted words that the model of these texts, or that of a part of them that leaves out a fold, can have: those of several
    texts, as nothing that one text alone has is more than chance."""
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    words, ids = np.unique(hashes, return_inverse=True)
    return words[np.bincount(_distinct(ids.reshape(-1), doc)[0], minlength=len(words)) > 1]


def _fit(hashes: np.ndarray, offs: np.ndarray, labels: np.ndarray, corpus: tuple[np.ndarray, np.ndarray] | None, total: int, chance: float = CHANCE) -> Model:
    words, every, tilt, bigrams, pairs, pair_tilt, told, used = _selected(hashes, offs, labels, chance)
    size, place = len(words), np.flatnonzero(used)
    context, after = bigrams // (size + 1), bigrams % (size + 1)
    ones, twos = (pairs == 1).sum(), (pairs == 2).sum()
    share = np.maximum(pairs - (ones / (ones + 2 * twos) if ones else 0), 0) / np.bincount(context, pairs, size + 2)[context]
    left = 1 - np.bincount(context[told], share[told], size + 2)
    number = np.full(size + 2, -1)
    number[place], number[size], number[size + 1] = np.arange(len(place)), len(place), len(place) + 1
    vocab = words[place]
    kept = number[context[told]] * (len(vocab) + 1) + number[after[told]]  # in order, as words are
    if corpus is None:
        corpus, total = np.unique(hashes, return_counts=True), len(hashes)
    base = np.append(corpus[1], 0)[_lookup(corpus[0], vocab)] / max(1, total)
    base = np.maximum(base, every[place] / max(1.0, every.sum()) * 1e-3)  # a word of the sample is one of the corpus
    classes, tilts = [], []
    for c in (0, 1):
        own = base * tilt[c][place]
        classes.append(np.append(own, 1.0) / (1 - base.sum() + own.sum()))  # other words are as likely as in the corpus
        before = np.append(tilt[c], [1.0, 1.0])[context[told]]
        tilts.append(np.append(pair_tilt[c][told] / before, 0.0))
    return Model(vocab, kept, np.append(share[told], 0.0), left[np.append(place, [size, size + 1])], tuple(classes), tuple(tilts))


def ratios(model: Model, hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Of every word, the log of its toxic over its ordinary probability."""
    size = len(model.vocab)
    ids = _lookup(model.vocab, hashes)
    left, key = _pairs(ids, offs, size)
    at = _lookup(model.bigrams, key)
    own = [model.share[at] * tilt[at] + model.left[left] * word[ids] for tilt, word in zip(model.tilts, model.words, strict=True)]
    return np.log(np.maximum(own[1], 1e-300) / np.maximum(own[0], 1e-300))


def features(model: Model, texts: K.Texts) -> np.ndarray:
    """Of each text, the mean ratio of its words, and the best mean over PASSAGE words in a row."""
    return _features(model, *word_hashes(texts))


def _features(model: Model, hashes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ratio = ratios(model, hashes, offs)
    n = np.diff(offs)
    out = np.zeros((len(n), 2))
    some = np.flatnonzero(n > 0)
    if not len(some):
        return out
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    out[:, 0] = (sums[offs[1:]] - sums[offs[:-1]]) / np.maximum(n, 1)
    begin, last = np.arange(len(ratio)), np.repeat(offs[1:], n)
    first = np.repeat(offs[:-1], n) == begin
    mean = (sums[np.minimum(begin + PASSAGE, last)] - sums[:-1]) / PASSAGE
    mean[(begin + PASSAGE > last) & ~first] = -np.inf
    out[some, 1] = np.maximum.reduceat(mean, offs[:-1][some])
    return out


def logistic(x: np.ndarray, y: np.ndarray, often: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights of a logistic function of standardised columns, then shift and scale; Newton steps, the same each time. often: how
    many rows each row stands for."""
    shift, scale = x.mean(0), x.std(0) + 1e-9
    often = np.ones(len(y)) if often is None else often
    z = np.column_stack([(x - shift) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (often * (p - y)) + ridge * w
        h = (z * (often * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.concatenate([w, shift, scale])


def probability(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    k = x.shape[1]
    z = (x - weights[k + 1 : 2 * k + 1]) / weights[2 * k + 1 :]
    return 1 / (1 + np.exp(-np.clip(z @ weights[:k] + weights[k], -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = MAX_ROWS, max_bytes: tuple[int, int] = MAX_BYTES) -> DataFrame:
    """Text and label of at most max_rows and max_bytes of either class, in the order of the hash of doc_id, and how many labelled
    rows its class has in all (known).

    Texts longer than 1 / LONG of the bound come last, and the first of them that doesn't fit is cut to what does, so they
    leave out no other row, and a class with any text is not empty."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = known.groupBy("toxic").agg(F.count("*").alias("known"))  # two rows
    ranked = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("at")).join(F.broadcast(sizes), "toxic")
    picked = [ranked.where(F.col("toxic") == c).orderBy("at", "doc_id").limit(max_rows[c]) for c in (0, 1)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    most = F.when(F.col("toxic") == 1, max_bytes[1]).otherwise(max_bytes[0])
    rows = rows.withColumn("own", F.octet_length("text")).withColumn("long", F.col("own") > most / LONG)
    order = Window.partitionBy("toxic").orderBy("long", "at", "doc_id", F.xxhash64("text"))
    rows = rows.withColumn("left", most - F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("own"))
    fits = F.col("own") <= F.col("left")
    text = F.when(fits, F.col("text")).otherwise(F.substring("text", F.lit(1), F.floor(F.col("left") / 4).cast("int")))  # a character has 4 bytes at most
    return rows.where(fits | F.col("long") & (F.col("left") >= 4)).select("doc_id", text.alias("text"), "toxic", "at", "known")


def corpus_counts(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """How often each word of the shared, sorted vocabulary occurs in all texts; the row of a null word counts all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        found, total = np.zeros(len(table) + 1, np.int64), 0
        for batch in batches:
            for texts in K.chunks(batch.column(0)):
                hashes, _ = word_hashes(texts)
                found += np.bincount(_lookup(table, hashes), minlength=len(table) + 1)
                total += len(hashes)
        there = np.flatnonzero(found[:-1])
        yield pa.record_batch({"word": pa.concat_arrays([pa.array(table[there].view(np.int64)), pa.nulls(1, pa.int64())]), "n": pa.array(np.append(found[there], total))})

    return K.arrow(docs.select("text"), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _in_one_task(rows: DataFrame, of: Callable[[pa.Table], object]) -> object:
    """of(rows), on an executor; for the sample only, which is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(batches)
        table = pa.Table.from_batches(kept).sort_by([("at", "ascending"), ("doc_id", "ascending")]) if kept else None
        yield pa.record_batch({"out": pa.array([pickle.dumps(of(table) if table is not None and table.num_rows else None)], pa.binary())})

    found = K.arrow(rows.repartition(1), run, "out binary").first()  # none without partitions
    return pickle.loads(found[0]) if found else None


def _vocabulary(rows: pa.Table) -> np.ndarray | None:
    """The words that the model may have; None if the sample has rows of one class only."""
    if len(rows["toxic"].unique()) < 2:
        return None
    return common_words(*_hashed(rows["text"]))


def _trained(rows: pa.Table, corpus: tuple[np.ndarray, np.ndarray], total: int) -> Model:
    """The model of the sample, and a logistic function of ratios from models that have not seen the text."""
    y = rows["toxic"].to_numpy().astype(np.int64)
    hashes, offs = _hashed(rows["text"])
    fold, n = np.arange(len(y)) % FOLDS, np.diff(offs)
    x = np.zeros((len(y), 2))

    def taken(those: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes[np.repeat(those, n)], np.append(0, np.cumsum(n[those]))

    for k in range(FOLDS):
        if len(np.unique(y[fold != k])) == 2:
            part = _fit(*taken(fold != k), y[fold != k], corpus, total)
            x[fold == k] = _features(part, *taken(fold == k))
    model = _fit(hashes, offs, y, corpus, total)
    known, sampled = rows["known"].to_numpy(), np.bincount(y, minlength=2)
    often = known / sampled[y]  # the bounds may cut one class more than the other
    model.weights = logistic(x, y, often * len(y) / often.sum())
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = MAX_ROWS, max_bytes: tuple[int, int] = MAX_BYTES) -> Model | None:
    """None if a class has no rows. docs: doc_id, text. labels: doc_id, toxic, of the rows that may be learned from.

    The sample stays on the executors: the driver sees its vocabulary, the words' counts and the model.
    """
    with tidy(docs.sparkSession) as steps:
        rows = cut(sample(docs, labels, max_rows, max_bytes))
        found = _in_one_task(rows, _vocabulary)
        model = None
        if found is not None:
            vocab = docs.sparkSession.sparkContext.broadcast(found)
            counts = corpus_counts(docs, vocab).toArrow()
            vocab.destroy()
            named = counts.filter(counts["word"].is_valid())
            total = sum(counts.filter(counts["word"].is_null())["n"].to_pylist())
            order = np.argsort(word := named["word"].to_numpy().view(np.uint64))
            shared = docs.sparkSession.sparkContext.broadcast((word[order], named["n"].to_numpy()[order]))
            model = _in_one_task(rows, lambda table: _trained(table, shared.value, total))
            shared.destroy()
        steps.done(docs)
    return model


def batch_scores(model: Model | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    return np.concatenate([np.zeros(0), *(probability(model.weights, features(model, t)) for t in K.chunks(column))])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(batch_scores(shared.value, batch.column(1)))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return K.arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is under the threshold, with all columns as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(batch_scores(shared.value, batch.column(at)) < threshold))

    return K.arrow(docs, run, docs.schema)
