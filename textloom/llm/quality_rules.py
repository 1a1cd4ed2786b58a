"""Quality rules by weak supervision.

Rules vote good (2), bad (0) or abstain (1). Expectation-maximisation over the counts of vote patterns, of which there are
at most 3 ** len(RULES) whatever the corpus, estimates how often each rule votes what on good and on bad texts; a text
stays if its posterior probability of being good reaches one half.

Defined cases: null, empty and blank texts have no words and fail the base rule. A null doc_id is kept as it is. Repeated
rows count as often as they occur. With an empty table nothing is estimated and nothing returned. One language's texts, or
one hot source, change nothing: no rows are grouped but by pattern. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.common import cut

WINDOW = 5
_SYMBOL, _UPPER, _LETTER, _SHOUT = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_SHOUT[[ord(c) for c in "!?"]] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(texts: K.Texts, w: K.Words | None = None, hashes: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Counts of each text. A repeated word lies in a window of five words that its text has twice or more. w and hashes: the
    texts' words and their hashes, if they are at hand."""
    n = len(texts)
    if w is None or hashes is None:
        w = K.words(texts)
        hashes = texts.span_hash(w.starts, w.ends)
    starts, ends, line_of = K.lines(texts)
    inked = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    again = K.occurrences(line_of[inked], texts.span_hash(starts[inked], ends[inked])) > 0
    spelt, stop = _plain(texts, w)
    return {
        "n_spelt": w.count(spelt),
        "n_stop": w.count(stop),
        "n_words": np.diff(w.offs),
        "word_chars": texts.count(((texts.data & 0xC0) != 0x80) & ~K.white(texts)),
        "n_symbols": texts.count(_SYMBOL[texts.data]),
        "n_dup_lines": np.bincount(line_of[inked][again], minlength=n),
        "n_repeat_words": w.count(_repeated(hashes, w)),
        "n_lines": np.bincount(line_of[inked], minlength=n),
        "n_upper": texts.count(_UPPER[texts.data]),
        "n_letters": texts.count(_LETTER[texts.data]),
        "n_shouts": texts.count(_SHOUT[texts.data]),
    }


def _repeated(hashes: np.ndarray, w: K.Words) -> np.ndarray:
    """Which words lie in a window of WINDOW words that their text has twice or more."""
    shingle, at = K.windows(hashes, w.offs, WINDOW)
    shingle ^= K.mix(w.text_of[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(shingle)
    shingle = shingle[order]
    same = shingle[1:] == shingle[:-1]
    del shingle
    twice = np.zeros(len(order), bool)
    twice[1:] = same
    twice[:-1] |= same
    first = at[order[twice]]
    out = np.zeros(len(hashes), bool)
    for k in range(WINDOW):
        out[first + k] = True
    return out


def _plain(texts: K.Texts, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Which words are of letters only, and which are stop words; one mark at the end of a word may stand, capitals count as small."""
    ends = w.ends - (_MARK[texts.data[w.ends - 1]] & (w.ends - w.starts > 1)) if len(w.ends) else w.ends
    odd = np.flatnonzero(~_SPELT[texts.data] & ~K.white(texts))
    word = np.searchsorted(w.starts, odd, "right") - 1
    spelt = np.ones(len(ends), bool)
    spelt[word[odd < ends[word]] if len(odd) else word] = False
    lower = texts.data.copy()
    lower[(lower >= 65) & (lower <= 90)] += 32
    hashes, known = K.Texts(texts.first, lower, texts.offs).span_hash(w.starts, ends), _stop_hashes()
    return spelt, known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


_MARK, _SPELT = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_SPELT[128:] = _SPELT[65:91] = _SPELT[97:123] = True
_SPELT[[ord(c) for c in "'-"]] = True
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for with as on be was by this are",
    "le la les de des du et un une en est que qui dans pour par sur",
    "der die das und den dem ein eine zu ist von mit nicht auf für",
    "el los las del y un una en es que con por para se su como",
)
_STOP: list[np.ndarray] = []


def _stop_hashes() -> np.ndarray:
    if not _STOP:
        data = " ".join(STOP_WORDS).encode()
        texts = K.Texts(0, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        w = K.words(texts)
        _STOP.append(np.unique(texts.span_hash(w.starts, w.ends)))
    return _STOP[0]


#: name, measure, of what, good at this share or beyond (None: never says so), bad at this share or beyond.
RULES = (
    ("symbols", "n_symbols", "n_words", None, 0.3),
    ("lines", "n_dup_lines", "n_lines", None, 0.3),
    ("repeats", "n_repeat_words", "n_words", None, 0.2),
    ("capitals", "n_upper", "n_letters", 0.2, 0.5),
    ("shouts", "n_shouts", "n_words", None, 0.3),
    ("long words", "word_chars", "n_words", None, 14.0),
    ("spelling", "n_spelt", "n_words", 0.9, 0.6),
    ("stop words", "n_stop", "n_words", 0.08, 0.02),
    ("length", "n_words", None, 40, 15),
)
#: Shares of bad, abstaining and good votes that a rule is taken to have before any are seen, on bad and on good texts;
#: and how many texts that belief weighs, as a share of all.
PRIOR = ((0.45, 0.35, 0.2), (0.02, 0.35, 0.63))
PRIOR_WEIGHT = 0.05


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One row for each text, one column for each rule. A share of nothing abstains."""
    out = np.ones((len(m["n_words"]), len(RULES)), np.int64)
    for k, (_, what, of, good, bad) in enumerate(RULES):
        whole = m[of] if of else np.ones(len(out), np.int64)
        share = m[what] / np.maximum(whole, 1)
        up = good is not None and good > bad
        if good is not None:
            out[(share >= good) if up else (share <= good), k] = 2
        out[(share < bad) if up else (share >= bad), k] = 0
        out[whole == 0, k] = 1
    return out


def pattern_votes(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(RULES)) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior probability of good for each pattern.

    Two classes, rules independent within a class, a prior belief that rules are mostly right; the start is the majority
    vote, and a rule's good votes may not come more often from bad texts than from good ones (nor the other way round),
    which keeps the classes' meaning.
    """
    if not len(patterns):
        return np.zeros(0)
    v = pattern_votes(patterns)
    balance = (v - 1).sum(1) / np.maximum(1, (v != 1).sum(1))
    good = 0.5 + 0.45 * balance
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        share = weight.sum(1) / counts.sum()
        tables = PRIOR_WEIGHT * counts.sum() * np.repeat(np.array(PRIOR)[:, None, :], len(RULES), 1) + 1e-3
        for value in range(3):
            tables[:, :, value] += weight @ (v == value)
        tables /= tables.sum(2, keepdims=True)
        for k in range(len(RULES)):
            for value, high in ((2, 1), (0, 0)):
                if tables[high, k, value] < tables[1 - high, k, value]:
                    tables[:, k, value] = tables[:, k, value].mean()
        tables /= tables.sum(2, keepdims=True)
        log = np.log(np.clip(share, 1e-9, 1))[:, None] + np.log(tables)[:, np.arange(len(RULES))[None, :], v].sum(2)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - good).max() < 1e-10:
            break
        good = new
    return good


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the vote pattern of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for texts in K.chunks(batch.column(1)):
                m = measure(texts)
                parts.append(np.column_stack([*(m[k] for k in BASE), votes(m) @ 3 ** np.arange(len(RULES))]))
            rows = np.concatenate([np.zeros((0, len(BASE) + 1), np.int64), *parts]).astype(np.int64)
            yield pa.record_batch({"doc_id": batch.column(0)} | {k: pa.array(rows[:, i]) for i, k in enumerate((*BASE, "pattern"))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return K.arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, {', '.join(f'{k} long' for k in BASE)}, pattern long")


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, base counts, base_failed, posterior and kept of every row."""
    rows = cut(measured(docs))
    found = rows.groupBy("pattern").count().orderBy("pattern").toArrow()
    patterns, counts = found["pattern"].to_numpy(), found["count"].to_numpy()
    posterior = estimate(patterns, counts.astype(float))
    spark = docs.sparkSession
    by_pattern = spark.createDataFrame(pa.table({"pattern": patterns.astype(np.int64), "posterior": posterior}))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        rows.join(F.broadcast(by_pattern), "pattern")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
        .select("doc_id", *BASE, "base_failed", "kept", "posterior")
    )
