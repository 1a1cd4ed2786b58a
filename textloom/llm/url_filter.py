"""URL rules behind Bloom filter cascades.

A rule is a host and a path prefix; it fits its host, all subdomains and every path with that prefix. The candidate keys of
a URL are its host suffixes, each with its path prefixes of the lengths that rules have. All candidate keys of the corpus
form the complete key universe. Level 1 of a cascade encodes the listed keys of that universe, level 2 the other keys that
pass level 1, level 3 the listed keys that pass level 2, and so on until none pass; so a key of the universe is listed if
and only if the first level that rejects it is an even one. Filters hold BITS bits a key: their size follows the list,
not the corpus, and is checked against MAX_BYTES before anything is broadcast.

Defined cases: null URLs and URLs without "://" have empty host and path, and no rule. A URL that no rule fits is in no
list: the cascades reject all its keys and it is allowed. Rules without a key in the corpus are in no level. Repeated rows
and null page_ids are rows like others; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.common import cut, thin, tidy

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BITS, HASHES = 12, 6
MAX_BYTES = 256 << 20
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _CAPITALS, _SMALL)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(key: str, level: int) -> tuple[int, int]:
    d = hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16, salt=level.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1


@dataclass
class Bloom:
    level: int
    size: int
    bits: np.ndarray
    hashes: int

    def places(self, key: str) -> list[int]:
        a, b = _digest(key, self.level)
        return [(a + i * b) % self.size for i in range(self.hashes)]

    def has(self, key: str) -> bool:
        bits = self.bits
        return all(bits[p >> 3] >> (p & 7) & 1 for p in self.places(key))


@dataclass
class Cascade:
    levels: list[Bloom]

    def has(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if not level.has(key):
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def candidates(name: str, way: str, lengths: Sequence[int]) -> list[tuple[str, str]]:
    """Host suffixes and path prefixes that a rule for the URL could have, longest rule first, longer host first of equals."""
    if not name:
        return []
    labels = name.split(".")
    found = [(".".join(labels[i:]), way[:n]) for i in range(len(labels)) for n in lengths if n <= len(way)]
    return sorted(set(found), key=lambda k: (-len(k[0]) - len(k[1]), -len(k[0]), k))


def universe(urls: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """The distinct candidate keys of all rows; urls: host, path."""
    labels = F.split("host", r"\.", -1)
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))))
    parts = urls.where("host <> ''").select(suffix.alias("suffix"), "path").select("suffix", F.explode(F.array(*(F.lit(n) for n in lengths))).alias("n"), "path")
    return parts.where(F.length("path") >= F.col("n")).select(F.concat("suffix", F.expr("substring(path, 1, n)")).alias("key")).distinct()


def _encode(keys: DataFrame, count: int, level: int) -> Bloom:
    """A filter of the keys: each task sets its bits in bytes, which are joined by bitwise or."""
    size = max(64, count * BITS)
    if size // 8 > MAX_BYTES:
        raise ValueError(f"{count} keys need a filter of more than {MAX_BYTES} bytes; split the list")
    empty = Bloom(level, size, np.zeros(size // 8 + 1, np.uint8), HASHES)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([p for key in batch.column(0).to_pylist() for p in empty.places(key)], np.int64)
            yield pa.record_batch({"byte": pa.array(at >> 3, pa.int64()), "bits": pa.array(1 << (at & 7), pa.int32())})

    found = K.arrow(keys, bits, "byte long, bits int").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toArrow()
    empty.bits[found["byte"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
    return empty


def build(keys: DataFrame, listed: DataFrame) -> Cascade:
    """A cascade that is exact on keys (the universe) for the listed ones; both have the column ``key``."""
    both = keys.select("key", F.lit(True).alias("there"), F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(False).alias("there"), F.lit(True).alias("listed")))
    marked = thin(cut(both.groupBy("key").agg(F.max("there").alias("there"), F.max("listed").alias("listed")).where("there")))
    levels: list[Bloom] = []
    context = keys.sparkSession.sparkContext
    members, others = (marked.where(F.col("listed") == side).select("key") for side in (True, False))
    while count := members.count():
        levels.append(_encode(members, count, len(levels)))
        shared = context.broadcast(levels[-1])

        def passing(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([shared.value.has(k) for k in batch.column(0).to_pylist()], pa.bool_()))

        members, others = thin(cut(K.arrow(others, passing, "key string"))), members
        shared.destroy()
    return Cascade(levels)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row; pages: page_id, url."""
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, _, p in rules})
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    cascades = {}
    with tidy(spark) as steps:
        keys = thin(cut(universe(urls.select("host", "path").distinct(), lengths)))
        for verdict in ("allow", "block"):
            listed = spark.createDataFrame([(h + p,) for v, h, p in rules if v == verdict], "key string")
            cascades[verdict] = build(keys, listed)
        steps.done(urls)
    shared = spark.sparkContext.broadcast((cascades, lengths))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascades, lengths = shared.value
        longest = max(lengths, default=0)
        known: dict[tuple[str, str], tuple[str | None, str]] = {}
        for batch in batches:
            rule, verdict = [], []
            for name, way in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = (name, way[:longest])
                if at not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    hits = ((h + p, v) for h, p in candidates(*at, lengths) for v in ("block", "allow") if cascades[v].has(h + p))
                    known[at] = next(hits, (None, "allow"))
                r, v = known[at]
                rule.append(r)
                verdict.append(v)
            yield pa.record_batch({"page_id": batch.column(0), "host": batch.column(1), "path": batch.column(2), "rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())})

    return K.arrow(urls, run, f"page_id {kind}, host string, path string, rule string, verdict string")
