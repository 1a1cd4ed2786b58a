"""Mixing sources to target weights, in DataFrame functions only.

1. Each source's documents, in a pseudorandom order, are one stream of words, packed into blocks of ``block`` words (the
   last may be shorter). A document's first word in its stream is a running sum in two levels, (source, bucket) and then
   buckets, so a hot source is spread over BUCKETS windows.
2. The mix is a list of block slots, dealt to output shards. A shard's source counts are a multinomial draw of its slots. By
   default it is stratified: the whole part of each expectation is given, and only the fractional parts' slots are drawn with
   their probabilities. A plain draw (``stratified=False``) leaves a source of n expected slots off its target by about
   1 / sqrt(n), whatever the draws: too much for small sources, whose words must come near their targets.
3. The j-th slot of a source takes, in pass j div n over its n blocks, block perm(j mod n), with a permutation of its own
   for each source and pass: three rounds of multiplication by a coprime prime, with parts of the range turned again.
4. Slots join blocks by (source, index); both sides are even, whatever the sources' sizes.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; no target is above REPEAT times
its source's size, the excess is shared again by weight. That is target = min(REPEAT * size, level * weight) for the one
level at which targets add up to all words.

Defined cases: null, empty and blank texts have size 0 and are taken 0 times. Null doc_ids and repeated rows are documents
like others. A null source is a source. If all texts are empty, targets are 0. An empty table gives an empty result. Slots
that would start a further pass than REPEAT are left out, so no document exceeds REPEAT times its size. The same rows give
the same mix, however they are partitioned. Windows without partitions run over sources (one row each) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, settled, tidy

BLOCK = 256
SHARD = 4096
REPEAT = 3
#: Shards whose slots of a source one window adds up.
SPAN = 4096
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"
#: Primes below 2**27; a source has fewer blocks than their product, so one of them at least is coprime to it.
PRIMES = (134217689, 134217649, 134217617)


def _random(*parts: Column | str | int) -> Column:
    """A pseudorandom integer under 2**32, by its parts."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def numbered(docs: DataFrame) -> DataFrame:
    """Of every row of docs, which is settled: its place as row, doc_id, source, size in words, and its place in the
    pseudorandom order: h, and k that numbers equal rows."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    order = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("source"), F.md5(F.coalesce("text", F.lit("")))))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", size.alias("size"), order.alias("h")))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("size")))


def sources(sizes: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """sid, source, source_size, target of each source; sizes: source, size."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = total.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", ((F.col("sid") - 1) % 3 + 1).cast("double"))
    fills = (F.lit(float(repeat)) * F.col("source_size") / F.col("weight")).alias("fills")
    ranked = ranked.select("*", fills)
    every = Window.partitionBy()
    upto = Window.orderBy("fills", "sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.select("*", F.sum("source_size").over(every).alias("total"), F.sum("weight").over(every).alias("weights"), F.sum("source_size").over(upto).alias("full"), F.sum("weight").over(upto).alias("gone"))
    # the level if just the sources before this one in the order were full
    level = (F.col("total") - repeat * (F.col("full") - F.col("source_size"))) / (F.col("weights") - (F.col("gone") - F.col("weight")))
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.min(F.when(F.col("level") <= F.col("fills"), F.struct("gone", "level"))).over(every)["level"])
    target = F.least(F.lit(float(repeat)) * F.col("source_size"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return ranked.select("sid", "source", "source_size", F.round(target, 6).alias("target"))


def shard_counts(names: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: str = SEED, stratified: bool = True) -> DataFrame:
    """sid, n (its blocks), shard and slots: how many slots of each output shard are the source's."""
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    expected = names.where("source_size > 0").select("sid", blocks.alias("n"), (F.col("target") * blocks / F.col("source_size")).alias("slots"))
    total = F.sum("slots").over(Window.partitionBy())
    expected = expected.select("sid", "n", (F.col("slots") / total).alias("p"), F.round(total).cast("long").alias("total")).where("total > 0")
    # shards come in spans, so that no task makes all of them
    spans = expected.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {shard} div {SPAN}")))).repartition("sid", "span")
    last = F.least(F.expr(f"(total - 1) div {shard}"), F.col("span") * SPAN + SPAN - 1)
    shards = spans.withColumn("shard", F.explode(F.sequence(F.col("span") * SPAN, last)))
    shards = shards.withColumn("width", F.least(F.lit(shard), F.col("total") - F.col("shard") * shard))
    whole = F.floor(F.col("p") * F.col("width")) if stratified else F.lit(0).cast("long")
    shards = shards.withColumn("whole", whole).withColumn("part", F.col("p") * F.col("width") - F.col("whole"))
    in_shard = Window.partitionBy("shard").orderBy("sid")
    upto = in_shard.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("shard")
    shards = shards.select("*", F.sum("part").over(upto).alias("high"), F.sum("part").over(every).alias("parts"), (F.col("width") - F.sum("whole").over(every)).alias("open"))
    # each open slot is one draw: its place on the line of the parts that are not given
    draws = shards.groupBy("shard").agg(F.max("open").alias("open"), F.max("parts").alias("parts")).where("open > 0")
    draws = draws.select("shard", "parts", F.explode(F.sequence(F.lit(1).cast("long"), F.col("open"))).alias("k"))
    draws = draws.select("shard", (_random(seed, "draw", F.col("shard"), F.col("k")) / F.lit(float(1 << 32)) * F.col("parts")).alias("at"))
    low = F.lag("high", 1, 0.0).over(in_shard)
    end = F.row_number().over(Window.partitionBy("shard").orderBy(F.col("sid").desc())) == 1
    lines = shards.select("sid", "n", "shard", "whole", low.alias("low"), F.when(end, F.lit(float("inf"))).otherwise(F.col("high")).alias("high"))
    got = lines.join(draws, "shard").where("at >= low AND at < high").groupBy("shard", "sid").agg(F.count("*").alias("drawn"))
    return lines.join(got, ["shard", "sid"], "left").select("sid", "n", "shard", (F.col("whole") + F.coalesce("drawn", F.lit(0))).alias("slots"))


ROUNDS = 3


def _prime(of: Column) -> Column:
    out = F.lit(PRIMES[-1])
    for p in reversed(PRIMES[:-1]):
        out = F.when(of % p != 0, F.lit(p)).otherwise(out)
    return out.cast("long")


def turn_keys(sid: Column, n: Column, repeat: int = REPEAT, seed: str = SEED) -> Column:
    """What the permutations of a source of n blocks turn by: a struct for each round of each pass. Made once for a source, as
    slots are many and the generated code of a stage is bounded."""
    digests = F.array(*(F.md5(F.concat_ws(":", F.lit(seed), sid.cast("string"), F.lit(f"{turn}:{r}"))) for turn in range(repeat) for r in range(ROUNDS)))

    def key(digest: Column, k: int) -> Column:
        return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")

    def turned(d: Column) -> Column:
        part = n - key(d, 1) % (F.floor(n / 2) + 1)
        return F.struct(key(d, 0).alias("a"), _prime(n).alias("whole"), part.alias("part"), _prime(part).alias("prime"), key(d, 2).alias("c"))

    return F.transform(digests, turned)


def permuted(slots: DataFrame) -> DataFrame:
    """slots (sid, n, turn, keys, x) with x in [0, n) put through the permutation of [0, n) of its source and pass.

    The rounds are a fold over the pass's keys: as columns of their own they make a method that is too large for the JVM's
    compiler. Beyond the last pass there are no keys, and x stays: the filter of those slots may be evaluated after this.
    """
    n = F.col("n")

    def turned(x: Column, key: Column) -> Column:
        moved = F.array((key["whole"] * x + key["a"]) % n)  # one value, used three times
        return F.transform(moved, lambda y: n - 1 - F.when(y < key["part"], (key["prime"] * y + key["c"]) % key["part"]).otherwise(y))[0]

    keys = F.slice("keys", (F.col("turn") * ROUNDS + 1).cast("int"), F.lit(ROUNDS))
    return slots.withColumn("x", F.aggregate(keys, F.col("x").cast("long"), turned)).drop("keys")


def before(rows: DataFrame, group: str, along: tuple[str, ...], amount: str) -> DataFrame:
    """rows with start, the sum of what comes before each of them in its source: in two levels, so that no window has all its rows.

    group orders the rows of a source first, then along."""
    inside = Window.partitionBy("sid", group).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    totals = rows.groupBy("sid", group).agg(F.sum(amount).alias("own"))
    over = Window.partitionBy("sid").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("sid", group, F.coalesce(F.sum("own").over(over), F.lit(0)).alias("base"))
    return rows.join(starts, ["sid", group]).withColumn("start", F.col("base") + F.col("inside")).drop(group, "base", "inside")


def block_uses(names: DataFrame, block: int = BLOCK, shard: int = SHARD, repeat: int = REPEAT, seed: str = SEED, stratified: bool = True) -> DataFrame:
    """How often the mix takes each block: sid, index, uses."""
    counts = shard_counts(names, block, shard, seed, stratified).withColumn("span", F.expr(f"shard div {SPAN}"))
    counts = before(counts, "span", ("shard",), "slots")
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    counts = counts.join(cut(names.where("source_size > 0").select("sid", turn_keys(F.col("sid"), blocks, repeat, seed).alias("keys"))), "sid")
    slots = counts.where("slots > 0").select("sid", "n", "keys", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("slots") - 1)).alias("slot"))
    slots = slots.where(F.col("slot") < repeat * F.col("n")).select("sid", "n", "keys", F.expr("slot div n").alias("turn"), (F.col("slot") % F.col("n")).alias("x"))
    return permuted(slots).select("sid", F.col("x").alias("index")).groupBy("sid", "index").agg(F.count("*").alias("uses"))


def placed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Where each row lies in its source's stream: its columns, sid, source_size, target and start."""
    named = rows.join(names.select("sid", F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return before(named.withColumn("bucket", F.substring("h", 1, 3)), "bucket", ("h", "k"), "size")


def pieces(rows: DataFrame, uses: DataFrame, block: int = BLOCK) -> DataFrame:
    """The part of each row in each block: row, at (its first word), words, uses (0 if the mix leaves the block out)."""
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    parts = rows.where("size > 0").select("row", "sid", "start", "size", F.explode(F.sequence(first, last)).alias("index"))
    begin = F.greatest(F.col("index") * block, F.col("start"))
    words = F.least((F.col("index") + 1) * block, F.col("start") + F.col("size")) - begin
    joined = parts.join(uses, ["sid", "index"], "left")
    return joined.select("row", (begin - F.col("start")).alias("at"), words.alias("words"), F.coalesce("uses", F.lit(0)).alias("uses"))


def _planned(docs: DataFrame, block: int, shard: int, repeat: int, seed: str, stratified: bool) -> tuple[DataFrame, DataFrame]:
    """Rows in their places, and their pieces."""
    rows = numbered(docs)
    names = cut(sources(rows.select("source", "size"), repeat))
    rows = cut(placed(rows, names))
    return rows, pieces(rows, block_uses(names, block, shard, repeat, seed, stratified), block)


def mixture(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, repeat: int = REPEAT, seed: str = SEED, stratified: bool = True) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    with tidy(docs.sparkSession) as steps:
        rows, parts = _planned(docs.select("doc_id", "source", "text"), block, shard, repeat, seed, stratified)
        took = parts.groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
        joined = steps.done(rows.join(took, "row", "left"))
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, repeat: int = REPEAT, seed: str = SEED, stratified: bool = True) -> DataFrame:
    """The mix as documents: of each row a copy for each time the mix takes any of its words, with the words taken.

    A copy of all words has the text as it is; a partial one has the taken words parted by one space. n_chars, if there is
    such a column, follows the text. Rows without words are not in a mix of words. All other columns are as they were.
    """
    with tidy(docs.sparkSession) as steps:
        docs = settled(docs)
        _, parts = _planned(docs.select("doc_id", "source", "text"), block, shard, repeat, seed, stratified)
        plan = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "words", "uses"))).alias("plan"))
        plan = cut(plan.withColumn("most", F.array_max(F.transform("plan", lambda p: p["uses"]))).where("most > 0"))
        whole_rows = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
        copies = steps.done(whole_rows.join(plan, "row"))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))))
    copies = copies.withColumn("whole", F.forall("plan", lambda p: p["uses"] >= F.col("copy")))
    copies = copies.withColumn("found", F.when(~F.col("whole"), F.regexp_extract_all(F.col("doc.text"), F.lit(WORD), F.lit(0))))
    taken = F.filter("plan", lambda p: p["uses"] >= F.col("copy"))
    kept = F.flatten(F.transform(taken, lambda p: F.slice(F.col("found"), (p["at"] + 1).cast("int"), p["words"].cast("int"))))
    out = copies.withColumn("text", F.when(F.col("whole"), F.col("doc.text")).otherwise(F.array_join(kept, " ")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))
