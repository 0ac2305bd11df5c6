"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents fall by hash into blocks, and its target becomes a quota of block draws: whole
rounds over all of its blocks, and part of one more. The quotas of all sources are divided among output
shards: a node of the tree splits its exact counts per source between its halves by hypergeometric draws,
so a leaf holds what a uniform shuffle of all draws would give it. Leaf by leaf, a shard then draws its
share at random from the blocks of each source that no shard has drawn in the round, so shards are
disjoint, and what a document is taken for follows from the leaves that drew its block. As blocks differ
in words, the last draw of a source is taken in part, or further ones follow, until its words are its
rounded target. A shard's documents are in a local hash order.

Word counts by (source, block) reach the driver: at most BLOCK_ROWS rows or, where there are more sources
than that, one row a source; then the plan isn't broadcast either.

Defined cases: null text has size 0; null is a source of its own, the last; a source without words has
target 0; a null doc_id is mixed like any other; repeated rows are each mixed, and share evenly what a cut
leaves them; documents of equal hash are taken alike; very long texts count whole, and may be the one taken
in part; an empty table gives an empty result; further columns are ignored (mixed_documents keeps them)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, materialize, packed, unpacked

WEIGHTS = (1, 2, 3)
#: Times its size that a source, and a document, gives at most.
REPEATS = 3
SEED = 20_011
#: Blocks of a source, and (source, block) rows on the driver, at most.
BLOCKS = 1024
BLOCK_ROWS = 1 << 18
#: Words of an output shard, and shards, at least and at most; a shard of more words is dealt to several tasks.
SHARD_WORDS = 50_000_000
SHARDS_LEAST, SHARDS = 8, 4096
#: Words of a piece of a shard, which one task sorts.
PIECE_WORDS = 2_000_000


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = REPEATS) -> list[float]:
    """The sum of sizes shared by weight, none above most times its size, the excess shared anew."""
    goal = [0.0] * len(sizes)
    left, free = float(sum(sizes)), list(range(len(sizes)))
    while free and left > 0:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in free:
                goal[i] = left * weights[i] / weight
            break
        for i in over:
            goal[i] = float(most * sizes[i])
        left -= sum(goal[i] for i in over)
        free = [i for i in free if i not in over]
    return goal


def splitting_tree(counts: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """counts of each source divided among shards: an array (shards, sources) of exact quotas."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(counts)), np.int64)

    def split(own: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = own
            return
        mid = (lo + hi) // 2
        total = int(own.sum())
        take = total * (mid - lo) // (hi - lo)
        left = np.zeros_like(own)
        for i in np.flatnonzero(own).tolist():  # the marginals of the multivariate draw, one source after another
            n = int(own[i])
            total -= n
            left[i] = rng.hypergeometric(n, total, take) if take else 0
            take -= int(left[i])
        split(left, lo, mid)
        split(own - left, mid, hi)

    split(np.asarray(counts, np.int64), 0, shards)
    return out


def quota(words: dict[int, int], give: int) -> int:
    """Block draws that a source's words in blocks stand for: whole rounds, and its share of one more."""
    size = sum(words.values())
    if not give:
        return 0
    rounds = min(REPEATS, give // size)
    rest = give - rounds * size
    return rounds * len(words) + (max(1, round(rest * len(words) / size)) if rest else 0)


def drawn(words: dict[int, int], give: int, quotas: np.ndarray, seed: Sequence[int]) -> list[tuple[int, int, int]]:
    """(block, shard, words) of a source in the order of draws, give words in all, the last draw perhaps in
    part. quotas: of each shard, which takes its share at random from what is left of the round."""
    if not give:
        return []
    rng, blocks, order, shard = np.random.default_rng(seed), np.array(sorted(words), np.int64), [], 0
    left = blocks
    for shard in np.flatnonzero(quotas).tolist():
        n = int(quotas[shard])
        while n:
            k, mixed = min(n, len(left)), rng.permutation(left)
            order += [(b, shard) for b in mixed[:k].tolist()]
            left = np.sort(mixed[k:]) if k < len(left) else blocks
            n -= k
    if len(left) < len(blocks):  # blocks differ in words: the last shard draws on where they fall short
        order += [(b, shard) for b in rng.permutation(left).tolist()]
    whole, used, out = give // sum(words.values()) * len(blocks), 0, []
    for i, (b, to) in enumerate(order):
        if used == give and i >= whole:
            break
        out.append((b, to, min(words[b], give - used)))
        used += out[-1][2]
    return out


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _blocks(sized: DataFrame, per: int) -> DataFrame:
    return sized.withColumn("block", F.pmod("h", F.lit(per)).cast("int"))


#: Rows d and k of one block; null is a source.
SAME_BLOCK = "d.source <=> k.source and d.block = k.block"
PLAN = "source string, block int, source_size long, target double, whole int, part long, shards array<int>"


def plan(words: dict[str | None, dict[int, int]], weights: Sequence[float], seed: int) -> tuple[list[tuple], int]:
    """Rows of PLAN for the words of blocks of sources, and the number of shards. whole: how often a block is
    taken whole; part: words taken of it once more; shards: of each time, the one in part last."""
    names = sorted(words, key=lambda s: (s is None, s or ""))
    sizes = [sum(words[s].values()) for s in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    quotas = [quota(words[s], round(g)) for s, g in zip(names, goal)]
    shards = max(1, min(SHARDS, max(SHARDS_LEAST, math.ceil(sum(sizes) / SHARD_WORDS)), sum(quotas)))
    leaves = splitting_tree(quotas, shards, seed)
    rows = []
    for i, (s, size, target) in enumerate(zip(names, sizes, goal)):
        own = {b: [0, 0, []] for b in words[s]}
        for b, shard, n in drawn(words[s], round(target), leaves[:, i], (seed, i)):
            own[b][0 if n == words[s][b] else 1] += 1 if n == words[s][b] else n
            own[b][2].append(shard)
        rows += [(s, b, size, float(target), *own[b]) for b in sorted(own)]
    return rows, shards


@dataclass
class Mix:
    """What is settled for all documents: a table of PLAN with the cut of blocks taken in part."""

    table: DataFrame
    per: int  # blocks of a source
    shards: int
    shard_words: int
    seed: int

    def applied(self, sized: DataFrame) -> DataFrame:
        """sized (.., source, size, h) with source_size, target, whole, shards and extra, the words taken of a
        document besides whole rounds. No row moves where the plan is broadcast."""
        own = ("source_size", "target", "whole", "shards", "at", "each")
        joined = _blocks(sized, self.per).alias("d").join(self.table.alias("k"), F.expr(SAME_BLOCK)).select("d.*", *[f"k.{c}" for c in own])
        at = _second(self.seed)
        extra = F.when(at < F.col("at"), F.col("size")).when(at == F.col("at"), F.least("size", "each")).otherwise(0)
        return joined.withColumn("extra", extra.cast("long")).drop("at", "each")


def _second(seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 2), "h")


def settle(sized: DataFrame, weights: Sequence[float], seed: int) -> Mix:
    """The mix of sized (source, size, h)."""
    spark = sized.sparkSession
    n_sources = max(1, sized.select("source").distinct().count())
    per = max(1, min(BLOCKS, BLOCK_ROWS // n_sources))
    blocked = _blocks(sized, per)
    words: dict[str | None, dict[int, int]] = {}
    for r in blocked.groupBy("source", "block").agg(F.sum("size").alias("words")).toLocalIterator():
        words.setdefault(r.source, {})[r.block] = r.words
    rows, shards = plan(words, weights, seed)

    def known(rows: list[tuple], schema: str) -> DataFrame:
        df = spark.createDataFrame(rows, schema)
        return F.broadcast(df) if len(rows) <= BLOCK_ROWS else df

    # One block per source is taken in part: its documents by a second hash, up to a cut that is found from sums
    # by the hash's first bits, then by hash within the level that the cut falls into.
    bits = max(0, min(10, (BLOCK_ROWS // n_sources).bit_length() - 1))
    parts = known([(r[0], r[1], r[5]) for r in rows if r[5]], "source string, block int, part long")
    inside = blocked.select("source", "block", "size", _second(seed).alias("at")).alias("d").join(parts.alias("k"), F.expr(SAME_BLOCK))
    inside = inside.select("d.*", "k.part").withColumn("level", F.shiftright("at", 64 - bits) if bits else F.lit(0).cast("long"))
    levels: dict[str | None, list] = {}
    for r in inside.groupBy("source", "block", "part", "level").agg(F.sum("size").alias("words")).toLocalIterator():
        levels.setdefault(r.source, []).append((r.level, r.words, r.block, r.part))
    reached = []
    for s, own in levels.items():
        before = 0
        for level, n, block, part in sorted(own):
            if before < part <= before + n:
                reached.append((s, block, level, part - before))
            before += n
    reached = known(reached, "source string, block int, level long, left long")
    edge = inside.alias("d").join(reached.alias("k"), F.expr(SAME_BLOCK + " and d.level = k.level"))
    edge = edge.groupBy("d.source", "d.block", "k.left", "d.at").agg(F.sum("d.size").alias("words"), F.count("*").alias("rows"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.withColumn("before", F.coalesce(running, F.lit(0))).filter("before < left and left <= before + words")
    each = F.floor((F.col("left") - F.col("before")) / F.col("rows")).cast("long").alias("each")
    cut = {(r.source, r.block): (r["at"], r["each"]) for r in edge.select("source", "block", "at", each).toLocalIterator()}  # a row a source
    table = known([(*r, *cut.get((r[0], r[1]), (None, None))) for r in rows], PLAN + ", at long, each long")
    total = sum(r[4] * words[r[0]][r[1]] + r[5] for r in rows)
    return Mix(table, per, shards, -(-total // shards), seed)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shards, local_order) for every row of docs
    (doc_id, text, source). shards: the shard of each time that the document is taken, the last time
    perhaps in part; local_order: its place within those shards."""
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), _hash(seed).alias("h"))
    sized = materialize(sized, "mixing-sizes")
    times = F.col("whole") + (F.col("extra") > 0).cast("int")
    return settle(sized, weights, seed).applied(sized).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("whole") + F.col("extra")).alias("taken"),
        F.slice("shards", 1, times).alias("shards"),
        F.xxhash64(F.lit(seed + 1), "h").alias("local_order"),
    )


def sharded(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(d, shard, local_order): each row d of docs as often as the mix takes it, a part of half a document or
    more as one, dealt to the shards that drew it and in local order within them. A task holds pieces of
    shards, each a stretch of that order, so a shard may be larger than a task."""
    sized = packed(docs, "doc_id", "text", "source").select("d", "source", size_of(F.col("text")).alias("size"), _hash(seed).alias("h"))
    settled = settle(materialize(sized.select("source", "size", "h"), "mixing-sizes"), weights, seed)
    times = F.col("whole") + (2 * F.col("extra") >= F.greatest("size", F.lit(1))).cast("int")
    rows = settled.applied(sized).select("d", F.explode(F.slice("shards", 1, times)).alias("shard"), F.xxhash64(F.lit(seed + 1), "h").alias("local_order"))
    pieces = max(1, math.ceil(settled.shard_words / PIECE_WORDS))
    piece = F.floor((F.col("local_order").cast("double") / 2.0**64 + 0.5) * pieces).cast("int")
    return rows.withColumn("piece", piece).repartition("shard", "piece").sortWithinPartitions("shard", "local_order").drop("piece")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The rows of sharded() with docs' own columns, in its order."""
    return unpacked(sharded(docs, weights, seed), docs.columns)


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> None:
    """A folder shard=N of Parquet files for each shard, rows (d, local_order) in local order."""
    sharded(docs, weights, seed).write.partitionBy("shard").parquet(path)
