"""SimHash near-duplicates by covering locality-sensitive hashing.

Every document gets a 64-bit fingerprint of its word shingles. Bit positions are assigned vectors of
GF(2)^(radius+1); table v keeps the bits whose vector has an odd product with v. For any radius or
fewer differing bits some non-zero v is orthogonal to all of their vectors, so that table drops
exactly such bits and the pair shares its key: no pair within the radius is missed.

Defined cases: null or wordless text has fingerprint zero and links like any other; fewer words than
a shingle make one shingle of the whole sequence; very long texts count whole; a bit that just half of the
hashes set is 0; repeated rows and exact copies share a fingerprint and so a component; a null doc_id takes
part in linking but is never a component's id unless the component has no other; an empty table gives an
empty result; further columns are ignored (drop_near_duplicates keeps them)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import workers, connected_components, give_back, materialize, packed, released, unpacked

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Rows of a bucket that are compared directly; larger buckets are first divided by equal bit fields.
DIRECT = 2048
#: Rows of a bucket from which on its fields are dealt out as buckets of their own.
HOT = 20_000
#: Hot buckets up to which their list is broadcast.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 15):
        part = grams[at : at + (1 << 15)]
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in part), "<u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(grams), bitorder="little")
    return int(bits.view("<i8")[0])


def covering_masks(radius: int = RADIUS, width: int = 64) -> list[int]:
    """One mask per non-zero vector of GF(2)^(radius+1), as unsigned integers."""
    n = 1 << (radius + 1)
    vectors = [1 + i % (n - 1) for i in range(width)]
    return [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, n)]


def star_edges(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(value, root) pairs that connect just what links of at most radius bits connect in values."""
    if len(values) > DIRECT:
        edges = []
        fields = radius + 1
        step = -(-64 // fields)
        for i in range(fields):  # radius differing bits leave one of radius+1 fields equal
            key = (values >> np.uint64(i * step)) & np.uint64((1 << min(step, 64 - i * step)) - 1)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(values[order], cuts):
                if len(part) > 1:
                    edges += _walk(part, radius)
        return edges
    return _walk(values, radius)


def _walk(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    edges, rest = [], values
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                front.extend(found)
                edges += [(f, root) for f in found]
    return edges


def _bucket_edges(radius: int):
    def run(batches):
        held_t, held_k, held_v = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        for last, pdf in _with_end(batches):
            t, k, v = (
                (np.concatenate([held_t, pdf.t.to_numpy()]), np.concatenate([held_k, pdf.k.to_numpy()]), np.concatenate([held_v, pdf.fp.to_numpy()]))
                if pdf is not None
                else (held_t, held_k, held_v)
            )
            if not len(t):
                continue
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            starts = np.concatenate([[0], cuts])
            ends = np.concatenate([cuts, [len(t)]])
            if not last:  # the last bucket may go on in the next batch
                held_t, held_k, held_v = t[starts[-1] :], k[starts[-1] :], v[starts[-1] :]
                starts, ends = starts[:-1], ends[:-1]
            out = []
            for i in np.flatnonzero(ends - starts > 1):
                out += star_edges(v[starts[i] : ends[i]].view(np.uint64), radius)
            if out:
                a = np.array(out, np.uint64).view(np.int64)
                yield pd.DataFrame({"src": a[:, 0], "dst": a[:, 1]})

    return run


def _with_end(batches):
    for pdf in batches:
        yield False, pdf
        del pdf
    give_back()  # once a task, as batches are short
    yield True, None


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    @F.pandas_udf("long")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in released(batches):
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    workers(docs.sparkSession)
    return docs.withColumn(out, compute(F.col(text)))


def fingerprint_links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(src, dst) edges among the distinct fingerprints of values(fp) that connect what links connect."""
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])
    rows = values.select("fp", F.explode(keys).alias("x")).select("x.t", "x.k", "fp")
    # A hot bucket isn't one task: its pairs within the radius share one of radius+1 fields of their bits, so each
    # field's values are buckets, numbered from the tables on. Few buckets are hot, as each has more than HOT rows.
    hot = materialize(rows.groupBy("t", "k").count().filter(F.col("count") > HOT).select("t", "k", F.lit(True).alias("hot")), "simhash-hot")
    if n_hot := hot.count():
        rows = _fields_dealt(rows, F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, len(masks), radius)
    return rows.repartition("t", "k").sortWithinPartitions("t", "k").mapInPandas(_bucket_edges(radius), "src long, dst long")


def _fields_dealt(rows: DataFrame, hot: DataFrame, tables: int, radius: int) -> DataFrame:
    """rows (t, k, fp), those of hot buckets (t, k, hot) once for each field of fp."""
    step = -(-64 // (radius + 1))
    fields = [F.shiftrightunsigned("fp", i * step).bitwiseAND(F.lit((1 << min(step, 64 - i * step)) - 1)) for i in range(radius + 1)]
    dealt = F.array(*[F.struct((F.lit(tables) + F.col("t") * (radius + 1) + i).cast("int").alias("t"), F.xxhash64("k", f).alias("k")) for i, f in enumerate(fields)])
    marked = rows.join(hot, ["t", "k"], "left").select("fp", F.explode(F.when(F.col("hot"), dealt).otherwise(F.array(F.struct("t", "k")))).alias("x"))
    return marked.select("x.t", "x.k", "fp")


def _components(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, c) for every fingerprint of prints, c the same for those that links connect."""
    values = materialize(prints.select("fp").distinct(), "simhash-classes")
    parts = connected_components(fingerprint_links(values, radius), "simhash-links")
    return values.join(parts, values.fp == parts.node, "left").select("fp", F.coalesce("component", "fp").alias("c"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text)."""
    prints = materialize(with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "simhash")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(_components(prints, radius), "fp")
    first = named.groupBy("c").agg(F.min("least").alias("component_id"))
    ids = named.join(first, "c").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null last), ties by a hash of the text. Rows
    are told apart by their doc_id and that hash; only what goes, or is there more than once, meets them again."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"))
    prints = materialize(with_fingerprints(docs.select("doc_id", "text")).select(key.alias("key"), "fp"), "simhash")
    # Per fingerprint and key the rows there are; per component its first key.
    counted = prints.groupBy("fp", "key").count()
    classes = counted.groupBy("fp").agg(F.min("key").alias("first")).join(_components(prints, radius), "fp")
    best = classes.groupBy("c").agg(F.min("first").alias("first"))
    first = classes.select("fp", "c").join(best, "c").select("fp", "first")
    judged = counted.join(first, "fp").select("key.doc_id", F.col("key.h").alias("h"), (F.col("key") == F.col("first")).alias("best"), "count")
    apart = materialize(judged.filter("not best or count > 1"), "simhash-apart")
    named = packed(docs, "doc_id", "text").withColumn("h", F.xxhash64("text")).alias("x")
    on = F.expr("x.doc_id <=> b.doc_id and x.h = b.h")
    kept = named.join(apart.alias("b"), on, "left_anti").select("d")
    repeated = named.join(apart.filter("best").alias("b"), on, "left_semi").dropDuplicates(["doc_id", "h"]).select("d")
    return unpacked(kept.union(repeated), docs.columns)
