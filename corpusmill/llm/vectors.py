"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors of cosine c are sqrt(2 - 2c) = eps apart. The vectors are rotated onto the leading principal
directions (a rotation keeps distances, so the bounded sample behind it affects speed alone), sorted by
their cells of side eps in those dimensions, and cut into intervals of the sequence: of equal numbers of
vectors, so that a dense cell is several, and of bounded bytes. The join is recursive: nodes of FAN
intervals, of FAN such nodes, and so on have bounding boxes, and from the root down only pairs of nodes go
on whose boxes are at most eps apart. Each level is a table of pairs, joined by Spark; none reaches the
driver. Inside a pair of intervals a task divides on in the same way, and compares what remains in double
precision.

Equal vectors are one class from the start. A task returns, per class, its number of links and a root it
is connected to, so groups of near copies are never written out as pairs.

Vectors of different lengths never link: each length has its own rotation and its own intervals.

Defined cases: null, empty, zero and non-finite vectors link with nothing and are their own component; a
null vec_id takes part in links but names no component unless there is no other; vectors are scaled by
their largest component first, so tiny and huge ones link like others; ties and repeated rows count as
further vectors; vectors of any length fit, a single interval holding LEAST of them at least; an empty
table gives an empty result; further columns are ignored."""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import connected_components, materialize, workers

COSINE = 0.95
#: Principal dimensions of the boxes, and those whose cells order the sequence.
DIMENSIONS, ORDERED = 8, 4
#: Vectors that the rotation is fitted on.
SAMPLE = 5000
#: Vectors of an interval at most, its bytes as doubles at most, and vectors at least; within these bounds a length
#: is cut into SPLITS intervals, so that small tables are many tasks too.
INTERVAL, INTERVAL_BYTES, LEAST, SPLITS = 8192, 1 << 25, 64, 12
#: Nodes that make up one of the next level.
FAN = 8
#: Vectors of a block that is compared without further division.
LEAF = 512


def unit_rows(vectors: list) -> np.ndarray:
    """Unit vectors of finite non-zero ones of one length; scaled first, so that no square is lost or overflows."""
    v = np.array(vectors, float)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1))[:, None]


def rotation(sample: np.ndarray, k: int) -> np.ndarray:
    """The leading k principal directions of unit vectors, as columns."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])[:, :k]
    return np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1))[1][:, ::-1][:, :k]


def axes_of(fitted: dict[int, np.ndarray], width: int) -> np.ndarray:
    """The rotation of vectors of a length; the first directions as they are where the sample had none."""
    return fitted[width] if width in fitted else np.eye(width)[:, :DIMENSIONS]


def apart(lo1, hi1, lo2, hi2, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
    return float((gap * gap).sum()) > eps * eps * (1 + 1e-9)


class Links:
    """Links among the vectors of one interval, or between those of two."""

    def __init__(self, unit: np.ndarray, coords: np.ndarray, copies: np.ndarray, eps: float, cosine: float):
        self.unit, self.coords, self.copies, self.eps, self.cosine = unit, coords, copies, eps, cosine
        self.links = np.zeros(len(unit), np.int64)
        self.root = np.arange(len(unit))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def join(self, a: int, b: int, c: int, d: int) -> None:
        x, y = self.coords[a:b], self.coords[c:d]
        if a == b or c == d or apart(x.min(0), x.max(0), y.min(0), y.max(0), self.eps):
            return
        if b - a <= LEAF and d - c <= LEAF:
            self.compare(a, b, c, d)
        elif (a, b) == (c, d):
            m = (a + b) // 2
            self.join(a, m, a, m), self.join(a, m, m, b), self.join(m, b, m, b)
        elif b - a >= d - c:
            m = (a + b) // 2
            self.join(a, m, c, d), self.join(m, b, c, d)
        else:
            m = (c + d) // 2
            self.join(a, b, c, m), self.join(a, b, m, d)

    def compare(self, a: int, b: int, c: int, d: int) -> None:
        near = self.unit[a:b] @ self.unit[c:d].T >= self.cosine
        same = a == c
        if same:
            np.fill_diagonal(near, False)
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(rows):
            return
        self.links[a:b] += near @ self.copies[c:d]
        if not same:
            self.links[c:d] += self.copies[a:b] @ near
        small = near[np.ix_(rows, cols)]
        left, right = rows.astype(np.int64) + a, cols.astype(np.int64) + c
        rl, cl = left.copy(), np.full(len(right), np.iinfo(np.int64).max)
        while True:  # least row reachable within the block
            was = rl.copy()
            cl = np.minimum(cl, np.where(small, rl[:, None], np.iinfo(np.int64).max).min(0))
            rl = np.minimum(rl, np.where(small, cl[None, :], np.iinfo(np.int64).max).min(1))
            if (rl == was).all():
                break
        for i, j in zip(np.concatenate([left, right]).tolist(), np.concatenate([rl, cl]).tolist()):
            self.union(i, j)


def _task(fitted: dict[int, np.ndarray], eps: float, cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "key", "cid"])
        unit = unit_rows(pdf.embedding.tolist())
        found = Links(unit, unit @ axes_of(fitted, unit.shape[1]), pdf.copies.to_numpy(np.int64), eps, cosine)
        n = int((pdf.side == 0).sum())
        if n == len(pdf):
            found.join(0, n, 0, n)
        else:
            found.join(0, n, n, len(pdf))
        cid = pdf.cid.to_numpy()
        own = np.flatnonzero(found.links > 0)
        return pd.DataFrame({"cid": cid[own], "links": found.links[own], "root": cid[[found.find(int(i)) for i in own]] if len(own) else cid[:0]})

    return run


def _ranked(placed: DataFrame) -> DataFrame:
    """placed in the order of (width, key, cid), with place: the row's number among those of its width. Ranges of the
    order are written as they are dealt; the sums of the rows before each range are few."""
    dealt = placed.repartitionByRange("width", "key", "cid").sortWithinPartitions("width", "key", "cid")
    dealt = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "vectors-order")
    part = F.shiftright("at", 33)
    ranges = dealt.groupBy(part.alias("part"), "width").agg(F.min("at").alias("least"), F.count("*").alias("n")).orderBy("width", "part").collect()
    starts, before = [], {}
    for r in ranges:
        starts.append((r.part, r.width, before.get(r.width, 0) - r.least))
        before[r.width] = before.get(r.width, 0) + r.n
    starts = F.broadcast(dealt.sparkSession.createDataFrame(starts, "part long, width int, shift long"))  # a row a task and width
    return dealt.withColumn("part", part).join(starts, ["part", "width"]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _boxes(nodes: DataFrame) -> DataFrame:
    edges = [f(F.col(n)[i]).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(DIMENSIONS)]
    boxes = nodes.groupBy("node").agg(*edges)
    return boxes.select("node", *[F.array(*[f"{n}{i}" for i in range(DIMENSIONS)]).alias(n) for n in ("lo", "hi")])


def interval_pairs(intervals: DataFrame, n: int, eps: float) -> DataFrame:
    """Pairs (a <= b) of the n intervals (node, lo, hi) that may hold vectors within eps, by recursion from the root."""
    levels = [intervals]
    while n > 1:
        n = -(-n // FAN)
        levels.append(materialize(_boxes(levels[-1].withColumn("node", F.floor(F.col("node") / FAN).cast("long"))), "vectors-boxes"))
    pairs = intervals.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    for nodes in levels[-2::-1] if len(levels) > 1 else ():
        below = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1)).alias(c)
        pairs = pairs.select(below("a"), "b").select("a", below("b")).filter("a <= b")
        x, y = (nodes.select(F.col("node").alias(s), F.col("lo").alias(f"{s}lo"), F.col("hi").alias(f"{s}hi")) for s in "ab")
        gap = F.zip_with(F.zip_with("alo", "bhi", lambda p, q: p - q), F.zip_with("blo", "ahi", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
        apart2 = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
        pairs = materialize(pairs.join(x, "a").join(y, "b").filter(apart2 <= eps * eps * (1 + 1e-9)).select("a", "b"), "vectors-pairs")
    return pairs


def near_vectors(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of table (vec_id, embedding)."""
    spark = table.sparkSession
    workers(spark)
    eps = math.sqrt(2 - 2 * cosine)
    e = F.col("embedding")
    finite = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce((F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = table.select("vec_id", e.alias("embedding"))
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = rows.filter(usable).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors-classes")
    sizes = {r.width: r["count"] for r in classes.groupBy(F.size("embedding").alias("width")).count().orderBy("width").collect()}
    if not sizes:
        return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

    sample = classes.orderBy(F.xxhash64("embedding"), "cid").limit(SAMPLE).select("embedding").toPandas().embedding
    fitted = {width: rotation(unit_rows(own.tolist()), min(DIMENSIONS, width)) for width, own in sample.groupby(sample.str.len())}

    @F.pandas_udf("struct<key:double,lo:array<double>>")
    def ordered(vectors: pd.Series) -> pd.DataFrame:
        keys, at = np.zeros(len(vectors)), np.zeros((len(vectors), DIMENSIONS))
        widths = vectors.str.len().to_numpy()
        side = int(2 / eps) + 3
        for width in np.unique(widths):
            own = np.flatnonzero(widths == width)
            x = unit_rows(vectors.iloc[own].tolist()) @ axes_of(fitted, int(width))
            key = np.zeros(len(x))
            for i in range(min(ORDERED, x.shape[1])):
                key = key * side + np.floor((x[:, i] + 1) / eps)
            tie = x[:, min(ORDERED, x.shape[1] - 1)]
            keys[own] = key + (tie + 1.001) / 2.002
            at[own, : x.shape[1]] = x
        return pd.DataFrame({"key": keys, "lo": list(at)})

    placed = classes.withColumn("o", ordered("embedding")).select("cid", "copies", "embedding", F.size("embedding").alias("width"), "o.key", "o.lo")
    per, first, n = {}, {}, 0  # of each length: vectors of an interval, and the number of its first
    for width, count in sizes.items():
        most = max(LEAST, min(INTERVAL, INTERVAL_BYTES // (8 * width)))
        per[width] = min(most, max(LEAST, -(-count // SPLITS)))
        first[width], n = n, n + -(-count // per[width])
    cuts = F.broadcast(spark.createDataFrame([(w, per[w], first[w]) for w in sizes], "width int, per long, first long"))  # a row a length
    interval = (F.col("first") + F.floor(F.col("place") / F.col("per"))).cast("long")
    placed = _ranked(placed).join(cuts, "width").withColumn("interval", interval).drop("per", "first", "place")
    widths = placed.groupBy("interval").agg(F.first("width").alias("width"))
    boxes = materialize(_boxes(placed.select(F.col("interval").alias("node"), "lo", F.col("lo").alias("hi"))), "vectors-boxes")
    pairs = interval_pairs(boxes, n, eps)
    if len(sizes) > 1:  # intervals of different lengths have nothing to do with one another
        of = lambda c: widths.select(F.col("interval").alias(c), F.col("width").alias(f"{c}_width"))
        pairs = pairs.join(of("a"), "a").join(of("b"), "b").filter("a_width = b_width").select("a", "b")
    sides = F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("interval"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("a").alias("interval"), F.lit(0).alias("side")), F.struct(F.col("b").alias("interval"), F.lit(1).alias("side")))
    ))
    parts = pairs.select("a", "b", sides.alias("s")).select("a", "b", "s.interval", "s.side")
    tasks = placed.select("cid", "copies", "embedding", "key", "interval").join(parts, "interval")
    found = tasks.groupBy("a", "b").applyInPandas(_task(fitted, eps, cosine), "cid long, links long, root long")
    found = materialize(found, "vectors-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("cid").alias("src"), F.col("root").alias("dst")), "vectors-components")
    named = classes.join(parts, classes.cid == parts.node, "left").select("cid", "least", "copies", "embedding", F.coalesce("component", "cid").alias("c"))
    first = named.groupBy("c").agg(F.min("least").alias("component_id"))
    full = named.join(first, "c").join(links, "cid", "left")
    full = full.select("embedding", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = rows.filter(usable).join(full, "embedding").select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
