"""Operators on ordered rows: ranks, first-wins selection, interleaving and running sums."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive order keys that share one bucket of a running sum.
BUCKET = 4096


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """Rows numbered from 1 within each group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, out: str = "rank") -> DataFrame:
    return ranked(df, by, order, out).filter(F.col(out) <= k)


def first_wins(df: DataFrame, identity: Sequence[Column | str], order: str) -> DataFrame:
    """The first row of each identity. The winner is a minimum, which combines before the shuffle, so that a
    hot identity isn't sorted in one task."""
    rest = [c for c in df.columns if c != order]
    keyed = df.withColumns({f"__k{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(identity)})
    keys = [f"__k{i}" for i in range(len(identity))]
    won = keyed.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__w"))
    return won.select(*[F.col(f"__w.{c}").alias(c) for c in df.columns])


def running(df: DataFrame, by: Sequence[str], buckets: Sequence[Column], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of value within each group, in the order of buckets, then of order.

    Two levels: sums per bucket of a group, a running sum over the buckets (few rows), then a window within
    each bucket. No group is sorted in one task, whatever its share of the rows. Buckets must follow the order
    of the columns in order; null groups count as groups."""
    names = [f"__b{i}" for i in range(len(buckets))]
    keys = [*by, *names]
    bucketed = df.withColumns(dict(zip(names, buckets, strict=True)) | {"__v": value})
    totals = bucketed.groupBy(*keys).agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy(*by).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__s"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = bucketed.withColumn("__o", F.coalesce(F.sum("__v").over(within), F.lit(0)))
    same = reduce(lambda x, y: x & y, [own[k].eqNullSafe(F.col(f"__s_{k}")) for k in keys])
    return own.join(starts, same).select(*[own[c] for c in df.columns if c != out], (F.col("__s") + F.col("__o")).alias(out))


def hash_bucket(key: str) -> Column:
    """The first 16 bits of a digest in hex: its order is the digest's."""
    return F.substring(key, 1, 4)


def interleaved(df: DataFrame, component: str, order: Sequence[str], out: str = "turn") -> DataFrame:
    """Round robin over components: out is the row's place in its component; sort by (out, component).
    order: columns, the first of them of integers."""
    return placed(df, [component], [F.floor(F.col(order[0]) / BUCKET)], order, out)


def placed(df: DataFrame, by: Sequence[str], buckets: Sequence[Column], order: Sequence[str], out: str) -> DataFrame:
    """ranked() for groups of any size; see running() for buckets."""
    counted = running(df, by, buckets, order, F.lit(1), out)
    return counted.withColumn(out, (F.col(out) + 1).cast("int"))


def offsets(df: DataFrame, order: str, value: str, out: str = "offset") -> DataFrame:
    """Exclusive running sum of value by the integer column order, over all rows."""
    return running(df, [], [F.floor(F.col(order) / BUCKET)], [order], F.col(value), out).withColumn(out, F.col(out).cast("long"))


def first_n(df: DataFrame, order: str, eligible: Column, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n eligible rows, and one row (accepted, skipped) of counts up to the last of them."""
    kept = df.filter(eligible).orderBy(order).limit(n)
    last = kept.agg(F.max(order).alias("last"), F.count("*").alias("accepted"))
    seen = df.join(F.broadcast(last), F.col(order) <= F.col("last")).groupBy("accepted").agg(F.count("*").alias("seen"))
    return kept, seen.select("accepted", (F.col("seen") - F.col("accepted")).alias("skipped"))
