"""What the operators share: input, word classes, samples and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import ship
from corpusmill.sources.scratch import materialize

#: A word, as the contracts of these operators define it.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of one Arrow batch handed to Python, so that long texts stay within a worker's memory.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers(spark: SparkSession) -> None:
    """Make ready for Python workers: they get this package, and Arrow batches stay small, as a batch of whole
    texts has to fit a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def give_back() -> None:
    """Return memory that this process has freed to the system: the allocators keep it otherwise, and as workers stay
    for later stages, each would go on holding what its largest batch took, beside the executor's heap."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _trim()(0)


def released(batches: Iterator) -> Iterator:
    """batches; what one has left free is given back before the next, and after the last."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable, which the optimizer can't copy into
    the places that use it."""
    return F.transform(F.array(value), body)[0]


def connected_components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, component) for every node of edges (src, dst): component is the smallest node reachable.

    Alternates large-star and small-star rewrites until the edge set is stable, each round written to
    the shared folder. Every step is a minimum per node with map-side combining and an equi-join, so a
    hub is pre-aggregated and its join partition can be split."""

    def stamp(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()

    e = materialize(
        edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), tag
    )
    seen = stamp(e)
    while seen[0]:
        both = e.union(e.select("dst", "src"))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = (
            large.join(least, "src")
            .filter("dst <> m")
            .select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .union(least)
            .distinct()
        )
        e = materialize(small, tag)
        now = stamp(e)
        if tuple(now) == tuple(seen):
            break
        seen = now
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(e.select("dst", "dst").distinct())


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """docs as a struct d of all its columns beside copies of the named ones, so that columns that an
    operator adds can't clash with its input's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), *[F.col(f"`{n}`") for n in names])


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of a packed frame again, some replaced."""
    return df.select(*[(new[c] if c in new else F.col(f"d.`{c}`")).alias(c) for c in columns])


def bounded_sample(rows: DataFrame, n: int) -> DataFrame:
    """The n rows (doc_id, text, ..) first by a hash of doc_id and text, so that one repeated id is no tie. Only
    hashes are ranked; of rows that share the last one, as repeated rows do, no more than n are taken."""
    hashed = rows.withColumn("__h", F.xxhash64("doc_id", "text"))
    first = [r[0] for r in hashed.select("__h").orderBy("__h").limit(n).collect()]
    return hashed.filter(F.col("__h") <= (first[-1] if first else 0)).drop("__h").limit(n)
