"""Overlap between a corpus and held-out texts: substrings, whole texts and probes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import bound, normalize
from corpusmill.operators.ordering import top_k

#: Characters of a query below which it isn't searched for.
MIN_CHARS = 24


#: Inner words of a query that are looked up together, at most.
WORDS = 3
#: Documents whose n-grams tell which of a query's are rare. They settle what is looked up, not what is found.
SAMPLE = 20_000
#: Rows up to which a side is broadcast, and queries without inner words that are searched for in one pass.
BROADCAST_ROWS, FEW = 200_000, 64


def queries(items: DataFrame, key: str, text: str, least: int = MIN_CHARS) -> DataFrame:
    """(key, query) of normalized texts that are long enough."""
    return items.select(key, normalize(F.col(text)).alias("query")).filter(F.length("query") >= least)


def _grams(words: Column, n: int, distinct: bool = True) -> Column:
    """Hashes of the n-grams of an array of words."""
    each = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.lit(n), F.slice(words, i, n)))
    found = F.when(F.size(words) >= n, F.array_distinct(each) if distinct else each)
    return F.coalesce(found, F.array().cast("array<bigint>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hits(docs: DataFrame, doc: str, text: str, asked: DataFrame, key: str, least: int = MIN_CHARS) -> DataFrame:
    """(doc, key) where a query occurs in a document's normalized text.

    A query's first and last word may be parts of a document's, the words between are whole. Of their n-grams (WORDS
    words, or as many as there are) each query is looked up by the one that is rarest in a sample of the documents.
    Documents give only their ids and the hashes of their n-grams for that; texts are searched where the n-gram is
    there. Queries without inner words are searched for in every text: few of them in one pass, more by the hash of
    their first characters."""
    words = F.split("query", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    sized = asked.withColumn("inner", inner).withColumn("n", F.least(F.size("inner"), F.lit(WORDS)))
    sizes = {r.n: r["count"] for r in sized.groupBy("n").count().collect()}  # at most WORDS + 1 rows
    normal = docs.select(doc, normalize(F.col(text)).alias("body"))
    hashed = bound(F.split("body", " "), lambda w: F.concat(*[_grams(w, n) for n in sorted(sizes) if n], F.array().cast("array<bigint>")))
    found = []
    if any(sizes.get(n) for n in range(1, WORDS + 1)):
        grams = F.coalesce(*[F.when(F.col("n") == n, _grams(F.col("inner"), n)) for n in sorted(sizes) if n])
        keyed = sized.filter("n > 0").select(key, F.explode(grams).alias("gram"))
        named = keyed.select("gram").distinct()
        seen = normal.limit(SAMPLE).select(F.explode(hashed).alias("gram")).join(F.broadcast(named) if sum(sizes.values()) * 100 <= BROADCAST_ROWS else named, "gram").groupBy("gram").count()
        rarest = keyed.join(seen, "gram", "left").groupBy(key).agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "gram")).alias("r"))
        anchors = rarest.select(key, "r.gram")
        pairs = normal.select(doc, F.explode(hashed).alias("gram")).join(_small(anchors, sum(sizes.values())), "gram").select(doc, key)
        texts = normal.join(pairs, doc).join(_small(asked, sum(sizes.values())), key)
        found.append(texts.filter(F.expr("contains(body, query)")).select(doc, key))
    if short := sizes.get(0):
        bare = sized.filter("n = 0").select(key, "query")
        if short <= FEW:
            rows = bare.collect()
            each = F.array_compact(F.array(*[F.when(F.contains("body", F.lit(r.query)), F.lit(r[key])) for r in rows]))
            found.append(normal.select(doc, F.explode(each).alias(key)))
        else:
            starts = F.transform(F.sequence(F.lit(1), F.length("body") - least + 1), lambda i: F.xxhash64(F.substring("body", i, F.lit(least))))
            openings = normal.filter(F.length("body") >= least).select(doc, F.explode(F.array_distinct(starts)).alias("gram"))
            pairs = openings.join(_small(bare.withColumn("gram", F.xxhash64(F.substring("query", 1, least))), short), "gram").select(doc, key)
            found.append(normal.join(pairs, doc).join(_small(bare, short), key).filter(F.expr("contains(body, query)")).select(doc, key))
    return reduce(DataFrame.unionByName, found).distinct() if found else normal.limit(0).select(doc).crossJoin(asked.limit(0).select(key))


def exact_overlap(held_out: DataFrame, train: DataFrame, digest: str = "digest") -> DataFrame:
    """Held-out rows whose normalized text occurs in the training rows."""
    return held_out.join(train.select(digest).distinct(), digest, "left_semi")


def probes(docs: DataFrame, by: list[str], order: str, eligible: Column, k: int = 2) -> DataFrame:
    """The first k eligible rows of each bucket."""
    return top_k(docs.filter(eligible), by, [order], k, "probe")


def forbidden(docs: DataFrame, doc: str, text: str, group: str, asked: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """(doc, reason) of records that may not be trained on: they hold a query, or belong to one of groups (group)."""
    found = hits(docs, doc, text, asked, key).select(doc).distinct().withColumn("reason", F.lit("passage"))
    grouped = docs.select(doc, group).join(groups, group, "left_semi").select(doc).withColumn("reason", F.lit("group"))
    return found.unionByName(grouped).groupBy(doc).agg(F.max("reason").alias("reason"))


def report(docs: DataFrame, doc: str, text: str, asked: DataFrame, key: str, probed: DataFrame) -> DataFrame:
    """One row of a corpus (split, ..): held-out records and those whose text is a training record's, queries found and
    their hits, probes."""
    digests = docs.select("split", F.sha2(normalize(F.col(text)), 256).alias("digest"))
    held = digests.filter("split <> 'train'")
    exact = exact_overlap(held, digests.filter("split = 'train'")).agg(F.count("*").alias("exact"))
    found = hits(docs, doc, text, asked, key).agg(F.countDistinct(key).alias("items"), F.count("*").alias("hits"))
    one = held.agg(F.count("*").alias("held_out")).crossJoin(exact).crossJoin(found)
    return one.crossJoin(probed.agg(F.count("*").alias("probes")))
