"""Deterministic sampling orders: epoch shuffles, token quotas and stratified subsets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.ident import keyed_digest
from corpusmill.operators.ordering import hash_bucket, placed, running, top_k


def epoch_batches(df: DataFrame, identity: str, seed: int, epochs: int, size: int) -> DataFrame:
    """(epoch, place, batch, identity): each epoch a permutation by hash; the last batch may be short."""
    each = df.select(identity).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    key = keyed_digest(str(seed), F.col("epoch"), F.col(identity))
    found = placed(each.withColumn("__k", key), ["epoch"], [hash_bucket("__k")], ["__k", identity], "place").drop("__k")
    return found.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long"))


def quota_order(df: DataFrame, stratum: str, tokens: str, identity: str, weights: dict[str, float], seed: int, epochs: int = 1) -> DataFrame:
    """df with quota, stratum_index and epoch; sorted by (quota, stratum_index) it is the order in which a
    greedy sampler takes rows, always from the stratum furthest below its weight: the sum of the tokens
    taken from a stratum before, over its weight, is when its turn comes. A row of a stratum without a weight
    is an error, as in a stream: the caller says which strata to leave out."""
    names = sorted(weights)
    weight, index = F.lit(None).cast("double"), F.lit(None).cast("int")
    for i, name in enumerate(names):
        weight = F.when(F.col(stratum) == name, weights[name]).otherwise(weight)
        index = F.when(F.col(stratum) == name, i).otherwise(index)
    unknown = F.raise_error(F.concat(F.lit("no weight for stratum "), F.coalesce(F.col(stratum).cast("string"), F.lit("null"))))
    own = df.filter(F.when(F.col(stratum).isin(names), True).otherwise(unknown.cast("boolean"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    own = own.withColumn("stratum_index", index).withColumn("__k", keyed_digest(str(seed), F.col("epoch"), F.col(identity)))
    order = ["epoch", "__k", identity]
    taken = running(own, [stratum], [F.col("epoch"), hash_bucket("__k")], order, F.col(tokens), "quota")
    return taken.withColumn("quota", F.col("quota") / weight).drop("__k")


def stratified(df: DataFrame, stratum: str, identity: Column, limit: int) -> DataFrame:
    """Rows in turn from the strata, each in the order of its identities' hashes, up to limit. No stratum can
    give more than limit rows, so the others go before the shuffle."""
    hashed = df.withColumn("__k", F.sha2(identity, 256))
    return top_k(hashed, [stratum], ["__k"], limit, "turn").orderBy("turn", stratum).limit(limit).drop("__k")


def balanced_weights(counts: DataFrame, group: str) -> DataFrame:
    """Equal weight for each value of group, shared equally by its strata."""
    groups = counts.select(group).distinct().count()
    return counts.withColumn("weight", F.lit(1.0 / max(groups, 1)) / F.count("*").over(Window.partitionBy(group)))


def resumed(batches: DataFrame, epoch: int, batch: int) -> DataFrame:
    """The rows of epoch_batches() from a position on: what a stopped run would have taken next."""
    return batches.filter((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col("batch") >= batch)))


def recycled(df: DataFrame, stratum: str, tokens: str, identity: str, weights: dict[str, float], seed: int, need: int) -> DataFrame:
    """The first rows of quota_order() until need tokens are taken, strata that run out starting anew with another
    permutation: a row of seen, the tokens before it in the whole order."""
    sizes = df.groupBy(stratum).agg(F.sum(tokens).alias("n")).collect()  # a row a stratum
    total = sum(weights.values())
    epochs = max([math.ceil(need * weights[r[stratum]] / total / r.n) + 1 for r in sizes if r.n and r[stratum] in weights], default=1)
    ordered = quota_order(df, stratum, tokens, identity, weights, seed, epochs)
    ordered = ordered.withColumn("__q", F.format_string("%020.6f", "quota"))
    seen = running(ordered, [], [F.floor(F.col("quota") / max(need / 256, 1))], ["__q", "stratum_index", "epoch", identity], F.col(tokens), "seen")
    return seen.filter(F.col("seen") < need).drop("__q")


def resolved(weights: dict[str, float] | None, families: dict[str, tuple[int, int]], strata: dict[str, tuple[int, int]]) -> dict:
    """How to sample: plain order without weights; else by family or by stratum, whichever the weights cover exactly,
    with weights that sum to 1 and the tokens that an example has on average (harmonic, as quotas are of tokens) and
    an epoch's examples have. families, strata: name to (examples, supervised tokens)."""
    examples, tokens = (sum(v[i] for v in families.values()) for i in (0, 1))
    if weights is None:
        return {"strategy": "shuffle", "epoch_tokens": tokens}
    for name, own in (("task_family", families), ("stratum", strata)):
        if set(weights) == set(own):
            break
    else:
        own = min(families, strata, key=len)
        raise ValueError(f"weights have to cover families or strata: missing {sorted(set(own) - set(weights))}, unknown {sorted(set(weights) - set(own))}")
    if any(isinstance(w, bool) or not isinstance(w, (int, float)) or not math.isfinite(w) or w <= 0 for w in weights.values()):
        raise ValueError("weights are positive and finite")
    total = sum(weights.values())
    share = {k: w / total for k, w in sorted(weights.items())}
    mean = 1 / sum(w / (own[k][1] / own[k][0]) for k, w in share.items())
    return {"strategy": "quota", "by": name, "weights": share, "mean_tokens": mean, "epoch_tokens": max(1, round(examples * mean))}


def predicted_tokens(df: DataFrame, stratum: str, tokens: str, identity: str, weights: dict[str, float], seed: int, samples: int) -> DataFrame:
    """One row (samples, tokens): what the first samples rows of the quota order have, strata not recycled."""
    first = quota_order(df, stratum, tokens, identity, weights, seed).orderBy("quota", "stratum_index").limit(samples)
    return first.agg(F.count("*").alias("samples"), F.sum(tokens).alias("tokens"))
