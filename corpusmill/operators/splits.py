"""Group splits by stable score, and leakage between splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.ident import unit_score
from corpusmill.functions.text import strip

RATIOS = (0.8, 0.1, 0.1)
NAMES = ("train", "dev", "test")


def split_of(group: Column, seed: int = 42, ratios: Sequence[float] = RATIOS) -> Column:
    score = unit_score(seed, strip(group.cast("string")))
    return F.when(score < ratios[0], NAMES[0]).when(score < ratios[0] + ratios[1], NAMES[1]).otherwise(NAMES[2])


def with_split(df: DataFrame, group: str, seed: int = 42, ratios: Sequence[float] = RATIOS) -> DataFrame:
    return df.withColumn("split", split_of(F.col(group), seed, ratios))


def split_counts(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("records"), F.countDistinct(group).alias("groups"))


def leakage(df: DataFrame, group: str) -> DataFrame:
    """Groups with rows in more than one split."""
    spread = df.groupBy(group).agg(F.countDistinct("split").alias("splits"), F.count("*").alias("records"))
    return spread.filter("splits > 1")
