"""Scores, metric rollups and comparisons of reports."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.schedule import close, finite
from corpusmill.functions.text import strip

LN2 = math.log(2.0)


def exact_score(response: Column, answer: Column) -> Column:
    return F.coalesce((strip(response) == answer).cast("double"), F.lit(0.0))


def _strict(text: str):
    def unique(pairs):
        keys = [k for k, _ in pairs]
        if len(set(keys)) < len(keys):
            raise ValueError("a key twice")
        return dict(pairs)

    def constant(name):
        raise ValueError(name)

    def number(text):
        value = float(text)
        if not math.isfinite(value):
            raise ValueError(text)
        return value

    return json.loads(text, object_pairs_hook=unique, parse_constant=constant, parse_float=number)


def same_json(a: str | None, b: str | None) -> bool:
    """Whether two strict JSON texts have the same value and types; true isn't 1 and 1.0 isn't 1."""
    try:
        x, y = (json.dumps(_strict(t), sort_keys=True, ensure_ascii=False) for t in (a, b))
    except (ValueError, TypeError, RecursionError):
        return False
    return x == y


@F.pandas_udf(T.DoubleType())
def json_score(response: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([float(same_json(a, b)) for a, b in zip(response, answer)], dtype=float)


def preference_score(chosen: Column, rejected: Column, tie: float = 1e-8) -> Column:
    margin = chosen - rejected
    return F.when(F.abs(margin) <= tie, 0.5).otherwise((margin > 0).cast("double"))


def rule_baseline(choices: Column) -> Column:
    """The score of guessing among choices; without any the always-empty answer's."""
    return F.coalesce(F.try_divide(F.lit(1.0), F.size(choices)), F.lit(0.0))


def loss_rollup(rows: DataFrame, by: str, digits: int = 6) -> DataFrame:
    """(by, tokens, loss, perplexity, bits_per_byte) of rows (by, loss, tokens, bytes): per value of by, and
    for all rows under null."""
    sums = rows.rollup(by).agg(
        F.sum("tokens").alias("tokens"), F.sum(F.col("loss") * F.col("tokens")).alias("nll"), F.sum("bytes").alias("bytes"), F.grouping(by).alias("all")
    )
    loss = F.col("nll") / F.col("tokens")
    return sums.select(
        F.when(F.col("all") == 1, "all").otherwise(F.col(by)).alias(by),
        "tokens",
        F.round(loss, digits).alias("loss"),
        F.round(F.exp(F.least(loss, F.lit(20.0))), digits).alias("perplexity"),
        F.round(F.when(F.col("bytes") > 0, F.col("nll") / LN2 / F.col("bytes")), digits).alias("bits_per_byte"),
    )


def consistent(total: Column, parts: Column, relative: float = 1e-6, absolute: float = 1e-6) -> Column:
    return finite(total) & finite(parts) & close(total, parts, relative, absolute)


def metric_rollup(values: DataFrame, expected: DataFrame, digits: int = 6) -> DataFrame:
    """(name, value, count, baseline, status) for every expected name; one without values is not-checked.
    values: (name, value, baseline)."""
    per = values.groupBy("name").agg(F.avg("value").alias("value"), F.count("value").alias("count"), F.avg("baseline").alias("baseline"))
    full = expected.join(per, "name", "left")
    status = F.when(F.coalesce("count", F.lit(0)) > 0, "ok").otherwise("not-checked")
    return full.select("name", F.round("value", digits).alias("value"), F.coalesce("count", F.lit(0)).alias("count"), F.round("baseline", digits).alias("baseline"), status.alias("status"))


def report_deltas(reports: DataFrame, stage: str, digits: int = 6) -> DataFrame:
    """(stage, name, value, delta) against each name's first stage; null unless all its values are there."""
    per = reports.groupBy("name").agg(F.min_by("value", stage).alias("first"), F.count_if(F.col("value").isNull()).alias("missing"))
    delta = F.when(F.col("missing") == 0, F.round(F.col("value") - F.col("first"), digits))
    return reports.join(per, "name").select(stage, "name", F.round("value", digits).alias("value"), delta.alias("delta"))


def best_step(log: DataFrame, step: str, loss: str, by: Sequence[str] = ()) -> DataFrame:
    """The least loss and its first step, the first and the last loss, per run."""
    return log.groupBy(*by).agg(
        F.min(loss).alias("best_loss"),
        F.min(F.struct(loss, step))[step].alias("best_step"),
        F.min_by(loss, step).alias("baseline_loss"),
        F.max_by(loss, step).alias("final_loss"),
    )
