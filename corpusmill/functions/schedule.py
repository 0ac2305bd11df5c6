"""Scalar parts of a training run: learning-rate schedule, budget, quotients and closeness of numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def lr_factor(step: Column, warmup: int, steps: int, floor: float) -> Column:
    """Linear warm-up, then a cosine down to the floor."""
    progress = F.least(F.greatest((step - warmup) / F.lit(max(steps - warmup, 1)), F.lit(0.0)), F.lit(1.0))
    decayed = F.lit(floor) + F.lit(1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress))
    return F.when(step < warmup, (step + 1) / F.lit(max(warmup, 1))).otherwise(decayed)


@dataclass(frozen=True)
class Budget:
    steps: int
    target_tokens: int
    estimated_tokens: int


def budget(examples: int, tokens: int, micro: int, accumulate: int, *, steps: int | None = None, train_tokens: int | None = None, epochs: float | None = None) -> Budget:
    """The two of steps, tokens and epochs that aren't given, from the one that is (steps first)."""
    if min(examples, tokens) <= 0:
        raise ValueError("a budget needs examples and tokens")
    per_step = tokens / math.ceil(examples / micro) * accumulate
    if steps is not None:
        target = math.ceil(steps * per_step)
    elif train_tokens is not None:
        target = train_tokens
    elif epochs is not None:
        target = math.ceil(epochs * tokens)
    else:
        raise ValueError("give steps, train_tokens or epochs")
    n = steps if steps is not None else math.ceil(target / per_step)
    return Budget(n, target, math.ceil(n * per_step))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def close(a: Column, b: Column, relative: float, absolute: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def quotient(a: Column, b: Column) -> Column:
    """a / b as IEEE 754 has it: infinite or NaN where b is zero, no error and no null."""
    return F.when(b == 0, a * F.pow(b.cast("double"), F.lit(-1.0))).otherwise(F.try_divide(a, b))


def rounded(x: Column, digits: int) -> Column:
    """x rounded as SQL's engines round doubles: scaled in binary, halves away from zero, its sign kept. F.round goes
    by the decimal form, which differs where scaling meets a half or misses it."""
    scaled = x * float(10**digits)
    return F.when(finite(scaled), F.signum(x) * F.round(F.abs(scaled)) / float(10**digits)).otherwise(x)
