"""Dividing rows into named splits and folds."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import ceil

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import BUCKETS, key_bucket

# The three parts of a hold-out run.
HOLD_OUT = {"train": 0.6, "validation": 0.2, "test": 0.2}


def hash_split(
    df: DataFrame,
    keys: Sequence[str],
    weights: dict[str, float] | None = None,
    seed: int = 17,
    out: str = "split",
) -> DataFrame:
    """Add the name of each row's split, chosen by its key values and the seed.

    No shuffle and no state: a row keeps its split under any partitioning, order
    or re-run. Rows with equal keys share a split.
    """
    weights = weights or HOLD_OUT
    total = sum(weights.values())
    bucket = key_bucket(keys, seed)
    names = list(weights)
    ends = [ceil(round(w / total * BUCKETS, 3)) for w in accumulate(weights.values())]
    choice = F.lit(names[-1])
    for name, end in reversed(list(zip(names[:-1], ends[:-1], strict=True))):
        choice = F.when(bucket < end, name).otherwise(choice)
    return df.withColumn(out, choice)


def random_split(
    df: DataFrame, weights: dict[str, float] | None = None, seed: int = 17
) -> dict[str, DataFrame]:
    """Named frames from Spark's own random split.

    Membership depends on partitioning and row order; prefer ``hash_split``.
    """
    weights = weights or HOLD_OUT
    parts = df.randomSplit(list(weights.values()), seed=seed)
    return dict(zip(weights, parts, strict=True))


def add_folds(
    df: DataFrame, keys: Sequence[str], k: int = 3, seed: int = 17, out: str = "fold"
) -> DataFrame:
    """Add a fold number 0..k-1 chosen by the key values and the seed."""
    return df.withColumn(out, F.pmod(key_bucket(keys, seed), F.lit(k)).cast("int"))
