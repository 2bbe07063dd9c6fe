"""Counting: rows, values, distinct values, and whole combinations of values.

Every count is a partial aggregate before its shuffle, so a value that holds a
third of all rows reaches the shuffle as one small row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def row_total(weight: str | None = None) -> Column:
    """Number of rows a group stands for: plain rows, or the sum of ``weight``."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight).cast("bigint")


def row_counts(df: DataFrame, stages: dict[str, Column | None]) -> DataFrame:
    """``(stage, rows)``: how many rows satisfy each condition, in one pass.

    ``None`` stands for every row.
    """
    totals = df.agg(
        *[
            (F.count(F.lit(1)) if test is None else F.count_if(test)).alias(stage)
            for stage, test in stages.items()
        ]
    )
    return totals.unpivot([], list(stages), "stage", "rows")


def preview(df: DataFrame, n: int, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in ascending order, nulls last.

    Each task keeps its own ``n`` rows only. The result is the same on every run
    if ``order_by`` leaves no ties between different rows. Without ``order_by``
    it is any ``n`` rows, from as few partitions as it takes.
    """
    if not order_by:
        return df.limit(n)
    return df.orderBy(*[F.asc_nulls_last(c) for c in order_by]).limit(n)


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """``(column, distinct_count)`` of several columns in one pass, nulls not counted.

    ``approx`` uses one small sketch per column and task instead of shuffling the
    distinct values; meant for wide tables with very many values.
    """
    count = F.approx_count_distinct if approx else F.count_distinct
    totals = df.agg(*[count(F.col(c)).alias(c) for c in cols])
    return totals.unpivot([], list(cols), "column", "distinct_count")


def value_counts(df: DataFrame, col: str, weight: str | None = None) -> DataFrame:
    """``(value, count)``, most frequent first, equal counts by value."""
    counts = df.groupBy(F.col(col).alias("value")).agg(row_total(weight).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc_nulls_last("value"))


def tally(df: DataFrame, cols: Sequence[str], weight: str = "rows") -> DataFrame:
    """One row per combination of ``cols`` and the number of rows that carry it.

    A table of categories, flags and small numbers shrinks from its rows to its
    combinations. Counts, dictionaries, tree training and model scoring over the
    tally, weighted by ``weight``, give what they give over the rows.
    """
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(weight))


def spread_tally(df: DataFrame, weight: str = "rows", parts: int = 100_000) -> DataFrame:
    """Cut heavy tally rows into several lighter ones with the same total weight.

    No row keeps more than about 1/``parts`` of all weight, at the price of at most
    ``parts`` more rows. Tree training samples rows to place its thresholds; one
    combination with a third of the weight would distort such a sample.
    """
    total = df.agg(F.sum(weight).alias("n")).first()["n"] or 0
    cap = max(1, -(-total // parts))
    pieces = F.ceil(F.col(weight) / F.lit(cap))
    share = F.floor(F.col(weight) / F.col("__pieces"))
    left_over = F.col(weight) % F.col("__pieces")
    return (
        df.withColumn("__pieces", pieces)
        .withColumn("__piece", F.explode(F.sequence(F.lit(1).cast("bigint"), "__pieces")))
        .withColumn(weight, share + (F.col("__piece") <= left_over).cast("bigint"))
        .drop("__pieces", "__piece")
    )
