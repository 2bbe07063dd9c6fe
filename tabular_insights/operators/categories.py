"""Reducing categories to their most frequent values, and numbering them.

Rows are reduced by a join with the dictionary, for any number of values; Spark picks
the kind of join by the size it finds. Literals are there for who asks for them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import shared_folder
from .profile import row_total, value_counts

MAX_LABELS = 10_000  # labels per column that a category model may hold


class TooManyLabels(ValueError):
    """A column has more values than a category model may hold."""


def _text(df: DataFrame, col: str) -> Column:
    is_text = isinstance(df.schema[col].dataType, T.StringType)
    return F.col(col) if is_text else F.col(col).cast("string")


def _counts_per_column(df: DataFrame, cols: Sequence[str], weight: str | None) -> DataFrame:
    """``(column, value, count)`` of several columns from one pass over ``df``."""
    kept = [_text(df, c).alias(c) for c in cols]
    ids = [] if weight is None else [weight]
    long = df.select(*ids, *kept).unpivot(ids, list(cols), "column", "value")
    return long.groupBy("column", "value").agg(row_total(weight).alias("count"))


def _ranked_counts(df: DataFrame, col: str, weight: str | None) -> DataFrame:
    """``(value, count, rank)`` for any number of values, without a single-task sort.

    The sorted counts are checkpointed, which fixes their partitions; a value's rank
    is its place in its partition plus the sizes of the partitions before.
    """
    shared_folder(df.sparkSession)
    counts = value_counts(df.withColumn(col, _text(df, col)), col, weight).checkpoint()
    placed = counts.select(
        "value",
        "count",
        F.spark_partition_id().alias("part"),
        (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1).alias("place"),
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("part")
        .agg(F.count(F.lit(1)).alias("size"))
        .select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    )
    return placed.join(F.broadcast(starts), "part").select(
        "value", "count", (F.col("start") + F.col("place")).alias("rank")
    )


def top_k_values(
    df: DataFrame,
    cols: str | Sequence[str],
    k: int = 32,
    weight: str | None = None,
    spread: bool = False,
) -> DataFrame:
    """``(column, value, count, rank)`` of the ``k`` most frequent values of each column.

    Equal counts rank by value. The columns are counted independently, in one pass, and
    every task passes on at most ``k`` candidates per column to the task that ranks them.
    For a ``k`` too large for one task, ``spread`` sorts each column across the cluster
    instead; it runs a job for each column at once.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    if not spread:
        order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_last("value"))
        counts = _counts_per_column(df, cols, weight)
        return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    tops = [
        _ranked_counts(df, c, weight)
        .filter(F.col("rank") <= k)
        .select(F.lit(c).alias("column"), "value", "count", F.col("rank").cast("int").alias("rank"))
        for c in cols
    ]
    return reduce(DataFrame.unionByName, tops)


def top_k_lists(
    df: DataFrame, cols: Sequence[str], k: int = 32, weight: str | None = None
) -> dict[str, list[str]]:
    """The top values of each column as lists; runs one job, returns ``k`` values per column.

    The lists are on the driver, so ``k`` is what bounds them.
    """
    lists: dict[str, list[str]] = {c: [] for c in cols}
    for row in top_k_values(df, cols, k, weight).orderBy("column", "rank").collect():
        lists[row["column"]].append(row["value"])
    return lists


def in_lists(df: DataFrame, lists: dict[str, list[str]]) -> Column:
    """True where every listed column holds one of its values; null never does."""
    test = F.lit(True)
    for col, values in lists.items():
        test = test & _text(df, col).isin([v for v in values if v is not None])
    return test


def _use_literals(how: str) -> bool:
    if how not in ("literal", "join"):
        raise ValueError("how must be 'literal' or 'join'")
    return how == "literal"


def keep_listed(df: DataFrame, top: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose value is in ``top`` (``column, value``) in every one of ``cols``."""
    for col in cols:
        side = top.filter(F.col("column") == col).select(F.col("value").alias("__top"))
        df = df.join(side, _text(df, col) == F.col("__top"), "left_semi")
    return df


def keep_top_k(
    df: DataFrame,
    cols: Sequence[str],
    k: int = 32,
    weight: str | None = None,
    how: str = "join",
) -> DataFrame:
    """Rows whose value is among the ``k`` most frequent in every one of ``cols``.

    All columns are counted on the unfiltered ``df``. ``join`` is lazy for any ``k``;
    ``literal`` runs one job for all dictionaries at once and leaves a filter that can
    reach the scan.
    """
    if _use_literals(how):
        return df.filter(in_lists(df, top_k_lists(df, cols, k, weight)))
    return keep_listed(df, top_k_values(df, cols, k, weight), cols)


def bucket_other(
    df: DataFrame,
    col: str,
    k: int = 32,
    other: str = "Other",
    weight: str | None = None,
    how: str = "join",
) -> DataFrame:
    """Replace values outside the ``k`` most frequent, and nulls, by ``other``; keeps all rows."""
    value = _text(df, col)
    if _use_literals(how):
        test = in_lists(df, top_k_lists(df, [col], k, weight))
        return df.withColumn(col, F.when(test, value).otherwise(F.lit(other)))
    top = top_k_values(df, col, k, weight).select(F.col("value").alias("__top"))
    joined = df.join(top, value == F.col("__top"), "left")
    return joined.withColumn(col, F.coalesce(F.col("__top"), F.lit(other))).drop("__top")


def category_labels(
    df: DataFrame, cols: Sequence[str], weight: str | None = None, max_labels: int = MAX_LABELS
) -> dict[str, list[str]]:
    """Every value of each column, most frequent first, equal counts by value.

    One pass and one job for all columns. Fails when a column has more than
    ``max_labels`` values, before they come to the driver.
    """
    counts = _counts_per_column(df, cols, weight).filter(F.col("value").isNotNull())
    limit = max_labels * len(cols)
    rows = counts.limit(limit + 1).collect()
    labels = {c: [r for r in rows if r["column"] == c] for c in cols}
    too_many = [c for c, found in labels.items() if len(found) > max_labels]
    if too_many or len(rows) > limit:
        raise TooManyLabels(
            f"more than {max_labels} categories in {too_many or list(cols)}; reduce them with "
            "keep_top_k, or use index_categories(how='join')"
        )
    return {
        c: [r["value"] for r in sorted(found, key=lambda r: (-r["count"], r["value"]))]
        for c, found in labels.items()
    }


def category_indexer(
    df: DataFrame,
    cols: Sequence[str],
    outputs: Sequence[str] | None = None,
    handle_invalid: str = "error",
    weight: str | None = None,
    max_labels: int = MAX_LABELS,
) -> PipelineModel:
    """One fitted category model per column: the most frequent value becomes 0.

    Equal counts number by value. Each stage is a ``StringIndexerModel``.
    """
    labels = category_labels(df, cols, weight, max_labels)
    outputs = outputs or [f"{c}_index" for c in cols]
    return PipelineModel(
        [
            StringIndexerModel.from_labels(labels[c], c, output, handle_invalid)
            for c, output in zip(cols, outputs, strict=True)
        ]
    )


def ranked_labels(df: DataFrame, col: str, weight: str | None = None) -> DataFrame:
    """``(value, index)``: the index a category model would give, for any number of values."""
    ranked = _ranked_counts(df.filter(F.col(col).isNotNull()), col, weight)
    return ranked.select("value", (F.col("rank") - 1).cast("double").alias("index"))


def _index_by_join(df, fit_on, col, output, handle_invalid, weight) -> DataFrame:
    labels = ranked_labels(fit_on, col, weight).select(
        F.col("value").alias("__label"), F.col("index").alias(output)
    )
    count = labels.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    how = "inner" if handle_invalid == "skip" else "left"
    joined = df.join(labels, _text(df, col) == F.col("__label"), how).drop("__label")
    index = F.col(output)
    if handle_invalid == "error":
        missing = F.raise_error(F.lit(f"value of {col} is null or not in the index"))
        index = F.coalesce(index, missing.cast("double"))
    if handle_invalid == "keep":
        index = F.coalesce(index, F.lit(float(count)))
    return joined.withColumn(output, index).withMetadata(
        output, category_mark(output, count + (handle_invalid == "keep"))
    )


def category_mark(name: str, size: int) -> dict:
    """Metadata that tells tree models of a column with ``size`` categories."""
    return {"ml_attr": {"name": name, "type": "nominal", "num_vals": size}}


def index_categories(
    df: DataFrame,
    cols: Sequence[str],
    outputs: Sequence[str] | None = None,
    handle_invalid: str = "error",
    fit_on: DataFrame | None = None,
    weight: str | None = None,
    how: str = "auto",
    max_labels: int = MAX_LABELS,
) -> DataFrame:
    """Add ``<col>_index`` for each column, numbered on ``fit_on`` (default ``df``).

    A null or unknown value is an error, is skipped, or is kept as one more
    category. ``model`` uses category models, whose labels are on the driver; ``join``
    takes columns with any number of values, of which the driver sees the number.
    ``auto`` is ``model`` unless a column has more than ``max_labels`` values. Either way
    the numbers are the same, and the columns are marked as categories of so many values,
    so a tree model treats them alike.
    """
    fit_on = df if fit_on is None else fit_on
    outputs = list(outputs or [f"{c}_index" for c in cols])
    if how not in ("auto", "model", "join"):
        raise ValueError("how must be 'auto', 'model' or 'join'")
    if how != "join":
        try:
            model = category_indexer(fit_on, cols, outputs, handle_invalid, weight, max_labels)
        except TooManyLabels:
            if how == "model":
                raise
        else:
            return model.transform(df)
    for col, output in zip(cols, outputs, strict=True):
        df = _index_by_join(df, fit_on, col, output, handle_invalid, weight)
    return df
