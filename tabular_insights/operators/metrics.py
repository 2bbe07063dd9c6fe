"""Classification metrics, all from one grouped count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .profile import row_total

METRICS = ("accuracy", "f1", "weighted_precision", "weighted_recall")


def confusion_matrix(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by..., label, prediction, rows)``; a class that is null or not whole is an error."""
    return df.groupBy(
        *by, _class(label).alias("label"), _class(prediction).alias("prediction")
    ).agg(row_total(weight).alias("rows"))


def _class(name: str) -> Column:
    whole = F.col(name).cast("int")
    bad = F.raise_error(F.concat(F.lit(f"{name} is not a class: "), F.coalesce(F.col(name).cast("string"), F.lit("null"))))
    return F.when(whole == F.col(name), whole).otherwise(bad.cast("int"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def metrics_of_matrix(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics from the output of ``confusion_matrix``, one row per ``by`` group.

    Classes weigh by their true rows. A class that is predicted but never true
    weighs nothing; a ratio over no rows is 0.
    """
    rows, zero = F.col("rows"), F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), rows).otherwise(zero)
    as_true = F.struct(
        F.col("label").alias("c"), rows.alias("n"), zero.alias("p"), hit.alias("tp")
    )
    as_predicted = F.struct(
        F.col("prediction").alias("c"), zero.alias("n"), rows.alias("p"), zero.alias("tp")
    )
    per_class = (
        matrix.select(*by, F.inline(F.array(as_true, as_predicted)))
        .groupBy(*by, "c")
        .agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    )
    n, p, tp = F.col("n"), F.col("p"), F.col("tp")
    total = F.sum("n")
    return per_class.groupBy(*by).agg(
        total.alias("rows"),
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(n * _ratio(2 * tp, n + p)) / total).alias("f1"),
        (F.sum(n * _ratio(tp, p)) / total).alias("weighted_precision"),
        (F.sum(n * _ratio(tp, n)) / total).alias("weighted_recall"),
    )


def classification_metrics(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by..., rows, accuracy, f1, weighted_precision, weighted_recall)``."""
    return metrics_of_matrix(confusion_matrix(df, label, prediction, weight, by), by)
