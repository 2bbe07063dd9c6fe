"""What a fitted tree model learned, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.base import Model
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import new_path


def feature_importances(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    """``(rank, feature, importance)``, most important first, equal ones in input order."""
    values = model.featureImportances.toArray()
    order = sorted(range(len(names)), key=lambda i: (-values[i], i))
    rows = [(rank, names[i], float(values[i])) for rank, i in enumerate(order, 1)]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


def _category_names(indexes: Column, labels: Sequence[str]) -> Column:
    """Category numbers as names; a number without a name stays a number."""
    known = F.array(*[F.lit(v) for v in labels]).cast("array<string>")

    def name(index: Column) -> Column:
        number = index.cast("int")
        return F.coalesce(F.get(known, number), number.cast("string"))

    return F.transform(indexes, name)


def saved_nodes(spark: SparkSession, model: Model) -> DataFrame:
    """The node table that a fitted tree model is saved as."""
    path = new_path(spark, "tree")
    model.save(path)
    return spark.read.parquet(f"{path}/data")


def tree_nodes(
    spark: SparkSession,
    model: Model,
    names: Sequence[str],
    labels: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One row per node of a decision tree or of all trees of a forest.

    Read back from the saved model, so trees of any size stay out of the driver.
    A numeric split sends values up to ``threshold`` left; a categorical one sends
    ``left_categories`` left, given by name for features found in ``labels``.
    A regression tree must be one of a 0/1 label; its nodes are given as those of a classifier.
    """
    nodes = saved_nodes(spark, model)
    if "nodeData" in nodes.columns:
        nodes = nodes.select(F.col("treeID").alias("tree_id"), "nodeData.*")
    else:
        nodes = nodes.withColumn("tree_id", F.lit(0))
    if isinstance(model, DecisionTreeRegressionModel):  # statistics are rows, sum and sum of squares
        rows, ones = F.get("impurityStats", F.lit(0)), F.get("impurityStats", F.lit(1))
        nodes = nodes.withColumns({
            "prediction": (2 * ones > rows).cast("double"),
            "impurity": 2 * F.col("impurity"),
            "gain": 2 * F.col("gain"),
            "impurityStats": F.array(rows - ones, ones),
        })
    split = F.col("split")
    inner = F.col("leftChild") >= 0
    values = split["leftCategoriesOrThreshold"]
    categorical = inner & (split["numCategories"] >= 0)
    feature = F.when(
        inner,
        F.element_at(F.array(*[F.lit(n) for n in names]), split["featureIndex"] + 1),
    )
    by_name = _category_names(values, [])
    for name, found in (labels or {}).items():
        by_name = F.when(feature == name, _category_names(values, found)).otherwise(by_name)
    return nodes.select(
        "tree_id",
        F.col("id").alias("node_id"),
        F.when(inner, F.col("leftChild")).alias("left_child"),
        F.when(inner, F.col("rightChild")).alias("right_child"),
        "prediction",
        "impurity",
        F.when(inner, F.col("gain")).alias("gain"),
        F.aggregate("impurityStats", F.lit(0.0), lambda a, v: a + v).alias("rows"),
        F.col("impurityStats").alias("class_rows"),
        feature.alias("feature"),
        F.when(inner & ~categorical, F.get(values, F.lit(0))).alias("threshold"),
        F.when(categorical, F.array_sort(by_name))
        .otherwise(F.lit(None).cast(T.ArrayType(T.StringType())))
        .alias("left_categories"),
    )
