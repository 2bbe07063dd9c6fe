"""Training and scoring with Spark ML classifiers. Every fit takes an explicit seed."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml.base import Model
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame, functions as F

SEED = 37


def _attributes(df: DataFrame, features: str) -> dict:
    return df.schema[features].metadata.get("ml_attr", {})


def largest_category(df: DataFrame, features: str = "features") -> int:
    """Values of the categorical feature that has most of them; 0 without one."""
    found = _attributes(df, features).get("attrs", {}).get("nominal", [])
    return max((a.get("num_vals", len(a.get("vals", []))) for a in found), default=0)


def check_bins(df: DataFrame, max_bins: int, features: str = "features") -> None:
    """Fail before any job when a categorical feature has more values than ``max_bins``."""
    for attr in _attributes(df, features).get("attrs", {}).get("nominal", []):
        size = attr.get("num_vals", len(attr.get("vals", [])))
        if size > max_bins:
            raise ValueError(
                f"feature {attr.get('name')} has {size} categories, more than max_bins={max_bins}"
            )


def fit_tree(
    df: DataFrame,
    max_depth: int = 5,
    min_instances_per_node: int = 1,
    max_bins: int = 32,
    label: str = "label",
    features: str = "features",
    seed: int = SEED,
    weight: str | None = None,
    weight_total: int | None = None,
    merge: bool = True,
    **settings: Any,
) -> DecisionTreeClassificationModel | DecisionTreeRegressionModel:
    """A gini decision tree.

    Spark's classifier merges sibling leaves of equal prediction, so a split that only parts the
    class shares is lost from the nodes and the importances. Without ``merge`` all splits stay: the
    tree is grown on the mean of a 0/1 label, whose variance is half its gini impurity, so the splits are
    the same; :func:`tabular_insights.operators.explain.tree_nodes` gives its nodes as those of a classifier.

    ``settings`` are other parameters of Spark's classifier, such as ``maxMemoryInMB``,
    ``cacheNodeIds`` and ``checkpointInterval`` for deep trees over many rows. With ``weight``, ``df`` is a tally: ``min_instances_per_node`` then counts the
    rows that the tally stands for, by way of the equal minimum weight per node.
    """
    check_bins(df, max_bins, features)
    kind = DecisionTreeClassifier if merge else DecisionTreeRegressor
    tree = kind(
        labelCol=label,
        featuresCol=features,
        maxDepth=max_depth,
        maxBins=max_bins,
        seed=seed,
        **settings,
    )
    if weight is None:
        return tree.setMinInstancesPerNode(min_instances_per_node).fit(df)
    total = weight_total or df.agg(F.sum(weight).alias("n")).first()["n"]
    if 2 * min_instances_per_node > total:  # no node can be divided
        tree.setMaxDepth(0)
    else:  # weights are whole numbers: at least m means more than m - 0.5
        tree.setMinWeightFractionPerNode((min_instances_per_node - 0.5) / total)
    return tree.setWeightCol(weight).fit(df)


def fit_forest(
    df: DataFrame,
    num_trees: int = 20,
    max_depth: int = 5,
    max_bins: int = 32,
    label: str = "label",
    features: str = "features",
    seed: int = SEED,
    bootstrap: bool = True,
    weight: str | None = None,
    **settings: Any,
) -> RandomForestClassificationModel:
    """A random forest; ``settings`` are other parameters of Spark's classifier.

    The bootstrap draws single rows, so a tally with ``weight`` needs ``bootstrap=False``;
    its trees then differ by their random choice of features only.
    """
    check_bins(df, max_bins, features)
    forest = RandomForestClassifier(
        labelCol=label,
        featuresCol=features,
        numTrees=num_trees,
        maxDepth=max_depth,
        maxBins=max_bins,
        seed=seed,
        bootstrap=bootstrap,
        **settings,
    )
    if weight is None:
        return forest.fit(df)
    if bootstrap:
        raise ValueError("a bootstrap over a tally would draw combinations instead of rows")
    return forest.setWeightCol(weight).fit(df)


def fit_mlp(
    df: DataFrame,
    layers: Sequence[int],
    block_size: int = 128,
    max_iter: int = 100,
    label: str = "label",
    features: str = "scaled_features",
    seed: int = 1234,
    num_classes: int = 2,
    **settings: Any,
) -> MultilayerPerceptronClassificationModel:
    """A multilayer perceptron trained by L-BFGS.

    The first layer must have one unit per feature, the last one at least one per
    class; more output units than classes are allowed. ``settings`` are other parameters
    of Spark's classifier, such as ``tol``, ``solver`` and ``initialWeights``.
    """
    width = _attributes(df, features).get("num_attrs")
    if width is not None and layers[0] != width:
        raise ValueError(f"the first layer has {layers[0]} units for {width} features")
    if layers[-1] < num_classes:
        raise ValueError(f"the last layer has {layers[-1]} units for {num_classes} classes")
    return MultilayerPerceptronClassifier(
        labelCol=label,
        featuresCol=features,
        layers=list(layers),
        blockSize=block_size,
        maxIter=max_iter,
        seed=seed,
        **settings,
    ).fit(df)


def score(model: Model, df: DataFrame) -> DataFrame:
    """Add ``rawPrediction``, ``probability`` and ``prediction``."""
    return model.transform(df)
