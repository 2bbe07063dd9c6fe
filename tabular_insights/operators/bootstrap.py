"""Forests whose bootstrap is drawn from a tally instead of from single rows.

Drawing each of ``n`` equal rows a Poisson number of times, one on average, draws their
combination a Poisson number of times with mean ``n``. The draw of a combination and a tree is
a function of the combination's values, the tree and the seed, so a forest is the same under
any partitioning, and after any lost task; every tree is then a weighted tree over the tally.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from math import exp, lgamma, log, pi

from pyspark import SparkContext, inheritable_thread_target, keyword_only
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import Column, DataFrame, functions as F

from .categories import category_mark
from .models import SEED, check_bins

#: Means up to this one are drawn from the exact distribution, larger ones by its normal expansion.
EXACT_MEAN = 32
_UNIT = float(1 << 52)


def _cumulative(mean: int) -> list[float]:
    """``P(Poisson(mean) <= k)`` for each ``k`` until the rest is below what a draw can tell."""
    sums, total, k = [], 0.0, 0
    while k <= mean or 1 - total > 1 / _UNIT:
        total += exp(k * log(mean) - mean - lgamma(k + 1))
        sums.append(total)
        k += 1
        if len(sums) > 4 * mean + 40:  # rounding keeps the sum from reaching 1
            break
    return sums


_TABLES = "array({})".format(
    ", ".join("array({})".format(", ".join(f"{c!r}D" for c in _cumulative(m))) for m in range(1, EXACT_MEAN + 1))
)


def _uniform(digest: Column, start: int) -> Column:
    """A number between 0 and 1, both excluded, from 13 hexadecimal digits."""
    return (F.conv(F.substring(digest, start, 13), 16, 10).cast("double") + 0.5) / _UNIT


def poisson(mean: Column, digest: Column) -> Column:
    """A Poisson number with whole ``mean``, from a hexadecimal digest of 26 digits or more.

    Beyond ``EXACT_MEAN`` it is a normal number with the first correction for skewness.
    """
    tables = F.expr(_TABLES)

    def drawn(pair: Column) -> Column:
        one, two = pair["one"], pair["two"]
        exact = F.size(F.filter(F.get(tables, mean.cast("int") - 1), lambda c: c <= one))
        z = F.sqrt(-2 * F.log(one)) * F.cos(2 * pi * two)
        wide = F.floor(mean + z * F.sqrt(mean.cast("double")) + (z * z - 1) / 6 + 0.5)
        return F.when(mean <= EXACT_MEAN, exact).otherwise(F.greatest(wide, F.lit(0)))

    # an argument of a function is computed once; a digest used in place, once for each use and table entry
    numbers = F.transform(
        F.array(digest), lambda d: F.struct(_uniform(d, 1).alias("one"), _uniform(d, 14).alias("two"))
    )
    return F.when(mean > 0, F.get(F.transform(numbers, drawn), F.lit(0))).otherwise(0).cast("bigint")


def bootstrap_draws(
    df: DataFrame, keys: Sequence[str], num_trees: int, weight: str = "rows", seed: int = SEED, out: str = "draws"
) -> DataFrame:
    """Add an array: how often each tree draws the tally row, whose values are ``keys``.

    No shuffle and no state. ``keys`` should tell the rows apart, as rows of equal keys are
    drawn alike; integers and strings print alike in every engine. A null prints as an empty
    text. A row of weight 0 or null is never drawn.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    mean = F.coalesce(F.col(weight).cast("bigint"), F.lit(0))
    trees = F.sequence(F.lit(0), F.lit(num_trees - 1))

    def draws(row: Column) -> Column:
        text = lambda tree: F.concat_ws(":", *([row] if parts else []), tree.cast("string"), F.lit(str(seed)))
        return F.transform(trees, lambda tree: poisson(mean, F.md5(text(tree))))

    # an argument of a function is computed once: the text of a row, which all of its trees share
    return df.withColumn(out, F.get(F.transform(F.array(F.concat_ws(":", *parts)), draws), F.lit(0)))


class _ForestParams(Params):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)


class BootstrapForestModel(Model, _ForestParams):
    """Trees that vote by the class probabilities of their leaves."""

    def __init__(self, trees: Sequence[DecisionTreeClassificationModel] = (), num_classes: int = 2) -> None:
        super().__init__()
        self.trees, self.num_classes = list(trees), num_classes

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def first(self, number: int) -> BootstrapForestModel:
        """The forest of the first ``number`` trees."""
        model = BootstrapForestModel(self.trees[:number], self.num_classes)
        settings = {name: self.getOrDefault(name) for name in ("maxDepth", "maxBins")}
        return model._set(numTrees=number, **settings)

    @property
    def featureImportances(self) -> DenseVector:
        """The mean of the trees' importances, summing to 1 unless no tree has a split."""
        total = sum(t.featureImportances.toArray() for t in self.trees)
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def as_spark_forest(self) -> RandomForestClassificationModel:
        """The same trees as a forest of Spark's, which has a writer and finds all leaves at once."""
        kinds = SparkContext._active_spark_context._jvm.org.apache.spark.ml.classification
        trees = JavaWrapper._new_java_array([t._java_obj for t in self.trees], kinds.DecisionTreeClassificationModel)
        features = self.trees[0].numFeatures
        return RandomForestClassificationModel(
            kinds.RandomForestClassificationModel(self.uid, trees, features, self.num_classes)
        )

    def votes(self, df: DataFrame, out: str = "votes") -> DataFrame:
        """Add an array with the class probabilities that each tree gives a row."""
        names = [f"__tree_{i}" for i in range(len(self.trees))]
        scored = df
        for tree, name in zip(self.trees, names):
            alone = tree.copy().setProbabilityCol(name).setRawPredictionCol("").setPredictionCol("")
            scored = alone.transform(scored)
        return scored.withColumn(out, F.array(*[vector_to_array(F.col(n)) for n in names])).drop(*names)

    def _transform(self, df: DataFrame) -> DataFrame:
        voted = self.votes(df, "__votes")
        sums = [
            reduce(lambda a, b: a + b, [F.get(F.get("__votes", F.lit(i)), F.lit(c)) for i in range(len(self.trees))])
            for c in range(self.num_classes)
        ]
        summed = voted.withColumn("__sums", F.array(*sums)).drop("__votes")
        shares = F.transform("__sums", lambda s: s / len(self.trees))
        best = F.array_position("__sums", F.array_max("__sums")) - 1
        return summed.withColumns(
            {
                "rawPrediction": array_to_vector(F.col("__sums")),
                "probability": array_to_vector(shares),
                "prediction": best.cast("double"),
            }
        ).drop("__sums")


class BootstrapForest(Estimator, _ForestParams):
    """A random forest over a tally that carries the draws of :func:`bootstrap_draws`.

    Tree ``i`` is a tree over the rows that it draws, weighted by their draws, with a random
    choice of features at every node as ``featureSubsetStrategy`` says. Forests of more trees
    start with the trees of smaller ones.
    """

    @keyword_only
    def __init__(
        self,
        *,
        numTrees: int = 20,
        maxDepth: int = 5,
        maxBins: int = 32,
        labelCol: str = "label",
        featuresCol: str = "features",
        drawsCol: str = "draws",
        featureSubsetStrategy: str = "sqrt",
        seed: int = SEED,
        parallelism: int = 4,
    ) -> None:
        super().__init__()
        self._set(numTrees=numTrees, maxDepth=maxDepth, maxBins=maxBins)
        self.label, self.features, self.draws = labelCol, featuresCol, drawsCol
        self.subset, self.seed, self.parallelism = featureSubsetStrategy, seed, parallelism

    def _fit(self, df: DataFrame) -> BootstrapForestModel:
        number = self.getOrDefault("numTrees")
        check_bins(df, self.getOrDefault("maxBins"), self.features)
        seen = df.agg(F.max(self.label).alias("top"), F.min(F.size(self.draws)).alias("trees")).first()
        if seen["top"] is None:
            raise ValueError("there are no rows to train on")
        if seen["trees"] < number:
            raise ValueError(f"the rows carry draws of {seen['trees']} trees, not {number}")
        classes = max(2, int(seen["top"]) + 1)
        # a tree may draw no row of the largest class, but has to know of it
        rows = df.withMetadata(self.label, category_mark(self.label, classes))
        rows = rows.select(self.features, self.label, self.draws)

        def tree(i: int) -> DecisionTreeClassificationModel:
            drawn = rows.withColumn("__weight", F.get(self.draws, F.lit(i))).filter("__weight > 0")
            one = RandomForestClassifier(
                labelCol=self.label, featuresCol=self.features, weightCol="__weight", numTrees=1, bootstrap=False,
                maxDepth=self.getOrDefault("maxDepth"), maxBins=self.getOrDefault("maxBins"),
                featureSubsetStrategy=self.subset, seed=self.seed + i,
            )
            return one.fit(drawn).trees[0]

        with ThreadPoolExecutor(max(1, min(self.parallelism, number))) as pool:
            trees = list(pool.map(inheritable_thread_target(df.sparkSession)(tree), range(number)))
        model = BootstrapForestModel(trees, classes)
        return model._set(**{name: self.getOrDefault(name) for name in ("numTrees", "maxDepth", "maxBins")})
