"""Forests cut at any depth and after any number of trees, scored in one pass.

A forest of a smaller depth is the upper part of a deeper one, as its nodes and its random
choices of features are made level by level. Where a cut leaves two leaves of equal prediction,
Spark would have merged them, so they are merged here as well: a merged leaf votes by its own
class shares.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.base import Model
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .explain import saved_nodes

LEAVES = "__leaves"
#: Spark's default ``maxMemoryInMB``: what the counts of one pass may take.
PASS_BYTES = 256 << 20


def levels_in_one_pass(num_trees: int, max_depth: int, max_bins: int, features: int, classes: int = 2) -> bool:
    """Whether all nodes of the widest level are surely counted in one pass."""
    nodes = num_trees * 2 ** max(0, max_depth - 1)
    return 4 * 8 * nodes * features * max_bins * classes <= PASS_BYTES


def cut_shares(nodes: list, depths: Sequence[int]) -> list[list[list[float]]]:
    """For each leaf of a tree, from left to right, the class shares by which the tree cut at each
    of ``depths`` votes there. ``nodes`` are the rows of the saved tree."""
    known = {n["id"]: n for n in nodes}
    leaves = sorted(i for i, n in known.items() if n["leftChild"] < 0)
    shares = {i: [] for i in leaves}

    def walk(place: int, level: int, depth: int, found: dict) -> tuple[float | None, list[int]]:
        """The prediction, if the node is a leaf of the cut tree, and the leaves below."""
        node = known[place]
        if node["leftChild"] < 0:
            found[place] = node["impurityStats"]
            return node["prediction"], [place]
        (one, left), (other, right) = (walk(node[c], level + 1, depth, found) for c in ("leftChild", "rightChild"))
        below = left + right
        if level >= depth or (one is not None and one == other):
            found.update(dict.fromkeys(below, node["impurityStats"]))
            return (node["prediction"] if level >= depth else one), below
        return None, below

    for depth in depths:
        found: dict[int, list[float]] = {}
        walk(0, 0, depth, found)
        for leaf in leaves:
            total = sum(found[leaf])
            shares[leaf].append([n / total if total else 0.0 for n in found[leaf]])
    return [shares[i] for i in leaves]


def forest_nodes(spark: SparkSession, model: Model) -> list[list]:
    """The saved nodes of every tree of a forest; a forest lives on the driver, and so do they here."""
    trees: dict[int, list] = {}
    for row in saved_nodes(spark, _as_one(model)).select("treeID", "nodeData.*").drop("split").collect():
        trees.setdefault(row["treeID"], []).append(row)
    return [trees[i] for i in sorted(trees)]


def leaf_numbers(model: Model, df: DataFrame) -> DataFrame:
    """``df`` with an array of the leaf of each tree, in ``LEAVES``."""
    placed = _as_one(model).copy().setLeafCol(LEAVES).transform(df).drop("rawPrediction", "probability", "prediction")
    return placed.withColumn(LEAVES, vector_to_array(LEAVES))


def _as_one(model: Model) -> RandomForestClassificationModel:
    """The trees in one model of Spark's, which is saved, and finds the leaves, in one go."""
    return model if isinstance(model, RandomForestClassificationModel) else model.as_spark_forest()


def score_cuts(model: Model, df: DataFrame, depths: Sequence[int], numbers: Sequence[int]) -> DataFrame:
    """``df`` once for each depth and number of trees, as ``max_depth`` and ``num_trees``, with
    the ``prediction`` of the forest of the first so many trees cut at that depth."""
    trees = [cut_shares(nodes, depths) for nodes in forest_nodes(df.sparkSession, model)]
    classes = range(len(trees[0][0][0]))
    shares = [[[[leaf[at][c] for leaf in tree] for tree in trees] for c in classes] for at in range(len(depths))]
    tables = F.from_json(F.lit(json.dumps(shares)), "array<array<array<array<double>>>>")

    def cast(at: int, c: int) -> Column:
        """What each tree cut at a depth gives a class."""
        at_leaf = F.get(F.get(tables, F.lit(at)), F.lit(c))
        return F.zip_with(F.col(LEAVES), at_leaf, lambda leaf, found: F.get(found, leaf.cast("int")))

    def votes(at: int, c: int, number: int) -> Column:
        first = F.slice(F.get(F.get("__cast", F.lit(at)), F.lit(c)), 1, number)
        return F.aggregate(first, F.lit(0.0), lambda total, share: total + share)

    # columns of their own, as an expression that is used twice would be computed twice
    placed = leaf_numbers(model, df)
    placed = placed.withColumn("__cast", F.array(*[F.array(*[cast(at, c) for c in classes]) for at in range(len(depths))]))
    places = [(at, depth, number) for at, depth in enumerate(depths) for number in numbers]
    sums = [F.array(*[votes(at, c, number) for c in classes]) for at, _, number in places]
    placed = placed.withColumn("__sums", F.array(*sums))
    cuts = []
    for place, (_, depth, number) in enumerate(places):
        found = F.get("__sums", F.lit(place))
        best = (F.array_position(found, F.array_max(found)) - 1).cast("double")
        cuts.append(F.struct(F.lit(depth).alias("max_depth"), F.lit(number).alias("num_trees"), best.alias("prediction")))
    return placed.select(*df.columns, F.inline(F.array(*cuts)))
