"""Trees cut at any depth, so that one fit answers for every smaller depth.

Trees of equal settings grow level by level: the tree of a smaller depth is the upper part of
a deeper one, and every node knows what it would predict as a leaf. A search over depths then
needs one fit for each combination of the other parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.base import Model
from pyspark.sql import DataFrame, SparkSession, functions as F

from .explain import saved_nodes
from .metrics import classification_metrics
from .tuning import Search, best_index, result_frame, select_best

LEAF = "__leaf"


def cut_predictions(spark: SparkSession, model: Model, depths: Sequence[int]) -> DataFrame:
    """``(leaf, predictions)``: for each leaf of a fitted tree what the tree predicts there when
    it is cut at each of ``depths``.

    Leaves are numbered from left to right, as the model numbers them. A tree lives on the
    driver, and so do its nodes here, as arrays: a few numbers for each node and depth.
    """
    nodes = saved_nodes(spark, model).select("id", "leftChild", "rightChild", "prediction").toArrow().sort_by("id")
    left, right, own = (nodes.column(c).to_numpy() for c in ("leftChild", "rightChild", "prediction"))
    wanted = np.array(depths)
    cut = np.empty((len(own), len(wanted)))
    cut[0] = own[0]
    level, depth = np.zeros(1, np.int64), 0
    while len(level):
        depth += 1
        above = level[left[level] >= 0]
        for child in (left[above], right[above]):
            cut[child] = np.where(wanted >= depth, own[child][:, None], cut[above])
        level = np.concatenate([left[above], right[above]])
    found = cut[left < 0]  # ids are in preorder, so leaves come from left to right
    starts = np.arange(len(found) + 1, dtype=np.int32) * len(wanted)
    columns = [pa.array(np.arange(len(found), dtype=float)), pa.ListArray.from_arrays(starts, found.ravel())]
    return spark.createDataFrame(pa.table(columns, ["leaf", "predictions"]), "leaf double, predictions array<double>")


def score_depths(model: Model, df: DataFrame, depths: Sequence[int]) -> DataFrame:
    """``df`` once for each depth, with ``max_depth`` and the ``prediction`` of the tree cut there."""
    leaves = cut_predictions(df.sparkSession, model, depths)
    at_leaf = model.copy().setLeafCol(LEAF).transform(df).drop("rawPrediction", "probability", "prediction")
    joined = at_leaf.join(leaves, F.col(LEAF) == F.col("leaf")).drop(LEAF, "leaf")
    cuts = F.arrays_zip(F.array(*[F.lit(d) for d in depths]).alias("max_depth"), F.col("predictions").alias("prediction"))
    names = [c for c in joined.columns if c != "predictions"]
    return joined.select(*names, F.explode(cuts).alias("cut")).select(
        *names, F.col("cut")["max_depth"].alias("max_depth"), F.col("cut")["prediction"].alias("prediction")
    )


def depth_search(
    train: DataFrame,
    scored: DataFrame,
    fit: Callable[..., Model],
    grid: list[dict[str, Any]],
    metric: str = "f1",
    label: str = "label",
    weight: str | None = None,
    split_col: str = "split",
    parallelism: int = 4,
) -> Search:
    """The same outcome as :func:`grid_search` over trees, with one fit for each combination of
    the parameters other than ``max_depth``, and one more for the best point.

    One job scores all depths of a tree on both splits. Fits take turns, as the driver holds the
    nodes of a tree while it grows and the passes of one fit keep the cluster busy; ``parallelism``
    is for the scores, which run beside the next fits.
    """
    spark = train.sparkSession
    others = [tuple(sorted((k, v) for k, v in point.items() if k != "max_depth")) for point in grid]
    settings = list(dict.fromkeys(others))
    scored = scored.filter(F.col(split_col).isin("train", "validation"))
    train, scored = train.persist(), scored.persist()
    turn = Lock()

    def run(setting: tuple) -> dict[int, dict[str, float]]:
        depths = sorted({p["max_depth"] for p, o in zip(grid, others) if o == setting})
        with turn:
            model = fit(train, max_depth=depths[-1], **dict(setting))
        cut = score_depths(model, scored, depths)
        found: dict[int, dict[str, float]] = {d: {} for d in depths}
        for row in classification_metrics(cut, label, weight=weight, by=["max_depth", split_col]).collect():
            found[row["max_depth"]][row[split_col]] = row[metric]
        for values in found.values():
            if len(values) < 2:
                raise ValueError(f"train and validation need rows, found {sorted(values)}")
        return found

    try:
        with ThreadPoolExecutor(max(1, min(parallelism, len(settings)))) as pool:
            by_setting = dict(zip(settings, pool.map(inheritable_thread_target(spark)(run), settings)))
        outcomes = [by_setting[o][p["max_depth"]] for p, o in zip(grid, others)]
        best = grid[best_index([o["validation"] for o in outcomes])]
        best_model = fit(train, **best)
    finally:
        train.unpersist()
        scored.unpersist()
    names = [f"training_{metric}", f"validation_{metric}"]
    results = result_frame(spark, grid, [(o["train"], o["validation"]) for o in outcomes], names)
    return Search(select_best(results, names[1]).orderBy("grid_index"), best_model, best)
