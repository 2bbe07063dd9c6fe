"""Grid search on a hold-out split, cross-validation, and choosing the best point."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product
from statistics import fmean, pstdev
from threading import Lock
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml.base import Estimator, Model
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .metrics import classification_metrics
from .models import score
from .votes import score_cuts

@dataclass(frozen=True)
class Search:
    """Outcome of a search: one result row per point, and the model of the best one."""

    results: DataFrame
    best_model: Model
    best_point: dict[str, Any]


def param_grid(**axes: Sequence[Any]) -> list[dict[str, Any]]:
    """Every combination of the axes; the last axis varies fastest."""
    return [dict(zip(axes, values, strict=True)) for values in product(*axes.values())]


def _field_type(name: str, values: list[Any]) -> T.DataType:
    """The type that holds every value of an axis."""
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {list, tuple}:
        return T.ArrayType(_field_type(name, [x for v in values for x in v]))
    if kinds <= {bool}:
        return T.BooleanType()
    if kinds <= {int}:
        return T.IntegerType() if all(abs(v) < 2**31 for v in values if v is not None) else T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    if kinds <= {str}:
        return T.StringType()
    raise ValueError(f"the values of {name} have no common type: {sorted(k.__name__ for k in kinds)}")


def _grid_fields(grid: list[dict[str, Any]]) -> list[T.StructField]:
    """Fields of the parameters; lists also as text. Fails before anything is fitted."""
    fields = []
    for name in grid[0]:
        kind = _field_type(name, [point[name] for point in grid])
        fields.append(T.StructField(name, kind))
        if isinstance(kind, T.ArrayType):
            fields.append(T.StructField(f"{name}_label", T.StringType()))
    return fields


def result_frame(
    spark: SparkSession, grid: list[dict[str, Any]], scores: list[tuple], names: Sequence[str]
) -> DataFrame:
    """``(grid_index, <parameters>, <scores>)`` with a fixed schema."""
    fields = _grid_fields(grid)
    kinds = {f.name: f.dataType for f in fields}
    rows = []
    for index, (point, values) in enumerate(zip(grid, scores, strict=True)):
        cells: list[Any] = [index]
        for name, value in point.items():
            cells.append(float(value) if isinstance(kinds[name], T.DoubleType) else value)
            if isinstance(kinds[name], T.ArrayType):
                cells.append(str(list(value)))
        rows.append((*cells, *values))
    index = T.StructField("grid_index", T.IntegerType())
    scored = [T.StructField(name, T.DoubleType()) for name in names]
    return spark.createDataFrame(rows, T.StructType([index, *fields, *scored]))


def best_index(scores: Sequence[float]) -> int:
    """Place of the highest score, the first of equals; NaN never wins over a number."""
    return max(range(len(scores)), key=lambda i: (-math.inf if math.isnan(scores[i]) else scores[i], -i))


def select_best(results: DataFrame, metric: str, order: str = "grid_index") -> DataFrame:
    """Add ``is_best``: true for the highest ``metric``, the lowest ``order`` among equals.

    ``order`` tells the rows apart. NaN never wins. The winner is one partial maximum
    per task, so a table of any size may be marked.
    """
    value = F.coalesce(F.nanvl(F.col(metric), F.lit(-math.inf)), F.lit(-math.inf))
    best = results.agg(F.min_by(order, F.struct(-value, F.col(order))))
    return results.withColumn("is_best", F.col(order) == best.scalar())


def grid_search(
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
    """Fit every grid point on ``train`` and score it on the splits of ``scored``.

    ``scored`` holds the ``train`` and ``validation`` splits, as rows or as a tally
    with ``weight``; one grouped count gives both metrics of a point. Both inputs
    stay persisted during the search. Points run ``parallelism`` at a time; of their
    models only the best one so far is kept.
    """
    spark = train.sparkSession
    _grid_fields(grid)
    lock, leader = Lock(), {}
    scored = scored.filter(F.col(split_col).isin("train", "validation"))
    train, scored = train.persist(), scored.persist()

    def run(place: int) -> tuple[float, float]:
        model = fit(train, **grid[place])
        found = classification_metrics(
            score(model, scored), label, weight=weight, by=[split_col]
        ).collect()
        values = {row[split_col]: row[metric] for row in found}
        if len(values) < 2:
            raise ValueError(f"train and validation need rows, found {sorted(values)}")
        with lock:
            held = leader.get("place")
            seen[place] = values["validation"]
            best = best_index([seen.get(i, math.nan) for i in range(len(grid))])
            if held is None or best == place:
                leader.update(place=place, model=model)
        return values["train"], values["validation"]

    seen: dict[int, float] = {}
    try:
        with ThreadPoolExecutor(max(1, min(parallelism, len(grid)))) as pool:
            outcomes = list(pool.map(inheritable_thread_target(spark)(run), range(len(grid))))
    finally:
        train.unpersist()
        scored.unpersist()
    names = [f"training_{metric}", f"validation_{metric}"]
    results = result_frame(spark, grid, outcomes, names)
    marked = select_best(results, names[1]).orderBy("grid_index")
    return Search(marked, leader["model"], grid[best_index([o[1] for o in outcomes])])


def cross_validate(
    data: DataFrame,
    estimator: Estimator,
    grid: list[dict[str, Any]],
    params: dict[str, str],
    metric: str = "accuracy",
    label: str = "label",
    fold_col: str = "fold",
    k: int = 3,
    parallelism: int = 4,
    weight: str | None = None,
    prefix: str | None = None,
    depth: str | None = None,
    alike: Callable[[dict[str, Any]], Any] | None = None,
    scored: DataFrame | None = None,
    train: Callable[[int | None], DataFrame] | None = None,
) -> Search:
    """k-fold cross-validation over the folds in ``fold_col``, then a refit on all rows.

    ``params`` maps grid names to the estimator's parameter names. Result rows hold
    the mean and the standard deviation of ``metric`` over the folds. For a tally, give
    ``weight`` here and to the estimator. The rows are kept during the search, so they are
    read and assembled once; the fits of all folds and points share one pool, and of their
    models none is held. ``prefix`` names a number of trees where a smaller forest is the
    ``first`` trees of a larger one: points that differ in it only then share a fit. So do
    points that differ in ``depth`` only, if that names the largest depth of a forest whose
    upper part is the forest of a smaller depth, and points of which ``alike`` says the same.
    ``scored`` are the rows or the tally that the held-out folds are scored on, by default the data;
    ``weight`` is a column of it. ``train`` gives the rows to fit on without a fold, or all of them
    for None, where they are kept in another form than the data.
    """
    spark = data.sparkSession
    _grid_fields(grid)
    data = data.persist()

    def rows_without(fold: int | None) -> DataFrame:
        if train:
            return train(fold)
        return data if fold is None else data.filter(F.col(fold_col) != fold)

    def settings(point: dict[str, Any]) -> dict:
        return {estimator.getParam(params[name]): value for name, value in point.items()}

    shared: dict[Any, list[int]] = {}
    for place, point in enumerate(grid):
        said = alike(point) if alike else point
        other = tuple(sorted((n, v) for n, v in said.items() if n not in (prefix, depth)))
        shared.setdefault(other if prefix or depth or alike else place, []).append(place)

    def run(task: tuple[list[int], int]) -> dict[tuple[int, int], float]:
        places, fold = task
        largest = {name: max(grid[p][name] for p in places) for name in (prefix, depth) if name}
        model = estimator.copy(settings({**grid[places[0]], **largest})).fit(rows_without(fold))
        held_out = (data if scored is None else scored).filter(F.col(fold_col) == fold)
        if prefix or depth:
            keys = [(grid[p].get(depth, 0), grid[p].get(prefix, 0)) for p in places]
            depths = sorted({d for d, _ in keys}) if depth else [model.getOrDefault("maxDepth")]
            numbers = sorted({n for _, n in keys}) if prefix else [len(model.trees)]
            cuts = classification_metrics(
                score_cuts(model, held_out, depths, numbers), label, weight=weight, by=["max_depth", "num_trees"]
            )
            by_cut = {(row["max_depth"], row["num_trees"]): row[metric] for row in cuts.collect()}
            found = {p: by_cut.get((d if depth else depths[0], n if prefix else numbers[0])) for p, (d, n) in zip(places, keys)}
        else:
            row = classification_metrics(score(model, held_out), label, weight=weight).first()
            found = dict.fromkeys(places, row and row[metric])
        if None in found.values():
            raise ValueError(f"fold {fold} has no rows")
        return {(place, fold): value for place, value in found.items()}

    tasks = [(places, fold) for places in shared.values() for fold in range(k)]
    try:
        found: dict[tuple[int, int], float] = {}
        with ThreadPoolExecutor(max(1, min(parallelism, len(tasks)))) as pool:
            for values in pool.map(inheritable_thread_target(spark)(run), tasks):
                found |= values
        by_point = [[found[place, fold] for fold in range(k)] for place in range(len(grid))]
        scores = [(fmean(values), pstdev(values)) for values in by_point]
        best = best_index([s[0] for s in scores])
        best_model = estimator.copy(settings(grid[best])).fit(rows_without(None))
    finally:
        data.unpersist()
    names = [f"avg_{metric}", f"std_{metric}"]
    results = select_best(result_frame(spark, grid, scores, names), names[0])
    return Search(results.orderBy("grid_index"), best_model, grid[best])


def best_params(model: Model) -> dict[str, Any]:
    """The tuned parameters of a fitted tree, forest or perceptron, read from the model."""
    found: dict[str, Any] = {}
    if model.hasParam("numTrees"):
        found["num_trees"] = model.getNumTrees
    for name, param in (
        ("max_depth", "maxDepth"),
        ("min_instances_per_node", "minInstancesPerNode"),
        ("max_bins", "maxBins"),
        ("layers", "layers"),
        ("block_size", "blockSize"),
    ):
        if model.hasParam(param):
            found[name] = model.getOrDefault(param)
    return found


def final_report(
    model: Model, df: DataFrame, label: str = "label", weight: str | None = None
) -> DataFrame:
    """All metrics of ``model`` on unseen rows, as one row."""
    return classification_metrics(score(model, df), label, weight=weight)
