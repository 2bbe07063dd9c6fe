"""The three complete runs: hold-out tree grid, hold-out perceptron grid, forest by folds.

Each run reads its input twice: the first pass, over the reduced columns only, counts
their values; the second keeps the rows with frequent values before anything is shuffled.
Category numbers, tree training and the hold-out scores come from a tally of what is
kept, staged in the shared folder. The perceptron and the forest train on single rows, so
their runs first stage the kept rows, one folder per split, and tally those.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import (
    BootstrapForest,
    add_folds,
    assemble,
    best_params,
    bootstrap_draws,
    category_indexer,
    check_bins,
    cross_validate,
    depth_search,
    drop_null_rows,
    feature_importances,
    final_report,
    fit_mlp,
    fit_tree,
    flag_to_int,
    grid_search,
    hash_split,
    keep_listed,
    largest_category,
    param_grid,
    spread_tally,
    tally,
    top_k_values,
    tree_nodes,
)
from ..operators.models import SEED
from ..operators.votes import levels_in_one_pass
from ..operators.categories import MAX_LABELS
from ..session import stage

IS_TRAIN = "split = 'train'"

# The published search grids.
TREE_GRID = param_grid(max_depth=[2, 5, 10, 15, 20], min_instances_per_node=[2, 5, 10, 15, 20])
MLP_GRID = param_grid(
    block_size=[32, 64, 128, 256],
    layers=[
        [6, 16, 8, 10], [6, 12, 8, 10], [6, 10, 10, 10], [6, 20, 20, 10], [6, 16, 16, 10],
        [6, 8, 8, 10], [6, 8, 10, 10], [6, 12, 12, 10], [6, 16, 20, 10], [6, 8, 20, 10],
    ],
)
FOREST_GRID = param_grid(num_trees=[10, 15], max_depth=[5, 7], max_bins=[32, 40])


@dataclass(frozen=True)
class IncidentSpec:
    """Which columns a run uses, and how.

    ``fit_on`` is ``"all"`` to number categories (and scale) over all rows before
    the split, or ``"train"`` to use training rows only and keep unseen values as
    one more category; limits on bins are then raised to the largest category, as the
    additional one would exceed the published limits.

    ``train_partitions`` deals the training rows: draws of a bootstrap and samples for
    thresholds hang on partitions, so a fixed number gives the same model on any cluster
    that reads the same staged files. ``tally_parts`` bounds the weight of one tally row.
    """

    keys: Sequence[str]
    label: str = "arrest"
    required: Sequence[str] = (
        "ts", "block", "primary_type", "description", "location_description", "arrest",
        "domestic", "beat", "district", "ward", "community_area", "year",
    )
    categories: Sequence[str] = ("primary_type", "description", "location_description")
    reduced: Sequence[str] = ("description", "location_description")
    flags: Sequence[str] = ("domestic",)
    numbers: Sequence[str] = ("ward", "year")
    k: int = 32
    seed: int = 17
    fit_on: str = "all"
    train_partitions: int = 16
    tally_parts: int = 100_000
    max_labels: int = MAX_LABELS

    @property
    def index_columns(self) -> list[str]:
        return [f"{c}_index" for c in self.categories]

    @property
    def features(self) -> list[str]:
        return [*self.index_columns, *self.flags, *self.numbers]


@dataclass(frozen=True)
class Flow:
    """``model`` takes cleaned rows with integer flags to predictions; the rest are tables."""

    results: DataFrame
    model: PipelineModel
    best_point: dict[str, Any]
    report: DataFrame
    nodes: DataFrame | None = None
    importances: DataFrame | None = None
    summary: DataFrame | None = None


@dataclass(frozen=True)
class _Prepared:
    indexer: PipelineModel
    tally: DataFrame  # features, split, fold if any, label, rows, draws if any
    rows: DataFrame | None  # features, split, fold if any, label; one row per incident
    merged: DataFrame | None  # features, label, draws of each tree without each fold and of all; one row per combination


def _prepare(
    df: DataFrame, spec: IncidentSpec, single_rows: bool = False, folds: int = 0, trees: int = 0, seed: int = SEED
) -> _Prepared:
    """Clean, count, reduce, split, number and assemble; draw the training tally for ``trees``."""
    if spec.fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    columns = [spec.label, *spec.categories, *spec.flags, *spec.numbers]
    clean = flag_to_int(drop_null_rows(df, spec.required), [spec.label, *spec.flags])
    extra = ["fold"] if folds else []
    top = stage(top_k_values(clean, spec.reduced, spec.k), "top")
    # only rows that are kept are worth a digest of their keys
    rows = hash_split(keep_listed(clean, top, spec.reduced), spec.keys, seed=spec.seed)
    if folds:
        rows = add_folds(rows, spec.keys, folds, seed=spec.seed)
    rows = rows.select("split", *extra, *columns)
    if single_rows:
        rows = stage(rows, "rows", ["split"])
    kept = stage(tally(rows, ["split", *extra, *columns]), "tally", ["split"])
    on_train = spec.fit_on == "train"
    indexer = category_indexer(
        kept.filter(IS_TRAIN) if on_train else kept,
        spec.categories,
        handle_invalid="keep" if on_train else "error",
        weight="rows",
        max_labels=spec.max_labels,
    )

    def ready(data: DataFrame, keep: Sequence[str]) -> DataFrame:
        return assemble(indexer.transform(data), spec.features, keep=["split", *keep, spec.label])

    merged = None
    keys, drawn = ["split", *extra, *columns], kept
    if trees:
        merged = bootstrap_draws(kept.filter(IS_TRAIN), keys, trees, seed=seed)
        merged = indexer.transform(_draws_without_folds(merged, columns, folds, trees))
        drawn_columns = [name for fold in [*range(folds), None] for name in _draw_columns(fold, trees)]
        merged = assemble(merged, spec.features, keep=[spec.label, *drawn_columns])
        merged = stage(merged.repartition(spec.train_partitions), "drawn")
        drawn = bootstrap_draws(kept, keys, trees, seed=seed)
    return _Prepared(
        indexer,
        ready(drawn, ["rows", *extra, *(["draws"] if trees else [])]),
        ready(rows, extra) if single_rows else None,
        merged,
    )


def _draw_columns(fold: int | None, trees: int) -> list[str]:
    """Names of the draws of each tree, without a fold or of all rows."""
    return [f"draws_{tree}" if fold is None else f"draws_{tree}_without_{fold}" for tree in range(trees)]


def _draws_without_folds(drawn: DataFrame, columns: Sequence[str], folds: int, trees: int) -> DataFrame:
    """One row for each combination of ``columns``, with the sums of its draws over the folds: over all
    but one, for each, and over all.

    The folds of a combination are one weighted row of a tree, so a fit reads no more rows than that, and
    of the columns, one for each tree, its own.
    """
    place = F.col("fold") if folds else F.lit(0)
    held = drawn.groupBy(*columns).agg(F.collect_list(F.struct(place.alias("fold"), "draws")).alias("__held"))
    none = F.array_repeat(F.lit(0).cast("bigint"), trees)

    def added(without: int) -> Column:
        parts = F.filter("__held", lambda part: part["fold"] != without)
        return F.aggregate(parts, none, lambda total, part: F.zip_with(total, part["draws"], lambda a, b: a + b))

    without = {f"__sums_{fold}": fold for fold in [*range(folds), None]}
    held = held.withColumns({name: added(-1 if fold is None else fold) for name, fold in without.items()})
    return held.select(
        *columns,
        *[
            F.get(name, F.lit(tree)).alias(out)
            for name, fold in without.items()
            for tree, out in enumerate(_draw_columns(fold, trees))
        ],
    )


def _bins(data: _Prepared, spec: IncidentSpec, asked: int) -> int:
    return max(asked, largest_category(data.tally)) if spec.fit_on == "train" else asked


def _number_values(kept: DataFrame, spec: IncidentSpec) -> int:
    """The most values that a feature which is no category has."""
    places = range(len(spec.index_columns), len(spec.features))
    values = vector_to_array("features")
    counts = kept.agg(*[F.count_distinct(F.get(values, F.lit(i))) for i in places]).first() if places else []
    return max(counts, default=0)


def _same_bins(point: dict[str, Any], values: int) -> dict[str, Any]:
    """``point`` without its bins where they change nothing: categories have bins of their own, and
    all thresholds of ``values`` numbers are tried. Beyond 100 bins more rows are sampled."""
    return {n: v for n, v in point.items() if n != "max_bins" or not values <= v <= 100}


def tree_flow(
    df: DataFrame,
    spec: IncidentSpec,
    grid: list[dict[str, Any]] = TREE_GRID,
    max_bins: int = 32,
    seed: int = SEED,
    parallelism: int = 4,
) -> Flow:
    """Tree grid by validation f1, nodes of the best tree, and its metrics on the test split.

    Points that differ in ``max_depth`` only share one fit.
    """
    data = _prepare(df, spec)
    light = spread_tally(data.tally.filter(IS_TRAIN), parts=spec.tally_parts)
    train = light.repartition(spec.train_partitions)
    max_bins = _bins(data, spec, max_bins)
    total = data.tally.filter(IS_TRAIN).agg(F.sum("rows").alias("n")).first()["n"]
    fit = partial(
        fit_tree, label=spec.label, max_bins=max_bins, seed=seed, weight="rows", weight_total=total, cacheNodeIds=True
    )
    found = depth_search(
        train, data.tally, fit, grid, label=spec.label, weight="rows", parallelism=parallelism
    )
    test = data.tally.filter(F.col("split") == "test")
    labels = {m.getOutputCol(): m.labels for m in data.indexer.stages}
    assembler = VectorAssembler(inputCols=spec.features, outputCol="features")
    return Flow(
        results=found.results,
        model=PipelineModel([data.indexer, assembler, found.best_model]),
        best_point=found.best_point,
        report=final_report(found.best_model, test, spec.label, weight="rows"),
        nodes=tree_nodes(df.sparkSession, found.best_model, spec.features, labels),
        importances=feature_importances(df.sparkSession, found.best_model, spec.features),
    )


def mlp_flow(
    df: DataFrame,
    spec: IncidentSpec,
    grid: list[dict[str, Any]] = MLP_GRID,
    max_iter: int = 100,
    seed: int = 1234,
    parallelism: int = 4,
) -> Flow:
    """Perceptron grid by validation f1 on standardised features; test metrics of the best."""
    data = _prepare(df, spec, single_rows=True)
    train = data.rows.filter(IS_TRAIN)
    scaler = StandardScaler(
        inputCol="features", outputCol="scaled_features", withMean=True, withStd=True
    ).fit(train if spec.fit_on == "train" else data.rows)
    train = scaler.transform(train).select("scaled_features", spec.label)
    train = train.repartition(spec.train_partitions)
    scored = scaler.transform(data.tally)
    fit = partial(fit_mlp, label=spec.label, max_iter=max_iter, seed=seed)
    found = grid_search(
        train, scored, fit, grid, label=spec.label, weight="rows", parallelism=parallelism
    )
    test = scored.filter(F.col("split") == "test")
    assembler = VectorAssembler(inputCols=spec.features, outputCol="features")
    return Flow(
        results=found.results,
        model=PipelineModel([data.indexer, assembler, scaler, found.best_model]),
        best_point=found.best_point,
        report=final_report(found.best_model, test, spec.label, weight="rows"),
    )


def forest_flow(
    df: DataFrame,
    spec: IncidentSpec,
    grid: list[dict[str, Any]] = FOREST_GRID,
    folds: int = 3,
    seed: int = SEED,
    parallelism: int = 4,
    bootstrap: bool | str = True,
) -> Flow:
    """Forest grid by accuracy over folds of the training split.

    Gives the best parameters with their validation accuracy, the importances, and
    the metrics on the test split. ``bootstrap`` is true for Spark's own, over single rows,
    ``"tally"`` for one drawn from the tally, or false. But for the first the forest, too,
    trains on the tally, and the size of the input matters for one pass only.
    """
    if bootstrap not in (True, False, "tally"):
        raise ValueError("bootstrap must be True, False or 'tally'")
    spark = df.sparkSession
    from_tally = bootstrap == "tally"
    trees = max(point.get("num_trees", 20) for point in grid) if from_tally else 0
    bootstrap = bootstrap is True
    data = _prepare(df, spec, single_rows=bootstrap, folds=folds, trees=trees, seed=seed)
    if spec.fit_on == "train":
        grid = [{**p, "max_bins": _bins(data, spec, p.get("max_bins", 32))} for p in grid]
    check_bins(data.tally, min(point.get("max_bins", 32) for point in grid))
    train = (data.rows if bootstrap else data.tally).filter(IS_TRAIN).drop("draws")
    train = train.repartition(spec.train_partitions)

    def without(fold: int | None) -> DataFrame:
        return data.merged.select("features", spec.label, F.array(*_draw_columns(fold, trees)).alias("draws"))

    if from_tally:
        forest = BootstrapForest(labelCol=spec.label, seed=seed, parallelism=parallelism)
    else:
        forest = RandomForestClassifier(
            labelCol=spec.label, featuresCol="features", seed=seed, bootstrap=bootstrap
        )
        if not bootstrap:
            forest.setWeightCol("rows")
    largest = {n: max(p.get(n, d) for p in grid) for n, d in (("num_trees", 20), ("max_depth", 5), ("max_bins", 32))}
    one_pass = levels_in_one_pass(*largest.values(), len(spec.features))
    found = cross_validate(
        train,
        forest,
        grid,
        {"num_trees": "numTrees", "max_depth": "maxDepth", "max_bins": "maxBins"},
        label=spec.label,
        k=folds,
        parallelism=parallelism,
        weight="rows",
        prefix="num_trees" if from_tally and "num_trees" in grid[0] else None,
        depth="max_depth" if one_pass and "max_depth" in grid[0] else None,
        alike=partial(_same_bins, values=_number_values(data.merged if from_tally else data.tally.filter(IS_TRAIN), spec)),
        scored=data.tally.filter(IS_TRAIN) if bootstrap else None,
        train=without if from_tally else None,
    )
    by_split = {
        name: data.tally.filter(F.col("split") == name) for name in ("validation", "test")
    }
    validation = final_report(found.best_model, by_split["validation"], spec.label, "rows")
    best = best_params(found.best_model)
    assembler = VectorAssembler(inputCols=spec.features, outputCol="features")
    return Flow(
        results=found.results,
        model=PipelineModel([data.indexer, assembler, found.best_model]),
        best_point=found.best_point,
        report=final_report(found.best_model, by_split["test"], spec.label, "rows"),
        importances=feature_importances(spark, found.best_model, spec.features),
        summary=validation.select(
            *[F.lit(best[name]).alias(name) for name in ("num_trees", "max_depth", "max_bins")],
            F.col("accuracy").alias("validation_accuracy"),
        ),
    )
