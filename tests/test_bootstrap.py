"""Forests whose bootstrap is drawn from a tally."""

from dataclasses import replace

import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from tabular_insights import contract, operators as ops
from tabular_insights.operators import votes
from tabular_insights.plans import flows

KEYS = ["a", "b", "label"]


@pytest.fixture(scope="module")
def counted(spark):
    """A tally whose label needs both features."""
    df = spark.range(4000).select(
        (F.col("id") % 7).cast("int").alias("a"), (F.hash("id") % 5).cast("int").alias("b"), "id"
    )
    df = df.withColumn("label", ((F.col("a") > 3) != ((F.col("b") > 0) | (F.col("id") % 11 == 0))).cast("int"))
    return ops.tally(df, KEYS).cache()


def forest(df, **settings):
    return ops.BootstrapForest(numTrees=6, maxDepth=4, **settings).fit(df)


def ready(df):
    return ops.assemble(df, ["a", "b"], keep=["a", "b", "label", "rows", "draws"])


def test_draws_have_the_mean_and_variance_of_poisson(spark):
    for mean in (1, 6, 32, 33, 400):
        df = spark.range(400).select("id", F.lit(mean).alias("rows"))
        drawn = ops.bootstrap_draws(df, ["id"], 25).select(F.explode("draws").alias("d"))
        average, variance, least = drawn.agg(F.avg("d"), F.var_samp("d"), F.min("d")).first()
        assert average == pytest.approx(mean, abs=4 * (mean / 10_000) ** 0.5)
        assert variance == pytest.approx(mean, rel=0.07)
        assert least >= 0


def test_draws_do_not_hang_on_partitions_or_on_the_number_of_trees(counted):
    one = rows(ops.bootstrap_draws(counted.repartition(7), KEYS, 6))
    two = rows(ops.bootstrap_draws(counted.coalesce(1), KEYS, 6))
    fewer = rows(ops.bootstrap_draws(counted, KEYS, 4))
    other = rows(ops.bootstrap_draws(counted, KEYS, 6, seed=5))
    assert one == two and [r[-1][:4] for r in one] == [r[-1] for r in fewer]
    assert one != other


def test_no_rows_and_nulls_are_never_drawn(spark):
    df = spark.createDataFrame([(None, 3), ("x", None), ("y", 0)], "a string, rows long")
    drawn = {r.a: r.draws for r in ops.bootstrap_draws(df, ["a"], 2).collect()}
    assert drawn["x"] == drawn["y"] == [0, 0] and len(drawn[None]) == 2
    assert ops.bootstrap_draws(df.limit(0), ["a"], 2).count() == 0


def test_the_same_forest_under_any_partitioning(counted):
    trees = [
        [t.toDebugString.split("\n", 1)[1] for t in forest(ready(ops.bootstrap_draws(counted.repartition(n), KEYS, 6))).trees]
        for n in (1, 5)
    ]
    assert trees[0] == trees[1]
    model = forest(ready(ops.bootstrap_draws(counted, KEYS, 6)))
    assert len({tuple(t.featureImportances.toArray()) for t in model.trees}) == 6


def test_votes_add_up_to_the_prediction(counted):
    data = ready(ops.bootstrap_draws(counted, KEYS, 6))
    model = forest(data)
    scored = model.votes(ops.score(model, data)).collect()
    for r in scored:
        sums = [sum(v[c] for v in r.votes) for c in range(2)]
        assert list(r.rawPrediction) == pytest.approx(sums)
        assert list(r.probability) == pytest.approx([s / 6 for s in sums])
        assert r.prediction == float(sums.index(max(sums)))
    assert ops.final_report(model, data, weight="rows").first()["accuracy"] > 0.85
    assert sum(model.featureImportances) == pytest.approx(1)
    assert ops.best_params(model) == {"num_trees": 6, "max_depth": 4, "max_bins": 32}


def test_a_rare_class_that_some_trees_never_draw(spark):
    df = spark.createDataFrame([(i, 0, int(i == 0) * 2, 1) for i in range(40)], "a int, b int, label int, rows long")
    data = ready(ops.bootstrap_draws(df, KEYS, 6))
    found = rows(ops.score(forest(data), data).select("a", F.size(ops.bootstrap.vector_to_array("probability"))))
    assert {r[1] for r in found} == {3}


def test_missing_draws_and_rows_are_errors(counted):
    data = ready(ops.bootstrap_draws(counted, KEYS, 3))
    with pytest.raises(ValueError, match="draws of 3 trees"):
        forest(data)
    with pytest.raises(ValueError, match="no rows"):
        forest(data.limit(0))


def test_folds_search_over_drawn_forests(counted):
    data = ready(ops.bootstrap_draws(counted, KEYS, 6)).withColumn("fold", F.pmod(F.hash("a", "b"), F.lit(3)))
    grid = ops.param_grid(num_trees=[2, 6], max_depth=[0, 4])
    names = {"num_trees": "numTrees", "max_depth": "maxDepth"}
    found = ops.cross_validate(data, ops.BootstrapForest(), grid, names, weight="rows")
    assert found.results.count() == 4
    assert found.best_point["max_depth"] == 4
    assert found.best_model.getNumTrees == found.best_point["num_trees"]
    shared = ops.cross_validate(data, ops.BootstrapForest(), grid, names, weight="rows", prefix="num_trees")
    assert rows(shared.results) == rows(found.results)


def test_a_digest_is_computed_once_for_each_draw(spark):
    """And not again for every entry of the table that the draw is looked up in."""
    df = spark.range(0, 50, 1, 1).select("id", (F.col("id") % 40 + 1).alias("n"))
    drawn = df.select(ops.poisson(F.col("n"), F.lit("f" * 26)).alias("most"), ops.poisson(F.col("n"), F.md5(F.col("id").cast("string"))).alias("k"))
    text = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("md5(") == 1
    assert rows(drawn.filter("most < 0 or k < 0")) == []


SPEC = replace(contract.ESCALATED_SPEC, train_partitions=4)


def test_training_rows_are_one_for_each_combination(spark, monkeypatch):
    """Its folds are added up, and only rows that are kept get a digest of their keys."""
    digested = []
    split = flows.hash_split
    monkeypatch.setattr(flows, "hash_split", lambda df, *args, **kw: digested.append(df) or split(df, *args, **kw))
    data = flows._prepare(contract.escalated(spark, SF_DIR), SPEC, folds=3, trees=4)
    tally = data.tally.filter(flows.IS_TRAIN)
    key = ["features", SPEC.label]
    assert data.merged.count() == tally.select(*key).distinct().count() < tally.count()
    assert digested[0].count() == data.tally.agg(F.sum("rows")).first()[0]
    for fold in (0, 2, None):
        some = tally if fold is None else tally.filter(F.col("fold") != fold)
        drawn = some.groupBy(*key).agg(*[F.sum(F.get("draws", F.lit(i))).alias(f"d{i}") for i in range(4)])
        names = flows._draw_columns(fold, 4)
        merged = data.merged.select(*key, *names).filter(F.greatest(*names) > 0)
        assert rows(merged) == rows(drawn.filter("greatest(d0, d1, d2, d3) > 0"))


def test_flow_over_merged_folds_scores_as_over_the_tally(spark):
    df, grid = contract.escalated(spark, SF_DIR), ops.param_grid(num_trees=[2, 4], max_depth=[2, 5], max_bins=[32])
    flow = flows.forest_flow(df, SPEC, grid, folds=2, bootstrap="tally")
    data = flows._prepare(df, SPEC, folds=2, trees=4, seed=ops.models.SEED)
    names = {"num_trees": "numTrees", "max_depth": "maxDepth", "max_bins": "maxBins"}
    train = data.tally.filter(flows.IS_TRAIN).repartition(4)
    forest = ops.BootstrapForest(labelCol=SPEC.label, seed=ops.models.SEED)
    by_tally = ops.cross_validate(train, forest, grid, names, label=SPEC.label, k=2, weight="rows")
    assert rows(flow.results) == rows(by_tally.results)
    assert flow.best_point == by_tally.best_point
    debug = [[t.toDebugString.split("\n", 1)[1] for t in f.trees] for f in (flow.model.stages[-1], by_tally.best_model)]
    assert debug[0] == debug[1]


def test_a_forest_is_saved_in_one_go(counted, monkeypatch):
    data = ready(ops.bootstrap_draws(counted, KEYS, 6))
    model = forest(data)
    saved = []
    nodes = votes.saved_nodes
    monkeypatch.setattr(votes, "saved_nodes", lambda *args: saved.append(1) or nodes(*args))
    cuts = votes.score_cuts(model, data, [1, 4], [2, 6])
    assert len(saved) == 1
    whole = cuts.filter("max_depth = 4 AND num_trees = 6").select("a", "b", "rows", "prediction")
    assert rows(whole) == rows(ops.score(model, data).select("a", "b", "rows", "prediction"))
    assert rows(model.as_spark_forest().transform(data).select("prediction")) == rows(ops.score(model, data).select("prediction"))
