import pytest
from conftest import SF_DIR, rows
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabular_insights import operators as ops
from tabular_insights.sources.adapter import INCIDENT_COLUMNS, incidents

CATEGORIES = ["primary_type", "description"]


@pytest.fixture(scope="module")
def data(spark):
    """Indexed rows with a label that needs more than one split."""
    df = ops.drop_null_rows(incidents(spark, SF_DIR), INCIDENT_COLUMNS)
    df = ops.flag_to_int(df, ["arrest", "domestic"])
    near = (F.col("ward") < 20) & (F.col("year") > 1997)
    df = df.withColumn("label", F.when(near, 1 - F.col("arrest")).otherwise(F.col("arrest")))
    df = ops.keep_top_k(df, ["description"], 32)
    df = ops.index_categories(df, CATEGORIES)
    return df.select("primary_type_index", "description_index", "domestic", "ward", "year", "label")


FEATURES = ["primary_type_index", "description_index", "domestic", "ward", "year"]


@pytest.fixture(scope="module")
def vectors(data):
    return ops.assemble(data, FEATURES).cache()


@pytest.mark.parametrize("least", [1, 5, 40])
def test_tree_from_a_tally_equals_tree_from_rows(data, vectors, least):
    counted = ops.assemble(ops.tally(data, [*FEATURES, "label"]), FEATURES)
    one = ops.fit_tree(vectors, max_depth=6, min_instances_per_node=least)
    two = ops.fit_tree(counted, max_depth=6, min_instances_per_node=least, weight="rows")
    assert one.numNodes > 3
    tree = lambda model: model.toDebugString.split("\n", 1)[1]
    assert tree(one) == tree(two)
    spread = ops.spread_tally(counted, parts=50)
    three = ops.fit_tree(spread, max_depth=6, min_instances_per_node=least, weight="rows")
    assert tree(one) == tree(three)


def test_minimum_beyond_half_of_the_rows(spark, data):
    counted = ops.assemble(ops.tally(data, [*FEATURES, "label"]), FEATURES)
    model = ops.fit_tree(counted, min_instances_per_node=10**6, weight="rows")
    assert model.numNodes == 1


def test_nodes_add_up(spark, vectors):
    model = ops.fit_tree(vectors, max_depth=5)
    nodes = ops.tree_nodes(spark, model, FEATURES).cache()
    leaves = nodes.filter("left_child IS NULL")
    total, right = leaves.agg(F.sum("rows"), F.sum(F.array_max("class_rows"))).first()
    assert total == vectors.count()
    accuracy = ops.final_report(model, vectors).first()["accuracy"]
    assert right / total == pytest.approx(accuracy, abs=1e-12)
    assert nodes.count() == model.numNodes
    inner = nodes.filter("left_child IS NOT NULL")
    assert inner.filter("feature IS NULL OR gain IS NULL").count() == 0
    kinds = inner.select(
        (F.col("threshold").isNull() != F.col("left_categories").isNull()).alias("one")
    )
    assert kinds.filter("NOT one").count() == 0


def test_forest_nodes_and_importances(spark, vectors):
    model = ops.fit_forest(vectors, num_trees=3, max_depth=3)
    nodes = ops.tree_nodes(spark, model, FEATURES)
    assert [r[0] for r in rows(nodes.select("tree_id").distinct())] == [0, 1, 2]
    found = ops.feature_importances(spark, model, FEATURES).collect()
    values = [r["importance"] for r in found]
    assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
    assert values == sorted(values, reverse=True) and min(values) >= 0
    assert sum(values) == pytest.approx(1)
    assert {r["feature"] for r in found} == set(FEATURES)


def test_forest_without_bootstrap_takes_a_tally(data, vectors):
    counted = ops.assemble(ops.tally(data, [*FEATURES, "label"]), FEATURES)
    one = ops.fit_forest(vectors, num_trees=4, max_depth=4, bootstrap=False)
    two = ops.fit_forest(counted, num_trees=4, max_depth=4, bootstrap=False, weight="rows")
    body = lambda model: model.toDebugString.split("\n", 1)[1]
    assert body(one) == body(two)
    with pytest.raises(ValueError, match="bootstrap"):
        ops.fit_forest(counted, weight="rows")


def test_same_seed_same_model(vectors):
    one = ops.fit_forest(vectors, num_trees=3, max_depth=3, seed=1)
    two = ops.fit_forest(vectors, num_trees=3, max_depth=3, seed=1)
    three = ops.fit_forest(vectors, num_trees=3, max_depth=3, seed=2)
    body = lambda model: model.toDebugString.split("\n", 1)[1]
    assert body(one) == body(two) != body(three)


def test_categories_must_fit_the_bins(spark):
    df = spark.range(330).select(
        F.concat(F.lit("c"), F.col("id") % 33).alias("c"), (F.col("id") % 2).alias("label")
    )
    indexed = ops.assemble(ops.index_categories(df, ["c"]), ["c_index"])
    with pytest.raises(ValueError, match="33 categories"):
        ops.fit_tree(indexed, max_bins=32)
    with pytest.raises(ValueError, match="33 categories"):
        ops.fit_forest(indexed, max_bins=32)
    ops.fit_tree(indexed, max_bins=33)


def test_one_more_category_for_unseen_values(spark):
    df = spark.range(320).select(
        F.concat(F.lit("c"), F.col("id") % 32).alias("c"), (F.col("id") % 2).alias("label")
    )
    kept = ops.index_categories(df, ["c"], handle_invalid="keep")
    vectors = ops.assemble(kept, ["c_index"])
    with pytest.raises(ValueError, match="33 categories"):
        ops.fit_tree(vectors, max_bins=32)
    ops.fit_tree(vectors, max_bins=33)


def test_perceptron_layers(vectors):
    scaled = ops.standardize(vectors)
    with pytest.raises(ValueError, match="first layer"):
        ops.fit_mlp(scaled, [4, 4, 2])
    with pytest.raises(ValueError, match="last layer"):
        ops.fit_mlp(scaled, [5, 4, 1])
    model = ops.fit_mlp(scaled, [5, 4, 10], max_iter=5)
    assert model.numClasses == 10
    again = ops.fit_mlp(scaled, [5, 4, 10], max_iter=5)
    assert list(model.weights) == list(again.weights)
    scored = ops.score(model, scaled)
    assert {"rawPrediction", "probability", "prediction"} <= set(scored.columns)


def test_standardize_known_values(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], ["p", "q"])
    scaled = ops.standardize(ops.assemble(df, ["p", "q"]))
    out = ops.vector_columns(scaled.select("scaled_features"), "scaled_features", ["p", "q"])
    found = sorted(tuple(r) for r in out.collect())
    expected = [(-0.872872, 0.0), (-0.218218, 0.0), (1.091089, 0.0)]
    assert found == [pytest.approx(e, abs=1e-6) for e in expected]


def test_standardize_on_other_rows(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (100.0,)], ["p"])
    vectors = ops.assemble(df, ["p"])
    scaled = ops.standardize(vectors, fit_on=vectors.filter(F.col("p") < 50))
    out = ops.vector_columns(scaled.select("scaled_features"), "scaled_features", ["p"])
    assert max(r[0] for r in out.collect()) == pytest.approx(99 / 2**0.5)


def test_null_in_a_vector_is_an_error(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "p double")
    with pytest.raises(Exception, match="null|Null|NULL"):
        ops.assemble(df, ["p"]).collect()


def test_pipeline_is_one_unit(spark):
    df = spark.range(200).select(
        F.concat(F.lit("c"), F.col("id") % 5).alias("c"),
        (F.col("id") % 7).alias("n"),
        (F.col("id") % 5 < 2).cast("int").alias("label"),
    )
    tree = DecisionTreeClassifier(labelCol="label", featuresCol="scaled_features", seed=1)
    chain = ops.build_pipeline(
        tree, ["c_index", "n"], before=[ops.category_indexer(df, ["c"])], scaled=True
    )
    scored = ops.score(chain.fit(df), df)
    assert ops.classification_metrics(scored).first()["accuracy"] == 1.0


def test_assemble_narrows(spark):
    df = spark.createDataFrame([(1, 2, "x")], "a int, b int, c string")
    out = ops.assemble(df, ["a", "b"], keep=["c"])
    assert out.columns == ["features", "c"]
    same = df.select(array_to_vector(F.array(F.lit(1.0), F.lit(2.0))))
    assert out.first()["features"] == same.first()[0]


def test_a_tree_that_keeps_leaves_of_equal_prediction(spark):
    """Both sides of the one split predict 1, so Spark's classifier merges them; the split is wanted as well."""
    counted = spark.createDataFrame([(0.0, 0, 40), (0.0, 1, 60), (1.0, 0, 10), (1.0, 1, 90)], "x double, y int, rows long")
    data = ops.assemble(counted, ["x"], keep=["rows", "y"])
    merged = ops.fit_tree(data, max_depth=2, label="y", weight="rows")
    whole = ops.fit_tree(data, max_depth=2, label="y", weight="rows", merge=False)
    assert ops.tree_nodes(spark, merged, ["x"]).count() == 1
    found = ops.tree_nodes(spark, whole, ["x"]).orderBy("node_id").select("prediction", "rows", "class_rows", "threshold").collect()
    assert [tuple(r) for r in found] == [
        (1.0, 200.0, [50.0, 150.0], 0.5), (1.0, 100.0, [40.0, 60.0], None), (1.0, 100.0, [10.0, 90.0], None)
    ]
    top = ops.tree_nodes(spark, whole, ["x"]).filter("node_id = 0").first()
    assert abs(top["impurity"] - 0.375) < 1e-12 and abs(top["gain"] - (0.375 - (0.48 + 0.18) / 2)) < 1e-12
    assert ops.feature_importances(spark, whole, ["x"]).first()["importance"] == 1.0
