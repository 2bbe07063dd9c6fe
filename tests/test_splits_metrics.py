import pytest
from conftest import rows
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from tabular_insights import operators as ops
from tabular_insights.functions import key_bucket

# Metric name here -> metric name of Spark's evaluator.
EVALUATOR_METRICS = {
    "accuracy": "accuracy",
    "f1": "f1",
    "weighted_precision": "weightedPrecision",
    "weighted_recall": "weightedRecall",
}

CASE = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (0, 0), (1, 3)]


def test_split_ignores_partitioning_and_order(spark):
    df = spark.range(1000).withColumn("name", F.lit("x"))
    one = ops.hash_split(df, ["id", "name"], seed=3)
    two = ops.hash_split(df.orderBy(F.desc("id")).repartition(7), ["id", "name"], seed=3)
    assert rows(one) == rows(two)
    assert rows(one) != rows(ops.hash_split(df, ["id", "name"], seed=4))


def test_split_is_complete_and_near_its_weights(spark):
    df = ops.hash_split(spark.range(20000), ["id"])
    sizes = dict(rows(df.groupBy("split").count()))
    assert sum(sizes.values()) == 20000
    assert abs(sizes["train"] - 12000) < 400 and abs(sizes["test"] - 4000) < 300


def test_null_and_position_in_keys(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "p string, q string")
    assert df.select(key_bucket(["p", "q"], 1)).distinct().count() == 2


def test_folds(spark):
    df = ops.add_folds(ops.hash_split(spark.range(30000), ["id"]), ["id"], k=3)
    sizes = rows(df.filter("split = 'train'").groupBy("fold").count())
    assert [f for f, _ in sizes] == [0, 1, 2]
    assert all(abs(n - 6000) < 300 for _, n in sizes)


def test_random_split_is_disjoint_and_complete(spark):
    df = spark.range(1000).repartition(4)
    parts = ops.random_split(df, seed=17)
    ids = [r[0] for part in parts.values() for r in part.collect()]
    assert sorted(ids) == list(range(1000))
    assert list(parts) == ["train", "validation", "test"]


def test_known_metrics_and_evaluator(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in CASE], ["label", "prediction"])
    found = ops.classification_metrics(df).first()
    assert found["rows"] == 7
    assert found["f1"] == pytest.approx(0.6)
    assert found["accuracy"] == pytest.approx(4 / 7)
    assert found["weighted_precision"] == pytest.approx(0.642857, abs=1e-6)
    for name, spark_name in EVALUATOR_METRICS.items():
        evaluator = MulticlassClassificationEvaluator(metricName=spark_name)
        assert found[name] == pytest.approx(evaluator.evaluate(df), abs=1e-12)


def test_metrics_of_a_tally(spark):
    df = spark.createDataFrame(CASE * 3, ["label", "prediction"])
    counted = ops.tally(df, ["label", "prediction"])
    one = ops.classification_metrics(df).first()
    two = ops.classification_metrics(counted, weight="rows").first()
    assert tuple(one) == pytest.approx(tuple(two))


def test_metrics_by_group(spark):
    df = spark.createDataFrame([("a", *r) for r in CASE] + [("b", 1, 1)], ["g", "label", "prediction"])
    found = {r["g"]: r for r in ops.classification_metrics(df, by=["g"]).collect()}
    assert found["a"]["f1"] == pytest.approx(0.6)
    assert found["b"]["f1"] == 1.0 and found["b"]["rows"] == 1
