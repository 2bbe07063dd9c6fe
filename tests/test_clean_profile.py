import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabular_insights import operators as ops
from tabular_insights.functions import all_present


def test_null_outside_the_model_drops_the_row(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (None, "b", 2.0), (3, "", float("nan")), (4, "", 4.0)],
        "beat int, kind string, x double",
    )
    assert rows(ops.project(ops.drop_null_rows(df), ["kind"])) == [("",), ("a",)]
    assert ops.drop_null_rows(df, ["kind"]).count() == 4


def test_flags(spark):
    df = spark.createDataFrame(
        [("true", True), ("TRUE", False), ("false", None), (None, True)], "s string, b boolean"
    )
    flags = ops.flag_to_int(df, ["s", "b"])
    assert [tuple(r) for r in flags.collect()] == [(1, 1), (0, 0), (0, 0), (0, 1)]
    assert dict(flags.dtypes) == {"s": "int", "b": "int"}


def test_project_renames(spark):
    df = ops.project(spark.range(1), ["id", "id"], {"id": "key"})
    assert df.columns == ["key", "key"]


def test_row_counts_in_one_scan(spark):
    df = spark.range(10).withColumn("x", F.when(F.col("id") > 3, F.col("id")))
    counts = ops.row_counts(df, {"all": None, "present": all_present(["x"])})
    assert counts._jdf.queryExecution().executedPlan().toString().count("Range (0, 10") == 1
    assert rows(counts) == [("all", 10), ("present", 6)]


def test_value_counts_order_and_ties(spark):
    df = spark.createDataFrame([(v,) for v in "bacca"] + [(None,)], "v string")
    found = [tuple(r) for r in ops.value_counts(df, "v").collect()]
    assert found == [("a", 2), ("c", 2), ("b", 1), (None, 1)]


def test_weighted_counts_match_plain_counts(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"))
    counted = ops.tally(df, ["a", "b"])
    assert counted.count() == 21
    assert rows(ops.value_counts(counted, "a", "rows")) == rows(ops.value_counts(df, "a"))


def test_distinct_counts(spark):
    df = spark.range(1000).select(
        F.col("id").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("b")
    )
    assert rows(ops.distinct_counts(df, ["a", "b"])) == [("a", 1000), ("b", 4)]
    near = dict(rows(ops.distinct_counts(df, ["a", "b"], approx=True)))
    assert near["b"] == 4 and abs(near["a"] - 1000) < 150


def test_preview(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (2,)], "x int").repartition(3)
    assert [r[0] for r in ops.preview(df, 4, ["x"]).collect()] == [1, 2, 3, None]
    plan = ops.preview(df, 2, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert ops.preview(df, 2).count() == 2


@pytest.mark.parametrize("parts", [1, 7, 100])
def test_spread_tally_keeps_totals(spark, parts):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1000), ("d", 333)], "k string, rows long")
    spread = ops.spread_tally(df, parts=parts)
    assert rows(spread.groupBy("k").agg(F.sum("rows"))) == rows(df)
    assert spread.schema["rows"].dataType.simpleString() == "bigint"
    assert spread.count() <= df.count() + parts
    assert spread.agg(F.max("rows"), F.min("rows")).first()[0] <= -(-1336 // parts)
    assert spread.agg(F.min("rows")).first()[0] >= 1
