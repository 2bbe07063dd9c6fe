"""Faults that were mended: what used to give a wrong result without a word."""

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import types as T

from tabular_insights import operators as ops
from tabular_insights.functions import all_present
from tabular_insights.sources import read_incidents, write_results


def test_not_a_number_is_missing_everywhere(spark):
    df = spark.createDataFrame([(1.0, "NaN"), (float("nan"), "a"), (None, "b")], "x double, s string")
    counted = ops.row_counts(df, {"present": all_present(["x", "s"], df.schema)}).first()["rows"]
    assert counted == ops.drop_null_rows(df).count() == 1


def test_a_class_is_whole(spark):
    df = spark.createDataFrame([(0.5, 0.0)], "label double, prediction double")
    with pytest.raises(Exception, match="not a class"):
        ops.confusion_matrix(df).collect()
    df = spark.createDataFrame([(None, 0.0)], "label double, prediction double")
    with pytest.raises(Exception, match="not a class"):
        ops.confusion_matrix(df).collect()
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 0.0)], "label double, prediction double")
    assert rows(ops.confusion_matrix(df)) == [(1, 0, 2)]


def test_fractions_of_a_second_survive(spark, tmp_path):
    at = datetime(2020, 1, 2, 13, 4, 5, 123456)
    df = spark.createDataFrame([(at,)], "t timestamp_ntz")
    write_results(df, f"{tmp_path}/t")
    back = spark.read.schema("t timestamp_ntz").option("header", True).csv(f"{tmp_path}/t")
    assert back.first()["t"] == at


def test_a_bad_cell_is_null(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text("Date,Beat\n01/02/2020 01:00:00 PM,12\n01/02/2020 01:00:00 PM,twelve\n")
    fields = {"Date": ("ts", T.TimestampNTZType()), "Beat": ("beat", T.IntegerType())}
    assert [r["beat"] for r in read_incidents(spark, str(file), fields).collect()] == [12, None]
    with pytest.raises(Exception):
        read_incidents(spark, str(file), fields, mode="FAILFAST").collect()
