"""Profiles by increments, perceptrons as tables, rejected cells, and staged runs."""

from pathlib import Path

import pytest
from conftest import SF_DIR, rows
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabular_insights import operators as ops
from tabular_insights.session import StagedRun, new_path, stage
from tabular_insights.sources import read_incidents, rejected_cells


def frame(spark, *values):
    return spark.createDataFrame([(v, v) for v in values], "a string, b string")


def test_a_source_is_read_once(spark):
    folder = new_path(spark, "state")
    assert ops.add_source(frame(spark, "x", "x", None), folder, "2001", ["a"], ["b"])
    assert ops.add_source(frame(spark, "x", "y"), folder, "2002", ["a"], ["b"])
    unreadable = frame(spark, "z").withColumn("a", F.raise_error(F.lit("read again")))
    assert not ops.add_source(unreadable, folder, "2001", ["a"], ["b"])
    assert rows(ops.sources(spark, folder)) == [("2001", 3), ("2002", 2)]
    assert rows(ops.merged_counts(spark, folder)) == [("a", "x", 3), ("a", "y", 1), ("a", None, 1)]
    assert rows(ops.merged_distincts(spark, folder)) == [("a", 2, True), ("b", 2, False)]
    assert rows(ops.merged_top_k(spark, folder, "a", 1)) == [("a", "x", 3, 1)]


def test_a_source_that_failed_is_written_anew(spark):
    folder = new_path(spark, "state")
    broken = frame(spark, "z").withColumn("a", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        ops.add_source(broken, folder, "2001", ["a"])
    assert ops.add_source(frame(spark, "z"), folder, "2001", ["a"])
    assert rows(ops.merged_counts(spark, folder)) == [("a", "z", 1)]


def test_empty_and_null_sources(spark):
    folder = new_path(spark, "state")
    empty = frame(spark, "x").limit(0)
    assert ops.add_source(empty, folder, "none", ["a"], ["b"])
    assert ops.add_source(frame(spark, None), folder, "null", ["a"], ["b"])
    assert rows(ops.merged_distincts(spark, folder)) == [("a", 0, True), ("b", 0, False)]
    assert rows(ops.sources(spark, folder)) == [("null", 1)]


@pytest.mark.parametrize("layers", [[2, 3], [2, 5, 2], [2, 4, 6, 3]])
def test_forward_pass_equals_the_model(spark, layers):
    points = [(float(x), float(y), (x * y) % layers[-1]) for x in range(6) for y in range(5)]
    df = spark.createDataFrame(points, "x double, y double, label int")
    df = df.withColumn("features", array_to_vector(F.array("x", "y")))
    model = ops.fit_mlp(df, layers, max_iter=20, features="features", num_classes=layers[-1])
    weights = stage(ops.layer_weights(spark, model), "weights")
    sizes = list(zip(layers, layers[1:]))
    assert weights.count() == sum((n + 1) * m for n, m in sizes)
    ours = ops.forward(df, weights, ["x", "y"]).select("x", "y", "probability", "prediction")
    theirs = {(r.x, r.y): r for r in model.transform(df).withColumn("p", vector_to_array("probability")).collect()}
    for r in ours.collect():
        assert r.probability == pytest.approx(theirs[r.x, r.y].p, abs=1e-9)
        assert r.prediction == theirs[r.x, r.y].prediction


def test_forward_pass_of_nulls_and_bad_tables(spark):
    kind = "layer int, from_unit int, to_unit int, weight double"
    one = spark.createDataFrame([(1, 0, 0, 1.0), (1, -1, 1, 0.5)], kind)
    df = spark.createDataFrame([(None,), (900.0,)], "x double")
    found = rows(ops.forward(df, one, ["x"]))
    assert found == [(900.0, [1.0, pytest.approx(0.0)], 0.0), (None, None, None)]
    with pytest.raises(ValueError, match="count from 1"):
        ops.forward(df, spark.createDataFrame([(2, 0, 0, 1.0)], kind), ["x"])
    with pytest.raises(ValueError, match="units"):
        ops.forward(df, spark.createDataFrame([(1, 4, 0, 1.0)], kind), ["x"])
    with pytest.raises(ValueError, match="two weights"):
        ops.forward(df, spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 0, 2.0)], kind), ["x"])


def test_rejected_cells_are_those_the_scan_nulls(spark, tmp_path):
    head = "Extra,Date,Block,Primary Type,Description,Location Description,Arrest,Domestic,Beat,District,Ward,Community Area,Year"
    lines = [
        "1,01/02/2020 03:04:05 PM,A,T,D,L,true,false,1,2,3,4,2020",
        '2,2020-01-02,A,T,D,L,maybe,FALSE,1,2.5," 3",,2020',
        '3,13/40/2020 99:00:00 PM,"A,""B""",T,D,L,,false,99999999999,x,"3,4",4,',
    ]
    file = tmp_path / "a.csv"
    file.write_text("\n".join([head, *lines]) + "\n")
    read = read_incidents(spark, str(file)).collect()
    bad = rejected_cells(spark, str(file))
    assert {r["file"].rsplit("/", 1)[1] for r in bad.collect()} == {"a.csv"}
    found = {(r["column"], r["text"]) for r in bad.collect()}
    assert {("ts", "2020-01-02"), ("arrest", "maybe"), ("district", "2.5"), ("beat", "99999999999"), ("ward", "3,4")} <= found
    nulls = {c for row in read for c in row.asDict() if row[c] is None}
    assert {c for c, _ in found} <= nulls
    empty = 1 + 1 + 1  # community area, arrest, year: null, yet not rejected
    assert sum(row[c] is None for row in read for c in row.asDict()) == len(found) + empty


def test_a_closed_run_leaves_nothing(spark):
    outside = stage(frame(spark, "x"), "outside")
    with StagedRun(spark) as run:
        kept = [stage(frame(spark, "x"), "inside") for _ in range(2)]
        assert rows(kept[0]) == [("x", "x")]
        with StagedRun(spark) as inner:
            stage(frame(spark, "y"), "inner")
            assert len(inner.paths) == 1 and len(run.paths) == 3
        folders = [Path(p) for p in run.paths]
        assert [f.exists() for f in folders] == [True, True, False]
    assert not any(f.exists() for f in folders) and run.paths == []
    run.close()
    assert rows(outside) == [("x", "x")]
    with pytest.raises(ZeroDivisionError), StagedRun(spark) as run:
        folder = Path(new_path(spark, "broken"))
        folder.mkdir()
        1 / 0
    assert not folder.exists()
