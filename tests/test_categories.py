import pytest
from conftest import rows
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from tabular_insights import operators as ops


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_ties_at_the_cut_go_by_value(spark):
    df = frame(spark, *"ddccbbbaa").repartition(4)
    found = ops.top_k_values(df, "v", 3).orderBy("rank")
    assert [tuple(r)[1:] for r in found.collect()] == [("b", 3, 1), ("a", 2, 2), ("c", 2, 3)]


def test_columns_are_counted_independently(spark):
    df = spark.createDataFrame(
        [("a", "x"), ("a", "y"), ("b", "z"), ("b", "z"), ("b", "z")], "p string, q string"
    )
    assert ops.top_k_lists(df, ["p", "q"], 1) == {"p": ["b"], "q": ["z"]}
    assert ops.keep_top_k(df, ["p", "q"], 1).count() == 3


@pytest.mark.parametrize("k", [1, 3, 50])
def test_literals_and_join_agree(spark, k):
    df = spark.range(2000).select(
        F.concat(F.lit("p"), (F.pow("id", 2) % 37).cast("int")).alias("p"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("q"), F.col("id") % 11)).alias("q"),
    )
    one = ops.keep_top_k(df, ["p", "q"], k, how="literal")
    two = ops.keep_top_k(df, ["p", "q"], k, how="join")
    assert rows(one) == rows(two) and one.columns == two.columns
    one = ops.bucket_other(df, "q", k, how="literal")
    two = ops.bucket_other(df, "q", k, how="join")
    assert rows(one) == rows(two) and one.count() == 2000


def test_null_takes_a_place_but_never_passes(spark):
    df = frame(spark, None, None, None, "a", "a", "b")
    assert rows(ops.keep_top_k(df, ["v"], 2)) == [("a",), ("a",)]
    assert rows(ops.keep_top_k(df, ["v"], 2, how="join")) == [("a",), ("a",)]
    other = ops.bucket_other(df, "v", 2)
    assert rows(ops.value_counts(other, "v")) == [("Other", 4), ("a", 2)]


def test_number_columns(spark):
    df = spark.createDataFrame([(5,), (5,), (7,)], "n int")
    assert rows(ops.keep_top_k(df, ["n"], 1)) == [(5,), (5,)]
    assert rows(ops.bucket_other(df, "n", 1)) == [("5",), ("5",), ("Other",)]


def test_literal_other_among_the_top(spark):
    """A real value called Other lets bucketed rows pass a later filter on the first list."""
    df = frame(spark, "Other", "Other", "a", "a", "b", "c")
    first = ops.top_k_lists(df, ["v"], 2)
    bucketed = ops.bucket_other(df, "v", 2)
    assert bucketed.filter(ops.in_lists(bucketed, first)).count() == 6
    df = frame(spark, "x", "x", "a", "a", "b", "c")
    first = ops.top_k_lists(df, ["v"], 2)
    bucketed = ops.bucket_other(df, "v", 2)
    assert bucketed.filter(ops.in_lists(bucketed, first)).count() == 4


def test_any_k_without_a_job(spark):
    """Building the operators starts no job, whatever ``k`` is."""
    df = frame(spark, *[f"v{i % 700}" for i in range(2000)])
    tracker, group = spark.sparkContext.statusTracker(), "any-k"
    spark.sparkContext.setJobGroup(group, group)
    built = [
        made
        for k in (32, 5000)
        for made in (ops.keep_top_k(df, ["v"], k), ops.bucket_other(df, "v", k), ops.top_k_values(df, "v", k))
    ]
    assert list(tracker.getJobIdsForGroup(group)) == []
    assert [b.count() for b in built] == [96, 2000, 32, 2000, 2000, 700]
    assert len(ops.top_k_lists(df, ["v"], 5000)["v"]) == 700


def test_many_labels_go_by_join(spark):
    df = frame(spark, *[f"v{i}" for i in range(30)], "v7")
    many = ops.index_categories(df, ["v"], max_labels=10)
    assert rows(many) == rows(ops.index_categories(df, ["v"], how="model"))
    with pytest.raises(ValueError, match="more than 10"):
        ops.index_categories(df, ["v"], how="model", max_labels=10)


def test_index_order_and_ties(spark):
    df = frame(spark, "b", "a", "c", "c", "d").repartition(3)
    model = ops.category_indexer(df, ["v"])
    assert list(model.stages[0].labels) == ["c", "a", "b", "d"]
    assert list(model.stages[0].labels) == StringIndexer(inputCol="v", outputCol="o").fit(df).labels


def test_columns_of_different_width(spark):
    """Each column keeps its own labels; none is padded to the widest."""
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "p string, q string")
    out = ops.index_categories(df, ["p", "q"])
    attrs = [out.schema[c].metadata["ml_attr"]["vals"] for c in ("p_index", "q_index")]
    assert attrs == [["a", "b"], ["x", "y", "z"]]


@pytest.mark.parametrize("how", ["model", "join"])
def test_unseen_values(spark, how):
    seen, df = frame(spark, "a", "a", "b"), frame(spark, "a", "z", None)

    def run(handle):
        out = ops.index_categories(df, ["v"], handle_invalid=handle, fit_on=seen, how=how)
        return sorted(((r[0], r[1]) for r in out.collect()), key=repr)

    with pytest.raises((PySparkException, Py4JJavaError), match="v|NULL"):
        run("error")
    assert run("skip") == [("a", 0.0)]
    assert run("keep") == [("a", 0.0), ("z", 2.0), (None, 2.0)]


def test_too_many_labels_are_refused_before_collecting(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("v"), F.lit("one").alias("w"))
    with pytest.raises(ValueError, match="join"):
        ops.category_labels(df, ["v", "w"], max_labels=400)
    assert len(ops.category_labels(df, ["v", "w"], max_labels=500)["v"]) == 500


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_distributed_ranks_equal_a_global_row_number(spark, conf, coalesce):
    conf(spark__sql__adaptive__coalescePartitions__enabled=coalesce)
    df = spark.range(20000).select(F.md5((F.col("id") % 3001).cast("string")).alias("v"))
    df = df.repartition(16)
    ranked = dict(rows(ops.ranked_labels(df, "v")))
    counts = rows(df.groupBy("v").count())
    expected = [v for v, _ in sorted(counts, key=lambda r: (-r[1], r[0]))]
    assert ranked == {v: float(i) for i, v in enumerate(expected)}


def test_join_index_equals_model_index(spark):
    df = spark.range(5000).select((F.pow("id", 2) % 97).cast("int").cast("string").alias("v"))
    one = ops.index_categories(df, ["v"])
    two = ops.index_categories(df, ["v"], how="join")
    assert rows(one) == rows(two)


def test_weighted_labels(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("a", 2)], "v string, rows long")
    assert ops.category_labels(df, ["v"], weight="rows") == {"v": ["b", "a"]}
    assert ops.top_k_lists(df, ["v"], 1, weight="rows") == {"v": ["b"]}
    assert rows(ops.keep_top_k(df, ["v"], 1, weight="rows", how="join")) == [("b", 5)]


def test_large_k_without_a_single_task(spark, conf):
    """The same ranks from a sort across the cluster as from one task."""
    conf(spark__sql__adaptive__coalescePartitions__enabled="false")
    df = spark.range(9000).select((F.pow("id", 2) % 2503).cast("int").cast("string").alias("v"))
    df = df.union(spark.range(300).select(F.lit(None).cast("string"))).repartition(8)
    counts = rows(df.groupBy("v").count())
    ordered = sorted(counts, key=lambda r: (-r[1], r[0] is None, r[0] or ""))
    found = ops.top_k_values(df, "v", 1100, spread=True)
    assert found.schema == ops.top_k_values(df, "v", 10).schema
    assert rows(found) == rows(ops.top_k_values(df, "v", 1100))
    got = [tuple(r)[1:] for r in found.orderBy("rank").collect()]
    assert got == [(v, n, i) for i, (v, n) in enumerate(ordered[:1100], 1)]
    top = {v for v, _ in ordered[:1100]} - {None}
    kept = ops.keep_top_k(df, ["v"], 1100)
    assert kept.count() == sum(n for v, n in counts if v in top)
    other = ops.bucket_other(df, "v", 1100)
    assert other.count() == 9300
    assert other.filter("v = 'Other'").count() == sum(n for v, n in counts if v not in top)


@pytest.mark.parametrize("invalid, size", [("error", 60), ("skip", 60), ("keep", 61)])
def test_marks_do_not_hang_on_the_number_of_labels(spark, invalid, size):
    """Above and below ``max_labels``: the same numbers, marks, error of a tree, and tree."""
    df = spark.range(600).select((F.col("id") % 60).cast("string").alias("c"), (F.col("id") % 60 % 7 == 1).cast("int").alias("label"))
    found = [ops.index_categories(df, ["c"], handle_invalid=invalid, max_labels=m) for m in (100, 59)]
    assert rows(found[0]) == rows(found[1])
    trees = []
    for indexed in found:
        data = ops.assemble(indexed, ["c_index"], keep=["label"])
        assert ops.largest_category(data) == size
        with pytest.raises(ValueError, match=f"{size} categories, more than max_bins=32"):
            ops.fit_tree(data)
        trees.append(ops.fit_tree(data, max_bins=64))
    assert trees[0].toDebugString.split("\n")[1:] == trees[1].toDebugString.split("\n")[1:]
    assert trees[0].depth == 1
