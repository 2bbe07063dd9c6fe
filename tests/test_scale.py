"""Plans and skew: what has to hold when the tables are very large."""

import subprocess
import sys

import pytest
from conftest import ROOT, SF_DIR, rows
from pyspark.sql import functions as F

from tabular_insights import contract, operators as ops, session
from tabular_insights.sources.adapter import incidents


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = sorted(
    set(contract.QUERIES)
    - {n for n in contract.QUERIES if n.startswith(("tree_", "mlp_", "forest_", "stump_"))}
)


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python_rows(spark, name):
    text = plan(contract.QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython"):
        assert word not in text


def test_scans_are_pruned(spark):
    text = plan(contract.value_counts_primary_type(spark, SF_DIR))
    assert "l_extendedprice" not in text and "p_retailprice" not in text
    text = plan(contract.value_counts_events(spark, SF_DIR))
    assert "ReadSchema: struct<event_type:string>" in text


def test_literal_dictionaries_reach_the_scan(spark):
    df = ops.keep_top_k(incidents(spark, SF_DIR), ["description"], 3, how="literal")
    text = plan(df)
    assert "PushedFilters: [In(p_name, [" in text


def test_counts_are_combined_before_the_shuffle(spark):
    text = plan(ops.value_counts(incidents(spark, SF_DIR), "primary_type"))
    assert text.index("partial_count") > text.index("Exchange hashpartitioning")


def test_hot_key_of_the_lookup_join_is_split(spark, conf, tmp_path):
    """One part holds a third of all rows and no side fits a broadcast."""
    folder = str(tmp_path)
    for name in ("part", "supplier"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    item = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    copies = item.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("copy")
    hot = F.pmod(F.xxhash64("l_orderkey", "l_extendedprice"), F.lit(3)) == 0
    skewed = copies.withColumn("l_partkey", F.when(hot, F.lit(7)).otherwise(F.col("l_partkey")))
    skewed.repartition(8).write.parquet(f"{folder}/lineitem.parquet")
    expected = rows(ops.value_counts(incidents(spark, folder), "primary_type"))

    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="40KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
    )
    counts = ops.value_counts(incidents(spark, folder), "primary_type")
    assert rows(counts) == expected
    text = plan(counts)
    assert "SortMergeJoin(skew=true)" in text and "BroadcastHashJoin" not in text


def test_large_folder_is_staged_as_many_files(spark, conf):
    """A split with most rows is written by many tasks, a small one by few."""
    conf(spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB")
    df = spark.range(0, 200_000, 1, 40).withColumn("noise", F.xxhash64("id"))
    df = df.withColumn("split", F.when(F.col("id") % 10 < 9, "train").otherwise("test"))
    staged = session.stage(df, "t", ["split"], rebalance=True)
    files = [f.split("split=")[1].split("/")[0] for f in staged.inputFiles()]
    assert files.count("train") > 8 and files.count("test") < 40
    assert rows(staged) == rows(df)
    assert staged.columns == df.columns


def test_staging_without_adaptive_execution_keeps_partitions(spark, conf):
    conf(spark__sql__adaptive__enabled="false")
    df = spark.range(0, 1000, 1, 4).withColumn("split", F.lit("train"))
    assert len(session.stage(df, "t", ["split"], rebalance=True).inputFiles()) == 4


def test_staged_splits_are_pruned(spark):
    df = spark.range(100).withColumn("split", F.when(F.col("id") > 5, "a").otherwise("b"))
    staged = session.stage(df, "t", ["split"])
    text = plan(staged.filter("split = 'b'"))
    assert "PartitionFilters: [isnotnull(split" in text
    assert rows(staged.filter("split = 'b'").select("id")) == [(i,) for i in range(6)]


def test_shared_folder_comes_from_the_session(tmp_path):
    """The setting is fixed when a session starts, so this takes a session of its own."""
    code = f"""
from pyspark.sql import SparkSession
from tabular_insights import operators as ops, session
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "file:{tmp_path}/shared").getOrCreate())
df = session.stage(spark.range(3).selectExpr("cast(id as string) v"), "t")
assert all("{tmp_path}/shared/t-" in f for f in df.inputFiles())
assert ops.ranked_labels(df, "v").count() == 3
assert spark.sparkContext.getCheckpointDir().startswith("file:{tmp_path}/shared/")
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=120)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(spark)


def test_hot_combination_counts_once_per_task(spark):
    df = spark.range(0, 100_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 1000)).alias("v")
    )
    top = ops.top_k_values(df, "v", 1).first()
    assert (top["value"], top["count"]) == ("hot", 33334)
