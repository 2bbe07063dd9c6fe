"""What several of the text operators share: reading, sizing, words and graph components."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabular_insights.session import stage

ROOT = str(Path(__file__).resolve().parents[2])
WORD = r"[^\x20\x09-\x0D]+"


def find_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did.

    On a cluster the package is installed or shipped with ``--py-files``; a path that a
    worker does not have is ignored there.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_parts(df: DataFrame, text: str, part_bytes: int) -> int:
    """Parts into which the texts are dealt: as many as the session's shuffles have, and
    more where a part would hold over ``part_bytes`` bytes of text."""
    total = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that a task holds the results of few texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def components(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Connected components of undirected ``edges``: rows ``(node, component)``.

    Alternates the large-star and small-star steps until no edge changes, so that every
    node hangs on the smallest node of its component. Each step is a grouping with a
    minimum and one join; a hub with very many edges is only ever a key of the partial
    minimum and of a join that adaptive execution splits. Every round is written to the
    shared folder, which cuts the lineage.
    """
    pairs = edges.select(F.col(source).alias("u"), F.col(target).alias("v")).filter("u <> v").distinct()
    pairs = stage(pairs, "edges")
    before = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = stage(small.filter("u <> v").distinct(), "edges")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def any_of(conditions):
    return reduce(lambda a, b: a | b, conditions)
