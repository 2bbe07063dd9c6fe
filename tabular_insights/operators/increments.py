"""Profiles that grow by a source at a time: a new year reads only itself.

The state of a source is additive: the count of every value of every profiled column, and a
mergeable sketch of each column's distinct values. The state of all sources is the sum of
theirs, so value counts, distinct counts and the most frequent values of many years never
read an old year again. A source is a folder of the state, written whole or not at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .categories import top_k_values

#: Logarithm of the registers of a sketch; its relative error is ``1.04 / sqrt(2**12)``.
SKETCH_SIZE = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_SIZE / 2)
_STATE = "source string, column string, value string, rows long, sketch binary"


def source_state(df: DataFrame, columns: Sequence[str], sketched: Sequence[str] = ()) -> DataFrame:
    """``(column, value, rows, sketch)``: value counts of ``columns``, and for each of
    ``sketched`` one row with the sketch of its values instead of counts. The row without a
    column counts all rows.

    Texts stand for the values; null is a value of its own among the counts and none in a
    sketch. Counts and sketches are a pass each over their columns of ``df``.
    """
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns], F.lit("").alias("__all"))
    long = cells.unpivot([], ["__all", *columns], "column", "value")
    none = F.lit(None)
    named = F.when(F.col("column") != "__all", F.col("column")).alias("column")
    counted = long.groupBy(named, F.when(F.col("column") != "__all", F.col("value")).alias("value"))
    state = counted.agg(F.count(F.lit(1)).alias("rows"), F.max(none.cast("binary")).alias("sketch"))
    if not sketched:
        return state
    sketches = df.agg(*[F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_SIZE).alias(c) for c in sketched])
    sketches = sketches.unpivot([], list(sketched), "column", "sketch")
    return state.unionByName(
        sketches.select("column", none.cast("string").alias("value"), none.cast("long").alias("rows"), "sketch")
    )


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """``(source, rows)``: the manifest of a state, one row per source."""
    return _state(spark, folder).filter("column IS NULL").groupBy("source").agg(F.sum("rows").alias("rows"))


def _state(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_STATE).parquet(folder)


def add_source(
    df: DataFrame, folder: str, source: str, columns: Sequence[str], sketched: Sequence[str] = ()
) -> bool:
    """Add the state of ``df`` to ``folder`` as ``source``; False, without reading ``df``, where
    that source is there already."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/source={source}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return False
    source_state(df, columns, sketched).write.mode("overwrite").parquet(path)
    return True


def merged_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``(column, value, count)`` over all sources."""
    counts = _state(spark, folder).filter("column IS NOT NULL AND sketch IS NULL")
    return counts.groupBy("column", "value").agg(F.sum("rows").alias("count"))


def merged_distincts(spark: SparkSession, folder: str) -> DataFrame:
    """``(column, distinct, is_exact)``: numbers of distinct values, exact for counted columns,
    estimated for sketched ones; null is no value."""
    counted = merged_counts(spark, folder).groupBy("column").agg(F.count("value").alias("distinct"))
    sketches = _state(spark, folder).filter("sketch IS NOT NULL").groupBy("column")
    estimated = sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
    return counted.withColumn("is_exact", F.lit(True)).unionByName(estimated.withColumn("is_exact", F.lit(False)))


def merged_top_k(spark: SparkSession, folder: str, column: str, k: int = 32) -> DataFrame:
    """The ``k`` most frequent values of a counted column, as :func:`top_k_values` ranks them."""
    counts = merged_counts(spark, folder).filter(F.col("column") == column)
    return top_k_values(counts.select(F.col("value").alias(column), "count"), column, k, weight="count")
