"""An incident table derived from the given order tables.

Used by the contract queries, the bench and the tests. The raw tables have no
nulls, no flags and no label worth learning; the expressions below bring in all
three. Both lookups are plain inner joins: Spark broadcasts ``part`` or
``supplier`` when its estimated size is under the session's threshold, and
otherwise sorts and merges with adaptive splitting of hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

INCIDENT_COLUMNS = [
    "ts", "block", "primary_type", "description", "location_description", "arrest",
    "domestic", "beat", "district", "ward", "community_area", "year",
]
KEY_COLUMNS = ["l_orderkey", "l_linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_size")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = item.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        supplier, F.col("l_suppkey") == F.col("s_suppkey")
    )
    line = F.col("l_linenumber")
    promoted = F.col("p_type").isin("PROMO", "ECONOMY")
    return joined.select(
        *KEY_COLUMNS,
        F.col("l_shipdate").alias("ts"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("block"),
        F.col("p_type").alias("primary_type"),
        F.col("p_name").alias("description"),
        F.when(F.col("p_size") != 50, F.concat(F.lit("LOC-"), F.col("p_size").cast("string"))).alias(
            "location_description"
        ),
        (promoted != (F.col("l_tax") >= 0.08)).alias("arrest"),
        (F.col("l_linestatus") == "F").alias("domestic"),
        F.col("l_suppkey").cast("int").alias("beat"),
        F.col("s_nationkey").alias("district"),
        F.pmod(F.col("l_suppkey"), F.lit(50)).cast("int").alias("ward"),
        F.when(line != 7, line).alias("community_area"),
        F.year("l_shipdate").alias("year"),
    )
