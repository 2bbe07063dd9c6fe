"""Where intermediate tables go, and how a frame is written there and read back.

Intermediates that several jobs share are parquet tables in the shared folder of
the cluster rather than local checkpoints: they survive the loss of any executor
and keep column and partition pruning for every later reader.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

SALTS = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or the one set on the context.

    Only a ``local`` session with neither setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tabular-insights-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for run in _OPEN_RUNS:
        run.paths.append(path)
    return path


class StagedRun:
    """Tables staged while this is open, by any thread; ``close`` deletes them.

    Used as a context manager around work whose results have been written or collected::

        with StagedRun(spark):
            write_results(tree_flow(df, spec).results, path)

    A frame that reads a table of a closed run fails. Without a run nothing is deleted.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []
        _OPEN_RUNS.append(self)

    def __enter__(self) -> StagedRun:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def close(self) -> None:
        """Delete what was staged; closing again does nothing."""
        if self in _OPEN_RUNS:
            _OPEN_RUNS.remove(self)
        while self.paths:
            remove(self.spark, self.paths.pop())


_OPEN_RUNS: list[StagedRun] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever the cluster keeps it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def gather(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bring rows of equal ``columns`` together before they are written to folders.

    Keeps a scan of very many tasks from writing one small file per task and folder.
    Adaptive execution cuts a large folder into tasks of the session's advisory size;
    without it the rows of a folder are dealt to ``SALTS`` tasks.
    """
    spark = df.sparkSession
    if not columns:
        return df
    if spark.conf.get("spark.sql.adaptive.enabled") != "true":
        return df.repartition(*columns, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    names = ", ".join(f"`{c}`" for c in columns)
    return spark.sql(f"SELECT /*+ REBALANCE({names}) */ * FROM {{df}}", df=df)


def stage(
    df: DataFrame, name: str, partition_by: Sequence[str] = (), rebalance: bool = False
) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and return a frame that reads it.

    With ``partition_by``, later filters on those columns skip whole folders. A frame
    that still has the partitions of a large scan should be rebalanced.
    """
    path = new_path(df.sparkSession, name)
    out = gather(df, partition_by) if rebalance else df
    out.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
