"""Writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..session import gather


def write_results(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    timestamp_format: str = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
) -> None:
    """Write ``df`` to the folder ``path``; every task writes its own part.

    With ``partition_by`` the rows are first gathered by folder.

    CSV parts carry a header. Arrays, which CSV cannot hold, are written as text
    such as ``[6, 12, 12, 10]``. Timestamps keep their microseconds unless another
    ``timestamp_format`` is given.
    """
    writer = df
    if fmt == "csv":
        for field in df.schema.fields:
            if isinstance(field.dataType, T.ArrayType):
                text = F.array_join(F.col(field.name).cast("array<string>"), ", ")
                writer = writer.withColumn(field.name, F.concat(F.lit("["), text, F.lit("]")))
    out = gather(writer, partition_by).write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        out = (
            out.option("header", True)
            .option("timestampFormat", timestamp_format)
            .option("timestampNTZFormat", timestamp_format)
        )
    out.format(fmt).save(path)
