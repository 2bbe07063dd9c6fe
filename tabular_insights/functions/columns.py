"""Column expressions shared by the operators. All of them stay inside Spark SQL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

BUCKETS = 1 << 32


def all_present(cols: Sequence[str], schema: T.StructType | None = None) -> Column:
    """True where none of the columns is null, nor NaN where ``schema`` has a float.

    With the schema it is the test by which rows with missing values are dropped.
    """

    def present(name: str) -> Column:
        kind = schema[name].dataType if schema is not None else None
        floating = isinstance(kind, (T.FloatType, T.DoubleType))
        return F.col(name).isNotNull() & ~F.isnan(name) if floating else F.col(name).isNotNull()

    return reduce(lambda a, b: a & b, map(present, cols))


def flag_expr(name: str, dtype: T.DataType) -> Column:
    """1 for true, 0 for anything else, null included.

    A string flag counts as true only when it reads exactly ``true``.
    """
    value = F.col(name)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(value.cast("int"), F.lit(0))
    return F.when(value == "true", 1).otherwise(0)


def key_bucket(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 2^32) that depends on the key values and the seed only.

    Row order, partitioning and engine do not matter. Keys should be integers or
    strings: other types print differently from engine to engine.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
