"""Projection, null dropping and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import all_present, flag_expr


def project(df: DataFrame, cols: Sequence[str], rename: dict[str, str] | None = None) -> DataFrame:
    """The named columns, in this order, under new names where ``rename`` gives one."""
    rename = rename or {}
    return df.select(*[F.col(c).alias(rename.get(c, c)) for c in cols])


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with no null (and no NaN) in ``cols``, all columns by default.

    Columns that later steps do not use still count: drop before narrowing.
    """
    return df.filter(all_present(list(cols) if cols else df.columns, df.schema))


def flag_to_int(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace boolean or ``"true"``/``"false"`` columns by 1 and 0."""
    return df.withColumns({c: flag_expr(c, df.schema[c].dataType) for c in cols})
