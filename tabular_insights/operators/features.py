"""Feature vectors, standardisation and estimator chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


def assemble(
    df: DataFrame, cols: Sequence[str], out: str = "features", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add a vector of ``cols``; with ``keep``, narrow to those columns and the vector.

    A null in any input is an error.
    """
    vectors = VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)
    return vectors if keep is None else vectors.select(out, *keep)


def standardize(
    df: DataFrame,
    input_col: str = "features",
    out: str = "scaled_features",
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Add ``(x - mean) / sample standard deviation``; a constant feature becomes 0.

    Mean and deviation come from one pass over ``fit_on``, all of ``df`` by default.
    """
    scaler = StandardScaler(inputCol=input_col, outputCol=out, withMean=True, withStd=True)
    return scaler.fit(df if fit_on is None else fit_on).transform(df)


def build_pipeline(
    estimator: Estimator,
    feature_cols: Sequence[str],
    before: Sequence[Estimator | Transformer] = (),
    scaled: bool = False,
) -> Pipeline:
    """``before`` (such as a category model), assembly, optional scaling, ``estimator``.

    The estimator reads ``features``, or ``scaled_features`` when ``scaled``.
    """
    stages = [*before, VectorAssembler(inputCols=list(feature_cols), outputCol="features")]
    if scaled:
        stages.append(
            StandardScaler(
                inputCol="features", outputCol="scaled_features", withMean=True, withStd=True
            )
        )
    return Pipeline(stages=[*stages, estimator])


def vector_columns(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """Replace a vector column by one double column per element."""
    values = vector_to_array(F.col(vector))
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, *[values[i].alias(name) for i, name in enumerate(names)])
