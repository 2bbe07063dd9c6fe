"""A multilayer perceptron as a table of weights, and its forward pass as column expressions.

The table can be written, compared, joined and queried like any other; the forward pass runs
in the engine's generated code, without the model object.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ``from_unit`` of a constant term.
CONSTANT = -1


def layer_weights(spark: SparkSession, model: MultilayerPerceptronClassificationModel) -> DataFrame:
    """``(layer, from_unit, to_unit, weight)`` of a fitted perceptron, units numbered from 0 in
    each layer; a row with ``from_unit`` -1 is the constant term of its unit."""
    sizes, flat = model.getLayers(), model.weights.toArray()
    rows, at = [], 0
    for layer, (n_in, n_out) in enumerate(zip(sizes, sizes[1:]), 1):
        block = flat[at : at + n_in * n_out].reshape(n_in, n_out)  # by input unit
        rows += [(layer, i, j, float(block[i, j])) for i in range(n_in) for j in range(n_out)]
        at += n_in * n_out
        rows += [(layer, CONSTANT, j, float(w)) for j, w in enumerate(flat[at : at + n_out])]
        at += n_out
    return spark.createDataFrame(rows, "layer int, from_unit int, to_unit int, weight double")


def forward(df: DataFrame, weights: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """``df`` with ``probability`` (an array) and ``prediction`` (the first most likely class).

    ``inputs`` are the columns of the input units; a null among them gives a null probability
    and prediction. The weights, as many as the network has, come to the driver; every unit
    is one column, computed once, of a projection for its layer. Layers but the last are
    logistic, the last one is normalised over its units.
    """
    by_layer: dict[int, dict[int, dict[int, float]]] = {}
    for row in weights.collect():
        unit = by_layer.setdefault(row["layer"], {}).setdefault(row["to_unit"], {})
        if unit.setdefault(row["from_unit"], row["weight"]) != row["weight"]:
            raise ValueError(f"two weights for {row['layer'], row['from_unit'], row['to_unit']}")
    if sorted(by_layer) != list(range(1, len(by_layer) + 1)):
        raise ValueError(f"layers must count from 1, found {sorted(by_layer)}")
    outside = {i for unit in by_layer[1].values() for i in unit} - set(range(CONSTANT, len(inputs)))
    if outside:
        raise ValueError(f"{len(inputs)} inputs, but weights of units {sorted(outside)}")
    names, before = list(df.columns), [F.col(c).cast("double") for c in inputs]
    for layer, units in sorted(by_layer.items()):
        last = layer == len(by_layer)
        columns = []
        for j in range(max(units) + 1):
            total = _weighted(units.get(j, {}), before)
            columns.append((total if last else 1 / (1 + F.exp(-total))).alias(f"__unit_{layer}_{j}"))
        df = df.select(*names, *columns)
        before = [F.col(f"__unit_{layer}_{j}") for j in range(len(columns))]
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in before])
    highest = F.greatest(*before) if len(before) > 1 else before[0]
    powers = [F.exp(c - highest) for c in before]
    total = reduce(lambda a, b: a + b, powers)
    first = F.array_position(F.array(*before), highest) - 1
    return df.select(
        *names,
        F.when(known, F.array(*[p / total for p in powers])).alias("probability"),
        F.when(known, first.cast("double")).alias("prediction"),
    )


def _weighted(weights: dict[int, float], inputs: Sequence[Column]) -> Column:
    total = F.lit(weights.get(CONSTANT, 0.0))
    for i, value in enumerate(inputs):
        total = total + F.lit(weights.get(i, 0.0)) * value
    return total
