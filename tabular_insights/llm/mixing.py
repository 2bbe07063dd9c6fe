"""Mixing of sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until their marginals meet
the targets, then documents are drawn with one probability per cell, calibrated so that
the expected number of drawn tokens is the wanted share of all tokens.

Everything is DataFrame functions. The documents are read for the cells (partial sums per
task) and once for the draw; raking works on the table of cells only. Every value of a
dimension has its own target and its own cells, however many there are: Spark chooses the
kind of the joins with targets and documents. Only the table of cells that is returned for
a report pools the values beyond the ``MAX_VALUES`` heaviest.

Defined cases: a null source, language or topic is the value ``(none)``; a null or empty
text has no tokens, weighs nothing and is drawn with its cell; a target value that no
document has is dropped and the others scaled up; values without a target share what the
targets leave, and where they leave nothing the values without a target keep their share
of the tokens and the targets are scaled to the others; a cell without
tokens has probability 0 unless everything is wanted; repeated rows are drawn together; a
null id is drawn as one id; an empty table gives an empty table; columns named as an added
one are replaced.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabular_insights.llm.common import WORD
from tabular_insights.session import stage

MAX_VALUES, SWEEPS, ROUNDS, TOLERANCE = 128, 5, 20, 1e-6
#: Cells that one task rakes alone.
TASK_CELLS = 1 << 17
#: Targets that leave less than this of 1 leave nothing.
LEAST_LEFT = 1e-9
NONE, REST = "(none)", "(rest)"


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def form_topic(text: str = "text") -> Column:
    """A topic from the form of a text: table, markup, numbers, brief or prose."""
    body = F.coalesce(F.col(text), F.lit(""))
    share = lambda pattern: F.length(F.regexp_replace(body, pattern, "")) / F.greatest(F.length(body), F.lit(1))
    return (
        F.when(F.length(body) < 200, "brief")
        .when(share(r"[^|]+") > 0.01, "table")
        .when(share(r"[^#$%&*<>]+") > 0.02, "markup")
        .when(share(r"[^0-9]+") > 0.05, "numbers")
        .otherwise("prose")
    )


def pooled(cells: DataFrame) -> DataFrame:
    """``cells`` for a report: of each dimension the ``MAX_VALUES`` heaviest values stay
    apart and all others are one row's ``(rest)``. Nothing is drawn by it."""
    columns = [c for c in cells.columns if c.startswith("cell_")]
    for name in columns:
        heaviest = cells.groupBy(name).agg(F.sum("tokens").alias("_t")).orderBy(F.desc("_t"), name).limit(MAX_VALUES)
        known = heaviest.select(F.col(name).alias("_value"))
        cells = cells.join(known, F.col(name) == F.col("_value"), "left")
        cells = cells.withColumn(name, F.coalesce("_value", F.lit(REST))).drop("_value")
    drawn = F.sum(F.col("tokens") * F.col("probability"))
    return cells.groupBy(*columns).agg(
        F.sum("tokens").alias("tokens"),
        F.sum("weight").alias("weight"),
        F.when(F.sum("tokens") > 0, drawn / F.sum("tokens")).otherwise(F.max("probability")).alias("probability"),
    )


def _targets(cells: DataFrame, column: str, wanted: dict[str, float] | float) -> DataFrame:
    """Rows ``(column, target)`` for every value that has tokens; targets sum to 1.

    A number is a temper: targets are the observed shares to that power.
    """
    seen = cells.groupBy(column).agg(F.sum("tokens").alias("t")).filter("t > 0")
    if isinstance(wanted, dict):
        named = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])[F.col(column)]
        whole, free, claimed = seen.agg(F.sum("t"), F.sum(F.when(named.isNull(), F.col("t"))), F.sum(named)).first()
        left = 1.0 - sum(wanted.values())
        if left > LEAST_LEFT:
            raw = F.coalesce(named, F.lit(left) * F.col("t") / F.lit(free or 1))
        else:
            scale = (whole - (free or 0)) / whole / claimed if claimed else 0.0
            raw = F.coalesce(named * F.lit(scale), F.col("t") / F.lit(whole or 1))
    else:
        raw = F.pow("t", F.lit(float(wanted)))
    total = seen.agg(F.sum(raw)).first()[0]
    return seen.select(column, (raw / F.lit(total or 1.0)).alias("target"))


def _arranged(cells: DataFrame, n_cells: int) -> DataFrame:
    """One partition for a table of few cells, where windows over its marginals need no
    shuffle; a larger one is dealt by the values of each marginal in turn."""
    return cells.coalesce(1) if n_cells <= TASK_CELLS else cells


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | float]) -> DataFrame:
    """``cells`` (a written table with ``tokens``) with the raked share ``weight``.

    After every few sweeps the table is written down, and the largest deviation of a
    marginal decides whether to go on.
    """
    n_cells, whole = cells.agg(F.count("*"), F.sum("tokens")).first()
    for column, wanted in targets.items():
        goal = _targets(cells, column, wanted).withColumnRenamed("target", f"target_{column}")
        cells = cells.join(goal, column, "left").fillna(0.0, [f"target_{column}"])
    weight = F.col("tokens") / F.lit(whole or 1) if whole else F.lit(0.0)
    cells = stage(_arranged(cells.withColumn("weight", weight), n_cells), "cells")
    for _ in range(ROUNDS):
        cells = _arranged(cells, n_cells)
        for _ in range(SWEEPS):
            for column in targets:
                marginal = F.sum("weight").over(Window.partitionBy(column))
                cells = cells.withColumn(
                    "weight", F.when(marginal > 0, F.col("weight") * F.col(f"target_{column}") / marginal).otherwise(0.0)
                )
        cells = stage(cells, "cells")
        gaps = _arranged(cells, n_cells).select(
            *[F.abs(F.sum("weight").over(Window.partitionBy(c)) - F.col(f"target_{c}")).alias(c) for c in targets]
        )
        gap = gaps.agg(F.max(F.greatest(*gaps.columns) if len(gaps.columns) > 1 else F.col(gaps.columns[0]))).first()[0]
        if gap is None or gap < TOLERANCE:
            break
    else:
        warnings.warn(f"raking ended {gap:.2g} off a marginal after {ROUNDS * SWEEPS} sweeps", stacklevel=2)
    return cells.drop(*[f"target_{c}" for c in targets])


def calibrate(cells: DataFrame, share: float) -> DataFrame:
    """``cells`` with ``probability``: proportional to weight per token, at most 1, with an
    expected number of drawn tokens of ``share`` of all tokens (as far as weights reach).

    The scale of the probabilities grows until no further cell reaches 1; each step is one
    sum over the cells.
    """
    if share >= 1:
        return cells.withColumn("probability", F.lit(1.0))
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    weighed = F.col("weight") > 0
    scale, n_full = 0.0, 0
    while True:
        full = weighed & (ratio * F.lit(scale) >= 1)
        tokens, spent, rest, count = cells.agg(
            F.sum("tokens"), F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(weighed & ~full, F.col("weight"))), F.count(F.when(full, 1))
        ).first()
        if scale and count == n_full:
            break
        if not rest:
            scale = float("inf")
            break
        scale, n_full = (share * tokens - (spent or 0)) / rest, count
    probability = F.when(weighed & (F.col("tokens") > 0), F.least(F.lit(1.0), ratio * F.lit(scale))).otherwise(0.0)
    return cells.withColumn("probability", probability)


def draw_number(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.xxhash64(F.col(id_col), F.lit(seed)).bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53))


def mix(
    df: DataFrame,
    targets: dict[str, dict[str, float] | float],
    share: float,
    dimensions: dict[str, Column],
    tokens: Column,
    id_col: str = "doc_id",
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``probability`` and ``drawn``, and the :func:`pooled` table of cells.

    ``dimensions`` gives the expression of each dimension that ``targets`` names.
    """
    keyed = {f"cell__{n}": F.coalesce(e.cast("string"), F.lit(NONE)) for n, e in dimensions.items()}
    columns = list(keyed)
    counted = df.select(*[e.alias(k) for k, e in keyed.items()], tokens.alias("tokens"))
    raked = rake(stage(counted.groupBy(*columns).agg(F.sum("tokens").alias("tokens")), "cells"), {f"cell__{n}": targets[n] for n in dimensions})
    cells = stage(calibrate(raked, share), "probabilities")
    joined = df.drop("probability", "drawn").withColumns(keyed)
    out = joined.join(cells.select(*columns, "probability"), columns, "left")
    out = out.withColumn("drawn", draw_number(id_col, seed) < F.col("probability"))
    return out.drop(*columns), pooled(cells)
