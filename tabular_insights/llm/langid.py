"""Language identification in two steps: the family first, then the language within it.

A family is predicted by one-versus-one linear support vector machines over hashed
byte n-grams, and within the family one-versus-one machines separate its languages.
Every machine is trained by Spark ML's ``LinearSVC`` on a bounded sample of labelled
documents; all documents are predicted, whole, without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; documents
without a label teach nothing; with one learned language every text with a letter gets
it, with none ``und``; languages outside :data:`FAMILIES` are families of their own;
repeated rows give equal rows; an empty table gives an empty table; columns other than
the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabular_insights.llm.common import find_package
from tabular_insights.session import stage

#: Families of related languages.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg"],
}
#: Documents of each language that training may use at most, on average, and languages.
SAMPLE, MAX_LANGUAGES = 1_500, 64
DIMENSIONS, STEP_DOCS = 2048, 256
UNKNOWN = "und"


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def features(texts: list[str]) -> np.ndarray:
    """Unit vectors of the square roots of hashed byte bigram and trigram counts."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for at in range(0, len(texts), STEP_DOCS):
        data = [b"  " + t.lower().encode() + b" " for t in texts[at : at + STEP_DOCS]]
        raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
        sizes = [len(d) for d in data]
        doc = np.repeat(np.arange(len(data), dtype=np.int64) * DIMENSIONS, sizes)
        first = np.zeros(len(raw), bool)
        first[np.cumsum([0, *sizes[:-1]])] = True
        pair = (raw[:-1] << np.uint32(8)) | raw[1:]
        three = (pair[:-1] << np.uint32(8)) | raw[2:]
        count = np.zeros(len(data) * DIMENSIONS)
        for grams, cut in ((pair, first[1:]), (three, first[1:-1] | first[2:])):
            hashed = (grams * np.uint32(2654435761)) >> np.uint32(21)
            inside = ~cut
            count += np.bincount(doc[: len(grams)][inside] + hashed[inside], minlength=len(count))
        vectors = np.sqrt(count.reshape(len(data), DIMENSIONS))
        out[at : at + len(data)] = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Machines:
    """One-versus-one machines between ``names``; the votes decide, margins break ties."""

    def __init__(self, names: list[str], weights: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.names, self.pairs = names, list(weights)
        self.matrix = np.array([w for w, _ in weights.values()], np.float32).reshape(len(weights), DIMENSIONS)
        self.bias = np.array([b for _, b in weights.values()], np.float32)

    def predict(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner of each row, and the probability of its closest duel."""
        if len(self.names) == 1:
            return np.zeros(len(vectors), np.int64), np.ones(len(vectors))
        margins = vectors @ self.matrix.T + self.bias
        votes = np.zeros((len(vectors), len(self.names)))
        closest = np.full(votes.shape, np.inf)
        for column, (a, b) in zip(margins.T, self.pairs):
            a, b = self.names.index(a), self.names.index(b)
            votes[:, a] += (column > 0) + 1e-3 * np.tanh(column)
            votes[:, b] += (column <= 0) - 1e-3 * np.tanh(column)
            closest[:, a] = np.minimum(closest[:, a], column)
            closest[:, b] = np.minimum(closest[:, b], -column)
        won = votes.argmax(axis=1)
        return won, 1 / (1 + np.exp(-2 * closest[np.arange(len(won)), won]))


def _fit(rows: DataFrame, kind: str, names: list[str]) -> Machines:
    weights = {}
    for a, b in combinations(names, 2):
        pair = rows.filter(F.col(kind).isin(a, b)).withColumn("label", (F.col(kind) == a).cast("double"))
        model = LinearSVC(maxIter=30, regParam=1e-4, tol=1e-4, standardization=False).fit(pair)
        weights[a, b] = (model.coefficients.toArray(), model.intercept)
    return Machines(names, weights)


def train(df: DataFrame, teach: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """Machines for the families, and for the languages of each family.

    Of each language about ``SAMPLE`` documents teach, drawn by a hash of the id; the
    ``MAX_LANGUAGES`` most frequent languages are learned. Both bound what training holds.
    """
    find_package(df.sparkSession)
    known = df.filter(teach & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = known.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    share = (F.xxhash64(F.col(id_col), F.lit(9)).bitwiseAND(F.lit(2**30 - 1)) / F.lit(2.0**30)).alias("share")
    drawn = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), share)
    drawn = drawn.join(F.broadcast(sizes), "lang").filter(F.col("share") * F.col("count") < SAMPLE)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(lang, t) for lang, t in zip(*map(lambda c: c.to_pylist(), batch.columns)) if has_letter(t)]
            found = features([t for _, t in pairs])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang for lang, _ in pairs], pa.string()),
                    pa.array([family_of(lang) for lang, _ in pairs], pa.string()),
                    pa.array(list(found), pa.list_(pa.float32())),
                ],
                ["lang", "family", "v"],
            )

    made = drawn.select("lang", "text").mapInArrow(vectors, "lang string, family string, v array<float>")
    kept = stage(made, "language-sample")
    rows = kept.select("lang", "family", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    languages = sorted(r[0] for r in kept.select("lang").distinct().collect())  # at most MAX_LANGUAGES
    families = sorted({family_of(x) for x in languages})
    within = {f: _fit(rows, "lang", [x for x in languages if family_of(x) == f]) for f in families}
    return _fit(rows, "family", families) if families else None, within


def predict(df: DataFrame, models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, lang_pred, score)`` from the text alone."""
    find_package(df.sparkSession)
    top, within = models
    schema = T.StructType(
        [df.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            spoken = np.array([i for i, t in enumerate(texts) if has_letter(t)], np.int64) if top else np.empty(0, np.int64)
            for at in range(0, len(spoken), STEP_DOCS):
                rows = spoken[at : at + STEP_DOCS]
                found = features([texts[i] for i in rows])
                family, sure = top.predict(found)
                for f, name in enumerate(top.names):
                    mine = np.flatnonzero(family == f)
                    if len(mine):
                        language, surer = within[name].predict(found[mine])
                        names[rows[mine]] = np.array(within[name].names, object)[language]
                        scores[rows[mine]] = np.minimum(sure[mine], surer)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], schema.names)

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(predicted, schema)
