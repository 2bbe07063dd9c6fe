"""Stupid-backoff language model scores of documents, with counts over all other documents.

Documents are dealt into groups by a hash of their row. Each group explodes its texts to
n-grams and sends its distinct n-grams once, as 64-bit hashes with counts, packed and cut
into buckets by hash range. A bucket is one part of the n-gram count tables: it adds up
the counts and joins them to the n-grams that the groups sent. The groups sum the scores
of each document. An n-gram that stands in a third of all documents is one entry for each
group, never a row for each document.

N-grams of one and two words are counted in a first round, those of each further length in
a round of their own, which leaves out what can stand in one row only: an n-gram of two rows
has both its shorter parts in two rows. So all counts outside a row stay exact.

Every text that is scored is also part of the corpus, so counts leave its own row out: an
n-gram counts as often as it stands in *other* rows, otherwise none would ever back off. The
score of a word after its history is ``count(history, word) / count(history)`` where the
n-gram stands at least ``min_count`` times (once) in other rows, else ``backoff`` times the
score after the history without its first word; the last resort is the word's share of all
words, those of its own row included, which is never 0.

Defined cases: a null or empty text has no words and scores 0; the first words of a text
have shorter histories; every row gives one row and counts once, repeated rows and null
ids included (a copy is another row); an empty table gives an empty table; columns other than the id and the text
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabular_insights.llm import counting
from tabular_insights.llm.common import find_package, text_parts
from tabular_insights.llm.packing import windows, word_hashes

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 1
GROUP_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
_MIX, _ODD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _grams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-gram of ``n`` words, and the place of its last word."""
    rolled, _, first = windows(words, counts, n)
    mixed = (rolled + np.uint64(n * int(_ODD) % 2**64)) * _MIX
    return (mixed ^ (mixed >> np.uint64(32))) * _ODD, first + n - 1


def _others(text_of: np.ndarray, places: np.ndarray, numbers: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """How often each n-gram stands outside its own text: ``numbers`` times in the group, of
    which its text has some, and ``outside`` times in other groups."""
    own, often = np.ones(len(places), np.int64), np.flatnonzero(numbers[places] > 1)
    _, which, found = np.unique(text_of[often] * len(numbers) + places[often], return_inverse=True, return_counts=True)
    own[often] = found[which]
    return (outside + numbers)[places] - own


class _Group:
    """The texts of a group, with what is known after the rounds that are ``told``.

    ``seen[n]`` has, for the last word of each n-gram of ``n`` words, how often the n-gram
    stands in other rows; ``asked`` has the n-grams of the next round and their counts.
    """

    def __init__(self, texts: list[str | None], order: int, told: list[np.ndarray]):
        self.words, self.counts = word_hashes(texts)
        self.text_of = np.repeat(np.arange(len(self.counts)), self.counts)
        self.seen: dict[int, np.ndarray] = {}
        self.share = np.empty(0)
        rounds = _rounds(order)
        for at, lengths in enumerate(rounds[: len(told) + 1]):
            grams = [self._candidates(n) for n in lengths]
            hashes, places, numbers = np.unique(np.concatenate([h for h, _ in grams]), return_inverse=True, return_counts=True)
            every = np.searchsorted(hashes, _MIX)  # stands for all words, in the first round
            if at == len(told):
                if at == 0 and len(self.words):
                    hashes, numbers = np.insert(hashes, every, _MIX), np.insert(numbers, every, len(self.words))
                self.asked = hashes, numbers
                return
            outside = told[at].astype(np.int64)
            if at == 0 and len(self.words):
                n_words, outside = outside[every] + len(self.words), np.delete(outside, every)
                self.share = (outside + numbers)[places[: len(self.words)]] / n_words
            parts = np.split(places, np.cumsum([len(h) for h, _ in grams])[:-1])
            for n, part, (_, last) in zip(lengths, parts, grams):
                self.seen[n] = np.zeros(len(self.words), np.int64)
                self.seen[n][last] = _others(self.text_of[last], part, numbers, outside)

    def _candidates(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        hashes, last = _grams(self.words, self.counts, n)
        if n <= 2:
            return hashes, last
        shared = (self.seen[n - 1][last] > 0) & (self.seen[n - 1][last - 1] > 0)
        return hashes[shared], last[shared]


def _rounds(order: int) -> list[list[int]]:
    return [[1, 2][:order], *([n] for n in range(3, order + 1))]


def score(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    backoff: float = BACKOFF,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """Rows ``(id, n_words, n_backed_off, log_score)``; natural logarithms, summed."""
    find_package(df.sparkSession)
    n_groups = text_parts(df, text_col, GROUP_BYTES)
    n_buckets = text_parts(df, text_col, BUCKET_BYTES)
    group = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_groups)).cast("int").alias("_group")
    dealt = df.select(group, F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            df.schema[id_col],
            T.StructField("n_words", T.LongType()),
            T.StructField("n_backed_off", T.LongType()),
            T.StructField("log_score", T.DoubleType()),
        ]
    )

    n_rounds = len(_rounds(order))

    def known(table: pa.Table, answers: pa.Table | None, n_told: int) -> _Group:
        told = [counting.totals(answers.filter(pc.equal(answers.column("_round"), r))) for r in range(n_told)]
        return _Group(table.column("text").to_pylist(), order, told)

    def asking(n_told: int):
        def asked(table: pa.Table, answers: pa.Table | None = None) -> pa.Table:
            return counting.sent(table.column("_group")[0].as_py(), *known(table, answers, n_told).asked, n_buckets, planes=True)

        return (lambda table, answers: asked(table, answers)) if n_told else (lambda table: asked(table))

    def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
        group = known(table, answers, n_rounds)
        counts, text_of = group.counts, group.text_of
        total, backed = np.zeros(len(counts)), np.zeros(len(counts), np.int64)
        if counts.sum():
            value, place = group.share, np.arange(len(text_of)) - np.repeat(np.cumsum(counts) - counts, counts)
            for n in range(2, order + 1):
                has_history = place >= n - 1
                longer, history = group.seen[n], np.append(1, group.seen[n - 1][:-1])
                used = has_history & (longer >= min_count)
                backed += np.bincount(text_of[has_history & ~used], minlength=len(counts))
                value = np.where(used, longer / np.maximum(history, 1), np.where(has_history, backoff * value, value))
            total = np.bincount(text_of, np.log(value), minlength=len(counts))
        columns = [table.column("id"), pa.array(counts, pa.int64()), pa.array(backed, pa.int64()), pa.array(total, pa.float64())]
        return pa.table(columns, schema.names)

    grouped, answers = dealt.groupBy("_group"), None
    for r in range(n_rounds):
        asked = grouped if answers is None else grouped.cogroup(answers.groupBy("_group"))
        told = counting.told(asked.applyInArrow(asking(r), counting.SENT), outside=True).withColumn("_round", F.lit(r))
        answers = told if answers is None else answers.union(told)
    return grouped.cogroup(answers.groupBy("_group")).applyInArrow(scored, schema)
