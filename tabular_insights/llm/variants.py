"""Spelling variants: words one edit apart, found by a frontier of states in a relational trie.

1. Texts give counts of words (:func:`word_counts`), summed by Spark.
2. The trie is a table of edges ``(node, letter, child)``. A node is the hash of a prefix of a
   word; only prefixes of several words have edges of their own, and what follows the last
   such prefix of a word is the tail of one edge.
3. States ``(word, rest, node, edits)`` are joined with the edges of their node, one level of
   the trie at a time: the letter read matches, or is replaced, inserted or deleted, once. A
   state with one edit that reaches the end of a word has found a neighbour.

A word is read forwards and backwards, in two tries; each reading edits the second half of the
word only, and one of the two has the edit there. So nodes near a root, which a large part of
all words share, are passed without edits, and a state meets the few edges below half a word.

Hashes of equal value for unlike prefixes only add states, as children are told apart, and
found pairs are checked on the words. A word has at most ``(2 * length + 1) * letters``
neighbours, so no group of pairs grows with the data. The rounds are as many as the letters of
the longest prefix that two words share.

Defined cases: a null or empty text has no words; a null id reads as the empty text in the
hash that decides on deletions; repeated rows count again; an empty table has no words; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabular_insights.llm.common import find_package, slices
from tabular_insights.session import stage

#: Every ``ERROR_RATE``-th pair of document and run loses a letter.
ERROR_RATE = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words that a task holds before it hands on their counts.
HELD = 1 << 18
_RUNS = re.compile("[a-z\u00C0-\u00FF]+")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}
    known = held.get

    def handed_on() -> pa.RecordBatch:
        columns = [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    for batch in slices(batches, 1_000):
        for id_text, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seed = zlib.crc32(f"{id_text or ''}:".encode())
            lowered = (text or "").encode().lower().decode()
            for run, n in Counter(_RUNS.findall(lowered)).items():
                found = zlib.crc32(run.encode(), seed)
                if found % ERROR_RATE == 0:
                    at = found % len(run)
                    run = run[:at] + run[at + 1 :]
                held[run] = known(run, 0) + n
            if len(held) > HELD:
                yield handed_on()
                held.clear()
    if held:
        yield handed_on()


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of all runs of letters, A-Z lower-cased, after the planted deletions."""
    find_package(df.sparkSession)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_counted, "word string, n long").filter(F.length("word") >= LEAST_LENGTH)
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _node(way: Column, word: Column, depth: Column) -> Column:
    return F.xxhash64(way, F.substring(word, F.lit(1), depth))


def _readings(words: DataFrame, least: int) -> DataFrame:
    """Every prefix of at least ``least`` letters that several words share, for each of them, in
    both ways of reading: its ``node``, the ``rest`` of the word, and whether edits ``start``."""
    length = F.length("word")
    ways = F.array(
        F.struct(F.lit(0).alias("way"), F.col("word").alias("read"), F.floor(length / 2).alias("half")),
        F.struct(F.lit(1).alias("way"), F.reverse("word").alias("read"), (length - F.floor(length / 2)).alias("half")),
    )
    read = words.select("id", F.explode(ways).alias("r")).select("id", "r.*")
    read = read.withColumn("depth", F.explode(F.sequence(F.lit(least), F.length("read"))))
    at = F.col("depth")
    prefixes = read.select(
        "id",
        at.alias("depth"),
        _node(F.col("way"), F.col("read"), at).alias("node"),
        F.substring("read", at + 1, F.length("read")).alias("rest"),
        F.when(at < F.length("read"), _node(F.col("way"), F.col("read"), at + 1)).alias("child"),
        (at >= F.col("half")).alias("edits"),
    )
    shared = prefixes.groupBy("node").agg(F.count("*").alias("words")).filter("words > 1").select("node")
    return prefixes.join(shared, "node")


def _edges(readings: DataFrame) -> DataFrame:
    """``(depth, node, letter, child, n, tail, target)``: the edge to each child with the number
    of words below; for one word the hash of its ``tail`` and its id as ``target``. An edge
    without a letter ends a word."""
    letter = F.substring("rest", 1, 1)
    tail = F.xxhash64(F.substring("rest", F.lit(2), F.length("rest")))
    ends = F.when(letter == "", F.col("id"))
    keys = ["depth", "node", letter.alias("letter"), "child", ends.alias("ends")]
    return readings.groupBy(*keys).agg(F.count("*").alias("n"), F.min(tail).alias("tail"), F.min("id").alias("target")).drop("ends")


def _after(letter: Column, rest: Column, edits: Column) -> Column:
    """What may be left of a word, once ``letter`` of an edge is read, as an array."""
    head, second = F.substring(rest, 1, 1), F.substring(rest, 2, 1)
    behind = F.substring(rest, F.lit(2), F.length(rest))
    is_letter, left = letter != "", rest != ""
    untouched = F.when(~edits, F.array(F.when(letter == head, behind)))
    replaced = F.when(is_letter & left & (letter != head), behind)
    inserted = F.when(is_letter, rest)
    deleted = F.when(left & (letter == second), F.substring(rest, F.lit(3), F.length(rest)))
    return F.array_compact(F.coalesce(untouched, F.array(replaced, inserted, deleted)))


def neighbours(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``(id, target)``: pairs of ``words`` ``(id, word)``, of at least ``least_length`` letters,
    that differ by one inserted, deleted or replaced letter; each pair in both directions."""
    least = least_length // 2
    readings = stage(_readings(words, least), "readings", ["depth"], rebalance=True)
    edges = stage(_edges(readings), "edges", ["depth"], rebalance=True)
    deepest = readings.agg(F.max("depth")).first()[0] or 0
    found, carried = [], None
    for depth in range(least, deepest + 1):
        # edits still to come: at half a word, before any
        frontier = readings.filter((F.col("depth") == depth) & F.col("edits")).select("id", "rest", "node", "edits")
        if carried is not None:
            frontier = frontier.unionByName(carried)
        below = edges.filter(F.col("depth") == depth).withColumnRenamed("node", "at").drop("depth")
        reads = F.col("edits") | (F.col("letter") == F.substring("rest", 1, 1))
        joined = frontier.join(below, (F.col("node") == F.col("at")) & reads)
        read = joined.withColumn("rest", F.explode(_after(F.col("letter"), F.col("rest"), F.col("edits"))))
        alone = F.col("n") == 1
        over = F.when(F.col("letter") == "", F.col("rest") == "").otherwise(alone & (F.xxhash64("rest") == F.col("tail")))
        goes_on = (F.col("letter") != "") & ~alone
        step = read.filter(goes_on | (over & (F.col("id") != F.col("target"))))
        step = stage(step.select("id", "rest", "child", F.when(over, F.col("target")).alias("target")), "frontier")
        carried = step.filter("target IS NULL").select("id", "rest", F.col("child").alias("node"), F.lit(False).alias("edits"))
        found.append(step.filter("target IS NOT NULL").select("id", "target"))
    if not found:
        return words.select("id", F.col("id").alias("target")).limit(0)
    return reduce(DataFrame.union, found).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for rows ``(word, form)``: the last word that the forms lead to. Each
    round follows twice as many; counts double at every step, so there are few."""
    ahead = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = stage(ahead, "roots")
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = ahead.join(further, "root", "left")
        if joined.filter("next IS NOT NULL").isEmpty():
            return ahead
        ahead = joined.select("word", F.coalesce("next", "root").alias("root"))


def group_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT
) -> DataFrame:
    """One row per word: ``form`` (its near word of largest count, the smaller of equals, if
    that count is at least twice its own), ``root`` (the end of its forms), ``n``, ``n_near``
    and ``form_n``."""
    counted = word_counts(df, id_col, text_col).filter((F.col("n") >= least_count) & (F.length("word") >= least_length))
    words = stage(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    pairs = neighbours(words.select("id", "word"), least_length)
    other = words.select(F.col("id").alias("target"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    named = pairs.join(words, "id").join(other, "target").filter(F.levenshtein("word", "near", 1) == 1)
    first = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("first")
    near = named.groupBy("word").agg(F.count("*").alias("n_near"), first)
    joined = words.join(near, "word", "left")
    has_form = -F.col("first.minus") >= 2 * F.col("n")
    formed = joined.select(
        "word",
        F.when(has_form, F.col("first.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has_form, -F.col("first.minus")).alias("form_n"),
    )
    formed = stage(formed, "formed")
    roots = _roots(formed.filter("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
