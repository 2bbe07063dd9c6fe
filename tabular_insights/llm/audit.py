"""Interaction audit of document filters, from a sparse document-term matrix.

1. Texts become shards: bounded runs of documents, each with the list of its words and a
   matrix in CSR form whose columns are places in that list.
2. The distinct words of all shards are numbered, which is the global dictionary: a word has
   the number of its first row among those of shard and word, of which there is one however
   often the shard holds the word. The columns of each shard become numbers of the dictionary.
3. The row sums of the matrix are the words of a document, its nonzero entries the distinct
   ones. Two of the filters hang on them; the other three are column expressions.
4. Documents are counted by part and by the set of filters that they fail, 32 sets at most.
   What every order of the filters removes at every step follows from these counts.

Failure conditions: A under 100 words; B ``100 * distinct < 80 * words``; C
``100 * capitals > 10 * code points`` with capitals ``[A-Z]``; D a character of ``[#$%&*|]``;
E the text of a smaller id. Words are maximal runs without ASCII white space.

Defined cases: a null text is empty, so it fails A only (and E as a copy); a null part is the
empty string; a null id is larger than every id; rows of equal id and text are no copies of
one another; a document is good or toxic if any label row of its id says so, a null label
says nothing; parts are those that occur, so an empty table gives an empty report; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabular_insights.llm.common import any_of, find_package, slices
from tabular_insights.llm.packing import pack, unpack
from tabular_insights.session import stage

#: Bytes of text in a shard, unless one document has more.
SHARD_BYTES = 32 << 20
#: Bytes of text whose words are taken apart at a time, unless one document has more.
CHUNK_BYTES = 2 << 20
FILTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}


class _Shard:
    """Documents of one shard: the places of their distinct words, and how often each occurs."""

    def __init__(self) -> None:
        self.terms, self.counts, self.ends, self.rows, self.bytes = [], [], [], [], 0

    def add(self, text: str | None) -> None:
        self.extend(pa.array([text or ""]))

    def extend(self, texts: pa.Array) -> None:
        """Count the words of some texts. Words are numbered among these texts, by Arrow: a dictionary
        of Python objects would take several times the text."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten()
        word = pc.not_equal(words, "")  # white space at either end leaves an empty one
        text_of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[word.to_numpy(zero_copy_only=False)]
        places = words.filter(word).dictionary_encode()
        size = max(1, len(places.dictionary))
        entries, counts = np.unique(text_of * size + places.indices.to_numpy(), return_counts=True)
        self.terms.append(pa.DictionaryArray.from_arrays(pa.array((entries % size).astype(np.int32)), places.dictionary))
        self.counts.append(counts.astype(np.int32))
        self.ends.append(np.bincount(entries // size, minlength=len(texts)))
        self.bytes += pc.sum(pc.binary_length(texts)).as_py()

    def batch(self, number: int) -> pa.RecordBatch:
        """One row, with the rows that were added beside the texts."""
        rows = pa.concat_arrays(self.rows)
        terms = pa.chunked_array(self.terms).unify_dictionaries()
        self.terms = []
        words = terms.chunk(0).dictionary
        columns = [
            pa.array([number], pa.int64()),
            pa.ListArray.from_arrays([0, len(rows)], rows),
            pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())),
            pa.array([pack(np.cumsum(np.concatenate(self.ends)))], pa.binary()),
            pa.array([pack(np.concatenate([c.indices.to_numpy() for c in terms.chunks]))], pa.binary()),
            pa.array([pack(np.concatenate(self.counts))], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["shard", "rows", "words", "ends", "terms", "counts"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, shard = TaskContext.get().partitionId() << 33, _Shard()
    for batch in slices(batches, 500):
        # copied, as a column of a batch that was read holds the whole of it, the texts included
        columns = [c.take(np.arange(len(c))) for c in batch.columns[:-1]]
        others = pa.StructArray.from_arrays(columns, batch.schema.names[:-1])
        texts = pc.fill_null(batch.column(batch.num_columns - 1), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            full = int(np.searchsorted(ends, before + SHARD_BYTES - shard.bytes)) + 1  # past the text that fills it
            stop = max(at + 1, min(full, len(texts), int(np.searchsorted(ends, before + CHUNK_BYTES, "right"))))
            shard.extend(texts.slice(at, stop - at))
            shard.rows.append(others.slice(at, stop - at))
            at = stop
            if shard.bytes >= SHARD_BYTES:
                made = shard.batch(number)
                number, shard = number + 1, _Shard()
                yield made
                del made
                pa.default_memory_pool().release_unused()
    if shard.rows:
        batch = columns = others = texts = None
        made = shard.batch(number)
        del shard
        yield made
        del made
    pa.default_memory_pool().release_unused()  # the worker waits for its next task with what it holds


def _renumbered(local: pa.Table, found: pa.Table) -> pa.Table:
    """A shard with numbers of the dictionary in place of places in its own list."""
    terms = np.empty(found.num_rows, np.int64)
    terms[found.column("place").to_numpy()] = found.column("term").to_numpy()
    packed = [pack(terms[unpack(t.as_py()).view(np.int64)]) for t in local.column("terms")]
    at = local.column_names.index("terms")
    return local.set_column(at, "terms", pa.array(packed, pa.binary()))


def _numbered_shards(df: DataFrame, text: Column, keep: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shards without their words, the dictionary number of each place in a shard, and the dictionary."""
    find_package(df.sparkSession)
    chosen = df.select(*[c.alias(n) for n, c in keep.items()], text.cast("string").alias("text"))
    row = T.StructType(chosen.schema.fields[:-1])
    schema = (
        T.StructType()
        .add("shard", T.LongType())
        .add("rows", T.ArrayType(row))
        .add("words", T.ArrayType(T.StringType()))
        .add("ends", T.BinaryType())
        .add("terms", T.BinaryType())
        .add("counts", T.BinaryType())
    )
    local = stage(chosen.mapInArrow(_shards, schema), "shards")
    words = local.select("shard", F.posexplode("words").alias("place", "word"))
    first = F.min("at").over(Window.partitionBy("word"))
    numbered = words.withColumn("at", F.monotonically_increasing_id()).withColumn("term", first)
    dictionary = numbered.filter("at = term").select("word", "term")
    return local.drop("words"), numbered.select("shard", "place", "term"), dictionary


def document_terms(df: DataFrame, text: Column, keep: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of ``text`` and its dictionary ``(word, term)``.

    The matrix has one row per shard: ``rows`` (an array of structs with the columns of
    ``keep``, one for each document), ``ends`` (past the last entry of each document),
    ``terms`` and ``counts`` (column and value of each entry), the last three packed as
    :func:`tabular_insights.llm.packing.unpack` reads them.
    """
    packed, found, dictionary = _numbered_shards(df, text, keep)
    return packed.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(_renumbered, packed.schema), dictionary


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows = batch.column(1).slice(i, 1).flatten()
            ends = unpack(batch.column(2)[i].as_py()).astype(np.int64)
            counts = np.append(0, np.cumsum(unpack(batch.column(4)[i].as_py()).astype(np.int64)))
            starts = np.append(0, ends[:-1])
            sums, nonzero = counts[ends] - counts[starts], ends - starts
            columns = [*rows.flatten(), pa.array(sums, pa.int64()), pa.array(nonzero, pa.int64())]
            names = [*[f.name for f in rows.type], "n_words", "n_distinct"]
            yield pa.RecordBatch.from_arrays(columns, names)


def _totals_schema(matrix: T.StructType) -> T.StructType:
    row = matrix["rows"].dataType.elementType
    return T.StructType([*row.fields, T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType())])


def row_totals(matrix: DataFrame) -> DataFrame:
    """The kept columns of every document, ``n_words`` (row sum) and ``n_distinct`` (nonzero entries)."""
    return matrix.mapInArrow(_totals, _totals_schema(matrix.schema))


def _renumbered_totals(local: pa.Table, found: pa.Table) -> pa.Table:
    made = pa.Table.from_batches(_totals(iter(_renumbered(local, found).to_batches())))
    pa.default_memory_pool().release_unused()
    return made


def document_totals(df: DataFrame, text: Column, keep: dict[str, Column]) -> DataFrame:
    """:func:`row_totals` of the matrix of :func:`document_terms`, a shard at a time.

    The worker that numbers the columns of a shard also takes its row sums: a second worker for
    every task, which a matrix handed from one function to the next needs, would hold it once more.
    """
    packed, found, _ = _numbered_shards(df, text, keep)
    shards = packed.groupBy("shard").cogroup(found.groupBy("shard"))
    return shards.applyInArrow(_renumbered_totals, _totals_schema(packed.schema))


def _failed(flags: dict[str, Column]) -> Column:
    mask = F.lit(0)
    for letter, fails in flags.items():
        mask = mask + F.when(fails, BIT[letter]).otherwise(0)
    return mask


def failures(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``(part, failed, n, good, toxic)``: documents by part and by the filters they fail.

    ``failed`` has a bit for each letter. Copies are counted by text before they meet, so a
    text that a third of all documents share is a few rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    flags = {
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    keep = {
        "id": F.col(id_col),
        "part": F.coalesce(F.col(part_col).cast("string"), F.lit("")),
        "digest": F.unhex(F.sha2(text, 256)),
        "failed": _failed(flags),
    }
    totals = document_totals(df, text, keep)
    flags = {"A": F.col("n_words") < 100, "B": 100 * F.col("n_distinct") < 80 * F.col("n_words")}
    said = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    kind = ["part", "failed", "good", "toxic"]
    judged = totals.withColumn("failed", F.col("failed") + _failed(flags)).join(said, "id", "left")
    judged = judged.fillna(False, ["good", "toxic"])
    by_id = judged.groupBy("digest", *kind, "id").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy("digest", *kind).agg(
        F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first")
    )
    least = F.min("first").over(Window.partitionBy("digest"))
    originals = F.when(least.isNull(), F.col("n")).when(F.col("first") == least, F.col("n_first")).otherwise(0)
    counted = by_text.select(*kind, "n", originals.alias("originals"))
    split = F.array(
        F.struct(F.col("failed"), F.col("originals").alias("n")),
        F.struct((F.col("failed") + BIT["E"]).alias("failed"), (F.col("n") - F.col("originals")).alias("n")),
    )
    long = counted.select("part", "good", "toxic", F.explode(split).alias("s")).select("part", "good", "toxic", "s.*")
    return long.groupBy("part", "failed").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def interactions(counted: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """What each step of each order of the filters does, for every part of ``counted``."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = counted.withColumn("filter_order", F.explode(orders))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    own, before = F.lit(0), F.lit(0)
    for letter in filters:
        own = F.when(F.col("letter") == letter, BIT[letter]).otherwise(own)
        before = before + F.when(F.instr("filter_order", letter) <= F.col("at"), BIT[letter]).otherwise(0)
    steps = steps.withColumns({"own": own, "before": before})
    fails = F.col("failed").bitwiseAND(F.col("own")) != 0
    earlier = F.col("failed").bitwiseAND(F.col("before")) != 0

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0))

    report = steps.groupBy("part", "filter_order", (F.col("at") + 1).alias("step"), "letter").agg(
        total(~any_of([fails, earlier])).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("failed") == F.col("own")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    over_orders = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return report.withColumn("shapley", over_orders).drop("letter")


def audit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """One row per part, order of the five filters and step: ``kept`` after it, ``removed`` by
    it, ``redundant`` (failing its filter, removed before), ``unique_fails``, ``good_lost``,
    ``toxic_lost``, and ``shapley`` (removed by its filter, summed over all orders)."""
    counted = stage(failures(df, labels, id_col, text_col, part_col), "failures")
    return interactions(counted)
