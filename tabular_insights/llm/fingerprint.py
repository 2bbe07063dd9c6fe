"""Merkle fingerprints of documents: equal roots mean equal texts, differing branches show edits.

A text is a tree: sections (runs of paragraphs, ended by a blank line or by a paragraph
whose digest falls in a fixed class), paragraphs (lines with their line feed), and leaves
(runs of words, cut after a word whose last bytes fall in a fixed class). All cuts depend
on the content around them only, so an edit moves no cut far from it. The fingerprint is
``root:section;section``, a section its paragraphs joined by commas, a paragraph its leaf
digests of eight hexadecimal digits each; every inner digest can be derived from the
leaves, and the root covers the exact bytes of the text.

Defined cases: a null text is the empty text, whose tree has no section; every row gives
one row, repeated rows and null ids included; an empty table gives an empty table;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabular_insights.llm.common import find_package, text_parts

BUCKET_BYTES = 8 << 20
LEAF = 8
#: One word in so many ends a leaf, one paragraph in so many ends a section, on average.
WORDS_PER_LEAF, PARAGRAPHS_PER_SECTION = 8, 8


def _digest(data: bytes, size: int = 16) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def _leaf_ends(data: bytes) -> np.ndarray:
    """Ends of leaves: after white space that follows four bytes of the fixed class, and
    after every line feed."""
    raw = np.frombuffer(data, np.uint8)
    space = np.flatnonzero((raw == 32) | (raw == 10)).astype(np.int64)
    tail = np.zeros(len(space), np.uint32)
    for back in range(1, 5):
        at = space - back
        tail = tail * np.uint32(0x01000193) ^ np.where(at >= 0, raw[np.maximum(at, 0)], 0).astype(np.uint32)
    tail = (tail ^ (tail >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    chosen = ((tail >> np.uint32(16)) % WORDS_PER_LEAF == 0) | (raw[space] == 10)
    return space[chosen] + 1


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text."""
    data = (text or "").encode()
    if not data:
        return _digest(b"") + ":"
    sections, paragraphs, leaves, start = [], [], [], 0
    for end in [*_leaf_ends(data).tolist(), len(data)]:
        if end > start:
            leaves.append(_digest(data[start:end], LEAF // 2))
        line_ends = data[end - 1] == 10 or end == len(data)
        if line_ends and leaves:
            blank = len(leaves) == 1 and data[start:end] == b"\n"
            paragraphs.append("".join(leaves))
            if blank or int(_digest(paragraphs[-1].encode(), 2), 16) % PARAGRAPHS_PER_SECTION == 0:
                sections.append(",".join(paragraphs))
                paragraphs = []
            leaves = []
        start = end
    if paragraphs:
        sections.append(",".join(paragraphs))
    branches = "".join(_digest(s.encode()) for s in sections)
    return _digest(branches.encode() + hashlib.blake2b(data, digest_size=16).digest()) + ":" + ";".join(sections)


def _leaves(branch: str) -> list[str]:
    return [p[i : i + LEAF] for p in branch.replace(";", ",").split(",") for i in range(0, len(p), LEAF)]


def likeness(one: str, other: str) -> float:
    """Twice the leaves that both trees have, over all leaves of both; 1 for equal roots.

    Equal sections are taken whole, only the rest is looked into.
    """
    if one.partition(":")[0] == other.partition(":")[0]:
        return 1.0
    a, b = (Counter(x.partition(":")[2].split(";")) for x in (one, other))
    alike = a & b
    shared = sum(n * len(_leaves(s)) for s, n in alike.items())
    left, right = (Counter(_leaves(";".join((x - alike).elements()))) for x in (a, b))
    sizes = 2 * shared + left.total() + right.total()
    return min(1.0, 2 * (shared + (left & right).total()) / sizes) if sizes else 0.0


def edits(one: str, other: str) -> list[tuple[int, int]]:
    """Places ``(section, paragraph)`` of ``one`` whose paragraph ``other`` does not have."""
    if one.partition(":")[0] == other.partition(":")[0]:
        return []
    theirs = other.partition(":")[2].split(";")
    sections, spare = set(theirs), Counter(p for s in theirs for p in s.split(","))
    found = []
    for i, section in enumerate(one.partition(":")[2].split(";")):
        if section in sections:
            continue
        for j, paragraph in enumerate(section.split(",")):
            if spare[paragraph] > 0:
                spare[paragraph] -= 1
            elif paragraph:
                found.append((i, j))
    return found


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, fingerprint)``, without a shuffle."""
    find_package(df.sparkSession)
    schema = T.StructType([df.schema[id_col], T.StructField("fingerprint", T.StringType())])

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array(map(fingerprint, batch.column(1).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], schema.names)

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(printed, schema)


def compare_with_edit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against an edited copy and against the next document.

    The edited copy has its last third replaced by the start of the next document in
    descending order of id (rows of equal id by text; null ids last; the first row follows
    the last). Documents are dealt into ranges of ids; the first document of the range
    below is sent along to each range, so no document is read outside its own range.

    Rows: id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited,
    near_next, edited_places.
    """
    find_package(df.sparkSession)
    low = -(2**63)
    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("key"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"),
    )
    n = text_parts(df, text_col, BUCKET_BYTES)
    n = max(n, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = rows.select("key").filter(F.col("key") > low)
    cuts = np.unique(np.array(keys.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n), np.float64))
    cuts = np.ceil(cuts).astype(np.int64)

    @F.pandas_udf("int")
    def bucket_of(key):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype(np.int32))

    dealt = rows.withColumn("bucket", bucket_of("key"))
    tops = dealt.groupBy("bucket").agg(F.max("key").alias("key")).orderBy("bucket").collect()  # one row per range
    sent = [(t["key"], tops[(i + 1) % len(tops)]["bucket"]) for i, t in enumerate(tops)]
    wanted = df.sparkSession.createDataFrame(sent, "key bigint, target int")
    along = rows.join(F.broadcast(wanted), "key").select(
        "id", "key", "body", F.col("target").alias("bucket"), F.lit(True).alias("along")
    )
    schema = T.StructType(
        [
            df.schema[id_col],
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_text", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
            T.StructField(
                "edited_places",
                T.ArrayType(T.StructType([T.StructField("section", T.IntegerType()), T.StructField("paragraph", T.IntegerType())])),
            ),
        ]
    )
    kinds = pa.list_(pa.struct([("section", pa.int32()), ("paragraph", pa.int32())]))

    def compared(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        keys, texts, along = (table.column(c).to_pylist() for c in ("key", "body", "along"))
        order = sorted(range(len(ids)), key=lambda i: (-keys[i], texts[i]))
        own = [i for i in order if not along[i]]
        guests = [i for i in order if along[i]]
        follow = own[1:] + guests[:1] if own else []
        prints = {i: fingerprint(texts[i]) for i in own}
        out = [[] for _ in schema.names[1:]]
        for i, j in zip(own, follow):
            text, k = texts[i], len(texts[i]) // 3
            edited = text[: len(text) - k] + texts[j][:k]
            mine, after = prints[i], prints.get(j) or fingerprint(texts[j])
            changed = mine if edited == text else fingerprint(edited)
            places = [{"section": a, "paragraph": b} for a, b in edits(changed, mine)]
            for column, value in zip(
                out, (len(text), edited, mine, changed, likeness(mine, changed), likeness(mine, after), places)
            ):
                column.append(value)
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), kinds]
        first = table.column("id").take(pa.array(own, pa.int64())).combine_chunks()
        return pa.table([first, *[pa.array(v, t) for v, t in zip(out, types)]], schema.names)

    full = dealt.withColumn("along", F.lit(False)).unionByName(along)
    return full.groupBy("bucket").applyInArrow(compared, schema)
