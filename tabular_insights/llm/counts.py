"""Token counts without token ids.

A piece of the vocabulary never holds a space after another character and never a line
feed, so a text falls into pre-tokens whose pieces do not depend on what stands around
them. Every distinct pre-token is counted once; the counts are joined to the frequencies
of pre-tokens in each document and summed.

Frequencies travel packed: a block of documents sends, for each bucket of pre-tokens, its
distinct pre-tokens with the places and frequencies of their documents. A bucket counts
the pieces of each of its distinct pre-tokens once, joins them to the frequencies and
answers each block with one sum per document. A pre-token of a third of all documents
would make its bucket hot, so buckets are salted: those of ``SALT`` scan partitions each
stand by themselves, which bounds what a bucket holds.

Defined cases: a null or empty text has no tokens; every row of the input gives one row,
repeated rows and null ids included; an empty table gives an empty table; columns other
than the id and the text are ignored. The input must be a stable table (files or a staged
frame), because rows are numbered by their place in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabular_insights.llm.common import find_package, text_parts
from tabular_insights.llm.packing import pack, spans, unpack

#: Tokens and documents of a block; scan partitions whose blocks share buckets; bytes of
#: text for which there is a bucket.
BLOCK_TOKENS, BLOCK_DOCS, SALT, BUCKET_BYTES = 4_000_000, 65_536, 512, 16 << 20
_POSTED = "salt int, bucket int, first_row bigint, names binary, lengths binary, docs binary, places binary, counts binary"
_PRE_TOKEN = re.compile(r" +[^ \n]*|\n|[^ \n]+")


def pre_tokens(text: str | None) -> list[str]:
    """Parts of ``text`` with the leading space that the vocabulary adds to every text."""
    return _PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_pieces(path: str, parts: list[str]) -> list[int]:
    """Pieces of each pre-token; a line feed in front keeps its left edge as it is."""
    coder = processor(path)
    return [len(ids) - 2 for ids in coder.encode(["\n" + p for p in parts], num_threads=1)]


def _posted(first: int, tokens: list[np.ndarray], known: dict[str, int], n_buckets: int) -> pa.RecordBatch:
    """Rows of :data:`_POSTED` of one block."""
    names = [n.encode() for n in known]
    buckets = np.array([xxhash.xxh64_intdigest(n) % n_buckets for n in names], np.int64)
    order = np.argsort(buckets, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    places = np.repeat(np.arange(len(tokens), dtype=np.int64), [len(t) for t in tokens])
    keys, counts = np.unique((rank[np.concatenate(tokens)] << 16) | places, return_counts=True)
    edges = np.searchsorted(keys >> 16, np.arange(len(names) + 1))
    rows = []
    for a, b in spans(buckets[order]):
        mine = [names[i] for i in order[a:b]]
        part = slice(edges[a], edges[b])
        lengths = np.array([len(n) for n in mine])
        rows.append(
            (
                (first >> 33) // SALT, int(buckets[order[a]]), first, b"".join(mine), pack(lengths),
                pack(np.diff(edges[a : b + 1])), pack(keys[part] & 0xFFFF), pack(counts[part]),
            )
        )
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _POSTED.split(", ")])


def _postings(n_buckets: int):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, tokens, known, held = 0, [], {}, 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if tokens and (held > BLOCK_TOKENS or row - first >= BLOCK_DOCS or row != first + len(tokens)):
                    if held:
                        yield _posted(first, tokens, known, n_buckets)
                    tokens, known, held = [], {}, 0
                if not tokens:
                    first = row
                parts = pre_tokens(text)
                for part in set(parts):
                    known.setdefault(part, len(known))
                tokens.append(np.fromiter(map(known.__getitem__, parts), np.int64, len(parts)))
                held += len(parts)
        if held:
            yield _posted(first, tokens, known, n_buckets)

    return postings


def _joined(path: str):
    def joined(table: pa.Table) -> pa.Table:
        """Sums of the documents of each block over the pre-tokens of one bucket."""
        distinct: dict[bytes, int] = {}
        numbers = []
        for names, lengths in zip(table.column("names").to_pylist(), table.column("lengths").to_pylist()):
            ends = np.cumsum(unpack(lengths)).tolist()
            found = [names[a:b] for a, b in zip([0, *ends], ends)]
            numbers.append(np.array([distinct.setdefault(n, len(distinct)) for n in found], np.int64))
        pieces = np.array(count_pieces(path, [n.decode() for n in distinct]), np.int64)
        places, sums = [], []
        columns = [table.column(c).to_pylist() for c in ("docs", "places", "counts")]
        for number, docs, at, count in zip(numbers, *columns):
            each = np.repeat(pieces[number], unpack(docs).astype(np.int64)) * unpack(count).astype(np.int64)
            total = np.zeros(int(unpack(at).max()) + 1, np.int64)
            np.add.at(total, unpack(at).astype(np.int64), each)
            some = np.flatnonzero(total)
            places.append(pack(some))
            sums.append(pack(total[some]))
        return pa.table({"first_row": table.column("first_row"), "places": pa.array(places, pa.binary()), "sums": pa.array(sums, pa.binary())})

    return joined


def _summed(table: pa.Table) -> pa.Table:
    """One row per document of a block from the answers of all buckets."""
    places = np.concatenate([unpack(p) for p in table.column("places").to_pylist()]).astype(np.int64)
    sums = np.concatenate([unpack(s) for s in table.column("sums").to_pylist()]).astype(np.int64)
    total = np.zeros(int(places.max()) + 1 if len(places) else 0, np.int64)
    np.add.at(total, places, sums)
    at = np.flatnonzero(total)
    return pa.table({"row": pa.array(at + table.column("first_row")[0].as_py(), pa.int64()), "n": pa.array(total[at], pa.int64())})


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, n_bytes, n_tokens)`` for every row of ``df``."""
    find_package(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("body"))

    postings = rows.select("row", "body").mapInArrow(_postings(text_parts(df, text_col, BUCKET_BYTES)), _POSTED)
    sums = (
        postings.groupBy("salt", "bucket")
        .applyInArrow(_joined(path), "first_row bigint, places binary, sums binary")
        .groupBy("first_row")
        .applyInArrow(_summed, "row bigint, n bigint")
    )
    sizes = rows.select("row", "id", F.octet_length("body").cast("long").alias("n_bytes"))
    return sizes.join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n", F.lit(0)).cast("long").alias("n_tokens")
    )
