"""Removal of word windows that repeat an earlier document.

Every window of consecutive words gets a Rabin-Karp hash (a polynomial in 64-bit word
hashes, modulo 2**64). Spark counts the windows by hash: documents are dealt into groups
by a hash of their row, each group sends its distinct window hashes once, packed and cut
into buckets by hash range, and each bucket finds the smallest document of every hash. A
window shared by a third of all documents is therefore one entry per group, not one per
document. What repeats is answered to the groups, where the repeated windows of a
document merge into maximal intervals of words.

Defined cases: a null or empty text has no words; a text shorter than a window keeps all
its words; rows of equal id do not repeat one another, each giving its row; a null id
counts as larger than every id; an empty table gives an empty table; columns of the input
pass through, except that those named as an added column are replaced. Two windows count
as equal when their 64-bit hashes are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabular_insights.llm.common import find_package, text_parts
from tabular_insights.llm.packing import bucket_of, pack, runs, spans, unpack, windows, word_hashes

WINDOW = 13
GROUP_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
_NO_ID = np.iinfo(np.int64).max
_WORDS = re.compile(r"[^ \t-\r]+")


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _lowest(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the smallest id of each."""
    order = np.argsort(hashes, kind="stable")
    hashes, ids = hashes[order], ids[order]
    starts = runs(hashes)
    return hashes[starts], np.minimum.reduceat(ids, starts) if len(starts) else ids


def remove_repeated(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW
) -> DataFrame:
    """``df`` with ``n_words``, ``n_removed``, ``removed`` (maximal intervals of words, end
    excluded) and ``kept_text`` (the text without the removed words and the white space
    after each of them)."""
    find_package(df.sparkSession)
    n_groups = text_parts(df, text_col, GROUP_BYTES)
    n_buckets = text_parts(df, text_col, BUCKET_BYTES)
    added = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField(
            "removed",
            T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
        ),
        T.StructField("kept_text", T.StringType()),
    ]
    rest = [c for c in df.columns if c not in {f.name for f in added}]
    schema = T.StructType([df.schema[c] for c in rest] + added)
    name = "_group"
    while name in df.columns:
        name += "_"
    group = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_groups)).cast("int").alias(name)
    dealt = df.select(group, *rest)
    at_id, at_text = rest.index(id_col) + 1, rest.index(text_col) + 1

    def sent(table: pa.Table) -> pa.Table:
        rolled, text_of, _ = windows(*word_hashes(table.column(at_text).to_pylist()), width)
        hashes, lowest = _lowest(rolled, _ids(table.column(at_id))[text_of])
        known = np.unique(lowest)
        places = np.searchsorted(known, lowest)
        bucket = bucket_of(hashes, n_buckets)
        rows = {"_bucket": [], "_group": [], "_first": [], "_steps": [], "_owners": [], "_ids": []}
        for a, b in spans(bucket):
            owners, local = np.unique(places[a:b], return_inverse=True)
            rows["_bucket"].append(int(bucket[a]))
            rows["_group"].append(table.column(0)[0].as_py())
            rows["_first"].append(hashes[a : a + 1].view(np.int64)[0])
            rows["_steps"].append(pack(np.diff(hashes[a:b], prepend=hashes[a])))
            rows["_owners"].append(pack(local))
            rows["_ids"].append(pack(np.diff(known[owners].view(np.uint64), prepend=np.uint64(0))))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))

    def answered(table: pa.Table) -> pa.Table:
        hashes, owners, groups = [], [], []
        for row in table.to_batches():
            cells = row.to_pydict()
            for first, steps, local, ids, at in zip(*[cells[c] for c in ("_first", "_steps", "_owners", "_ids", "_group")]):
                found = np.cumsum(unpack(steps)) + np.array([first], np.int64).view(np.uint64)
                hashes.append(found)
                owners.append(np.cumsum(unpack(ids)).view(np.int64)[unpack(local).astype(np.int64)])
                groups.append(np.full(len(found), at, np.int64))
        hashes, owners, groups = map(np.concatenate, (hashes, owners, groups))
        distinct, lowest = _lowest(hashes, owners)
        least = lowest[np.searchsorted(distinct, hashes)]
        told = np.flatnonzero(least < owners)
        told = told[np.argsort(groups[told], kind="stable")]
        at = groups[told]
        parts = spans(at)
        return pa.table(
            {
                "_group": pa.array([int(at[a]) for a, _ in parts], pa.int32()),
                "_hashes": pa.array([hashes[told[a:b]].tobytes() for a, b in parts], pa.binary()),
                "_lowest": pa.array([least[told[a:b]].tobytes() for a, b in parts], pa.binary()),
            }
        )

    def removed(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, ids = table.column(at_text).to_pylist(), _ids(table.column(at_id))
        words, counts = word_hashes(texts)
        rolled, text_of, _ = windows(words, counts, width)
        distinct, lowest = _lowest(rolled, ids[text_of])
        if answers.num_rows and len(distinct):
            told = np.concatenate([np.frombuffer(x, np.uint64) for x in answers.column("_hashes").to_pylist()])
            least = np.concatenate([np.frombuffer(x, np.int64) for x in answers.column("_lowest").to_pylist()])
            lowest[np.searchsorted(distinct, told)] = least
        hit = lowest[np.searchsorted(distinct, rolled)] < ids[text_of] if len(rolled) else np.empty(0, bool)
        sizes = np.maximum(counts - width + 1, 0)
        ends = np.cumsum(sizes)
        intervals, kept, gone = [], [], []
        for text, n, a, b in zip(texts, counts, ends - sizes, ends):
            starts = np.flatnonzero(hit[a:b])
            if not len(starts):
                intervals.append([])
                kept.append(text or "")
                gone.append(0)
                continue
            breaks = np.flatnonzero(np.diff(starts) > width)
            firsts = starts[np.append(0, breaks + 1)]
            lasts = starts[np.append(breaks, len(starts) - 1)] + width
            places = [m.start() for m in _WORDS.finditer(text)] + [len(text)]
            edges = [0, *[places[w] for pair in zip(firsts, lasts) for w in pair], len(text)]
            kept.append("".join([text[x:y] for x, y in zip(edges[::2], edges[1::2])]))
            intervals.append([{"start": int(x), "end": int(y)} for x, y in zip(firsts, lasts)])
            gone.append(int((lasts - firsts).sum()))
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        new = [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(intervals, kinds), pa.array(kept, pa.string())]
        return pa.table([*table.columns[1:], *new], [*rest, *[f.name for f in added]])

    sums = dealt.groupBy(name).applyInArrow(
        sent, "_bucket int, _group int, _first bigint, _steps binary, _owners binary, _ids binary"
    )
    answers = sums.groupBy("_bucket").applyInArrow(answered, "_group int, _hashes binary, _lowest binary")
    return dealt.groupBy(name).cogroup(answers.groupBy("_group")).applyInArrow(removed, schema)
