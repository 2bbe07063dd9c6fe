"""Counts of hashes over all groups of documents, each group sending a hash once.

A group sends its distinct hashes with their counts, packed, one row for each bucket (a
range of hashes). A bucket adds up the counts and answers each row with the totals of its
hashes, in the order in which they were sent, or with what other groups add to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabular_insights.llm.packing import bucket_of, pack, runs, spans, unpack

SENT = "_bucket int, _group int, _first bigint, _steps binary, _counts binary"
TOLD = "_group int, _bucket int, _totals binary"
_KINDS = {"_bucket": pa.int32(), "_group": pa.int32(), "_first": pa.int64(), "_steps": pa.binary(), "_counts": pa.binary()}


def sent(group: int, hashes: np.ndarray, numbers: np.ndarray, n_buckets: int, planes: bool = False) -> pa.Table:
    """Rows of :data:`SENT` from the sorted distinct ``hashes`` of a group; ``planes`` as in ``pack``."""
    bucket = bucket_of(hashes, n_buckets)
    rows = [
        (int(bucket[a]), group, hashes[a : a + 1].view(np.int64)[0],
         pack(np.diff(hashes[a:b], prepend=hashes[a]), planes), pack(numbers[a:b], planes))
        for a, b in spans(bucket)
    ]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS.values())], list(_KINDS))


def _told(table: pa.Table, outside: bool) -> pa.Table:
    firsts = table.column("_first").to_numpy().view(np.uint64)
    parts = [np.cumsum(unpack(s)) + f for s, f in zip(table.column("_steps").to_pylist(), firsts)]
    numbers = np.concatenate([unpack(c) for c in table.column("_counts").to_pylist()])
    hashes = np.concatenate(parts)
    order = np.argsort(hashes, kind="stable")
    starts = runs(hashes[order])
    totals = np.empty(len(hashes), np.uint64)
    totals[order] = np.repeat(np.add.reduceat(numbers[order], starts), np.diff(np.append(starts, len(hashes))))
    if outside:
        totals -= numbers
    ends = np.cumsum([len(p) for p in parts])
    packed = [pack(totals[e - len(p) : e], planes=outside) for p, e in zip(parts, ends)]
    return pa.table({"_group": table.column("_group"), "_bucket": table.column("_bucket"), "_totals": pa.array(packed, pa.binary())})


def told(rows: DataFrame, outside: bool = False) -> DataFrame:
    """The answers to rows of :data:`SENT`; with ``outside`` the counts of all other groups,
    which are mostly 0 where hashes are rare, so that they take little room."""
    return rows.groupBy("_bucket").applyInArrow(lambda table: _told(table, outside), TOLD)


def totals(answers: pa.Table) -> np.ndarray:
    """The totals of a group's hashes, in their order."""
    found = [unpack(t) for t in answers.sort_by("_bucket").column("_totals").to_pylist()]
    return np.concatenate(found) if found else np.empty(0, np.uint64)
