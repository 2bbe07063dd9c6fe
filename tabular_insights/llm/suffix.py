"""Removal of byte strings that occur more than once, with a deep-shallow suffix sort.

Every window of ``length`` bytes has an anchor, the smallest hash among its byte grams, so
equal windows have their anchors at equal places. Windows of one anchor are cut into
pieces of bounded size by their distance from it; all windows of a piece share a core of
bytes.

1. Groups of documents send the hash of each core once; Spark counts them.
2. For pieces whose core repeats, the bytes that their windows cover (a context) are
   combined by digest: equal contexts are one row with a number, so copies of a text cost
   one row for each group. What occurs twice as a whole is a repeat as a whole.
3. Contexts that occur once are compared with the others of their core; only the bytes of
   these are fetched, once for each different context. The suffixes that
   start at the anchors, and the reversed ones before them, are sorted by multikey
   quicksort to a shallow depth, and groups with long common prefixes by blind tries.
   Neighbours' common prefixes say which windows are equal. A core with too many different
   contexts for one task is not sorted; its windows are counted by a 128-bit digest.

The answers go back to the groups, whose documents lose every covered byte.

Defined cases: a null or empty text has no bytes; a text shorter than ``length`` keeps
all; matches inside one text count, overlapping ones too; every row is a text of its own,
so a repeated row is removed like any copy; null ids are texts like others; an empty table
gives an empty table; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabular_insights.llm import counting
from tabular_insights.llm.common import find_package, text_parts
from tabular_insights.llm.packing import spans
from tabular_insights.session import stage

LENGTH = 400
GROUP_BYTES, BUCKET_BYTES = 2 << 20, 64 << 20
#: Bytes of a gram, windows of a piece, contexts of a core that one task sorts, pairs
#: compared without a sort, bytes that quicksort looks at.
GRAM, PIECE, SORTED, FEW, SHALLOW = 64, 128, 4096, 6, 32
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_VALUES = np.random.default_rng(6).integers(0, 2**64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def pieces(data: np.ndarray, ends: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Pieces of the windows of texts that end at ``ends`` in ``data``: the hash of the
    core, first and last window, and the anchor of each."""
    n = len(data)
    none = {k: np.empty(0, np.int64) for k in ("first", "last", "anchor")} | {"core": np.empty(0, np.uint64)}
    if n < length:
        return none
    gram = min(GRAM, length)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers(_STEP, n), out=sums[1:])
    back = _powers(_BACK, n + 1)
    grams = (sums[gram:] - sums[:-gram]) * back[: n - gram + 1]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    bits = np.uint64(n.bit_length())
    width = length - gram + 1
    padded = np.full(-(-len(grams) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(grams)] = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    starts = np.flatnonzero(np.repeat(ends, sizes)[:windows] - np.arange(windows) >= length)
    if not len(starts):
        return none
    anchor = anchor[starts]
    part = (anchor - starts) // PIECE
    new = (np.diff(anchor) != 0) | (np.diff(part) != 0) | (np.diff(starts) != 1)
    at = np.flatnonzero(np.append(True, new))
    to = np.append(at[1:], len(starts)) - 1
    first, last, anchor, part = starts[at], starts[to], anchor[at], part[at]
    begin = anchor - part * PIECE
    end = begin + length - PIECE + 1
    core = ((sums[end] - sums[begin]) * back[begin] + part.astype(np.uint64)) * np.uint64(0xA0761D6478BD642F)
    core ^= core >> np.uint64(32)
    return {"core": core * np.uint64(_STEP), "first": first, "last": last, "anchor": anchor}


def common_prefix(a: bytes, b: bytes) -> int:
    """Bytes that ``a`` and ``b`` start with alike."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """A trie of different strings that keeps branching depths and bytes only; each string
    is compared once, with the leaf that a blind descent finds."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: tuple | int | None = None

    def _byte(self, i: int, depth: int) -> int:
        return self.strings[i][depth] if depth < len(self.strings[i]) else -1

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = i
            return
        node = self.root
        while isinstance(node, tuple):  # blindly, by the branching bytes alone
            node = (node[1].get(self._byte(i, node[0])) or next(iter(node[1].values())))[0]
        shared = common_prefix(self.strings[i], self.strings[node])
        parent, key, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < shared:
            parent, key = node, self._byte(i, node[0])
            node = node[1][key][0]
        if isinstance(node, tuple) and node[0] == shared:
            node[1][self._byte(i, shared)] = [i]
            return
        sample = node
        while isinstance(sample, tuple):
            sample = next(iter(sample[1].values()))[0]
        branch = (shared, {self._byte(sample, shared): [node], self._byte(i, shared): [i]})
        if parent is None:
            self.root = branch
        else:
            parent[1][key] = [branch]

    def in_order(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][k][0] for k in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def deep_shallow_order(strings: list[bytes]) -> list[int]:
    """The order of ``strings``: multikey quicksort to a shallow depth, then blind tries
    for what still has a common prefix. Equal strings stand together as they came."""
    equal: dict[bytes, list[int]] = {}
    for i, string in enumerate(strings):
        equal.setdefault(string, []).append(i)
    out: list[int] = []
    stack = [([same[0] for same in equal.values()], 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) < 2:
            out += members
        elif depth >= SHALLOW:
            trie = BlindTrie(strings)
            for i in members:
                trie.insert(i)
            out += trie.in_order()
        else:
            byte = lambda i: strings[i][depth] if depth < len(strings[i]) else -1
            pivot = byte(members[len(members) // 2])
            less = [i for i in members if byte(i) < pivot]
            same = [i for i in members if byte(i) == pivot]
            more = [i for i in members if byte(i) > pivot]
            stack += [(more, depth), (same, depth + 1), (less, depth)]
    return [i for first in out for i in equal[strings[first]]]


def repeated_windows(contexts: list[bytes], anchors: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each of some different contexts of one core, the intervals of bytes covered by
    windows that another context has too."""
    n = len(contexts)
    high = np.array(anchors, np.int64)  # distance from the first window to the anchor
    low = high - np.array([len(c) for c in contexts], np.int64) + length
    right = [c[a:] for c, a in zip(contexts, anchors)]
    left = [c[:a][::-1] for c, a in zip(contexts, anchors)]
    covered: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def cover(j: int, least: int, most: int) -> None:
        covered[j].append((anchors[j] - most, anchors[j] - least + length))

    if n <= FEW:
        for j in range(n):
            for k in range(j):
                least = max(low[j], low[k], length - common_prefix(right[j], right[k]))
                most = min(high[j], high[k], common_prefix(left[j], left[k]))
                if least <= most:
                    cover(j, int(least), int(most))
                    cover(k, int(least), int(most))
        return covered
    ranks, shared = [], []
    for strings in (right, left):
        order = deep_shallow_order(strings)
        ranks.append(np.array(order))
        shared.append(np.array([common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]))
    changes = np.concatenate([low, high + 1, length - shared[0], shared[1] + 1])
    changes = np.unique(changes[(changes >= low.min()) & (changes <= high.max() + 1)])
    for least, after in zip(changes, changes[1:]):
        alike = np.zeros(n, np.int64)
        for order, prefix, needed in zip(ranks, shared, (length - least, least)):
            numbers = np.append(0, np.cumsum(prefix < needed))
            part = np.empty(n, np.int64)
            part[order] = numbers
            alike = alike * n + part
        alike = np.where((low <= least) & (least <= high), alike, -1)
        _, inverse, count = np.unique(alike, return_inverse=True, return_counts=True)
        for j in np.flatnonzero((alike >= 0) & (count[inverse] > 1)):
            cover(j, int(least), int(after) - 1)
    return covered


def _merged(found: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_COVERED = "digest binary, covered array<struct<start:int,end:int>>"


def _sorted_out(length: int):
    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, held = None, []

        def done():
            found = repeated_windows([h[1] for h in held], [h[2] for h in held], length) if len(held) > 1 else []
            rows = [(h[0], _merged(f)) for h, f in zip(held, found) if f and h[3] == 1]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], _SPANS)], ["digest", "covered"]
            )

        for batch in batches:
            for key, *row in zip(*[batch.column(c).to_pylist() for c in ("core", "digest", "context", "anchor", "n")]):
                if key != core and held:
                    yield done()
                    held = []
                core = key
                held.append(row)
        if held:
            yield done()

    return sorted_out


def _windows(length: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, context in zip(batch.column("digest").to_pylist(), batch.column("context").to_pylist()):
                places = range(len(context) - length + 1)
                found = [hashlib.blake2b(context[i : i + length], digest_size=16).digest() for i in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest] * len(found), pa.binary()), pa.array(places, pa.int32()), pa.array(found, pa.binary())],
                    ["digest", "place", "window"],
                )

    return windows


def _laid_out(table: pa.Table) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray]:
    """Rows of a group in an order that hangs on their content only, and their bytes."""
    texts = [(t or "").encode() for t in table.column("text").to_pylist()]
    ids = table.column("id").to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (repr(ids[i]), texts[i]))
    texts = [texts[i] for i in order]
    return order, texts, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def remove_repeated_bytes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH
) -> DataFrame:
    """Rows ``(id, n_bytes, n_removed, removed, kept)``: maximal removed runs of bytes (end
    excluded), and the bytes that stay. ``length`` is at least ``PIECE``."""
    find_package(df.sparkSession)
    n_groups = text_parts(df, text_col, GROUP_BYTES)
    n_buckets = text_parts(df, text_col, BUCKET_BYTES)
    group = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_groups)).cast("int").alias("_group")
    dealt = df.select(group, F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            df.schema[id_col],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField(
                "removed",
                T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
            ),
            T.StructField("kept", T.BinaryType()),
        ]
    )

    def sent(table: pa.Table) -> pa.Table:
        _, _, data, ends = _laid_out(table)
        cores, numbers = np.unique(pieces(data, ends, length)["core"], return_counts=True)
        return counting.sent(table.column("_group")[0].as_py(), cores, np.minimum(numbers, 2), n_buckets)

    def repeated_cores(table: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, data, ends = _laid_out(table)
        found = pieces(data, ends, length)
        raw, rows = data.tobytes(), {}
        if len(found["core"]):
            distinct = np.unique(found["core"])
            repeated = counting.totals(answers)[np.searchsorted(distinct, found["core"])] > 1
            core, first, last, anchor = (found[k][repeated] for k in ("core", "first", "last", "anchor"))
            for key, a, b, at in zip(core.view(np.int64).tolist(), first.tolist(), last.tolist(), anchor.tolist()):
                context = raw[a : b + length]
                digest = hashlib.blake2b(context, digest_size=16, salt=(at - a).to_bytes(8, "little")).digest()
                rows.setdefault(digest, (key, at - a, len(context), []))[3].append(a)
        values = list(rows.values())
        return pa.table(
            {
                "core": pa.array([v[0] for v in values], pa.int64()),
                "digest": pa.array(list(rows), pa.binary()),
                "anchor": pa.array([v[1] for v in values], pa.int32()),
                "size": pa.array([v[2] for v in values], pa.int32()),
                "_group": pa.array([table.column("_group")[0].as_py()] * len(values) if values else [], pa.int32()),
                "places": pa.array([v[3] for v in values], pa.list_(pa.int32())),
            }
        )

    def fetched(table: pa.Table, wanted: pa.Table) -> pa.Table:
        raw = _laid_out(table)[2].tobytes() if wanted.num_rows else b""
        found = [raw[a : a + n] for a, n in zip(wanted.column("place").to_pylist(), wanted.column("size").to_pylist())]
        columns = [wanted.column(c) for c in ("core", "digest", "anchor", "n")]
        return pa.table([*columns, pa.array(found, pa.binary())], ["core", "digest", "anchor", "n", "context"])

    def removed(table: pa.Table, answers: pa.Table) -> pa.Table:
        order, texts, data, ends = _laid_out(table)
        edges = np.zeros(len(data) + 1, np.int32)
        for places, covered in zip(answers.column("places").to_pylist(), answers.column("covered").to_pylist()):
            for span in covered:
                np.add.at(edges, np.array(places) + span["start"], 1)
                np.add.at(edges, np.array(places) + span["end"], -1)
        gone = np.cumsum(edges[:-1]) > 0
        columns = [[None] * len(texts) for _ in range(4)]
        for row, text, end in zip(order, texts, ends):
            mine = gone[end - len(text) : end]
            parts = [(a, b) for a, b in spans(mine) if mine[a]] if mine.any() else []
            kept = data[end - len(text) : end][~mine].tobytes() if parts else text
            values = (len(text), len(text) - len(kept), [{"start": a, "end": b} for a, b in parts], kept)
            for column, value in zip(columns, values):
                column[row] = value
        types = [pa.int64(), pa.int64(), _SPANS, pa.binary()]
        return pa.table([table.column("id"), *[pa.array(c, t) for c, t in zip(columns, types)]], schema.names)

    answers = counting.told(dealt.groupBy("_group").applyInArrow(sent, counting.SENT))
    rows = dealt.groupBy("_group").cogroup(answers.groupBy("_group")).applyInArrow(
        repeated_cores, "core bigint, digest binary, anchor int, size int, _group int, places array<int>"
    )
    rows = stage(rows, "contexts")  # where they stand, without their bytes
    place = F.struct("_group", F.get("places", F.lit(0)).alias("place"), "anchor", "size")
    distinct = rows.groupBy("core", "digest").agg(F.sum(F.size("places")).alias("n"), F.min(place).alias("at"))
    distinct = stage(distinct.select("core", "digest", "n", "at.*"), "distinct-contexts")
    whole = distinct.filter("n > 1").select(
        "digest", F.array(F.struct(F.lit(0).alias("start"), F.col("size").alias("end"))).alias("covered")
    )
    sizes = distinct.groupBy("core").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("single"))
    unsure = stage(distinct.join(sizes.filter("m > 1 AND single > 0"), "core"), "unsure-contexts")

    def contexts(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select("_group", "core", "digest", "anchor", "size", "n", "place")
        return dealt.groupBy("_group").cogroup(wanted.groupBy("_group")).applyInArrow(
            fetched, "core bigint, digest binary, anchor int, n bigint, context binary"
        )

    compared = contexts(unsure.filter(F.col("m") <= SORTED)).repartition("core").sortWithinPartitions("core", "digest")
    covered = whole.unionByName(compared.mapInArrow(_sorted_out(length), _COVERED))
    large = unsure.filter(F.col("m") > SORTED)
    if not large.isEmpty():
        exploded = contexts(large).mapInArrow(_windows(length), "digest binary, place int, window binary")
        exploded = stage(exploded, "windows")
        twice = exploded.groupBy("window").agg(F.count("*").alias("c")).filter("c > 1").select("window")
        span = F.struct(F.col("place").alias("start"), (F.col("place") + length).alias("end"))
        counted = exploded.join(twice, "window").groupBy("digest").agg(F.collect_list(span).alias("covered"))
        covered = covered.unionByName(counted)
    located = rows.select("digest", "_group", "places").join(covered, "digest").select("_group", "places", "covered")
    return dealt.groupBy("_group").cogroup(located.groupBy("_group")).applyInArrow(removed, schema)
