"""N-gram Jaccard join of documents with Bayesian pruning of candidates.

1. Every document becomes its set of word shingles. Documents of equal sets are one class,
   represented by its smallest id, and only representatives go on.
2. Bands of MinHash values give candidates. Their MinHash values are compared a few at a
   time; a pair is dropped as soon as the posterior probability of reaching the threshold
   falls below the tolerance. What is left joins candidates to clusters.
3. Inside a cluster pairs are pruned in the same way and the rest verified on the sets.

Pairs are never rows: a task compares two blocks of a bucket or a cluster and hands on
one row per member (its links, and the smallest member it is connected to). Buckets and
clusters of any size are cut into blocks of bounded size, so no group meets in one task.

A band misses a pair of the threshold with probability ``(1 - 0.8**4)**32``, about 5e-8.

Defined cases: a text of one to four words is one shingle; a null or empty text has none,
is its own class and has no links; copies are links of one another; rows that share an id
are one document, each different text of it standing in its own class; a row without id
gets the class of its text but is nobody's link; an empty table gives an empty table;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabular_insights.llm.common import components, find_package, slices
from tabular_insights.llm.packing import spans, windows, word_hashes
from tabular_insights.session import stage

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
VALUES, BAND, STEP = 128, 4, 16
#: Members of a block, pairs compared at a time, shingles of a slice of the exact check.
BLOCK, PAIRS, COLUMNS = 512, 1 << 20, 4096


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    draw = lambda: rng.integers(0, 2**64, VALUES, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def min_hash(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set, as 32-bit integers."""
    a, b = _functions()
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None] * a + b
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    rolled, text_of, _ = windows(words, counts, size)
    ends = np.cumsum(np.bincount(text_of, minlength=len(counts))) if len(counts) else []
    sets, start, at = [], 0, 0
    for end, n in zip(ends, counts):
        if 0 < n < size:
            few = np.frombuffer(hashlib.blake2b(words[at : at + n].tobytes(), digest_size=8).digest(), np.uint64)
            sets.append(few)
        else:
            sets.append(np.unique(rolled[start:end]))
        start, at = end, at + n
    return sets


@lru_cache(maxsize=4)
def least_agreement(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For 0, ``STEP``, 2 ``STEP``, ... compared values: agreements that a pair needs for a
    posterior of ``tolerance`` or more that it reaches ``threshold``.

    Uniform prior over the similarity; eight bits of each value are compared, so different
    values agree once in 256.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    agree = grid + (1 - grid) / 256
    needed = [0]
    for n in range(STEP, VALUES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        logs = m * np.log(agree) + (n - m) * np.log1p(-agree)
        mass = np.exp(logs - logs.max(axis=1, keepdims=True))
        posterior = mass[:, grid >= threshold].sum(axis=1) / mass.sum(axis=1)
        needed.append(int(np.argmax(posterior >= tolerance)))
    return tuple(needed)


def surviving(values: np.ndarray, left: np.ndarray, right: np.ndarray, needed: tuple[int, ...]) -> np.ndarray:
    """Places of the pairs that are not dropped at any step."""
    alive = np.arange(len(left))
    agreed = np.zeros(len(left), np.int16)
    for k, least in enumerate(needed[1:]):
        part = slice(k * STEP, (k + 1) * STEP)
        agreed = agreed + (values[left[alive], part] == values[right[alive], part]).sum(axis=1, dtype=np.int16)
        stay = agreed >= least
        alive, agreed = alive[stay], agreed[stay]
    return alive


def smallest_connected(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` members the smallest member that the pairs connect it to."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs inside each run of rows, some at a time."""
    rows = np.arange(sizes.sum())
    after = np.repeat(starts + sizes, sizes) - 1 - rows
    total = np.cumsum(after)
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS)))
        left = np.repeat(rows[at:end], after[at:end])
        begin = np.cumsum(after[at:end]) - after[at:end]
        yield left, left + 1 + np.arange(len(left)) - np.repeat(begin, after[at:end])
        at = end


def _features(sets: bool):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000):
            found = shingle_sets(batch.column(batch.num_columns - 1).to_pylist())
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
            minima = [min_hash(s) for s in found]
            short = pa.array([m.astype(np.uint8).tobytes() for m in minima], pa.binary())
            columns = [*batch.columns[:-1], pa.array(digests, pa.binary()), short]
            names = [*batch.schema.names[:-1], "digest", "sig"]
            if sets:
                columns.append(pa.array([s.tobytes() for s in found], pa.binary()))
                names.append("shingles")
            else:
                keys = [_band_keys(m) if len(s) else None for m, s in zip(minima, found)]
                columns.append(pa.array(keys, pa.list_(pa.int64())))
                names.append("bands")
            yield pa.RecordBatch.from_arrays(columns, names)

    return made


def _band_keys(minima: np.ndarray) -> np.ndarray:
    bands = minima.astype(np.uint64).reshape(-1, BAND)
    key = np.arange(len(bands), dtype=np.uint64) + np.uint64(1)
    for j in range(BAND):
        key = (key ^ bands[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _blocks(df: DataFrame, key: str, size: str, node: str) -> DataFrame:
    """Rows dealt to pairs of blocks of their group: columns ``one``, ``other``, ``side``."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / BLOCK).cast("int"))
    own = df.withColumn("_n", n).withColumn("_own", F.pmod(F.xxhash64(node), F.col("_n")).cast("int"))
    dealt = own.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumns(
        {
            "one": F.least("_own", "_with"),
            "other": F.greatest("_own", "_with"),
            "side": (F.col("_own") > F.col("_with")).cast("int"),
        }
    ).drop("_n", "_own", "_with", size)


def _compared(needed: tuple[int, ...]):
    """Connected candidates of each bucket, from rows that come bucket by bucket."""

    def edges_of(cells: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        group, node, values = cells["group"], cells["node"], cells["sig"]
        parts = np.array(spans(group), np.int64).reshape(-1, 2)
        found = []
        for left, right in _pairs(parts[:, 0], parts[:, 1] - parts[:, 0]):
            across = (cells["one"][left] == cells["other"][left]) | (cells["side"][left] != cells["side"][right])
            left, right = left[across], right[across]
            kept = surviving(values, left, right, needed)
            found.append((left[kept], right[kept]))
        left, right = (np.concatenate([f[i] for f in found]) for i in (0, 1)) if found else (np.empty(0, int),) * 2
        label = smallest_connected(len(node), left, right)
        moved = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["src", "dst"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None and held.num_rows else table
            last = [held.column(c)[-1].as_py() for c in ("key", "one", "other")]
            tail = held.num_rows
            for c, value in zip(("key", "one", "other"), last):
                same = held.column(c).to_numpy() == value
                tail = min(tail, int(same[::-1].argmin()) if not same.all() else held.num_rows)
            yield from edges_of(_cells(held.slice(0, held.num_rows - tail)))
            held = held.slice(held.num_rows - tail)
        if held is not None:
            yield from edges_of(_cells(held))

    return compared


def _cells(table: pa.Table) -> dict[str, np.ndarray]:
    cells = {c: table.column(c).to_numpy() for c in ("key", "node", "one", "other", "side")}
    keys = np.stack([cells[c] for c in ("key", "one", "other")], axis=1)
    new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1)) if len(keys) else np.empty(0, bool)
    raw = b"".join(table.column("sig").to_pylist())
    return cells | {"group": np.cumsum(new), "sig": np.frombuffer(raw, np.uint8).reshape(-1, VALUES)}


def _verified(threshold: float, needed: tuple[int, ...]):
    """Links of the members of two blocks of a cluster, verified on their shingle sets."""

    def verified(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        copies, side = table.column("copies").to_numpy(), table.column("side").to_numpy()
        within = table.column("one")[0].as_py() == table.column("other")[0].as_py()
        values = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, VALUES)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        a = np.arange(len(node)) if within else np.flatnonzero(side == 0)
        b = a if within else np.flatnonzero(side == 1)
        left, right = (x.ravel() for x in np.meshgrid(a, b, indexing="ij"))
        if within:
            left, right = left[left < right], right[left < right]
        kept = surviving(values, left, right, needed)
        left, right = left[kept], right[kept]
        if len(left):
            both = _shared(sets, sizes, left, right)
            linked = both >= threshold * (sizes[left] + sizes[right] - both) - 1e-9
            left, right = left[linked], right[linked]
        n = len(node)
        texts = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
        docs = np.bincount(left, copies[right], n) + np.bincount(right, copies[left], n)
        label = smallest_connected(n, left, right)
        with_link = np.flatnonzero(texts)
        return pa.table(
            {
                "node": pa.array(node[with_link]),
                "n_texts": pa.array(texts[with_link], pa.int64()),
                "n_docs": pa.array(docs[with_link].astype(np.int64)),
                "root": pa.array(node[label[with_link]]),
            }
        )

    return verified


def _shared(sets: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common shingles of each pair, by products of membership matrices, some columns at a time."""
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[column] > 1
    owner, column = owner[several], np.unique(column[several], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        member = np.zeros((len(sets), COLUMNS), np.float32)
        member[owner[a:b], column[a:b] - at] = 1
        total += member @ member.T
    return total[left, right].astype(np.int64)


def join_similar(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """One row per row of ``df``: the id, ``class_id`` (smallest id of equal shingle sets),
    ``group_id`` (smallest id connected by links), ``n_links`` (other documents linked) and
    ``n_similar_texts`` (other classes linked)."""
    find_package(df.sparkSession)
    needed = least_agreement(threshold, tolerance)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(_features(False), "id bigint, digest binary, sig binary, bands array<bigint>")
    features = stage(made, "shingled")
    known = features.filter("digest IS NOT NULL AND id IS NOT NULL")
    classes = known.groupBy("digest").agg(
        F.min("id").alias("node"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    classes = stage(classes, "classes")
    banded = classes.select("node", F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = banded.join(crowded, "key").join(classes.select("node", "sig"), "node")
    dealt = _blocks(members, "key", "size", "node").select("key", "node", "one", "other", "side", "sig")
    candidates = dealt.repartition("key", "one", "other").sortWithinPartitions("key", "one", "other", "node")
    near = candidates.mapInArrow(_compared(needed), "src bigint, dst bigint")
    clusters = stage(components(near), "clusters")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    # always a merge: the clustered ids grow with the documents, at every size alike
    clustered = clusters.join(sizes, "component").select(F.col("node").alias("id"), "component", "size")
    texts = rows.join(clustered.hint("merge"), "id").select("component", "size", F.col("id").alias("node"), "text")
    shingled = texts.mapInArrow(
        _features(True), "component bigint, size bigint, node bigint, digest binary, sig binary, shingles binary"
    )
    counted = classes.select("node", "digest", "copies")
    verified = shingled.join(counted, ["node", "digest"]).dropDuplicates(["node", "digest"]).drop("digest")
    links = (
        _blocks(verified, "component", "size", "node")
        .groupBy("component", "one", "other")
        .applyInArrow(_verified(threshold, needed), "node bigint, n_texts bigint, n_docs bigint, root bigint")
    )
    links = stage(links, "links")
    totals = links.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    groups = components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    judged = counted.join(totals, "node", "left").join(groups, "node", "left")
    whole = features.select("id", "digest").join(judged, "digest", "left")
    return whole.select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col),
        F.coalesce("node", "id").alias("class_id"),
        F.coalesce("component", "node", "id").alias("group_id"),
        (F.coalesce("n_docs", F.lit(0)) + F.coalesce(F.col("copies") - F.col("id").isNotNull().cast("int"), F.lit(0)))
        .cast("long")
        .alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_similar_texts"),
    )


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of similar texts, that of the smallest id.

    Rows, not ids, are grouped: unlike texts of one id are judged each by itself, rows without
    an id like any other, and come after rows with one; of equal ids a hash of the whole row
    decides. Rows equal in every column are one. Texts without words are similar to nothing.
    """
    key, number, group = (_unused(df, name) for name in ("_key", "_number", "_in_group"))
    keyed = df.withColumn(key, F.sha2(F.to_json(F.struct(*df.columns)), 256))
    numbered = keyed.select(F.xxhash64(key).alias(number), key, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    judged = join_similar(numbered.select(number, "text"), number, "text").select(number, F.col("group_id").alias(group))
    judged = stage(judged.distinct(), "judged")
    order = F.struct(F.col("id").isNull(), "id", key)
    best = numbered.drop("text").join(judged, number).groupBy(group).agg(F.min_by(key, order).alias(key))
    return keyed.join(best.select(key), key, "left_semi").dropDuplicates().select(*df.columns)


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
