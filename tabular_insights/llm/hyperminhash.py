"""Near-duplicate documents by HyperMinHash sketches, confirmed on full shingle sets.

1. A document becomes its set of word shingles and a HyperMinHash sketch: the hashes of the
   set fall into buckets, and a bucket keeps of its smallest hash the number of leading zeros
   and the bits after the first one. Documents of equal sets are one class.
2. Bands of such registers give groups of classes. A pair of a group is estimated from its
   registers, corrected for registers that agree by chance; the pairs that could reach the
   threshold are verified on the sets, unless links found before connect them already.
3. First every class is compared with one leader of its groups, which connects most copies
   of one text at a cost that grows with their number. What is left are groups whose members
   are in several components. There only pairs of different components are compared, and
   none inside the largest component.

Pairs are never rows: a task compares two blocks of a group, of bounded count and size, and
hands on at most one row per member, the smallest member it is connected to.

A pair at the threshold shares no band with probability ``(1 - 0.8**5)**32``, about 3e-6, and
is dropped by its estimate with probability 1e-6.

Defined cases: a text with fewer words than a shingle is one shingle; a null or empty text has
none and is linked with nothing; A-Z count as a-z; rows that share an id are judged each by
their own text; the component of rows without any id is null, and all of them are kept, while
a row without id beside one with an id is not; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabular_insights.llm.common import components, find_package, slices
from tabular_insights.llm.packing import windows, word_hashes
from tabular_insights.session import stage

SHINGLE, PERCENT = 4, 80
#: Registers of a sketch, registers of a band, mantissa bits of a register of 16 bits.
REGISTERS, BAND, MANTISSA = 160, 5, 10
EMPTY = 0xFFFF
#: Probability with which the estimate may drop a pair at the threshold.
TOLERANCE = 1e-6
#: Fixed value: share of registers of unlike minima that agree, times 2**MANTISSA, as published.
CHANCE = 0.169919487159739093975315012348630288992889
#: Members and shingles of a block, pairs estimated at a time.
BLOCK, BLOCK_SHINGLES, PAIRS = 512, 1 << 22, 1 << 17
#: What identifies two blocks that are compared.
KEYS = ["group", "one", "other"]


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    words, counts = word_hashes([t.encode().lower().decode() if t else None for t in texts])
    rolled, text_of, _ = windows(words, counts, size)
    rolled = (rolled ^ (rolled >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    rolled ^= rolled >> np.uint64(29)
    ends = np.cumsum(np.bincount(text_of, minlength=len(counts))) if len(counts) else []
    sets, start, at = [], 0, 0
    for end, n in zip(ends, counts):
        if 0 < n < size:
            few = hashlib.blake2b(words[at : at + n].tobytes(), digest_size=8).digest()
            sets.append(np.frombuffer(few, np.uint64))
        else:
            sets.append(np.unique(rolled[start:end]))
        start, at = end, at + n
    return sets


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a sorted set. A hash times the number of buckets has the bucket above
    64 bits and the value below, so buckets are runs, each from its smallest value on."""
    registers = np.full(REGISTERS, EMPTY, np.uint16)
    if len(hashes):
        low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
        bucket = (high * np.uint64(REGISTERS) + (low * np.uint64(REGISTERS) >> np.uint64(32))) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        part, bits = np.frexp((hashes[first] * np.uint64(REGISTERS)).astype(np.float64))
        zeros = np.minimum(64 - bits, 62)
        mantissa = np.clip((part - 0.5) * 2 ** (MANTISSA + 1), 0, 2**MANTISSA - 1)
        registers[bucket[first].astype(np.int64)] = (zeros << MANTISSA) + mantissa.astype(np.int64)
    return registers


@lru_cache(maxsize=4)
def least_estimates(percent: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """For each number of registers that a pair fills, the estimate below which the pair is
    dropped: agreements that a pair at the threshold reaches but for ``tolerance``."""
    found = [0.0]
    p = percent / 100
    for n in range(1, REGISTERS + 1):
        logs = [
            math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
            for k in range(n + 1)
        ]
        fewest = int(np.searchsorted(np.cumsum(np.exp(logs)), tolerance, "right"))
        found.append((fewest - 0.5) / n)
    return np.array(found)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of rows of registers, and the registers that either of the two fills."""
    filled = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    agreed = ((a == b) & (a != EMPTY)).sum(axis=1)
    ratio = n_a / n_b
    by_chance = filled * CHANCE / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (agreed - by_chance) / filled, filled


def _features(texts: bool):
    """Of the last column, texts: size of the set, its digest, the sketch, and the text itself."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000):
            found = shingle_sets(batch.column(batch.num_columns - 1).to_pylist())
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
            columns = [
                *batch.columns[:-1],
                pa.array([len(s) for s in found], pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([sketch(s).tobytes() for s in found], pa.binary()),
            ]
            names = [*batch.schema.names[:-1], "n", "digest", "sketch"]
            if texts:
                columns.append(batch.columns[-1])
                names.append(batch.schema.names[-1])
            yield pa.RecordBatch.from_arrays(columns, names)

    return made


def _dealt(groups: DataFrame) -> DataFrame:
    """Rows ``(group, node, part, rest, n)`` dealt to pairs of blocks of their group.

    Members of the ``rest`` meet one another and all others; the others do not meet one
    another. ``side`` tells which members of ``(one, other)`` are compared: 0 with 1, 2 with 2.
    """

    def blocks(test: Column) -> Column:
        count, shingles = F.count_if(test), F.sum(F.when(test, F.col("n")).otherwise(0))
        return F.greatest(F.ceil(count / BLOCK), F.when(count > 0, F.ceil(shingles / BLOCK_SHINGLES)).otherwise(0)).cast("int")

    sizes = groups.groupBy("group").agg(blocks(F.col("rest")).alias("r"), blocks(~F.col("rest")).alias("l"))
    drawn = F.xxhash64("node", F.lit("block"))
    own = F.pmod(drawn, F.when(F.col("rest"), F.col("r")).otherwise(F.col("l"))).cast("int")
    all_blocks = F.sequence(F.lit(0), F.when(F.col("rest"), F.col("r") + F.col("l")).otherwise(F.col("r")) - 1)
    dealt = groups.join(sizes.filter("r > 0"), "group").withColumn("own", own).withColumn("block", F.explode(all_blocks))
    mine, with_it, inner = F.col("own"), F.col("block"), F.col("rest") & (F.col("block") < F.col("r"))
    return dealt.select(
        "group",
        "node",
        "part",
        F.when(inner, F.least(mine, with_it)).when(F.col("rest"), mine).otherwise(with_it).alias("one"),
        F.when(inner, F.greatest(mine, with_it)).when(F.col("rest"), with_it).otherwise(F.col("r") + mine).alias("other"),
        F.when(inner & (mine == with_it), 2).when(~F.col("rest") | (inner & (mine > with_it)), 1).otherwise(0).alias("side"),
    )


def _runs(starts: np.ndarray, total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows in the same run, some at a time."""
    ends = np.append(starts[1:], total)
    after = np.repeat(ends, ends - starts) - 1 - np.arange(total)
    reached = np.cumsum(after)
    at = 0
    while at < total:
        stop = max(at + 1, int(np.searchsorted(reached, (reached[at - 1] if at else 0) + PAIRS)))
        left = np.repeat(np.arange(at, stop), after[at:stop])
        begin = np.cumsum(after[at:stop]) - after[at:stop]
        yield left, left + 1 + np.arange(len(left)) - np.repeat(begin, after[at:stop])
        at = stop


def _connected(table: pa.Table, percent: int) -> pa.Table:
    """Links within some pairs of blocks, whose rows follow one another, as rows ``(src, dst)``:
    each member with the smallest it is connected to. Verified where there are texts, whose sets
    are made here: compressed, a text is less than half its hashes, which do not shrink."""
    least = least_estimates(percent)
    node, part, side, size = (table.column(c).to_numpy() for c in ("node", "part", "side", "n"))
    registers = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    exact = "text" in table.column_names
    sets: dict[int, np.ndarray] = {}
    keys = np.stack([table.column(c).to_numpy() for c in KEYS], axis=1)
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    above = list(range(len(node)))

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_sets([table.column("text")[i].as_py()])[0]
        return sets[i]

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    for left, right in _runs(starts, len(node)):
        meet = (part[left] != part[right]) & ((side[left] != side[right]) | (side[left] == 2))
        left, right = left[meet], right[meet]
        found, filled = estimate(registers[left], registers[right], size[left], size[right])
        near = found >= least[filled]
        for a, b in zip(left[near].tolist(), right[near].tolist()):
            low, high = sorted((top(a), top(b)))
            if low == high:
                continue
            if exact:
                both = len(np.intersect1d(shingles(a), shingles(b), assume_unique=True))
                if 100 * both < percent * (len(shingles(a)) + len(shingles(b)) - both):
                    continue
            above[high] = low
    tops = np.array([top(i) for i in range(len(node))], np.int64)
    moved = np.flatnonzero(tops != np.arange(len(node)))
    return pa.table({"src": pa.array(node[moved], pa.int64()), "dst": pa.array(node[tops[moved]], pa.int64())})


def _in_turn(percent: int):
    """:func:`_connected` over rows that come sorted by pairs of blocks, many small pairs at once."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = np.ones(table.num_rows, bool)
            for c in KEYS:
                values = table.column(c).to_numpy()
                last &= values == values[-1] if len(values) else True
            done = table.num_rows - int(last.sum())
            if done:
                yield from _connected(table.slice(0, done), percent).to_batches()
                held = table.slice(done).to_batches()
        if held:
            yield from _connected(pa.Table.from_batches(held), percent).to_batches()

    return compared


def _links(groups: DataFrame, attributes: DataFrame, percent: int, exact: bool) -> DataFrame:
    wanted = ["node", "n", "sketch", *(["text"] if exact else [])]
    dealt = _dealt(groups).join(attributes.select(*wanted), "node")
    if exact:
        dealt = dealt.groupBy(*KEYS)
        return dealt.applyInArrow(lambda table: _connected(table.sort_by("node"), percent), "src long, dst long")
    dealt = dealt.repartition(*KEYS).sortWithinPartitions(*KEYS, "node")
    return dealt.mapInArrow(_in_turn(percent), "src long, dst long")


def _parted(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """Groups ``(group, node, n)`` that hold several components, with the component of each
    member as ``part`` and whether it is outside the largest one as ``rest``."""
    known = clusters.select("node", F.col("component").alias("part"))
    placed = groups.join(known, "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = placed.groupBy("group", "part").agg(F.count("*").alias("members"))
    largest = parts.groupBy("group").agg(F.max_by("part", "members").alias("largest"), F.count("*").alias("parts"))
    mixed = placed.join(largest.filter("parts > 1").select("group", "largest"), "group")
    return mixed.select("group", "node", "part", (F.col("part") != F.col("largest")).alias("rest"), "n")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``df``: the id, ``n_shingles``, ``component_id`` (smallest id reachable
    by links) and ``kept``. Two texts are linked where ``100 * common >= percent * all`` shingles."""
    find_package(df.sparkSession)
    id_kind = df.schema[id_col].dataType
    rows = df.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"),
        F.col(text_col).cast("string").alias("text"),
    )
    measured = T.StructType([T.StructField("id", id_kind), T.StructField("row", T.LongType()), T.StructField("n", T.LongType())])
    measured = measured.add("digest", T.BinaryType()).add("sketch", T.BinaryType())
    features = stage(rows.mapInArrow(_features(False), measured), "sketched")
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")
    classes = features.filter("n > 0").groupBy("digest").agg(first, F.max("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stage(
        classes.select(
            F.monotonically_increasing_id().alias("node"), "digest", F.col("first.id").alias("first_id"),
            F.col("first.row").alias("row"), "n", "sketch",
        ),
        "classes",
    )
    band = F.substring("sketch", F.col("band") * (2 * BAND) + 1, F.lit(2 * BAND))
    banded = classes.select("node", "n", "sketch", F.explode(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1))).alias("band"))
    banded = banded.select("node", "n", F.col("band"), band.alias("registers"))
    banded = banded.filter(F.col("registers") != F.lit(b"\xff" * (2 * BAND)))
    banded = banded.select(F.xxhash64("band", "registers").alias("group"), "node", "n")
    crowded = banded.groupBy("group").agg(F.min("node").alias("leader"), F.count("*").alias("size")).filter("size > 1")
    members = stage(banded.join(crowded.drop("size"), "group"), "members")

    compared = members.select("node").distinct().join(classes.select("node", "row", "digest"), "node")
    texts = rows.select("row", "text").join(compared.withColumnRenamed("digest", "known"), "row")
    texts = texts.dropDuplicates(["row", "node", "text"]).select("node", "known", "text")
    full = "node long, known binary, n long, digest binary, sketch binary, text string"
    sets = texts.mapInArrow(_features(True), full).filter("known = digest").drop("known", "digest")
    sets = stage(sets, "sets")

    led = members.filter("leader < node").groupBy("node").agg(F.min("leader").alias("group"), F.first("n").alias("n"))
    led = stage(led, "led")
    heads = led.select("group").distinct().withColumn("node", F.col("group")).join(classes.select("node", "n"), "node")
    star = led.select("group", "node", F.lit(False).alias("rest"), "n").unionByName(heads.withColumn("rest", F.lit(True)))
    near = stage(_links(star.withColumn("part", F.col("node")), sets, percent, True), "links")
    clusters = stage(components(near), "clusters")

    open_groups = stage(_parted(members.select("group", "node", "n"), clusters), "mixed")
    close = stage(_links(open_groups, sets, percent, False), "close")
    bundles = components(close).select("node", F.col("component").alias("group")).join(classes.select("node", "n"), "node")
    far = _links(stage(_parted(bundles, clusters), "mixed"), sets, percent, True)
    clusters = stage(components(stage(near.union(far), "links")), "clusters")

    placed = classes.select("node", "digest", "first_id").join(clusters, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    judged = placed.join(least, "component").select("digest", "component_id")
    whole = features.select("id", "n", "digest").join(judged, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return whole.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
