"""SimHash near-duplicates: fingerprints, tiled exact comparison, components.

Fingerprints are grouped first, so exact copies are one row. The distinct ones
fall into tiles by their population counts (one count for each 16-bit quarter).
Two fingerprints that differ in at most ``radius`` bits have counts that differ
by at most ``radius`` in sum, so a tile only meets the tiles within that
distance; all others are skipped. A task holds one slice of a home tile and one
bounded chunk of the tiles that visit it, compares them by numpy exclusive-or
and bit counts, and returns a spanning forest of the links that it found, never
all pairs.

Edge cases: null and empty texts (and texts without words) have fingerprint
zero and link like any other; fewer words than a shingle hash as one shingle;
ties (as many ones as zeros) give bit 0; repeated rows share their fingerprint
and component; rows that share a doc_id but not their text are told apart by
fingerprint; rows without a doc_id link like others, and a component of only
such has a null id; an empty table gives no rows; other columns are ignored by
``clusters`` and kept by ``keep_one``.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm import near_copies
from threadlake.llm.common import runs, small_batches, written
from threadlake.llm.components import components

QUARTERS, WIDTH = 4, 16
#: Distinct fingerprints in a slice of a home tile, and in a chunk of its visitors.
TILE, CHUNK = 4096, 1 << 18
BLOCK = 1024


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for k in range(0, n, 65536):  # bounded memory on very long texts
        part = np.array(hashes[k : k + 65536], dtype=">u8").view(np.uint8)
        total += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _tile_key(fp: Column) -> Column:
    counts = [F.bit_count(F.shiftrightunsigned(fp, WIDTH * k).bitwiseAND(F.lit(2**WIDTH - 1).cast("long"))) for k in range(QUARTERS)]
    return sum((c * F.lit((WIDTH + 1) ** k) for k, c in enumerate(counts)), F.lit(0)).cast("int")


def _near_keys(key: Column, radius: int) -> Column:
    """Keys, up to ``key`` itself, whose counts differ by at most ``radius`` in sum: the homes to visit.

    A step over the edge of a count's range names some other key: a needless visit, never a missed one.
    """
    steps = [step for step in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, step)) <= radius]
    shifts = sorted({sum(d * (WIDTH + 1) ** k for k, d in enumerate(step)) for step in steps})
    return F.transform(F.lit([x for x in shifts if x <= 0]), lambda x: x.cast("int") + key)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches over the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_within(home: np.ndarray, guest: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indices into home followed by guest) that connect what lies within ``radius`` bits."""
    n, edges = len(home) + len(guest), [np.zeros((2, 0), np.int64)]
    for k in range(0, len(guest), BLOCK):
        i, j = np.nonzero(np.bitwise_count(home[:, None] ^ guest[None, k : k + BLOCK]) <= radius)
        j = j + k + len(home)
        if len(i) > n:  # a dense block: only its forest goes on
            root = _forest(i, j, n)
            i = np.flatnonzero(root != np.arange(n))
            j = root[i]
        edges.append(np.stack([i, j]))
    a, b = np.concatenate(edges, axis=1)
    root = _forest(a, b, n)
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) between nodes, connecting the same classes as all links would.

    ``prints`` has distinct fingerprints ``fp``, each with the number ``rep`` of its node.
    """
    tiled = prints.withColumn("key", _tile_key(F.col("fp")))
    # At most 17**4 rows, whatever the input: small enough to broadcast.
    counts = tiled.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    homes = counts.select(F.explode(_near_keys(F.col("key"), radius)).alias("home"), "n").groupBy("home").agg(F.sum("n").alias("visitors"))
    homes = counts.join(F.broadcast(homes), F.col("key") == F.col("home")).select("home", F.ceil(F.col("n") / TILE).cast("int").alias("slices"), F.ceil(F.col("visitors") / CHUNK).cast("int").alias("chunks"))
    homes = F.broadcast(homes)
    part = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at_home = tiled.withColumnRenamed("key", "home").join(homes, "home").select("home", part("slices", 1).alias("slice"), every("chunks").alias("chunk"), F.lit(True).alias("own"), "fp", "rep")
    visits = tiled.select(F.explode(_near_keys(F.col("key"), radius)).alias("home"), "fp", "rep").join(homes, "home")
    visits = visits.select("home", every("slices").alias("slice"), part("chunks", 2).alias("chunk"), F.lit(False).alias("own"), "fp", "rep")

    none = pa.table({"a": [], "b": []}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    def compare(group: pa.Table) -> pa.Table:
        if group.num_rows < 2:
            return none
        own = group.column("own").to_numpy(zero_copy_only=False).astype(bool)
        fp, rep = (group.column(c).to_numpy() for c in ("fp", "rep"))
        fp = fp.view(np.uint64)
        reps = np.concatenate([rep[own], rep[~own]])
        a, b = links_within(fp[own], fp[~own], radius)
        differ = reps[a] != reps[b]
        return pa.table({"a": reps[a][differ], "b": reps[b][differ]}, schema=none.schema)

    def run(batches):
        for group in runs(batches, ["home", "slice", "chunk"]):
            yield from compare(group).to_batches()

    dealt = at_home.unionByName(visits).repartition("home", "slice", "chunk").sortWithinPartitions("home", "slice", "chunk")
    return dealt.mapInArrow(run, "a long, b long")


def clusters(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the component is the least doc_id reachable, null if no row of it has one."""
    prints = written(fingerprints(docs, shingle, seed), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(links(nodes.select("fp", F.col("fp").alias("rep")), radius))
    placed = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    least = placed.groupBy("class").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(least, "class").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies: that of the least doc_id (texts that share it by hash). Rows without a doc_id all stay.

    Near copies share 0.8 of their 5-word shingles: wider apart than this module's radius, so they are found by wider prints (``near_copies``).
    """
    return near_copies.keep_one(docs)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id)."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return clusters(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
