"""Classes of near copies by SimHash: word shingles at least ``LEAST`` alike (Jaccard), every link checked on the whole sets.

Texts with equal shingle sets are one node. A node has a fingerprint of 256
bits over its distinct shingles, four words of 64: texts 0.8 alike differ in 39
bits on average (deviation 5.7), unrelated ones in 128. Fingerprints meet in
tiles: bands of set sizes (sets 0.8 alike lie in the same band or in
neighbouring ones), cut into slices. A task compares two slices by numpy
exclusive-or and bit counts, skips blocks whose sizes or population counts are
too far apart, and returns a forest of what lies within the radius. Those
connected candidates are then checked on their whole shingle sets, again slice
against slice, and only links that hold make classes. Where a candidate group
outgrows one slice, its members first meet the one with the most candidates,
and what is of one class then is not compared again.

No task holds more than two slices, no row stands for a pair, and groups of
copies of any size give a forest. The comparison itself is exact and so grows
with the square of a size band; the slices are small next to that, so what is
shuffled grows with the number of slices of a band.

A pair exactly ``LEAST`` alike lies outside the radius with a probability of
about 1e-4, a closer one with less.

Edge cases: texts without words are one class; fewer words than a shingle are
one shingle; rows without a doc_id are left out of ``classes``; repeated rows
share their class; no rows give no rows. Shingles and sets are compared by
64-bit hash.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import runs, small_batches, written
from threadlake.llm.components import components

SHINGLE, LEAST = 5, Fraction(4, 5)
WORDS = 4
#: Bits in which candidates differ at most, in all words and in the first one; sets of fewer than FEW shingles scatter more.
RADIUS, FIRST, FEW, WIDE = 60, 24, 9, 84
#: Nodes of a slice of a size band; nodes and shingles of a slice of candidates whose sets are compared.
TILE, MEMBERS, SHINGLES = 16384, 512, 500_000
BLOCK, GUESTS = 256, 4096
SALTS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
FACTORS = np.array([1, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25], np.uint64)
PRINTS = "doc_id long, seen long, key long, n int, band int, " + ", ".join(f"w{k} long" for k in range(WORDS))
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :].tolist(), strict=False)], np.uint64))


def wide_print(found: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of hashes: ``WORDS`` times 64 bits, each set if it is set in over half the hashes."""
    total = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(found), 4096):
        h = found[k : k + 4096, None] ^ SALTS
        h = (h ^ (h >> np.uint64(29))) * FACTORS
        h ^= h >> np.uint64(32)
        total += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(found)).view(np.uint64)


def band(n: int) -> int:
    """Sets with sizes in a ratio of ``LEAST`` at least have bands that differ by one at most; -1 where only equal sets are alike."""
    return math.floor(math.log(n) / -math.log(LEAST)) if n * (1 - LEAST) >= LEAST else -1


def _key(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, seen, text): ``seen`` is a hash of the text."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("seen"), text.alias("text")).filter("doc_id is not null")


def prints(docs: DataFrame) -> DataFrame:
    """``PRINTS`` of every row with a doc_id: the shingle set's hash, its size and band, and its fingerprint."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            words = np.array([wide_print(s) for s in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            columns = [*batch.columns[:2], pa.array(map(_key, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array([band(len(s)) for s in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(words[:, k], pa.int64()) for k in range(WORDS))], names=[x.split()[0] for x in PRINTS.split(", ")])

    return _texts(docs).mapInArrow(run, PRINTS)


def near(home: dict[str, np.ndarray], guest: dict[str, np.ndarray], same: bool):
    """Pairs (i, j) within the radius, block by block; both sides sorted by size. With ``same`` only i < j."""
    pop = lambda side: np.bitwise_count(side["w"]).sum(axis=1, dtype=np.int32)
    pops, first = (pop(home), pop(guest)), np.ascontiguousarray(guest["w"][:, 0])
    for a in range(0, len(home["n"]), BLOCK):
        n, w, p = (x[a : a + BLOCK] for x in (home["n"], home["w"], pops[0]))
        # guests between 0.8 of the block's least and 1/0.8 of its largest size
        low = int(np.searchsorted(guest["n"], -(-n[0] * LEAST.numerator // LEAST.denominator)))
        high = int(np.searchsorted(guest["n"], n[-1] * LEAST.denominator // LEAST.numerator, "right"))
        for b in range(max(low, a if same else 0), high, GUESTS):
            part = slice(b, min(high, b + GUESTS))
            widest = max(int(p.min()) - int(pops[1][part].max()), int(pops[1][part].min()) - int(p.max()))
            if widest > (WIDE if n[0] * LEAST < FEW else RADIUS):
                continue
            at = np.flatnonzero(np.bitwise_count(w[:, 0, None] ^ first[None, part]) <= FIRST)
            i, j = np.divmod(at, part.stop - b)
            apart = np.bitwise_count(w[i] ^ guest["w"][j + b]).sum(axis=1, dtype=np.int32)
            fits = apart <= np.where(np.minimum(n[i], guest["n"][j + b]) < FEW, WIDE, RADIUS)
            i, j = i[fits] + a, j[fits] + b
            ratio = np.minimum(home["n"][i], guest["n"][j]) * LEAST.denominator >= np.maximum(home["n"][i], guest["n"][j]) * LEAST.numerator
            if same:
                ratio &= i < j
            if ratio.any():
                yield i[ratio], j[ratio]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of the edges i-j that join different classes of ``label`` one after the other; ``label`` is updated."""
    used = []
    while True:
        open_ = np.flatnonzero(label[i] != label[j])
        if not len(open_):
            return np.concatenate([np.zeros(0, np.int64), *used])
        low, high = np.minimum(label[i[open_]], label[j[open_]]), np.maximum(label[i[open_]], label[j[open_]])
        # every class takes the least class that it meets: one edge each, and no circles, as labels only fall
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        used.append(open_[first])
        to = np.arange(len(label))
        to[high[first]] = low[first]
        while (to[to] != to).any():
            to = to[to]
        label[:] = to[label]


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b, met): a forest of the nodes within the radius of each other, and rows (a, a) with the number of nodes met.

    ``nodes`` has distinct keys, sizes, bands and words.
    """
    nodes = nodes.filter("band >= 0")
    # a band for each quarter of size: a handful of rows
    slices = {r["band"]: -(-r["count"] // TILE) for r in nodes.groupBy("band").count().collect()}
    if not slices:
        return nodes.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(0).cast("long").alias("met"))
    known = F.create_map(*(F.lit(x).cast("int") for pair in sorted(slices.items()) for x in pair))
    count = lambda b: F.coalesce(known[b], F.lit(0))
    upto = lambda n, body: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), body)).otherwise(F.array().cast("array<struct<hb:int,hs:int,gb:int,gs:int,own:boolean>>"))
    cell = lambda hb, hs, gb, gs, own: F.struct(hb.cast("int").alias("hb"), hs.cast("int").alias("hs"), gb.cast("int").alias("gb"), gs.cast("int").alias("gs"), own.alias("own"))
    b, s = F.col("band"), F.col("slice")
    cells = F.concat(
        upto(count(b), lambda t: cell(b, F.least(s, t), b, F.greatest(s, t), s <= t)),
        upto(count(b + 1), lambda t: cell(b, s, b + 1, t, F.lit(True))),
        upto(count(b - 1), lambda t: cell(b - 1, t, b, s, F.lit(False))),
    )
    dealt = nodes.withColumn("slice", F.pmod(F.xxhash64("key", F.lit(1)), count(b)).cast("int")).withColumn("cell", F.explode(cells))
    words = [f"w{k}" for k in range(WORDS)]
    cell_keys = ["hb", "hs", "gb", "gs"]
    dealt = dealt.select("cell.*", "key", "n", *words).repartition(*cell_keys).sortWithinPartitions(*cell_keys, "n", "key")

    def side(group: pa.Table, at: np.ndarray) -> dict[str, np.ndarray]:
        part = group.take(pa.array(at))
        return {"key": part.column("key").to_numpy(), "n": part.column("n").to_numpy().astype(np.int64), "w": np.stack([part.column(w).to_numpy() for w in words], axis=1).view(np.uint64)}

    def run(batches):
        for group in runs(batches, cell_keys):
            own = group.column("own").to_numpy(zero_copy_only=False).astype(bool)
            home, guest = side(group, np.flatnonzero(own)), side(group, np.flatnonzero(~own))
            same = not len(guest["n"])
            if same and (group.column("hb")[0], group.column("hs")[0]) != (group.column("gb")[0], group.column("gs")[0]):
                continue
            keys = home["key"] if same else np.concatenate([home["key"], guest["key"]])
            label, met, edges = np.arange(len(keys)), np.zeros(len(keys), np.int64), []
            for i, j in near(home, home if same else guest, same):
                j = j if same else j + len(home["key"])
                met += np.bincount(i, minlength=len(keys)) + np.bincount(j, minlength=len(keys))
                used = _merge(label, i, j)
                edges.append(np.stack([keys[i[used]], keys[j[used]]]))
            hit = np.flatnonzero(met)
            if len(hit):
                a, b = np.concatenate([*edges, np.stack([keys[hit], keys[hit]])], axis=1)
                n = np.concatenate([np.zeros(len(a) - len(hit), np.int64), met[hit]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "met"])

    return dealt.mapInArrow(run, "a long, b long, met long")


def sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, found): the shingle sets, as bytes, of the rows in ``wanted`` (doc_id, seen)."""

    def run(batches):
        for batch in batches:
            found = [shingles(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_key, found), pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "found"])

    # the wanted rows grow with the documents: never broadcast, whatever the size
    rows = _texts(docs).join(wanted.hint("merge"), ["doc_id", "seen"], "left_semi").dropDuplicates(["doc_id", "seen"])
    return rows.mapInArrow(run, "key long, found binary").groupBy("key").agg(F.any_value("found").alias("found"))


def _alike(shared: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sets with ``shared`` common members and ``n`` members together (counted twice) are alike."""
    return shared * LEAST.denominator >= LEAST.numerator * (n - shared)


def with_lead(pairs: DataFrame) -> DataFrame:
    """Of rows (key, found, lead, lead_found) those (key, lead) whose sets are alike."""

    def run(batches):
        for batch in batches:
            rows = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            fits = [bool(_alike(np.intersect1d(x, y, assume_unique=True).size, len(x) + len(y))) for x, y in rows]
            yield batch.select(["key", "lead"]).filter(pa.array(fits, pa.bool_()))

    return pairs.select("key", "lead", "found", "lead_found").mapInArrow(run, "key long, lead long")


def alike_edges(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Edges (places) between the group's own rows and its guests (or among its own, without guests) that connect all sets alike; rows of one class count as connected."""
    own = group.column("own").to_numpy(zero_copy_only=False).astype(bool)
    found = [np.frombuffer(x, np.uint64) for x in group.column("found").to_pylist()]
    n = np.array([len(x) for x in found], np.int64)
    words = np.unique(np.concatenate(found), return_inverse=True)[1].astype(np.int32)
    vocabulary = int(words.max(initial=-1)) + 1
    words = np.split(words, np.cumsum(n)[:-1])
    label = np.unique(group.column("class").to_numpy(), return_inverse=True)[1]
    flag, edges = np.zeros(vocabulary, bool), [np.zeros((2, 0), np.int64)]
    guests = np.flatnonzero(own if own.all() else ~own)
    for hub in np.flatnonzero(own):
        at = guests[(label[guests] != label[hub]) & ((guests > hub) if own.all() else True)]
        at = at[np.minimum(n[at], n[hub]) * LEAST.denominator >= np.maximum(n[at], n[hub]) * LEAST.numerator]
        if not len(at):
            continue
        flag[words[hub]] = True
        shared = np.add.reduceat(flag[np.concatenate([words[k] for k in at])], np.concatenate([[0], np.cumsum(n[at])[:-1]]), dtype=np.int64)
        flag[words[hub]] = False
        hits = at[_alike(shared, n[at] + n[hub])]
        if len(hits):
            met, first = np.unique(label[hits], return_index=True)
            edges.append(np.stack([np.full(len(first), hub), hits[first]]))
            label[np.isin(label, met)] = label[hub]
    return tuple(np.concatenate(edges, axis=1))


def linked(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (a, b) between keys of ``nodes``: a forest of all links between sets alike."""
    met = written(candidates(nodes), "copies-near")
    group = components(met.select("a", "b"))
    degree = met.filter("a = b").groupBy("a").agg(F.sum("met").alias("met"))
    members = group.join(degree, group["node"] == degree["a"], "left").join(nodes, group["node"] == nodes["key"])
    members = written(members.select("key", "component", F.coalesce("met", F.lit(0)).alias("met"), F.col("n").cast("long").alias("n"), "doc_id", "seen"), "copies-members")
    known = written(sets(docs, members.select("doc_id", "seen")), "copies-sets")

    def cuts(fits) -> Column:
        return F.greatest(F.ceil(F.sum(F.when(fits, F.col("n"))) / SHINGLES), F.ceil(F.count_if(fits) / MEMBERS), F.lit(0)).cast("int")

    large = members.groupBy("component").agg(cuts(F.lit(True)).alias("cuts"), F.max_by("key", F.struct("met", "key")).alias("lead")).filter("cuts > 1").select("component", "lead")
    leads = large.join(known.select(F.col("key").alias("lead"), F.col("found").alias("lead_found")), "lead")
    asked = members.select("key", "component").join(leads, "component").filter("key <> lead").join(known, "key")
    first = written(with_lead(asked), "copies-leads")

    # of one class with the lead, or a class of its own
    placed = members.select("key", "component", "n").join(large, "component", "left").join(first.select("key", F.lit(True).alias("hit")), "key", "left")
    placed = placed.withColumn("lead", F.coalesce(F.col("hit") | (F.col("key") == F.col("lead")), F.lit(False)))
    sizes = placed.groupBy("component").agg(cuts(~F.col("lead")).alias("others"), cuts(F.col("lead")).alias("own_lead"))
    placed = written(placed.join(sizes.filter("others > 0"), "component"), "copies-placed")
    slice_ = F.pmod(F.xxhash64("key", F.lit(2)), F.when(F.col("lead"), F.col("own_lead")).otherwise(F.col("others"))).cast("int")
    to = lambda n, body: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), body)).otherwise(F.array().cast("array<struct<i:int,j:int,own:boolean>>"))
    cell = lambda i, j, own: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), own.alias("own"))
    s, others = F.col("slice"), F.col("others")
    as_other = F.concat(to(others, lambda t: cell(F.least(s, t), F.greatest(s, t), s <= t)), to(F.col("own_lead"), lambda t: cell(s, others + t, F.lit(True))))
    as_lead = to(others, lambda t: cell(t, others + s, F.lit(False)))
    cells = placed.withColumn("slice", slice_).select("component", "key", F.when(F.col("lead"), F.lit(0).cast("long")).otherwise(F.col("key")).alias("class"), F.explode(F.when(F.col("lead"), as_lead).otherwise(as_other)).alias("cell"))
    cell_keys = ["component", "i", "j"]
    dealt = cells.join(known, "key").select("component", "cell.*", "key", "class", "found").repartition(*cell_keys).sortWithinPartitions(*cell_keys)

    def run(batches):
        for group in runs(batches, cell_keys):
            own = group.column("own").to_numpy(zero_copy_only=False).astype(bool)
            if group.num_rows > 1 and own.any() and (not own.all() or group.column("i")[0] == group.column("j")[0]):
                keys = group.column("key").to_numpy()
                a, b = alike_edges(group)
                yield pa.RecordBatch.from_arrays([pa.array(keys[a]), pa.array(keys[b])], schema=EDGE)

    found = dealt.mapInArrow(run, "a long, b long")
    return first.select(F.col("key").alias("a"), F.col("lead").alias("b")).unionByName(found)


def placed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, seen, class) of every distinct row with a doc_id: the class is one of its keys."""
    rows = written(prints(docs), "copies")
    words = [F.any_value(f"w{k}").alias(f"w{k}") for k in range(WORDS)]
    nodes = rows.groupBy("key").agg(F.min(F.struct("doc_id", "seen")).alias("rep"), F.any_value("n").alias("n"), F.any_value("band").alias("band"), *words)
    nodes = written(nodes.select("key", "rep.*", "n", "band", *(f"w{k}" for k in range(WORDS))), "copies-nodes")
    found = components(linked(nodes, docs))
    return rows.select("doc_id", "seen", "key").distinct().join(found, rows["key"] == found["node"], "left").select("doc_id", "seen", F.coalesce("component", "key").alias("class"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every distinct doc_id and text: the component is the least doc_id reachable."""
    placed = written(placed_rows(docs), "copies-classes")
    least = placed.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "class").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class: that of the least (doc_id, hash of the text). Rows without a doc_id all stay."""
    chosen = written(placed_rows(docs), "copies-classes").groupBy("class").agg(F.min(F.struct("doc_id", "seen")).alias("one")).select("one.*")
    seen, by = "_seen", "_by"
    while {seen, by} & {c.lower() for c in docs.columns}:
        seen, by = seen + "_", by + "_"
    rows = docs.withColumn(by, F.col("doc_id").cast("long")).withColumn(seen, F.xxhash64(F.col("text").cast("string")))
    kept = rows.join(chosen.select(F.col("doc_id").alias(by), F.col("seen").alias(seen)).hint("merge"), [by, seen], "left_semi").dropDuplicates([by, seen])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionByName(docs.filter("doc_id is null").select(*columns))

