"""Importance resampling of a corpus towards a target distribution, on hashed n-gram features.

Features are the runs of one and two words of a text, each in one of ``BUCKETS``
buckets by checksum. A bucket's gain is the logarithm of how much more often it
occurs in the target than in the corpus; a document's weight is the mean gain of
its features, and documents are drawn without replacement by Gumbel noise on
their weights.

The corpus is inverted: blocks of documents become postings (bucket, document,
count), of which those for one range of buckets travel as one packed row. With
them, in the same partition, stand the counts of both corpora for the range's
buckets. From these the gains are computed where they are used; each posting
list then emits its documents' contributions, which are summed by block. The
postings of one range are dealt out over many keys by block, so a bucket that
every document holds is no hot key, and the counts come from partial sums.

Ranks need no total order in one place: scores are whole numbers of a narrow
range, so a histogram of them gives each score its first rank, and only
documents that share a score are sorted against each other.

Edge cases: null and empty texts have no features and weight 0; a null doc_id
takes part in the noise as the text ``null`` and stands before others in ties;
rows with equal doc_id share their noise and, where they tie, are ordered by
weight and number of features; equal rows count and are drawn each; an empty
target or corpus gives gains from the other side alone; an empty table gives no
rows; only doc_id and text are read.
"""

from __future__ import annotations

import math
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.llm.common import runs, small_batches, written
from threadlake.llm.packing import small_in, small_out, sorted_in, sorted_out

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Ranges of buckets, each a row of a block's postings.
PARTS = 32
#: Features of a block, and its documents.
BLOCK, DOCS = 4_000_000, 1 << 16
#: Blocks whose postings for a range share a key.
SHARED = 4
#: Words of a text whose features are hashed at a time.
STEP = 1 << 18
#: Each byte of a word itself, A-Z in lower case; all others a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LETTERS).split()


def features(found: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the runs of one and two of the words, ascending."""
    counts = np.zeros(buckets, np.int64)
    for k in range(0, len(found), STEP):
        part = found[k : k + STEP + 1]  # one word more, for the last pair
        single = list(map(crc32, part))
        pairs = list(map(crc32, part[1:], map(crc32, repeat(b" "), single[: len(part) - 1])))
        h = np.array(single[:STEP] + pairs, np.uint32) % np.uint32(buckets)
        if len(found) <= STEP:
            return np.unique(h.astype(np.int64), return_counts=True)
        counts += np.bincount(h, minlength=buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _slices(block: int, docs: list) -> pa.RecordBatch:
    """Rows of one block: its documents, and for each range of buckets that it holds the postings and the range's sums."""
    n = len(docs)
    bucket = np.concatenate([d[3][0] for d in docs])
    count = np.concatenate([d[3][1] for d in docs])
    # One number for each posting: the bucket, then the document. Sorted by it, the postings are inverted.
    key = bucket * n + np.repeat(np.arange(n), [len(d[3][0]) for d in docs])
    order = np.argsort(key)
    key, count, bucket = key[order], count[order], bucket[order]
    rows = [(block, -1, [d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs], None, None, None)]
    width = -(-BUCKETS // PARTS)
    ends = np.searchsorted(bucket, np.arange(PARTS + 1) * width)
    for part, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if a < b:
            sums = np.bincount(bucket[a:b] - part * width, weights=count[a:b], minlength=width).astype(np.int64)
            rows.append((block, part, None, None, None, sorted_in(key[a:b] - part * width * n), small_in(count[a:b] - 1), sums.tolist()))
    kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in POSTINGS.split(", ")])


POSTINGS = "block long, part int, doc_id array<long>, n_words array<long>, n_features array<long>, keys binary, counts binary, sums array<long>"


def postings(docs: DataFrame) -> DataFrame:
    """The corpus inverted, as rows of ``POSTINGS``: of part -1 a block's documents, of others its postings in one range of buckets."""
    small_batches(docs.sparkSession)

    def invert(batches):
        number, block, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text)
                n = max(0, 2 * len(found) - 1)
                block.append((doc_id, len(found), n, features(found)))
                held += n
                if held >= BLOCK or len(block) >= DOCS:
                    yield _slices(number, block)
                    number, block, held = number + 1, [], 0
        if block:
            yield _slices(number, block)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(invert, POSTINGS)


def bucket_counts(inverted: DataFrame, name: str) -> DataFrame:
    """(part, place, count): occurrences by bucket. Sums are partial before they are exchanged, so rows are tasks times ``BUCKETS`` at most."""
    return inverted.filter("part >= 0").select("part", F.posexplode("sums").alias("place", "n")).filter("n > 0").groupBy("part", "place").agg(F.sum("n").alias(name))


def gain(s: int, t: int, s_all: int, t_all: int, buckets: int = BUCKETS) -> int:
    return math.floor(1000 * math.log(float((t + 1) * (s_all + buckets)) / float((s + 1) * (t_all + buckets))))


def contributions(inverted: DataFrame, corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(block, sums): for each block and range of buckets, count times gain summed by document of the block.

    ``corpus`` and ``target`` are ``bucket_counts`` of the two sides.
    """
    blocks = inverted.filter("part < 0").count()
    keys = max(1, -(-blocks // SHARED))
    # BUCKETS rows at most, whatever the input; a range's counts go to each of its keys.
    both = corpus.join(target, ["part", "place"], "full").select("part", F.struct("place", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).alias("c"))
    totals = both.agg(F.sum("c.s").alias("s_all"), F.sum("c.t").alias("t_all")).first()
    s_all, t_all = totals["s_all"] or 0, totals["t_all"] or 0
    counted = both.groupBy("part").agg(F.collect_list("c").alias("c")).select("part", F.explode(F.sequence(F.lit(0), F.lit(keys - 1))).alias("share"), "c.place", "c.s", "c.t")
    size = inverted.filter("part < 0").select("block", F.size("doc_id").alias("docs"))
    posted = inverted.filter("part >= 0").select("part", F.pmod(F.xxhash64("block"), F.lit(keys)).cast("int").alias("share"), "block", "keys", "counts").join(size, "block")
    none = lambda kind: F.lit(None).cast(kind)
    first = counted.select("part", "share", none("long").alias("block"), none("binary").alias("keys"), none("binary").alias("counts"), none("int").alias("docs"), "place", "s", "t")
    then = posted.select("part", "share", "block", "keys", "counts", "docs", *(none("array<int>" if c == "place" else "array<long>").alias(c) for c in ("place", "s", "t")))
    # Counts (no block) come before the postings that need them.
    dealt = first.unionByName(then).repartition("part", "share").sortWithinPartitions("part", "share", "block")
    width = -(-BUCKETS // PARTS)

    def emit(batches):
        gains = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["block"] is None:
                    gains = np.zeros(width, np.int64)
                    gains[row["place"]] = [gain(s, t, s_all, t_all) for s, t in zip(row["s"], row["t"], strict=True)]
                else:
                    bucket, doc = np.divmod(sorted_out(row["keys"]), row["docs"])
                    sums = np.zeros(row["docs"], np.int64)
                    np.add.at(sums, doc, gains[bucket] * (small_out(row["counts"]) + 1))
                    out.append((row["block"], sums.astype("<i8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["block", "sums"])

    return dealt.mapInArrow(emit, "block long, sums binary")


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of ``docs``."""
    inverted = written(postings(docs), "resampling-postings")
    wanted = postings(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    emitted = contributions(inverted, written(bucket_counts(inverted, "s"), "resampling-corpus"), written(bucket_counts(wanted, "t"), "resampling-target"))
    heads = inverted.filter("part < 0").select("block", "doc_id", "n_words", "n_features", F.lit(None).cast("binary").alias("sums"))
    rest = emitted.select("block", *(F.lit(None).cast("array<long>").alias(c) for c in ("doc_id", "n_words", "n_features")), "sums")
    dealt = heads.unionByName(rest).repartition("block").sortWithinPartitions("block")
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")])

    def add_up(batches):
        for group in runs(batches, ["block"]):
            head, sums = None, 0
            for row in group.to_pylist():
                if row["sums"] is None:
                    head = row
                else:
                    sums = sums + np.frombuffer(row["sums"], "<i8")
            n = np.array(head["n_features"], np.int64)
            weight = np.broadcast_to(sums, len(n)) // np.maximum(n, 1)  # numpy rounds down
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (head["doc_id"], head["n_words"], n, weight)], schema=schema)

    return dealt.mapInArrow(add_up, T.StructType([T.StructField(c, T.LongType()) for c in schema.names]))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from a digest of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def draw(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... for the ``percent`` % highest scores of rows with ``least`` words, else null.

    ``scored`` is read twice, so it should be a table.
    """
    able = scored.filter(F.col("n_words") >= least)
    # Scores are thousandths of logarithms of counts, so there are some 10**5 of them at most: a small table.
    tall = written(able.groupBy("score").agg(F.count(F.lit(1)).alias("k")), "resampling-scores")
    quota = percent * (tall.agg(F.sum("k").alias("n")).first()["n"] or 0) // 100
    before = tall.select("score", (F.sum("k").over(Window.orderBy(F.desc("score"))) - F.col("k")).alias("before")).filter(F.col("before") < quota)
    inside = Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), F.desc("weight"), F.desc("n_features"))
    # Equal rows are one while they are sorted, however many they are.
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    grouped = able.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).join(F.broadcast(before), "score")
    first = grouped.withColumn("first", F.col("before") + F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies"))
    placed = first.select(*columns, F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("copies"))).alias("place"))
    rank = F.when(F.col("place") <= quota, F.col("place"))
    highest = placed.select(*columns, rank.cast("long").alias("rank"))
    others = scored.join(F.broadcast(before.select("score", F.lit(True).alias("reached"))), "score", "left").filter(F.col("reached").isNull() | (F.col("n_words") < least))
    return highest.unionByName(others.select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row: drawn rows have a rank."""
    scored = weights(docs, target).withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))
    return draw(written(scored, "resampling-scored"), percent, least)
