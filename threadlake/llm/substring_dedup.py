"""Removal of passages that occurred earlier in the corpus, by windows of consecutive words.

A word goes if a window of ``WINDOW`` words that covers it has the same words
as one that starts earlier: in a document of smaller doc_id, or earlier in the
same document. Few windows repeat, so a count-min sketch says first which may.

Counting. Every window is counted by its anchor, the one of its ``GRAM``-word
runs with the least hash: equal windows have equal anchors at equal distances,
so an anchor occurs at least as often as any window that it stands for, while
neighbouring windows share theirs. Blocks of documents sketch their anchors
(``DEPTH`` rows of cells, as many cells as the corpus needs, of which a block
sends those it touched, packed by range of cells). Ranges merge what the blocks
sent and answer each with a bit a cell: more than one. Sums only overestimate,
so no repeated window is lost.

Grouping. Windows estimated repeated form runs. Runs with the same words are
one group, of which the earliest stands for all; of a passage copied into
thousands of documents one copy goes on. The windows of these are grouped
exactly by 128-bit digests of their words; the earliest of each group stays.

Both groupings have map-side partial results, so hot passages shrink before
they are exchanged; tables between the passes are Parquet in the shared folder.

Edge cases: null and empty texts have no words and keep nothing; texts shorter
than a window are kept whole; rows without a doc_id come first; rows that share
a doc_id count as documents of their own, ordered by a digest of their words,
then as they lie, so of equal rows one stays; an empty table gives no rows; only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import runs, small_batches, written
from threadlake.llm.packing import small_in, small_out, sorted_in, sorted_out, squeeze, unsqueeze

WINDOW, GRAM = 20, 12
#: Rows of the sketch; cells are a power of two, ``ROOM`` times the words of the corpus at least.
DEPTH, ROOM = 2, 4
#: Words and documents of a block, and words whose anchors meet in one range of cells.
BLOCK, DOCS, PART = 1_500_000, 1 << 16, 12_000_000
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))

BLOCKS = "block long, doc_id array<long>, n array<long>, words binary"
SETTLED = "block long, at int, doc_id long, tie long, n_words long, kept string, words binary, runs array<struct<start: long, n: long, hi: long, lo: long>>"


class _Hashes(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(h: np.ndarray, k: int = 0) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[k]
    h = (h ^ (h >> np.uint64(29))) * ODD[2]
    return h ^ (h >> np.uint64(32))


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """By place, a hash of the ``size`` words that begin there (for as many places as there are such), from sums over powers of two."""
    out, done, power, span = None, 0, h, 1  # power: of the span words from a place
    factor = pow(int(ODD[0]), 1, 1 << 64)
    while True:
        if size & span:
            tail = power[done:]
            out = tail if out is None else out[: len(tail)] * np.uint64(pow(factor, span, 1 << 64)) + tail[: len(out)]
            done += span
        if done == size:
            return out[: max(0, len(h) - size + 1)]
        power = power[:-span] * np.uint64(pow(factor, span, 1 << 64)) + power[span:]
        span *= 2


def anchors(h: np.ndarray, n: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows that lie in one document, place of each one's anchor, gram hashes by place); ``n`` are the documents' words in order."""
    last = np.repeat(np.cumsum(n), n)  # end of the document that a word is of
    place = np.arange(len(h))
    start = place[place + window <= last]
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    g = _mixed(_grams(h, gram))
    least, where, span, need = g, place[: len(g)], 1, window - gram + 1
    while span < need:  # least of the first, two, four... grams from a place, the first of equal ones
        step = min(span, need - span)
        right = least[step:] < least[:-step]
        where = np.where(right, where[step:], where[:-step])
        least = np.where(right, least[step:], least[:-step])
        span += step
    return start, where[start], g


class Block:
    """A block's windows, their anchors, and the sketch's cells of these."""

    def __init__(self, row: dict, bits: int, known: dict[bytes, int]) -> None:
        self.n = np.array(row["n"], np.int64)
        self.raw = unsqueeze(row["words"])
        self.words = self.raw.split()
        h = np.fromiter((known[w] for w in self.words), np.uint64, len(self.words))
        self.start, anchor, g = anchors(h, self.n)
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]  # anchors of later windows never lie before
        self.anchor = np.cumsum(new) - 1  # by window, the number of its anchor
        self.cells = [(_mixed(g[anchor[new]], k) >> np.uint64(64 - bits)).astype(np.int64) for k in range(DEPTH)]


def _ranges(cells: np.ndarray, parts: int, bits: int):
    """(range, from, to) over ascending cells."""
    part = cells * parts >> bits
    ends = np.flatnonzero(np.diff(part, prepend=-1, append=parts + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield int(part[a]), a, b


def _spans(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of each run of consecutive numbers."""
    new = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return at[new], np.diff(new, append=len(at))


def kept_words(words: list[bytes], candidates: list, firsts: list, window: int = WINDOW) -> list[bytes]:
    """The words of a document that stay: of its candidate windows (first, number), only those at ``firsts`` are not repeats."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, n in candidates:
        gone[start : start + n] = 1
    gone[firsts] = 0
    starts = np.flatnonzero(gone)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def blocks(docs: DataFrame) -> DataFrame:
    """The documents as rows of ``BLOCKS``, their words one space apart."""
    small_batches(docs.sparkSession)
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def pack(batches):
        number, ids, n, texts, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row():
            values = (number, ids, n, squeeze(b" ".join(t for t in texts if t)))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["block", "doc_id", "n", "words"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = (text or "").encode("utf-8", "replace").split()
                ids.append(doc)
                n.append(len(found))
                texts.append(b" ".join(found))
                held += len(found)
                if held >= BLOCK or len(ids) >= DOCS:
                    yield row()
                    number, ids, n, texts, held = number + 1, [], [], [], 0
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, BLOCKS)


def sketches(cut: DataFrame, parts: int, bits: int) -> DataFrame:
    """(part, block, cells, counts): what each block adds to each range of each row of the sketch."""

    def sketch(batches):
        known, kinds = _Hashes(), (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            for row in batch.to_pylist():
                for k, cells in enumerate(Block(row, bits, known).cells):
                    cells, n = np.unique(cells, return_counts=True)
                    out = [(k * parts + part, row["block"], sorted_in(cells[a:b]), small_in(n[a:b] - 1)) for part, a, b in _ranges(cells, parts, bits)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "block", "cells", "counts"])

    return cut.mapInArrow(sketch, "part long, block long, cells binary, counts binary")


def merged(sketched: DataFrame) -> DataFrame:
    """(block, part, often): for the cells that a block sent, in order, a bit each: the merged count is over one."""

    def merge(batches):
        for group in runs(batches, ["part"]):
            cells = [sorted_out(x) for x in group.column("cells").to_pylist()]
            counts = np.concatenate([small_out(x) + 1 for x in group.column("counts").to_pylist()])
            _, which = np.unique(np.concatenate(cells), return_inverse=True)
            often = (np.bincount(which, weights=counts) > 1)[which]
            bits = [np.packbits(x).tobytes() for x in np.split(often, np.cumsum([len(c) for c in cells])[:-1])]
            yield pa.RecordBatch.from_arrays([group.column("block").combine_chunks(), group.column("part").combine_chunks(), pa.array(bits, pa.binary())], names=["block", "part", "often"])

    return sketched.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "block long, part long, often binary")


def settled(cut: DataFrame, answers: DataFrame, parts: int, bits: int, digest: bool) -> DataFrame:
    """Rows of ``SETTLED``: documents without candidate windows as kept, the others with their words and runs of candidates."""
    kept = (lambda raw: hashlib.sha256(raw).hexdigest()) if digest else (lambda raw: raw.decode("utf-8", "replace"))
    schema = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()), ("words", pa.binary()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "n", "hi", "lo")])))])
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def settle(rows: pa.Table, replies: pa.Table) -> pa.Table:
        out, known = [], _Hashes()
        for row in rows.to_pylist():  # a block is one row
            block = Block(row, bits, known)
            bit = {p: x for p, x in zip(replies.column("part").to_pylist(), replies.column("often").to_pylist(), strict=True)}
            hot = np.ones(len(block.cells[0]), bool)
            for k, cells in enumerate(block.cells):
                cells, which = np.unique(cells, return_inverse=True)
                often = [np.unpackbits(np.frombuffer(bit[k * parts + part], np.uint8), count=b - a) for part, a, b in _ranges(cells, parts, bits)]
                if often:
                    hot &= np.concatenate(often).astype(bool)[which]
            candidates = block.start[hot[block.anchor]]
            ends = np.cumsum(block.n)
            lengths = np.fromiter(map(len, block.words), np.int64, len(block.words)) + 1
            byte = np.concatenate(([0], np.cumsum(lengths)))  # where a word begins
            cut_at = np.searchsorted(candidates, np.concatenate(([0], ends)))
            for at, (doc, n, end) in enumerate(zip(row["doc_id"], block.n.tolist(), ends.tolist(), strict=True)):
                base, mine = end - n, candidates[cut_at[at] : cut_at[at + 1]]
                raw = block.raw[byte[base] : max(byte[base], byte[end] - 1)] if n else b""
                found = [{"start": s - base, "n": k} | dict(zip(("hi", "lo"), _halves(block.raw[byte[s] : byte[s + k + WINDOW - 1] - 1]), strict=True)) for s, k in zip(*(x.tolist() for x in _spans(mine)), strict=True)]
                out.append((row["block"], at, doc, signed(xxhash.xxh3_64_intdigest(raw)), n, None if found else kept(raw), squeeze(raw) if found else None, found))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return cut.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(settle, SETTLED)


def _halves(raw: bytes) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(raw), ">i8").tolist())


def first_windows(found: DataFrame) -> DataFrame:
    """(block, at, firsts): the candidate windows of ``settled`` documents that are the earliest with their words."""
    order = ["doc_id", "tie", "block", "at"]
    each = found.select(*order, F.explode("runs").alias("r")).select(*order, "r.*")
    leaders = each.groupBy("hi", "lo").agg(F.min(F.struct(*order, "start", "n")).alias("f")).select("f.*")
    leaders = leaders.groupBy(*order).agg(F.collect_list(F.struct("start", "n")).alias("leading"))
    # One number for a document's place in the order, as each of its windows carries it: sorted partitions number their rows in order.
    leaders = written(leaders.orderBy(*(F.asc_nulls_first(c) for c in order)).select("block", "at", F.monotonically_increasing_id().alias("rank"), "leading"), "substring-leaders")
    texts = found.filter("words is not null").select("block", "at", "words").join(leaders, ["block", "at"]).select("rank", "words", "leading")
    kind = pa.schema([(c, pa.int64()) for c in ("hi", "lo", "rank", "start")])

    def windows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw = unsqueeze(row["words"])
                ends = np.cumsum(np.fromiter(map(len, raw.split()), np.int64) + 1) - 1
                starts = np.concatenate(([0], ends[:-1] + 1))
                at = np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in row["leading"]])
                view = memoryview(raw)
                digests = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts[at].tolist(), ends[at + WINDOW - 1].tolist(), strict=True)])
                hi, lo = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.repeat(pa.scalar(row["rank"], pa.int64()), len(at)), pa.array(at, pa.int64())], schema=kind)

    spread = texts.mapInArrow(windows, "hi long, lo long, rank long, start long")
    earliest = spread.groupBy("hi", "lo").agg(F.min(F.struct("rank", "start")).alias("f")).select("f.*")
    return earliest.groupBy("rank").agg(F.collect_list("start").alias("firsts")).join(leaders.select("rank", "block", "at"), "rank").select("block", "at", "firsts")


def dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: the words that stay, one space apart, or with ``digest`` their SHA-256."""
    cut = written(blocks(docs), "substring-blocks")
    total = int(cut.select(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0)
    bits, parts = max(16, (ROOM * total).bit_length()), max(1, -(-total // PART))
    found = written(settled(cut, merged(sketches(cut, parts, bits)), parts, bits, digest), "substring-settled")
    firsts = first_windows(found)
    some = found.filter("words is not null").select("block", "at", "doc_id", "n_words", "words", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["n"].alias("n"))).alias("runs"))
    kept = (lambda raw: hashlib.sha256(raw).hexdigest()) if digest else (lambda raw: raw.decode("utf-8", "replace"))

    def cleaned(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                stay = kept_words(unsqueeze(row["words"]).split(), [(r["start"], r["n"]) for r in row["runs"]], row["firsts"] or [])
                out.append((row["doc_id"], row["n_words"], row["n_words"] - len(stay), kept(b" ".join(stay))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = some.join(firsts, ["block", "at"], "left").select("doc_id", "n_words", "words", "runs", "firsts")
    whole = found.filter("words is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    return whole.unionByName(joined.mapInArrow(cleaned, "doc_id long, n_words long, n_removed long, kept string"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    return dedup(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
