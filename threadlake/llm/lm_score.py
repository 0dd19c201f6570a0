"""Stupid-backoff language-model scores of a corpus by its own n-gram counts.

The score of a document is the sum over its words of log S: for a word with two
words before it, c(abc) / c(ab) where the trigram occurs at least ``CUTOFF``
times in the corpus, else ``BACKOFF`` * c(bc) / c(b); for the second word
c(bc) / c(b); for the first c(b) / N.

Documents are cut into blocks of ``BLOCK`` words, written once as word hashes.
A block explodes into its distinct n-grams of orders 1 to 3, each a 62-bit
hash above two bits for the order, with the block's own count. The count tables are partitioned by ranges of
that hash: each block sends each range one sorted slice, the range sums what
the blocks sent and returns the totals in the slice's order. Totals are then
joined to their block, where the n-grams stand at hand, and summed by document.
Slices travel packed (differences of sorted hashes), so a word as frequent as
may be is one entry of each block, and no row stands for a token.

Counts cover all documents and are exact up to equality of 62-bit hashes.

Edge cases: null and empty texts score 0 with 0 words; one-word texts have the
first term only; a text longer than a block goes on in the next one; equal rows
are scored each (and counted each); an empty table gives no rows; ties do not
arise; only doc_id and text are read.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import small_batches, written

CUTOFF, BACKOFF = 2, 0.4
#: Words of a block, and n-grams (of all blocks together, at most) in a range of hashes: what a task holds.
BLOCK, PART = 5_500_000, 3_000_000
#: Bytes of a text that are split into words at a time, and words whose n-grams are hashed at a time.
CHUNK, STEP = 1 << 22, 1 << 19
SPACE = re.compile(rb"[ \t-\r]")
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))
BLOCKS = "block long, rid array<long>, doc_id array<long>, before array<int>, n array<int>, tokens long, words binary, ids binary"


class _Hashes(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def word_hashes(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """The hash of each word of a text."""
    raw, at, found = (text or "").encode("utf-8", "replace").lower(), 0, [np.zeros(0, np.uint64)]
    while at < len(raw):
        stop = SPACE.search(raw, at + CHUNK)
        end = stop.end() if stop else len(raw)
        words = raw[at:end].split()
        found.append(np.fromiter((known[w] for w in words), np.uint64, len(words)))
        at = end
    return np.concatenate(found)


def _squeeze(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 8 or 4 bytes, byte plane by byte plane: where they are small, the upper planes vanish."""
    planes = [_squeeze(p.tobytes()) for p in x.view(np.uint8).reshape(-1, x.itemsize).T]
    return np.array([len(x), *map(len, planes)], "<u4").tobytes() + b"".join(planes)


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    n, *sizes = np.frombuffer(raw[: 4 * width + 4], "<u4").tolist()
    out, at = np.empty((n, width), np.uint8), 4 * width + 4
    for k, size in enumerate(sizes):
        out[:, k] = np.frombuffer(pa.decompress(raw[at : at + size], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
        at += size
    return out.view(kind).reshape(-1)


def _sorted_in(x: np.ndarray) -> bytes:
    """Numbers of which most follow a slightly smaller one (differences wrap)."""
    return _planes(np.diff(x, prepend=np.uint64(0)))


def _sorted_out(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, np.uint64), dtype=np.uint64)


def _counts_in(x: np.ndarray) -> bytes:
    """Counts, nearly all of them small: one byte each, the larger ones after them."""
    small = _squeeze(np.minimum(x, 255).astype(np.uint8).tobytes())
    return np.array([len(x), len(small)], "<u4").tobytes() + small + x[x >= 255].astype("<i8").tobytes()


def _counts_out(raw: bytes) -> np.ndarray:
    n, size = np.frombuffer(raw[:8], "<u4").tolist()
    x = np.frombuffer(pa.decompress(raw[8 : 8 + size], decompressed_size=n, codec="zstd", asbytes=True), np.uint8).astype(np.int64)
    x[x == 255] = np.frombuffer(raw[8 + size :], "<i8")
    return x


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts in 32 bits, where they fit."""
    return x if x.max(initial=0) >> 32 else x.astype(np.uint32)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes in order."""
    h = y * MIX[1]
    h += (x ^ (y >> np.uint64(31))) * MIX[0]
    h ^= h >> np.uint64(29)
    h *= MIX[2]
    h ^= h >> np.uint64(32)
    return h


class Block:
    """The words of a block, in the order of its pieces."""

    def __init__(self, row: dict) -> None:
        self.n = np.array(row["n"], np.int64)
        words, ids = _sorted_out(row["words"]), _unplanes(row["ids"], np.uint32)
        self.words = words[ids] if len(ids) else np.zeros(0, np.uint64)
        del words, ids
        place = np.arange(len(self.words), dtype=np.int32)
        place -= np.repeat((np.cumsum(self.n) - self.n).astype(np.int32), self.n)
        #: Words before a word in its piece, as far as they matter.
        self.place = np.minimum(place, 2).astype(np.uint8)
        #: Words that stand here only because the next piece of their text needs them are counted elsewhere.
        self.own = self.place >= np.repeat(np.array(row["before"], np.uint8), self.n)

    def keys(self, order: int) -> np.ndarray:
        """By place, the n-gram of an order (0, 1 or 2 words before the last) that ends there; without meaning where a piece has no such."""
        w, out = self.words, np.zeros(len(self.words), np.uint64)
        for low in range(order, len(w), STEP):
            high = min(len(w), low + STEP)
            h = w[low - order : high - order]
            for k in range(order):
                last = w[low - order + k + 1 : high - order + k + 1]
                h = _pair(h, ~last if k else last)
            out[low:high] = (h & ~np.uint64(3)) | np.uint64(order)
        return out


def requests(block: Block, parts: int):
    """(range, distinct n-grams of all orders, sorted, how often each ends in the block) by range of hashes."""
    ends = [block.place >= order for order in range(3)]
    keys, at, foreign = np.empty(sum(map(np.count_nonzero, ends)), np.uint64), 0, []
    for order, fits in enumerate(ends):
        found = block.keys(order)
        foreign.append(found[fits & ~block.own])
        found = found[fits]
        keys[at : at + len(found)] = found
        at += len(found)
        del found
    del ends, fits
    keys.sort()
    foreign = np.sort(np.concatenate(foreign))
    at = 0
    while at < len(keys):
        part = int(keys[at] >> np.uint64(32)) * parts >> 32
        least = -(-((part + 1) << 32) // parts) << 32  # of the next range
        end = len(keys) if least >= 1 << 64 else int(np.searchsorted(keys, np.uint64(least)))
        there, n = np.unique(keys[at:end], return_counts=True)
        other = foreign[np.searchsorted(foreign, there[0]) : np.searchsorted(foreign, there[-1], "right")]
        np.subtract.at(n, np.searchsorted(there, other), 1)
        yield part, there, n
        at = end


def block_scores(block: Block, totals: list[np.ndarray], tokens: int) -> np.ndarray:
    """The sum of log S over each piece's own words; ``totals`` are by order those of the block's requests, in their order."""
    s, before = np.zeros(len(block.words)), None
    for order, total in enumerate(totals):
        keys, now, done = block.keys(order), np.zeros(len(block.words), total.dtype), 0
        # By the upper four bits, so that only a part is sorted at a time. (numpy looks up sorted keys faster than others.)
        upper = keys.view(np.uint8)[7::8] >> 4 if sys.byteorder == "little" else keys.view(np.uint8)[::8] >> 4
        for k in range(16):
            ends = np.flatnonzero((upper == k) & (block.place >= order))
            by = np.argsort(keys[ends])
            ends = ends[by]
            there = keys[ends]
            new = np.ones(len(ends), bool)
            new[1:] = there[1:] != there[:-1]
            now[ends] = total[done + np.cumsum(new) - 1]
            done += np.count_nonzero(new)
        del keys, upper
        if order == 0:
            at = np.flatnonzero(block.own & (block.place == 0))
            s[at] = np.log(now[at] / tokens)
        elif order == 1:
            at = np.flatnonzero(block.own & (block.place >= 1))
            s[at] = np.log(now[at] / before[at - 1])
            s[block.own & (block.place > 1)] += np.log(BACKOFF)
        else:
            at = np.flatnonzero(block.own & (block.place >= 2) & (now >= CUTOFF))
            s[at] = np.log(now[at] / before[at - 1])
        before = now
    return np.bincount(np.repeat(np.arange(len(block.n)), block.n), weights=s, minlength=len(block.n)).astype(np.float64)


def blocks(docs: DataFrame) -> DataFrame:
    """The documents as rows of ``BLOCKS``: pieces of texts, and the words of all pieces as numbers of a sorted dictionary."""

    def row(number: int, pieces: list) -> pa.RecordBatch:
        h = np.concatenate([p[3] for p in pieces])
        words, ids, n = np.unique(h, return_inverse=True, return_counts=True)
        common = np.lexsort((words, -n))  # frequent words get small numbers, which pack well; the many rare ones stay in order
        rank = np.empty(len(words), np.uint32)
        rank[common] = np.arange(len(words), dtype=np.uint32)
        values = [number, *([p[k] for p in pieces] for k in range(3)), [len(p[3]) for p in pieces], sum(len(p[3]) - p[2] for p in pieces), _sorted_in(words[common]), _planes(rank[ids])]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    def pack(batches):
        known, base, done, number, pieces, held = _Hashes(), TaskContext.get().partitionId() << 36, 0, 0, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, at = word_hashes(text, known), 0
                while True:
                    start, end = max(0, at - 2), min(len(h), at + BLOCK - held)
                    pieces.append((base + done, doc, at - start, h[start:end]))
                    held, at = held + end - at, end
                    if held >= BLOCK:
                        yield row(base + number, pieces)
                        number, pieces, held = number + 1, [], 0
                    if at >= len(h):
                        break
                done += 1
        if pieces:
            yield row(base + number, pieces)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, BLOCKS)


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_score) of every row."""
    small_batches(docs.sparkSession, 4000)
    cut = written(blocks(docs), "lm-blocks")
    tokens = int(cut.agg(F.sum("tokens").alias("n")).first()["n"] or 0)
    parts = max(1, -(-3 * tokens // PART))

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for part, keys, n in requests(Block(row), parts):
                    values = zip([part, row["block"], _sorted_in(keys), _counts_in(n)], (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], names=["part", "block", "keys", "n"])

    def add_up(group: pa.Table) -> pa.Table:
        slices = [_sorted_out(x) for x in group.column("keys").to_pylist()]
        ends = np.cumsum([len(x) for x in slices])[:-1]
        keys, n = np.concatenate(slices), np.concatenate([_counts_out(x) for x in group.column("n").to_pylist()])
        del slices
        order = np.argsort(keys, kind="stable")  # sorted runs, which it merges
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        del keys
        which = np.empty(len(order), np.int32)
        which[order] = np.cumsum(new, dtype=np.int32) - 1
        del order, new
        total = np.bincount(which, weights=n).astype(np.int64)[which]
        del which, n
        by_order = [[], [], []]
        for keys, there in zip((_sorted_out(x) for x in group.column("keys").to_pylist()), np.split(total, ends), strict=True):
            for k, out in enumerate(by_order):
                out.append(_counts_in(there[keys & np.uint64(3) == np.uint64(k)]))
        return pa.table({"block": group.column("block"), "part": group.column("part")} | {f"n{k}": pa.array(x, pa.binary()) for k, x in enumerate(by_order)})

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")
        totals = [np.concatenate([np.zeros(0, np.uint32), *map(_narrow, map(_counts_out, answers.column(f"n{k}").to_pylist()))]) for k in range(3)]
        out = []
        for row in rows.to_pylist():  # a block is one row
            block = Block(row)
            n = block.n - np.array(row["before"], np.int64)
            out.append(pa.table({"rid": pa.array(row["rid"], pa.int64()), "doc_id": pa.array(row["doc_id"], pa.int64()), "n": n, "s": block_scores(block, totals, tokens)}))
        return pa.concat_tables(out) if out else pa.table({"rid": [], "doc_id": [], "n": [], "s": []}, schema=pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("s", pa.float64())]))

    asked = cut.mapInArrow(ask, "part long, block long, keys binary, n binary")
    answered = asked.groupBy("part").applyInArrow(add_up, "block long, part long, n0 binary, n1 binary, n2 binary")
    pieces = cut.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, "rid long, doc_id long, n long, s double")
    whole = pieces.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_words"), F.sum("s").alias("s"))
    return whole.select("doc_id", "n_words", F.round("s", 6).alias("log_score"))
