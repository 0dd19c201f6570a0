"""Benchmark decontamination by the q-gram lemma and banded alignment.

A passage of m characters that occurs with at most k edits shares at least
m - q + 1 - k*q q-grams with its occurrence, all on diagonals (text position
less passage position) within k of each other. For every text, the q-grams it
shares with the benchmark are counted by passage and diagonal band; bands
overlap by half, so each occurrence lies in one whole. Bands that reach the
bound are verified by a banded alignment of the passage, all bands of a passage
together, unless the passage stands in the text exactly.

Texts and passages are compared code point by code point, in lower case, with
one space for each run of ASCII characters that are no letters or digits
(punctuation of other scripts counts as it is). The edit budget is ``EDITS`` of the passage's length, less
where a short passage would leave the lemma nothing to count; passages of fewer
than ``Q`` characters must occur exactly, as whole words.

A q-gram that many passages of a block share is left out of the passages that
can do without it, and their bound is lowered by as many, so that no candidate
is lost; what is left is expanded in slices of bounded size.

The benchmark is the stated query set: it goes out in blocks of bounded size,
each held against all documents in one pass without a shuffle.

Edge cases: null or empty texts match nothing, and null or empty passages are
never found; equal passages are found under each of their ids; a passage found
more than once in a text is reported once, at its best place (ties: the first);
repeated rows are reported each; empty tables give no rows; texts are read
whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import plain_names, small_batches

Q, EDITS = 10, 0.08
#: Characters of the benchmark in one block, and of texts scanned together.
BLOCK_CHARS, TOGETHER = 1 << 21, 1 << 20
#: Passages that may share a q-gram before it is left out, and shared q-grams that are expanded together.
COMMON, SLICE = 32, 1 << 22
#: Cells of the alignments that are computed together.
CELLS = 1 << 20
BREAK = 1
ASCII = np.array([48 <= c < 58 or 97 <= c < 123 for c in range(128)])
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def plain(text: str | None) -> np.ndarray:
    """The code points of a text in lower case, everything else than letters and digits as spaces; as many as before."""
    lowered = (text or "").replace("\u0130", "i").lower().encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(lowered, "<u4").astype(np.uint32)
    points[(points < 128) & ~ASCII[np.minimum(points, 127)]] = 32
    return points


def padded(text: str | None) -> np.ndarray:
    """``plain`` between two spaces."""
    space = np.array([32], np.uint32)
    return np.concatenate([space, plain(text), space])


def squeeze(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``raw`` with runs of spaces made one, and where its code points came from."""
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    at = np.flatnonzero(keep)
    return raw[at], at


def grams(a: np.ndarray) -> np.ndarray:
    """A 64-bit number for each run of Q = 10 code points."""
    if len(a) < Q:
        return np.zeros(0, np.uint64)
    two = a.astype(np.uint64)
    two = two[:-1] * BASE + two[1:]
    four = two[:-2] * BASE**2 + two[2:]
    ten = (four[:-4] * BASE**4 + four[4:])[: len(a) - Q + 1] * BASE**2 + two[8:]
    ten ^= ten >> np.uint64(29)
    return ten * MIX


def place_of(passage: np.ndarray, text: np.ndarray) -> int:
    """Where a passage first occurs in a text exactly, or -1."""
    raw, want = text.tobytes(), passage.tobytes()
    at = raw.find(want)
    while at >= 0 and at % 4:
        at = raw.find(want, at + 1)
    return at // 4


def budget(m: int) -> int:
    """Edits allowed for a passage of ``m`` characters, so that the lemma asks for one shared q-gram at least."""
    return max(0, min(int(EDITS * m), (m - Q) // Q))


class Index:
    """The q-grams of a block of passages."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        cleaned = [(i, squeeze(padded(t))[0]) for i, t in items]
        cleaned = [(i, a) for i, a in cleaned if len(a) > 2]
        self.short = [(i, a) for i, a in cleaned if len(a) - 2 < Q]
        self.items = [(i, a[1:-1]) for i, a in cleaned if len(a) - 2 >= Q]
        self.sizes = np.array([len(a) for _, a in self.items], np.int64)
        self.budgets = np.array([budget(int(m)) for m in self.sizes], np.int64)
        #: Shared q-grams in a band from which on a passage is verified.
        self.least = self.sizes - Q + 1 - self.budgets * Q
        found = [grams(a) for _, a in self.items]
        key = np.concatenate([np.zeros(0, np.uint64), *found])
        item = np.repeat(np.arange(len(found)), [len(g) for g in found])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in found)])
        order = np.argsort(key, kind="stable")
        key, item, place = key[order], item[order], place[order]
        _, which, n = np.unique(key, return_inverse=True, return_counts=True)
        # the most common q-grams of a passage go first, as long as one of its others must still be shared
        common = np.flatnonzero(n[which] > COMMON)
        common = common[np.lexsort((-n[which[common]], item[common]))]
        starts = np.flatnonzero(np.append(True, item[common][1:] != item[common][:-1])[: len(common)])
        nth = np.arange(len(common)) - np.repeat(starts, np.diff(np.append(starts, len(common))))
        gone = common[nth < self.least[item[common]] - 1]
        self.least -= np.bincount(item[gone], minlength=len(self.items))
        keep = np.ones(len(key), bool)
        keep[gone] = False
        key, self.item, self.place = key[keep], item[keep], place[keep]
        self.keys, self.starts = np.unique(key, return_index=True)
        self.ends = np.append(self.starts[1:], len(key))
        self.shift = np.uint64(64 - 22)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys * BASE) >> self.shift] = True

    def hits(self, text: np.ndarray):
        """Slices of (text position, passage, passage position) of every shared q-gram, of bounded size."""
        if not len(self.keys):
            return
        for low in range(0, len(text) - Q + 1, TOGETHER):
            g = grams(text[low : low + TOGETHER + Q - 1])
            at = np.flatnonzero(self.seen[(g * BASE) >> self.shift])
            k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
            same = self.keys[k] == g[at]
            at, k = at[same] + low, k[same]
            n = self.ends[k] - self.starts[k]
            upto = np.cumsum(n)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SLICE, "right")))
                m = n[a:b]
                row = np.repeat(np.arange(a, b), m)
                post = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m) + self.starts[k][row]
                yield at[row], self.item[post], self.place[post]
                a = b


def align(item: np.ndarray, whole: np.ndarray, begins: np.ndarray, lengths: np.ndarray, lows: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best occurrence in each band: the ``width`` diagonals from ``lows`` on of the text at ``begins`` in ``whole``; edits are ``most`` + 1 where there is none."""
    steps, n = np.arange(width), len(lows)
    edits, start, end = np.full(n, most + 1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    live, begins, lengths = np.arange(n), begins[:, None], lengths[:, None]
    j0 = lows[:, None] + steps  # the text position before which a diagonal begins
    cost, begin = np.where((j0 >= 0) & (j0 <= lengths), 0, most + 1).astype(np.int64), j0.copy()
    for i, c in enumerate(item.tolist()):
        j = j0 + i
        other = whole[np.clip(begins + j, 0, len(whole) - 1)] != c
        pair = np.where((j >= 0) & (j < lengths), cost + other, most + 1)
        skip = np.full_like(cost, most + 2)  # a passage character without its own in the text
        skip[:, :-1] = cost[:, 1:] + 1
        came = np.zeros_like(begin)
        came[:, :-1] = begin[:, 1:]
        new, origin = np.minimum(skip, pair), np.where(skip < pair, came, begin)
        # text characters without their own in the passage: along the row, each one edit more
        run = np.minimum.accumulate(new - steps, axis=1)
        far = run + steps
        if (far < new).any():
            source = np.maximum.accumulate(np.where(new - steps == run, steps, 0), axis=1)
            origin = np.where(far < new, np.take_along_axis(origin, source, 1), origin)
        cost, begin = far, origin
        good = cost.min(axis=1) <= most
        if not good.all():
            live, begins, lengths, j0, cost, begin = (x[good] for x in (live, begins, lengths, j0, cost, begin))
            if not len(live):
                return edits, start, end
    b, row = cost.argmin(axis=1), np.arange(len(live))
    edits[live], start[live], end[live] = cost[row, b], begin[row, b], j0[row, b] + len(item)
    return edits, start, end


def _bands(index: Index, whole: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, passage, band) of every diagonal band with enough shared q-grams. Band b covers 2 * budget + 1 diagonals, twice."""
    span = 2 * index.budgets + 1
    #: Text, passage and band in one number: bands lie between -size and the texts' length.
    far = int(len(whole) + index.sizes.max(initial=0) + 2)
    keys, counts, held = [], [], 0

    def together() -> tuple[np.ndarray, np.ndarray]:
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)

    for at, item, place in index.hits(whole):
        doc = np.searchsorted(ends, at, side="right")
        band = (at - starts[doc] - place) // span[item] + far // 2
        key, n = np.unique((doc * len(index.items) + item) * (2 * far) + band, return_counts=True)
        keys.append(key)
        counts.append(n)
        held += len(key)
        if held > 2 * SLICE and len(keys) > 1:
            key, n = together()
            keys, counts, held = [key], [n], len(key)
    if not keys:
        return []
    key, n = together()
    # bands overlap by half: a window is a band and the next one
    both = n.copy()
    nxt = np.searchsorted(key, key + 1)
    nxt[nxt == len(key)] = 0
    both += np.where(key[nxt] == key + 1, n[nxt], 0)
    before = key - 1
    alone = ~np.isin(before, key)
    windows, shared = np.concatenate([key, before[alone]]), np.concatenate([both, n[alone]])
    item = windows // (2 * far) % len(index.items)
    windows, item = windows[fits := shared >= index.least[item]], item[fits]
    return sorted(zip((windows // (2 * far) // len(index.items)).tolist(), item.tolist(), (windows % (2 * far) - far // 2).tolist(), strict=True))


def find(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item id, edits, start, end) of every passage found; start and end are code points of the text."""
    raws = [padded(t) for t in texts]
    joined = [x for r in raws for x in (r, np.array([BREAK], np.uint32))]
    whole, origin = squeeze(np.concatenate(joined)[:-1])
    breaks = np.flatnonzero(whole == BREAK)
    starts, ends = np.concatenate([[0], breaks + 1]), np.append(breaks, len(whole))
    offsets = np.cumsum([0, *(len(r) + 1 for r in raws)])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    near: dict[int, list[tuple[int, int]]] = {}
    for d, i, b in _bands(index, whole, starts, ends):
        if (d, i) in best:  # bands rise, so no later one holds an earlier place
            continue
        k = int(index.budgets[i])
        span, text, passage = 2 * k + 1, whole[starts[d] : ends[d]], index.items[i][1]
        low, high = b * span - k, (b + 2) * span - 1 + k
        a = max(0, low)
        exact = place_of(passage, text[a : max(a, high + len(passage) + 1)])
        if exact >= 0:
            best[d, i] = (0, a + exact, a + exact + len(passage))
        else:
            near.setdefault(i, []).append((d, low))
    for i, bands in near.items():
        k, passage = int(index.budgets[i]), index.items[i][1]
        bands = [(d, low) for d, low in bands if best.get((d, i), (1,))[0]]
        width = 6 * k + 2
        for a in range(0, len(bands), many := max(1, CELLS // width)):
            of, lows = np.array(bands[a : a + many], np.int64).T
            for d, *found in zip(of.tolist(), *(x.tolist() for x in align(passage, whole, starts[of], ends[of] - starts[of], lows, width, k)), strict=True):
                if found[0] <= k and ((d, i) not in best or tuple(found[:2]) < best[d, i][:2]):
                    best[d, i] = tuple(found)
    out = [(d, index.items[i][0], edits, a, b) for (d, i), (edits, a, b) in sorted(best.items())]
    for item_id, passage in index.short:
        for d in range(len(texts)):
            a = place_of(passage, whole[starts[d] : ends[d]])
            if a >= 0:
                out.append((d, item_id, 0, a + 1, a + len(passage) - 1))

    def point(d: int, a: int) -> int:
        """The code point of the text that stands at place ``a`` of its squeezed form."""
        here = starts[d] + a
        return (int(origin[here]) if here < len(origin) else len(joined)) - int(offsets[d]) - 1

    return [(d, i, edits, max(0, point(d, a)), min(len(texts[d] or ""), point(d, b - 1) + 1)) for d, i, edits, a, b in out]


def together(texts: list[str | None]):
    """(first place, texts) of runs of about ``TOGETHER`` characters at most, or of one text."""
    a, size = 0, 0
    for b, t in enumerate(texts):
        if b > a and size + len(t or "") > TOGETHER:
            yield a, texts[a:b]
            a, size = b, 0
        size += len(t or "")
    if texts:
        yield a, texts[a:]


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS):
    """The passages in lists of about ``most`` characters at most, however large the benchmark."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and length(text) > 0")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-int(total) // most)
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_id, edits, start, end) for every document and passage found in it."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias(key), F.col("text").cast("string").alias("text"))
    schema = source.select(key).schema
    for name in ("item_id", "edits", "start", "end"):
        schema = schema.add(name, "long")
    out = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # of bounded size, see blocks

        def run(batches, shared=shared):
            index = Index(shared.value)
            for batch in batches:
                rows = [(d + a, *rest) for a, texts in together(batch.column(1).to_pylist()) for d, *rest in find(texts, index)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                taken = batch.column(0).take(pa.array(columns[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, *(pa.array(c, pa.int64()) for c in columns[1:])], names=[key, "item_id", "edits", "start", "end"])

        out = out.unionByName(source.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no passage is found, with their columns as they were."""
    small_batches(docs.sparkSession)
    names, kept = docs.columns, plain_names(docs)
    schema = kept.schema
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # of bounded size, see blocks

        def run(batches, shared=shared):
            index = Index(shared.value)
            for batch in batches:
                texts, clean = batch.column(names.index("text")).cast(pa.string()).to_pylist(), np.ones(batch.num_rows, bool)
                for a, some in together(texts):
                    clean[[a + d for d, *_ in find(some, index)]] = False
                yield batch.filter(pa.array(clean))

        kept = kept.mapInArrow(run, schema)
    return kept.toDF(*names)
