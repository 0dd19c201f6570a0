"""Repeated passages removed by longest-previous-factor arrays; the first copy stays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier:
in a smaller doc_id, or before in the same document. Suffix arrays cannot span
a corpus, so equal strings are first brought together:

1. Every string of ``LENGTH`` bytes is anchored at its least q-gram (by hash;
   of equal ones the leftmost). Equal strings have equal anchors, so only the
   strings around equal anchors have to meet. About one anchor in 43 bytes is
   shuffled, by hash, with a digest of its surroundings (the strings it anchors),
   never the text.
2. Anchors whose whole surroundings repeat are settled by order alone: all but
   the first are copies. Map tasks settle what they can before the shuffle, so
   a group of copies sends one row for each batch, whatever its size.
3. Where different surroundings share an anchor, the surroundings are fetched
   and sorted into a suffix array, many groups together in chunks of bounded
   size. The previous and next smaller positions in suffix order give each
   suffix its longest previous factor; factors of ``LENGTH`` and more are copies.
4. Anchors that stand in more different surroundings than fit one chunk (a
   passage that very many documents share, each with its own neighbours) are
   settled string by string as in step 2, with the strings' digests as keys.

Edge cases: a null text counts as empty; texts shorter than ``LENGTH`` lose
nothing; rows with equal doc_id count as one document after the other, by text;
null doc_ids come first; an empty table gives no rows; texts are read whole;
other columns pass through ``dedup``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.common import fresh, small_batches, written

LENGTH, GRAM = 100, 16
REACH = LENGTH - GRAM
#: Surroundings of one anchor that still go into a suffix array together, and bytes of a chunk.
MOST, CHUNK = 4096, 1 << 19
HOT_SALT = 64
FIRST = np.iinfo(np.int64).min
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))


def _pack(a: np.ndarray, n: int) -> np.ndarray:
    """The numbers that each run of ``n`` bytes (a power of two, at most 8) spells."""
    out, size = a.astype(np.uint64), 1
    while size < n:
        out = (out[:-size] << np.uint64(8 * size)) | out[size:]
        size *= 2
    return out


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, first, last): the least q-gram of every string of LENGTH bytes, and the first and last string that it anchors."""
    a = np.frombuffer(text, np.uint8)
    if len(a) < LENGTH:
        return (np.zeros(0, np.int64),) * 3
    out, block = [], 1 << 20
    for start in range(0, len(a) - LENGTH + 1, block):  # bounded memory on very long texts
        part = a[start : start + block + LENGTH - 1]
        h = _gram_hashes(part)
        # The hash's upper bits, then the position: the least is the leftmost of the least.
        low = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)
        size, window = 1, REACH + 1
        while 2 * size <= window:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < window:
            low = np.minimum(low[: len(low) - (window - size)], low[window - size :])
        out.append(start + (low & np.uint64((1 << 21) - 1)).astype(np.int64))
    found = np.concatenate(out)
    new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[new], new, np.append(new[1:], len(found)) - 1


def _gram_hashes(a: np.ndarray) -> np.ndarray:
    eight = _pack(a, 8)
    h = (eight[:-8] * MIX[0]) ^ ((eight[8:] + MIX[2]) * MIX[1])
    h ^= h >> np.uint64(29)
    h *= MIX[2]
    h ^= h >> np.uint64(32)
    return h


def longest_previous(text: np.ndarray, valid: np.ndarray, place: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which valid suffixes have a previous factor of ``length``: one that equals their first bytes and has a smaller place.

    Suffixes are sorted by their first ``length`` bytes, by doubling ranks; the
    previous and the next smaller place in that order are the only candidates.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(length, np.uint8)])
    _, rank = np.unique(_pack(padded, 8)[:n], return_inverse=True)
    size = 8
    while size < length:
        step = min(size, length - size)
        ahead = np.concatenate([rank, np.zeros(step, rank.dtype)])[step : n + step]
        _, rank = np.unique(rank.astype(np.int64) * (n + 1) + ahead, return_inverse=True)
        size += step
    at = np.flatnonzero(valid)
    order = at[np.lexsort((place[at], rank[at]))]
    pos, rk = place[order], rank[order]
    found = np.zeros(n, bool)
    for back in (True, False):
        key, r = (pos, rk) if back else (pos[::-1], rk[::-1])
        smaller = np.arange(len(key)) - 1
        # Pointer jumping to the nearest smaller place; beyond equal strings it could not be a copy.
        open_ = np.arange(1, len(key))
        while True:
            to = smaller[open_]
            open_ = open_[(to >= 0) & (r[to] == r[open_]) & (key[to] >= key[open_])]
            if not len(open_):
                break
            smaller[open_] = smaller[smaller[open_]]
        hit = (smaller >= 0) & (r[smaller] == r) & (key[smaller] < key)
        found[order if back else order[::-1]] |= hit
    return found


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans (touching ones are one run)."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[new], e[np.append(new[1:], len(s)).astype(np.int64) - 1] if len(s) else e


def numbered(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str, str]:
    """``docs`` with columns that order them: doc_id (null first), and the turn among rows of equal doc_id."""
    d, c, t = fresh(docs, "_doc"), fresh(docs, "_copy"), fresh(docs, "_body")
    base = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))).withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    twice = base.groupBy(d).count().filter("count > 1").select(d)
    if twice.isEmpty():
        return base.withColumn(c, F.lit(0)), d, c, t
    turn = (F.row_number().over(Window.partitionBy(d).orderBy(t)) - 1).cast("int")
    return base.join(twice, d, "left_anti").withColumn(c, F.lit(0)).unionByName(base.join(twice, d, "left_semi").withColumn(c, turn)), d, c, t


ROW = "h long, ctx long, doc long, copy int, at int, start int, end int"
NAMES = ["h", "ctx", "doc", "copy", "at", "start", "end"]


def _batch(columns: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=NAMES)


def _settle(h, ctx, doc, copy, at, start, end) -> pa.RecordBatch:
    """Rows of which only the first of equal (h, ctx) stays open; the others become removed spans (h and ctx null)."""
    order = np.lexsort((at, copy, doc, ctx, h))
    h, ctx, doc, copy, at, start, end = (x[order] for x in (h, ctx, doc, copy, at, start, end))
    # Two surroundings of one document may bring the same place twice: one row is enough.
    new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (h, ctx, doc, copy, at)], axis=0)]) if len(h) else np.zeros(0, bool)
    h, ctx, doc, copy, at, start, end = (x[new] for x in (h, ctx, doc, copy, at, start, end))
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (ctx[1:] == ctx[:-1])]) if len(h) else np.zeros(0, bool)
    keys = [pa.array(x, pa.int64(), mask=again) for x in (h, ctx)]
    return _batch([*keys, doc, copy, at, start, end])


def _scan(batches):
    """Anchors of every document with the digest of their surroundings."""
    for batch in batches:
        docs, copies, texts = (batch.column(k).to_pylist() for k in range(3))
        parts, ctx = [], []
        for d, c, t in zip(docs, copies, texts, strict=True):
            raw = t.encode("utf-8", "replace")
            at, start, end = anchors(raw)
            if len(at):
                end = end + LENGTH
                view = memoryview(raw)
                ctx += [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                grams = np.frombuffer(raw, np.uint8)[at[:, None] + np.arange(GRAM)].ravel()
                h = _gram_hashes(grams)[::GRAM]
                parts.append((h.view(np.int64), np.full(len(at), d), np.full(len(at), c), at, start, end))
        if parts:
            h, doc, copy, at, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield _settle(h, np.array(ctx, np.uint64).view(np.int64), doc, copy, at, start, end)


def _firsts(batches, keep: np.ndarray):
    """Over rows sorted by (h, ctx, doc, copy, at): the first of each (h, ctx) stays open, the others are removed.

    All rows of an anchor are here unless it is one of ``keep``, so an open row
    whose anchor has no other surroundings is nothing that repeats, and goes.
    """
    last, pending, many = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).fill_null(0).to_numpy() for k in range(7)]
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        again, same = np.zeros(len(null), bool), np.zeros(len(null), bool)
        again[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1]) & ~null[1:] & ~null[:-1]
        same[1:] = again[1:] & np.all([x[1:] == x[:-1] for x in cols[2:5]], axis=0)
        here = lambda k: tuple(int(x[k]) for x in cols[:5])
        if last is not None and not null[0]:
            again[0], same[0] = last[:2] == here(0)[:2], last == here(0)
        last = None if null[-1] else here(-1)

        gone = (again | null) & ~same
        if gone.any():
            empty = pa.nulls(int(gone.sum()), pa.int64())
            yield _batch([empty, empty, *(x[gone] for x in cols[2:])])
        first = [x[~again & ~null] for x in cols]
        if not len(first[0]):
            continue
        if pending is not None:
            first = [np.concatenate(x) for x in zip(pending, first, strict=True)]
        h = first[0]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(new, len(h)))
        wanted = np.repeat((size > 1) | np.isin(h[new], keep) | (h[new] == many), size) if many is not None else np.repeat((size > 1) | np.isin(h[new], keep), size)
        # The last anchor may go on in the next batch: alone so far, it waits.
        pending = [x[-1:] for x in first] if not wanted[-1] else None
        many = h[-1] if wanted[-1] else None
        if wanted.any():
            yield _batch([x[wanted] for x in first])


def _settled(rows: DataFrame, hot: list[int]) -> DataFrame:
    """Brings equal (h, ctx) together and settles them; the anchors in ``hot`` are spread by ctx."""
    keep = np.array(hot, np.int64)
    salt = F.when(F.col("h").isin(hot), F.pmod("ctx", F.lit(HOT_SALT))).otherwise(F.lit(0)) if hot else F.lit(0)
    # Spans that map tasks have settled carry no key; they are spread by document.
    by = F.when(F.col("h").isNull(), F.xxhash64("doc", "at")).otherwise(F.xxhash64("h", salt))
    dealt = rows.withColumn("by", by).repartition("by").sortWithinPartitions("h", "ctx", "doc", "copy", "at").select(*NAMES)
    return dealt.mapInArrow(lambda batches: _firsts(batches, keep), ROW)


def _suffixes(batches):
    """Rows (h, doc, copy, start, body), sorted by h, to removed spans; a chunk holds whole groups."""
    h, doc, copy, start, body, size = [], [], [], [], [], 0

    def solve(n: int):
        d, c, s = (np.array(x[:n], np.int64) for x in (doc, copy, start))
        bodies = body[:n]
        lens = np.fromiter(map(len, bodies), np.int64, n)
        text = np.frombuffer(b"".join(bodies), np.uint8)
        ends = np.cumsum(lens)
        begins = ends - lens
        row = np.repeat(np.arange(n), lens)
        inside = np.arange(len(text)) - begins[row]
        valid = inside + LENGTH <= lens[row]
        _, turn = np.unique(np.stack([d, c]), axis=1, return_inverse=True)  # documents in order
        place = (turn.ravel()[row] << 40) + s[row] + inside
        hit = np.flatnonzero(longest_previous(text, valid, place))
        if not len(hit):
            return None
        r, a = row[hit], s[row[hit]] + inside[hit]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] > a[:-1] + LENGTH)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(a)) - 1
        z = np.zeros(len(first), np.int32)
        none = pa.nulls(len(first), pa.int64())
        return _batch([none, none, d[r[first]], c[r[first]].astype(np.int32), z, a[first].astype(np.int32), (a[last] + LENGTH).astype(np.int32)])

    for batch in batches:
        for x, values in zip((h, doc, copy, start, body), (batch.column(k).to_pylist() for k in range(5)), strict=True):
            x += values
        size = sum(map(len, body))
        if size >= CHUNK:
            n = len(h)
            while n and h[n - 1] == h[-1]:
                n -= 1
            if n:
                found = solve(n)
                if found:
                    yield found
                for x in (h, doc, copy, start, body):
                    del x[:n]
    if h:
        found = solve(len(h))
        if found:
            yield found


def _strings(batches):
    """Rows (h, doc, copy, start, body) to a row for each string of LENGTH bytes, with its digest as key."""
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True))
        for k in range(0, len(rows), 2000):
            doc, copy, at, key = [], [], [], []
            for d, c, s, body in rows[k : k + 2000]:
                view = memoryview(body)
                n = len(body) - LENGTH + 1
                key += [xxhash.xxh3_128_digest(view[i : i + LENGTH]) for i in range(n)]
                doc += [d] * n
                copy += [c] * n
                at += range(s, s + n)
            two = np.frombuffer(b"".join(key), np.int64).reshape(-1, 2)
            at = np.array(at, np.int64)
            yield _settle(two[:, 0], two[:, 1], np.array(doc, np.int64), np.array(copy, np.int64), at, at, at + LENGTH)


def removed(plain: DataFrame) -> DataFrame:
    """(doc, copy, start, end): removed byte spans of documents (doc, copy, text); they may overlap."""
    spark = plain.sparkSession
    small_batches(spark, 1000)
    scanned = plain.mapInArrow(_scan, ROW)
    # Routing only: anchors with a large share of a sample of the documents are spread over partitions.
    some = plain.sample(0.01, 7).mapInArrow(_scan, ROW).filter("h is not null")
    hot = [r["h"] for r in some.groupBy("h").count().filter("count >= 64").orderBy(F.desc("count"), "h").limit(1000).collect()]  # at most 1000 numbers
    settled = written(_settled(scanned, hot), "repeats")
    open_ = settled.filter("h is not null")
    shared = open_.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    wanted = written(open_.join(shared, "h").select("h", "doc", "copy", "start", "end", (F.col("n") > MOST).alias("many")), "repeats-open")
    done = settled.filter("h is null").select("doc", "copy", "start", "end")

    need = wanted.groupBy("doc", "copy").agg(F.collect_list(F.struct("h", "start", "end", "many")).alias("places"))  # bounded by the document
    cut = plain.join(need, ["doc", "copy"]).select("doc", "copy", "text", "places")

    def bodies(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for d, c, t, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = t.encode("utf-8", "replace")
                for p in places:
                    for x, v in zip(out, (p["h"], d, c, p["start"], raw[p["start"] : p["end"]], p["many"]), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], names=["h", "doc", "copy", "start", "body", "many"])

    around = written(cut.mapInArrow(bodies, "h long, doc long, copy int, start int, body binary, many boolean"), "repeats-around")
    few = around.filter("not many").select("h", "doc", "copy", "start", "body").repartition("h").sortWithinPartitions("h", "doc", "copy", "start")
    by_suffix = few.mapInArrow(_suffixes, ROW)
    strings = around.filter("many").select("h", "doc", "copy", "start", "body").mapInArrow(_strings, ROW)
    by_string = _settled(strings, []).filter("h is null")
    return done.unionByName(by_suffix.select("doc", "copy", "start", "end")).unionByName(by_string.select("doc", "copy", "start", "end"))


def _with_spans(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with its body and an array of removed spans."""
    frame, d, c, t = numbered(docs)
    spans, mine = fresh(frame, "_removed"), ("_sd", "_sc")
    found = removed(frame.select(F.col(d).alias("doc"), F.col(c).alias("copy"), F.col(t).alias("text")).filter(F.octet_length("text") >= LENGTH))
    lists = found.groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "end")).alias(spans)).withColumnsRenamed({"doc": mine[0], "copy": mine[1]})
    joined = frame.join(lists, (frame[d] == lists[mine[0]]) & (frame[c] == lists[mine[1]]), "left").drop(*mine, d, c)
    return joined, t, spans


def _keep(raw: bytes, spans: list | None) -> tuple[bytes, int, int]:
    """What remains, the bytes removed and the number of maximal removed runs."""
    if not spans:
        return raw, 0, 0
    s, e = merged(np.array([x["start"] for x in spans], np.int64), np.array([x["end"] for x in spans], np.int64))
    edges = zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True)
    return b"".join([raw[a:b] for a, b in edges]), int((e - s).sum()), len(s)


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of the text (a character cut in two becomes the replacement character)."""
    joined, body, spans = _with_spans(docs)
    names = docs.columns

    def run(batches):
        for batch in batches:
            n = len(names)
            kept = [_keep(t.encode("utf-8", "replace"), x)[0].decode("utf-8", "replace") for t, x in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            columns = [pa.array(kept, pa.string()) if x == "text" else batch.column(k) for k, x in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*(F.col(f"`{c}`") for c in names), body, spans).mapInArrow(run, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    joined, body, spans = _with_spans(docs.select("doc_id", "text"))

    def run(batches):
        for batch in batches:
            raws = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            kept = [_keep(raw, x) for raw, x in zip(raws, batch.column(2).to_pylist(), strict=True)]
            columns = [batch.column(0), [len(raw) for raw in raws], [k[1] for k in kept], [k[2] for k in kept], [hashlib.sha256(k[0]).hexdigest() for k in kept]]
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([x if k == 0 else pa.array(x, kinds[k]) for k, x in enumerate(columns)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), body, spans).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
