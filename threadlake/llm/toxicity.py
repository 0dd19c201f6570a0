"""Toxicity by a small convolutional network over hashed words.

A word is hashed whole and by its leading 4 to 7 letters, so inflected and
unseen forms share what is learnt of a stem; its embedding is the sum over those
buckets. Filters of several widths run over a text's embeddings, and the largest response of each filter over the
whole text goes into a logistic output. The network is fitted in numpy on a
bounded sample of labelled rows (``SAMPLE`` of each class, chosen by hash), and
applied to every whole text inside Spark tasks. There each filter is multiplied
into the embeddings of a batch's distinct words once, so a text costs table
look-ups and additions.

Scores are calibrated on held-back training rows: 0.3 is where toxic and clean
rows part best. ``thresholds`` are calibrated by language on the same rows;
language decides only which threshold a row is held against, never its score.

Edge cases: null and empty texts (and texts without words) get the score of no
evidence at all; equal texts get equal scores; with fewer than ten labelled
rows, or with one label only, every score is the prior: the share of toxic ones
among them, 0 without any; repeated rows are scored each, and count once in
fitting; an empty table gives no rows; only doc_id, text and lang are read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import small_batches

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
STEMS = (4, 5, 6, 7)
PARTS = 1 + len(STEMS)
#: At most so many labelled rows of each class are drawn for fitting.
SAMPLE = 1500
#: Buckets seen in fewer training texts than this share the bucket of the unknown.
LEAST_TEXTS = 3
EPOCHS, BATCH, RATE, CUT = 8, 32, 0.02, 0.3
#: Texts scored together, and words remembered between them.
TOGETHER, REMEMBERED = 250, 200_000
WORD = re.compile(r"[^\W\d_]+")


def parts(word: str) -> list[int]:
    """The buckets of a word and of its stems; bucket 0 stands for none."""
    raw = [word, *(f"{word[:k]}-" if len(word) > k else "" for k in STEMS)]
    return [1 + zlib.crc32(x.encode("utf-8", "replace")) % (BUCKETS - 1) if x else 0 for x in raw]


class Words(dict):
    """word -> row of ``table``, which holds the buckets of each word; row 0 is padding."""

    def __init__(self) -> None:
        self.rows = [[0] * PARTS]

    def __missing__(self, word: str) -> int:
        self.rows.append(parts(word))
        self[word] = n = len(self.rows) - 1
        return n

    def ids(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        return np.fromiter((self[w] for w in words), np.int32, len(words))

    def table(self) -> np.ndarray:
        return np.array(self.rows, np.int32)


@dataclass
class Network:
    """Embeddings, filters and output of the network, with its calibration."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    #: The score of every text, where there was nothing to learn from.
    prior: float | None = None

    def vectors(self, table: np.ndarray) -> np.ndarray:
        """The embeddings of words, given their buckets."""
        return sum((self.embed[table[:, k]] for k in range(1, PARTS)), self.embed[table[:, 0]])

    def tables(self, table: np.ndarray) -> list[list[np.ndarray]]:
        """For each width and offset, the response of each word."""
        vectors = self.vectors(table)
        return [[vectors @ w[k] for k in range(len(w))] for w in self.filters]

    def pooled(self, ids: np.ndarray, tables: list[list[np.ndarray]], block: int = 1 << 16) -> np.ndarray:
        """The largest response of each filter over a whole text (padded by width - 1 on both sides)."""
        out = []
        for table in tables:
            pad = np.zeros(len(table) - 1, np.int32)
            padded = np.concatenate([pad, ids, pad]) if len(ids) else np.zeros(len(table), np.int32)
            n = len(padded) - len(table) + 1
            best = np.full(table[0].shape[1], -np.inf, np.float32)
            for a in range(0, n, block):  # bounded memory on very long texts
                b = min(n, a + block)
                total = table[0][padded[a:b]]
                for k in range(1, len(table)):
                    total = total + table[k][padded[a + k : b + k]]
                best = np.maximum(best, total.max(axis=0))
            out.append(best)
        return np.maximum(np.concatenate(out) + self.bias, 0)

    def logits(self, texts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        tables = self.tables(table)
        return np.array([float(self.pooled(ids, tables) @ self.out) + self.out_bias for ids in texts])

    def scores(self, logits: np.ndarray) -> np.ndarray:
        """Calibrated: a logit at ``shift`` scores exactly the cut."""
        if self.prior is not None:
            return np.full(len(logits), self.prior)
        z = self.scale * (logits - self.shift) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[np.ndarray], labels: np.ndarray, table: np.ndarray, seed: int = 11) -> Network:
    """Fits the network by Adam on the logistic loss, gradients through the maxima only."""
    rng = np.random.default_rng(seed)
    # The first dimension starts as each bucket's smoothed log-odds, so filters have something to hold on to.
    pos, neg = np.ones(BUCKETS), np.ones(BUCKETS)
    for ids, y in zip(texts, labels, strict=True):
        (pos if y else neg)[np.unique(table[ids])] += 1
    known = pos + neg - 2 >= LEAST_TEXTS
    known[0] = False
    table = np.where(known[table], table, 0)
    embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    embed[:, 0] = np.where(known, np.log(pos / (labels.sum() + 2)) - np.log(neg / (len(labels) - labels.sum() + 2)), 0)
    embed[~known] = 0
    net = Network(embed, [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0.2, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), -1.0)
    for w in net.filters:
        w[:, 0, :] = np.abs(w[:, 0, :]) + 0.2
    params = [net.embed, *net.filters, net.bias, net.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    step, out_state = 0, [0.0, 0.0]
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            grads = [np.zeros_like(p) for p in params[1:]]
            rows, row_grads, g_bias_out = [], [], 0.0
            for t in batch:
                pooled, where = [], []
                for w in net.filters:
                    width = len(w)
                    pad = np.zeros(width - 1, np.int32)
                    padded = np.concatenate([pad, texts[t], pad]) if len(texts[t]) else np.zeros(width, np.int32)
                    e = net.vectors(table[padded])
                    n = len(padded) - width + 1
                    total = sum(e[k : k + n] @ w[k] for k in range(width))
                    best = total.argmax(axis=0)
                    pooled.append(total[best, np.arange(FILTERS)])
                    where.append((padded, best))
                z = np.concatenate(pooled) + net.bias
                h = np.maximum(z, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.out_bias, -30, 30)))
                g = float((p - labels[t]) * weight[t]) / len(batch)
                grads[-1] += g * h
                g_bias_out += g
                gz = g * net.out * (z > 0)
                grads[-2] += gz
                for k, (w, (padded, best)) in enumerate(zip(net.filters, where, strict=True)):
                    own = gz[k * FILTERS : (k + 1) * FILTERS]
                    for d in range(len(w)):
                        own_parts = table[padded[best + d]]
                        grads[k][d] += (net.vectors(own_parts) * own[:, None]).T
                        rows.append(own_parts.ravel())
                        row_grads.append(np.repeat(w[d].T * own[:, None], PARTS, axis=0))
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            ids, back = np.unique(np.concatenate(rows), return_inverse=True)
            g_embed = np.zeros((len(ids), DIM), np.float32)
            np.add.at(g_embed, back, np.concatenate(row_grads))
            g_embed[ids == 0] = 0  # padding and the unknown stay at nothing
            for p, m, v, g, part in [(params[0], first[0], second[0], g_embed, ids)] + [(p, m, v, g, slice(None)) for p, m, v, g in zip(params[1:], first[1:], second[1:], grads, strict=True)]:
                m[part] = 0.9 * m[part] + 0.1 * g
                v[part] = 0.999 * v[part] + 0.001 * g * g
                p[part] -= RATE * fix * m[part] / (np.sqrt(v[part]) + 1e-8)
            out_state = [0.9 * out_state[0] + 0.1 * g_bias_out, 0.999 * out_state[1] + 0.001 * g_bias_out**2]
            net.out_bias -= RATE * fix * out_state[0] / (np.sqrt(out_state[1]) + 1e-8)
    return net


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut of the best F1, midway between the two scores that it parts."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    k = int(np.argmax(f1))
    low = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float((z[order[k]] + low) / 2)


def fit(texts: list[np.ndarray], labels: np.ndarray, langs: list[str], table: np.ndarray) -> Network:
    """A network fitted on all rows, calibrated on the outcome for rows that a fold held back."""
    if len(texts) < 10 or labels.min() == labels.max():
        prior = float(labels.mean()) if len(labels) else 0.0
        n = FILTERS * len(WIDTHS)
        return Network(np.zeros((BUCKETS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(n, np.float32), np.zeros(n, np.float32), 0.0, thresholds={"": CUT}, prior=prior)
    z = np.zeros(len(texts))
    for fold in range(2):
        held = np.arange(len(texts)) % 2 == fold
        net = train([t for t, h in zip(texts, held, strict=True) if not h], labels[~held], table)
        z[held] = net.logits([t for t, h in zip(texts, held, strict=True) if h], table)
    net = train(texts, labels, table)
    net.shift = _best_cut(z, labels)
    net.scale = 1 / max(float(z.std()), 1e-3) * 2
    net.thresholds = {"": CUT}
    score = net.scores(z)
    for lang in sorted(set(langs)):
        own = np.array([x == lang for x in langs])
        if labels[own].sum() >= 10 and (1 - labels[own]).sum() >= 10:
            net.thresholds[lang] = min(0.9, max(0.05, _best_cut(score[own], labels[own])))
    return net


def held_out():
    """Rows that labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray, list[str], np.ndarray]:
    """At most ``most`` labelled rows of each class, the first by hash of their id: word numbers, labels, languages, and the buckets of each word number."""
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    chosen = None
    for y in (0, 1):
        part = marked.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")
    # Repeated rows of an id count once: at most 2 * most rows go to the driver.
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "toxic", "row.*")
    got = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))

    def number(batches):
        for batch in batches:
            out = []
            for text in batch.column(3).to_pylist():
                words = Words()
                ids = words.ids(text)
                out.append((ids.astype("<i4").tobytes(), words.table().astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([x[k] for x in out], pa.binary()) for k in range(2))], names=["doc_id", "toxic", "lang", "ids", "parts"])

    # Four bytes a word and the buckets of the distinct words, not texts, go to the driver.
    got = got.mapInArrow(number, "doc_id long, toxic int, lang string, ids binary, parts binary").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    known, texts = {(0,) * PARTS: 0}, []
    for r in got:
        rows = [known.setdefault(x, len(known)) for x in map(tuple, np.frombuffer(r["parts"], "<i4").reshape(-1, PARTS).tolist())]
        texts.append(np.array(rows, np.int32)[np.frombuffer(r["ids"], "<i4")])
    return texts, np.array([r["toxic"] for r in got], np.int64), [r["lang"] for r in got], np.array(list(known), np.int32)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang, score) of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size: the network's

    def run(batches):
        model = shared.value
        words = Words()
        for batch in batches:
            texts, z = batch.column(1).to_pylist(), [np.zeros(0)]
            for k in range(0, len(texts), TOGETHER):
                if len(words) > REMEMBERED:
                    words = Words()
                ids = [words.ids(t) for t in texts[k : k + TOGETHER]]
                used, back = np.unique(np.concatenate([np.zeros(1, np.int32), *ids]), return_inverse=True)
                table = np.array([words.rows[u] for u in used.tolist()], np.int32)
                ends = np.cumsum([1, *map(len, ids)])
                z.append(model.logits([back[a:b].astype(np.int32) for a, b in zip(ends[:-1], ends[1:], strict=True)], table))
            z = np.concatenate(z)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(model.scores(z), pa.float64())], names=["doc_id", "lang", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return plain.mapInArrow(run, "doc_id long, lang string, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, flagged): ``flagged`` holds the score against its language's threshold."""
    net = fit(*sample(docs, labels))
    limits = F.create_map(*(F.lit(x) for pair in (net.thresholds or {"": CUT}).items() for x in pair))
    limit = F.coalesce(F.try_element_at(limits, F.coalesce("lang", F.lit(""))), F.lit(net.thresholds.get("", CUT)))
    return score(docs, net).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (F.col("score") >= limit).alias("flagged")
    )
