"""Byte-pair encoding and decoding with a published vocabulary.

A word starts as a row of symbols. A segment tree stands over its adjacent
pairs; a leaf holds ``rank * width + place``, a node the least of its two
children, so the root names the leftmost pair of the lowest rank. A merge
updates at most three leaves (the pair itself and its two neighbours), each in
logarithmic time, until the root says that nothing can be merged. Short words
are encoded many at a time, as rows of one numpy tree; long ones by a tree of
their own.

Texts are normalised and split as the vocabulary's file says: NFC, white space
to one space, lower case, then contractions, runs of letters, single digits and
runs of other characters. Strings of the special tokens in a text are those
tokens. Letters and digits are those of the installed ``regex`` module; code
points that only the newest Unicode versions assign may be cut differently by
the library. ``decode`` joins token strings with a space, as the file names no
decoder.

Edge cases: null and empty texts give no ids and an empty decoded text;
repeated rows are encoded each; an empty table gives no rows; other columns
pass through ``encode`` untouched; very long texts and words are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from threadlake.llm.common import fresh, plain_names, small_batches

END = "</w>"
#: The split pattern of the vocabulary's file.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
NONE = np.iinfo(np.int64).max
#: Longer words (in bytes) get a tree of their own.
SHORT = 32
#: Words remembered by a worker, and the longest word worth remembering.
CACHE, CACHED_LENGTH = 200_000, 64


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    names = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class Vocabulary:
    """The merges of a vocabulary file as numbers, with encoding and decoding."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.bits = max(self.token).bit_length()
        self.merge = {(ids[a] << self.bits) | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        keys = np.array(sorted(self.merge), np.int64)
        self.keys = keys
        self.ranks = np.array([self.merge[int(k)][0] for k in keys], np.int64)
        self.merged = np.zeros(len(merges), np.int64)
        for rank, new in self.merge.values():
            self.merged[rank] = new
        names = byte_names()
        self.inner = np.array([ids[c] for c in names], np.int64)
        self.last = np.array([ids[c + END] for c in names], np.int64)
        self.split = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.cache: dict[str, tuple[bytes, str]] = {}

    # one word, a tree of its own

    def _one(self, word: bytes) -> list[int]:
        n = len(word)
        sym = [*(int(self.inner[b]) for b in word[:-1]), int(self.last[word[-1]])]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        width = 1 << max(1, (n - 1).bit_length())
        merge, bits, none = self.merge, self.bits, NONE

        def leaf(i: int) -> int:
            found = merge.get((sym[i] << bits) | sym[right[i]]) if right[i] < n else None
            return found[0] * width + i if found else none

        tree = [none] * (2 * width)
        tree[width : width + n] = [leaf(i) for i in range(n)]
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            k >>= 1
            while k:
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while tree[1] != none:
            rank, i = divmod(tree[1], width)
            j = right[i]
            sym[i] = int(self.merged[rank])
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            put(j, none)
            put(i, leaf(i))
            if left[i] >= 0:
                put(left[i], leaf(left[i]))
        out, i = [], 0
        while i < n:
            out.append(sym[i])
            i = right[i]
        return out

    # many words of at most ``width`` bytes, a row of one tree each

    def _leaves(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """The leaf of each pair (a, b); a negative symbol stands for none."""
        key = (a << self.bits) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at] * width + place, NONE)

    def _many(self, words: list[bytes], width: int) -> list[list[int]]:
        rows = len(words)
        size = np.fromiter(map(len, words), np.int64, rows)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(rows, width)
        place = np.arange(width)
        sym = np.where(place < size[:, None], self.inner[raw], -1)
        sym[np.arange(rows), size - 1] = self.last[raw[np.arange(rows), size - 1]]
        left = np.broadcast_to(place - 1, (rows, width)).copy()
        right = np.broadcast_to(place + 1, (rows, width)).copy()
        tree = np.full((rows, 2 * width), NONE, np.int64)
        tree[:, width : 2 * width - 1] = self._leaves(sym[:, :-1], sym[:, 1:], place[:-1], width)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        live = np.flatnonzero(tree[:, 1] != NONE)
        levels = width.bit_length() - 1
        while len(live):
            rank, i = np.divmod(tree[live, 1], width)
            j = right[live, i]
            after = right[live, j]
            sym[live, i] = self.merged[rank]
            sym[live, j] = -2
            right[live, i] = after
            inside = after < width
            left[live[inside], after[inside]] = i[inside]
            before = left[live, i]
            symbol = sym[live, i]
            next_symbol = np.where(inside, sym[live, np.minimum(after, width - 1)], -1)
            prev_symbol = np.where(before >= 0, sym[live, np.maximum(before, 0)], -1)
            tree[live, width + j] = NONE
            tree[live, width + i] = self._leaves(symbol, next_symbol, i, width)
            has = before >= 0
            tree[live[has], width + before[has]] = self._leaves(prev_symbol[has], symbol[has], before[has], width)
            for leaf in (j, i, np.maximum(before, 0)):
                k = width + leaf
                for _ in range(levels):
                    k >>= 1
                    tree[live, k] = np.minimum(tree[live, 2 * k], tree[live, 2 * k + 1])
            live = live[tree[live, 1] != NONE]
        keep = sym >= 0
        flat, ends = sym[keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each (normalised) word."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list[list[int]] = [[]] * len(raw)
        by_width: dict[int, list[int]] = {}
        for k, w in enumerate(raw):
            if len(w) == 1:
                out[k] = [int(self.last[w[0]])]
            elif len(w) > SHORT:
                out[k] = self._one(w)
            else:
                by_width.setdefault(1 << (len(w) - 1).bit_length(), []).append(k)
        for width, places in by_width.items():
            for a in range(0, len(places), 8192):
                part = places[a : a + 8192]
                for k, ids in zip(part, self._many([raw[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text, without the special tokens' strings."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        return WORD.findall(text.lower())

    def pieces(self, text: str | None) -> list[str | int]:
        """Words, and the ids of special tokens, in order."""
        text = text or ""
        if self.split is None or "<|" not in text:
            return self.words(text)
        out: list[str | int] = []
        at = 0
        for m in self.split.finditer(text):
            out += [*self.words(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.words(text[at:])

    def encode_texts(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids (little-endian unsigned 32-bit) and its decoded text."""
        cut = [self.pieces(t) for t in texts]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = list({w for pieces in cut for w in pieces if w not in cache})
        extra: dict = {}
        strings = [w for w in new if isinstance(w, str)]
        ids = [*self.encode_words(strings), *([w] for w in new if not isinstance(w, str))]
        for w, found in zip([*strings, *(w for w in new if not isinstance(w, str))], ids, strict=True):
            (extra if isinstance(w, str) and len(w) > CACHED_LENGTH else cache)[w] = (np.array(found, "<u4").tobytes(), self.decode(found))
        out = []
        for pieces in cut:
            found = [cache[w] if w in cache else extra[w] for w in pieces] if extra else [cache[w] for w in pieces]
            out.append((b"".join([x[0] for x in found]), " ".join([x[1] for x in found])))
        return out

    def decode(self, ids) -> str:
        """The text of ids, special tokens included."""
        token = self.token
        return " ".join([token[i] for i in ids])


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str | None) -> Vocabulary:
    """The vocabulary of a path, loaded once a worker; without one that of the worker's own installation."""
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def default_path() -> str:
    """Where the installed tokenizer files keep the vocabulary used here."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with a column of token ids."""
    kept = [c for c in docs.columns if c != ids]
    source = fresh(docs, "_text")
    small_batches(docs.sparkSession)
    plain = plain_names(docs.select(*(f"`{c}`" for c in kept), F.col(text).cast("string").alias(source)), len(kept))
    schema = plain.drop(source).schema.add(ids, ArrayType(IntegerType()))

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            found = [np.frombuffer(raw, "<u4").astype(np.int32) for raw, _ in vocab.encode_texts(batch.column(batch.num_columns - 1).to_pylist())]
            arrays = [*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], ids])

    return plain.mapInArrow(run, schema).toDF(*kept, ids)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def texts(column):
        vocab = vocabulary(path)
        return column.map(lambda x: "" if x is None else vocab.decode(x.tolist() if hasattr(x, "tolist") else x))

    return encoded.withColumn(text, texts(F.col(ids)))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            found = vocab.encode_texts(batch.column(1).to_pylist())
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = [
                batch.column(0),
                pa.array([len(raw) // 4 for raw, _ in found], pa.int64()),
                pa.array([sha(raw) for raw, _ in found], pa.string()),
                pa.array([sha(text.encode("utf-8")) for _, text in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
