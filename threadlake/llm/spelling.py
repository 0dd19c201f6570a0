"""Spelling variants of a corpus's words: words one edit from a much more frequent one take its form.

Words are the runs of letters of whole texts, counted over the corpus; some
occurrences lose a letter first (``SLIP``), which plants variants. Words of at
least ``LEAST`` letters that occur ``OFTEN`` times are compared by an
even-partition pigeonhole join: a word is cut into two segments whose lengths
depend on its own only, and is indexed under each. One edit leaves one of the
two whole, so a word probes the words of its own length and those one letter
shorter with the substrings that can be their segments: the one at the same
place, and the one shifted by the difference in length. Candidates are made
distinct and verified by an edit distance of one.

Words that share a segment with very many others (a hot prefix) are told apart
further: within such a segment the rest of the word is cut into two segments
again, by the same argument, and both join the key; a key still hot is split
by adaptive execution, as this is an ordinary equi-join. No pair leaves the join
but those that share a segment.

Edge cases: null and empty texts have no words; a null doc_id counts as the
text ``null`` in the slip's hash; equal rows count each; ties for the largest
count go to the word that is first in code-point order; an empty table gives no
rows; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import small_batches, written

LEAST, OFTEN, TIMES, SLIP = 6, 5, 5, 199
#: Words under one segment from which on the rest of the word joins the key.
HOT = 500
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
LOWER = {k: k + 32 for k in range(65, 91)}


def spelt(run: str, doc_id: int | None) -> str:
    """A lower-cased run as it counts in a document: one code point short where the slip's hash says so."""
    h = crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """(word, n): every word of at least ``least`` letters and ``often`` occurrences."""
    small_batches(docs.sparkSession)
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")  # shorter runs cannot become words

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def count(batches):
        counts = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for run, n in Counter(runs.findall((text or "").translate(LOWER))).items():
                    counts[spelt(run, doc_id)] += n
                if len(counts) > HELD:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return found.filter(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def _halves(text: Column, size: Column) -> list[tuple[Column, Column]]:
    """The even partition of words of ``size`` letters, as found in ``text`` (of ``size`` or one more): (segment, what is left of ``text``).

    The first segment is a prefix. The second stands at the end; in a longer text that is its place shifted by the difference.
    """
    cut, n = F.floor(size / 2).cast("int"), F.length(text)
    return [(text.substr(F.lit(1), cut), text.substr(cut + 1, n)), (text.substr(n - (size - cut) + 1, size), text.substr(F.lit(1), n - (size - cut)))]


def _keys(words: DataFrame, probe: bool) -> DataFrame:
    """A row for each segment of a word (``probe``: for each that a word of its length or one less could have), with the rest of the word."""
    word, size = F.col("word"), F.length("word")
    of = [size, size - 1] if probe else [size]
    parts = [F.struct(k.cast("int").alias("size"), F.lit(side).alias("side"), seg.alias("seg"), rest.alias("rest")) for k in of for side, (seg, rest) in enumerate(_halves(word, k))]
    return words.select("word", "n", F.explode(F.array(*parts)).alias("p")).select("word", "n", "p.*")


def _refined(keys: DataFrame, hot: DataFrame, probe: bool) -> DataFrame:
    """``keys`` with a column ``more``: empty, or for hot segments a segment of the rest, in a row for each."""
    size = F.col("size") - F.length("seg")  # of the rest in the shorter word
    inner = F.array(*(F.concat(F.lit(f"{side}:"), seg) for side, (seg, _) in enumerate(_halves(F.col("rest"), size))))
    marked = keys.join(hot.withColumn("hot", F.lit(True)), ["size", "side", "seg"], "left")
    return marked.withColumn("more", F.explode(F.when(F.col("hot"), inner).otherwise(F.array(F.lit("")))))


def near(words: DataFrame) -> DataFrame:
    """(word, other): every ordered pair of ``words`` (word, n) that one inserted, deleted or replaced code point separates, once."""
    index, probe = _keys(words, False), _keys(words, True)
    hot = index.groupBy("size", "side", "seg").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > HOT).drop("k")
    index, probe = _refined(index, hot, False), _refined(probe, hot, True)
    key = ["size", "side", "seg", "more"]
    left = probe.select(*key, F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = index.select(*key, F.col("word").alias("b"), F.col("n").alias("b_n"))
    same = F.length("a") == F.length("b")
    # Of two words of one length each probes the other: one order is enough.
    met = left.join(right, key).filter(F.when(same, F.col("a") < F.col("b")).otherwise(F.lit(True)))
    near = met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()
    return near.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))).alias("p")).select("p.*")


def forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n) of ``words`` (word, n): the form is the most frequent near word, if ``times`` as frequent."""
    # The largest count first, then the word that is first: min_by over the negated count.
    best = near(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("neg"), F.col("other").alias("form"))).alias("best"))
    taken = F.when(-F.col("best.neg") >= times * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.neg")).alias("form_n")))
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), taken.alias("t")).select("word", "n", "n_near", "t.form", "t.form_n")


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` that has a form; the root has none.

    Counts rise at each step, so chains end; each round doubles the steps that are taken.
    """
    reached = written(found.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached_next = reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        reached_next = written(reached_next, "spelling-roots")
        if not reached_next.filter("moved").limit(1).count():
            return reached_next.select("word", "root")
        reached = reached_next.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus."""
    words = written(vocabulary(docs), "spelling-words")
    found = written(forms(words), "spelling-forms")
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
