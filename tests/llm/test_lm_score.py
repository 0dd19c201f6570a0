from collections import Counter
from math import log

from tests.compare import assert_equal, connect
from tests.llm.helpers import EDGES, clashing, frame
from threadlake.llm import lm_score as L
from threadlake.llm.queries import ORACLES

ROWS = [*EDGES, (20, "the cat sat on the mat the cat sat"), (21, "the cat sat"), (22, "A a A a b"), (22, "A a A a b")]


def brute(rows):
    texts = []
    for i, t in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\v\f\r":
            t = t.replace(c, " ")
        texts.append((i, [w for w in t.split(" ") if w]))
    one, two, three = (Counter(g for _, w in texts for g in zip(*(w[k:] for k in range(n)))) for n in (1, 2, 3))
    total, out = sum(one.values()), []
    for i, w in texts:
        s = log(one[w[0],] / total) if w else 0.0
        for k in range(1, len(w)):
            if k >= 2 and three[w[k - 2], w[k - 1], w[k]] >= L.CUTOFF:
                s += log(three[w[k - 2], w[k - 1], w[k]] / two[w[k - 2], w[k - 1]])
            else:
                s += (log(L.BACKOFF) if k >= 2 else 0) + log(two[w[k - 1], w[k]] / one[w[k - 1],])
        out.append((i or -1, len(w), round(s, 4)))
    return sorted(out)


def result(df):
    return sorted((r.doc_id or -1, r.n_words, round(r.log_score, 4)) for r in L.scores(df).collect())


def test_matches_brute_force(spark):
    assert result(clashing(frame(spark, ROWS))) == brute(ROWS)


def test_many_blocks_and_ranges(spark, monkeypatch):
    # Texts that go on over several blocks, a word in every block, ranges of a few n-grams.
    monkeypatch.setattr(L, "BLOCK", 7)
    monkeypatch.setattr(L, "PART", 5)
    monkeypatch.setattr(L, "CHUNK", 16)
    rows = [(i, t) for i, t in ROWS if i != 9] + [(9, "word " * 300), (30, " ".join(f"w{k % 11}" for k in range(200)))]
    assert result(frame(spark, rows).repartition(3)) == brute(rows)


def test_packing_is_lossless():
    import numpy as np

    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**64, 5000, np.uint64))
    counts = r.choice([0, 1, 2, 254, 255, 256, 10**10], 5000)
    assert (L._sorted_out(L._sorted_in(keys)) == keys).all() and (L._counts_out(L._counts_in(counts)) == counts).all()
    assert not len(L._sorted_out(L._sorted_in(keys[:0]))) and not len(L._counts_out(L._counts_in(counts[:0])))


def test_oracle_and_empty(spark):
    sf = "/root/testdata/sf0.001"
    assert_equal(L.scores(spark.read.parquet(f"{sf}/documents.parquet")), connect(sf), ORACLES["op8_lm_score"])
    assert L.scores(frame(spark, [])).count() == 0
