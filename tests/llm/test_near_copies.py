import random

import numpy as np

from tests.llm.helpers import EDGES, clashing, frame
from threadlake.llm import near_copies as N
from threadlake.llm import simhash as S


def sets_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_classes_are_those_of_all_pairs(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = [None, "", "one", "one two", "ONE two"]
    for _ in range(12):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 5, 8, 14):
            copy = list(base)
            for k in r.sample(range(200), changes):
                copy[k] = word()
            texts.append(" ".join(copy))
    r.shuffle(texts)
    found = [sets_of(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    got = {x.doc_id: x.component_id for x in N.classes(frame(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(root))
    apart = [(i, j) for i in range(len(texts)) for j in range(i) if root[i] == root[j] and (S.fingerprint(texts[i]) ^ S.fingerprint(texts[j])).bit_count() > 3]
    assert len(apart) > 20  # radius 3 over 3-word shingles does not link these
    assert {x.doc_id for x in S.keep_one(frame(spark, list(enumerate(texts)))).collect()} == set(root)


def brute_classes(texts):
    found, root = [sets_of(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if a == b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def chained(r, groups, changes):
    """Groups of texts that change step by step, so that the ends of a group are no copies of each other."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(groups):
        now = [word() for _ in range(60)]
        for _ in range(changes):
            now = list(now)
            now[r.randrange(60)] = word()
            texts.append(" ".join(now))
    return texts


def test_small_slices_and_leads_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 5)
    monkeypatch.setattr(N, "MEMBERS", 4)
    texts = chained(random.Random(8), 4, 14)
    root = brute_classes(texts)
    got = {x.document: x.component_id for x in N.classes(frame(spark, list(enumerate(texts)))).withColumnRenamed("doc_id", "document").collect()}
    assert got == dict(enumerate(root)) and 4 <= len(set(root)) < len(texts)


def test_short_texts_are_found(spark):
    # four words more than the shingles: sets of 5 of which 4 are shared
    texts = ["one two three four five six seven eight", "one two three four five six seven eight nine", "x y z", "x y z w", "X Y z"]
    assert brute_classes(texts) == [0, 0, 2, 3, 2]
    assert [N.band(n) for n in (1, 3, 4)] == [-1, -1, N.band(5) - 1]
    got = {x.doc_id: x.component_id for x in N.classes(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2}


def test_bands_and_prints():
    for n in range(4, 3000):
        for m in (n, n + 1, n * 5 // 4):
            assert m * 4 > n * 5 or abs(N.band(n) - N.band(m)) <= 1
    r = np.random.default_rng(3)
    found = np.unique(r.integers(0, 2**64, 9000, np.uint64))
    assert (N.wide_print(found) == N.wide_print(found[::-1])).all() and not N.wide_print(found[:0]).any()
    apart = [int(np.bitwise_count(N.wide_print(found[k : k + 90]) ^ N.wide_print(found[k + 10 : k + 100])).sum()) for k in range(0, 8000, 100)]
    assert np.mean(apart) < 45 and max(apart) <= N.RADIUS  # 80 of 100 shared


def test_keep_one_keeps_rows_that_differ(spark):
    rows = [*EDGES, (3, "a b c d e"), (3, "totally different words here now"), (3, "A b c d e"), (4, "a  b c d e")]
    docs = clashing(frame(spark, [x for x in rows if x[0] != 9]))
    kept = S.keep_one(docs).collect()
    texts = [sets_of(r.text) for r in kept if r.doc_id is not None]
    assert len(texts) == len({frozenset(t) for t in texts}) and {frozenset(t) for t in texts} == {frozenset(sets_of(r.text)) for r in docs.collect() if r.doc_id is not None}
    assert sum(r.doc_id is None for r in kept) == 1 and [r.doc_id for r in kept if (r.text or "").lower().split() == "a b c d e".split()] == [3]
