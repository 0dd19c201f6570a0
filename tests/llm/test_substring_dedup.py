import hashlib
import random

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import EDGES, clashing, frame
from threadlake.llm import substring_dedup as S


def words(text):
    return (text or "").encode().split()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(rows, window=20):
    docs = sorted(((i is not None, i or 0, signed(xxhash.xxh3_64_intdigest(b" ".join(words(t)))), words(t)) for i, t in rows), key=lambda x: x[:3])
    seen, out = set(), []
    for there, i, _, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i if there else None, len(w), sum(gone), kept.decode()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def documents(seed=1):
    r = random.Random(seed)
    pick = lambda n: " ".join(r.choice(["a", "bé", "ccc", "d", "ee", "f"]) for _ in range(n))
    passages = [pick(r.randint(15, 70)) for _ in range(10)]
    rows = [(r.choice([None, k, k, k, 5]), " \t".join(r.choice(passages) if r.random() < 0.4 else pick(r.randint(1, 40)) for _ in range(r.randint(0, 8)))) for k in range(120)]
    return [*rows, (200, "ab cd " * 60), (201, "a " * 500), (202, "x " * 19), (203, "x " * 20), (204, "y " * 21), (205, "ab cd " * 30 + "z " + "ab cd " * 40), (206, passages[0]), (206, passages[0]), (206, passages[1]), *[(300 + k, passages[2] + " " + passages[3]) for k in range(40)], *EDGES[:-1], (9, "word " * 3000)]


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, ranges and collisions
        for name, value in (("BLOCK", 300), ("DOCS", 5), ("PART", 900)):
            monkeypatch.setattr(S, name, value)
    rows = documents()
    expected = brute(rows)
    assert sum(x[2] for x in expected) > 5000
    docs = clashing(frame(spark, rows))
    assert result(S.dedup(docs)) == expected
    got = sorted(((r.doc_id, r.n_removed, r.kept_sha256) for r in S.report(docs).collect()), key=str)
    assert got == sorted(((x[0], x[2], hashlib.sha256(x[3].encode()).hexdigest()) for x in expected), key=str)


def test_collisions_in_the_sketch_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "_mixed", lambda h, k=0: h & np.uint64(3 << 62))  # four cells: nearly all windows are estimated repeated
    rows = documents(2)[:60]
    assert result(S.dedup(frame(spark, rows))) == brute(rows)


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(4)
    h = r.integers(0, 3, 3000).astype(np.uint64)  # few different words: many equal windows and grams
    n = np.array([0, 700, 19, 20, 21, 0, 2240])
    start, anchor, g = S.anchors(h, n, window=8, gram=5)
    ends = np.cumsum(n)
    expected = [k for a, b in zip(ends - n, ends) for k in range(a, b - 7)]
    assert start.tolist() == expected and (np.diff(anchor) >= 0).all()
    assert ((anchor >= start) & (anchor + 5 <= start + 8)).all()
    offsets, hashes = {}, {}
    for s, a in zip(start.tolist(), anchor.tolist()):
        assert offsets.setdefault(h[s : s + 8].tobytes(), a - s) == a - s
        assert g[a] == g[s : s + 4].min()
    for k in range(len(h) - 4):
        assert hashes.setdefault(h[k : k + 5].tobytes(), g[k]) == g[k]
    assert len(set(hashes.values())) == len(hashes)
    for size in (1, 2, 3, 7, 12, 20):
        found = S._grams(h, size)
        assert len(found) == len(h) - size + 1 and len(set(found.tolist())) == len({h[k : k + size].tobytes() for k in range(len(h) - size + 1)})


def test_empty_table(spark):
    assert S.dedup(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert result(S.dedup(frame(spark, [(1, None), (None, "")]))) == [(1, 0, 0, ""), (None, 0, 0, "")]
