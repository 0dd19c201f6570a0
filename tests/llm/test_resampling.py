import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import EDGES, clashing, frame
from threadlake.llm import resampling as R


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def buckets(text):
    w = words(text)
    return Counter(zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def brute(rows, target, percent=25):
    docs, s, t = [(i, words(x), buckets(x)) for i, x in rows], Counter(), Counter()
    for _, _, b in docs:
        s.update(b)
    for x in target:
        t.update(buckets(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (s_all + 10000)) / ((s[b] + 1) * (t_all + 10000)))) for b in s}
    scored = []
    for i, w, b in docs:
        n = sum(b.values())
        weight = sum(c * gain[k] for k, c in b.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(w), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in scored if x[1] >= 20), key=lambda x: (-x[4], x[0] is not None, x[0] or 0, -x[3], -x[2]))
    quota = percent * len(able) // 100
    out = [(*x, k + 1) if k < quota else (*x, None) for k, x in enumerate(able)] + [(*x, None) for x in scored if x[1] < 20]
    return sorted(out, key=str)


def documents(n=120, seed=5):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünï", "99", "the", "The", "a-b", "naïve"]
    text = lambda: " ".join(vocabulary[min(305, int(r.exponential(60)))] for _ in range(r.integers(0, 120)))
    rows = [(int(r.integers(n)) if r.random() < 0.9 else None, text()) for _ in range(n)]
    return rows + [rows[3]] * 30 + [(400, "same words here " * 10)] * 30, [text() for _ in range(9)]


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, several keys a range, texts hashed in steps
        for name, value in (("BLOCK", 700), ("DOCS", 9), ("SHARED", 2), ("STEP", 7)):
            monkeypatch.setattr(R, name, value)
    rows, target = documents()
    rows += EDGES
    items = spark.createDataFrame([(k, t) for k, t in enumerate([*target, None, ""])], "item_id int, text string")
    assert result(R.resample(clashing(frame(spark, rows)), items)) == brute(rows, target)


def test_empty_sides(spark):
    rows, target = documents(40)
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    assert R.resample(frame(spark, rows).limit(0), items).count() == 0
    assert result(R.resample(frame(spark, rows), items.limit(0), percent=50)) == brute(rows, [], percent=50)
    assert result(R.resample(frame(spark, [(1, None), (2, "")]), items)) == brute([(1, None), (2, "")], target)


def test_long_text_in_steps(monkeypatch):
    found = R.words("Lorem ipsum, dolor 7 sit amet " * 50)
    whole = R.features(found)
    for step in (1, 2, 49, 100, len(found) - 1):
        monkeypatch.setattr(R, "STEP", step)
        bucket, count = R.features(found)
        assert bucket.tolist() == whole[0].tolist() and count.tolist() == whole[1].tolist()
