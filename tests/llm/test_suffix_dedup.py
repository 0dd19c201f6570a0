import hashlib
import random

import numpy as np

from tests.llm.helpers import clashing, frame
from threadlake.llm import suffix_dedup as S


def brute(rows):
    seen, out = set(), []
    for d, t in sorted((i if i is not None else -(2**63), t or "") for i, t in rows):
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - S.LENGTH + 1):
            window = raw[i : i + S.LENGTH]
            if window in seen:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(window)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def documents():
    r = random.Random(1)
    pick = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passages = [pick(r.randint(60, 300)) for _ in range(8)]
    rows = [(r.choice([None, i, i, i, 5]), "".join(r.choice(passages) if r.random() < 0.4 else pick(r.randint(1, 150)) for _ in range(r.randint(0, 8)))) for i in range(100)]
    return [*rows, (200, "ab" * 2000), (201, "a" * 500), (202, "x" * 99), (203, None), (204, ""), (205, "ab" * 60 + "z" + "ab" * 90), (206, passages[0]), (206, passages[0])]


def result(df):
    return sorted((r.doc_id if r.doc_id is not None else -(2**63), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.report(df).collect())


def test_matches_brute_force(spark):
    assert result(clashing(frame(spark, documents()))) == brute(documents())


def test_hot_anchors_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST", 3)
    assert result(frame(spark, documents())) == brute(documents())


def test_longest_previous_factors():
    r = np.random.default_rng(2)
    text = r.integers(0, 3, 400).astype(np.uint8)
    valid = np.arange(400) + 20 <= 400
    got = S.longest_previous(text, valid, np.arange(400), length=20)
    raw = text.tobytes()
    assert got.tolist() == [bool(valid[i]) and raw.find(raw[i : i + 20]) < i for i in range(400)]
    tiny = np.frombuffer(b"ab" * 30, np.uint8)
    ok = np.arange(60) + 20 <= 60
    assert S.longest_previous(tiny, ok, np.arange(60), length=20).tolist() == [bool(ok[i]) and i >= 2 for i in range(60)]


def test_dedup_keeps_the_first_copy(spark):
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh") for _ in range(150))
    docs = clashing(frame(spark, [(1, "head " + passage), (2, "other " + passage + " tail"), (3, None)]))
    got = {r.doc_id: r.text for r in S.dedup(docs).collect()}
    assert got[1] == "head " + passage and got[2] == "other tail"[:5] + got[2][5:] and len(got[2]) <= 11 and not got[3]
    assert S.report(docs.limit(0)).count() == 0
