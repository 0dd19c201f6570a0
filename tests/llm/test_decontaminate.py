import random

import numpy as np

from tests.llm.helpers import EDGES, clashing, frame
from threadlake.llm import decontaminate as D

R = random.Random(5)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(300)]
PROSE = lambda n: " ".join(R.choice(WORDS) for _ in range(n))
ITEMS = [(i, PROSE(30)) for i in range(12)] + [(50, "Tiny"), (51, ""), (52, None), (53, "exactly-ten")]


def squeezed(t):
    return D.squeeze(D.padded(t))[0]


def brute(passage, text):
    """The least number of edits that make the passage a part of the text."""
    p, t = squeezed(passage)[1:-1], squeezed(text)
    before, steps = np.zeros(len(t) + 1, np.int64), np.arange(len(t) + 1)
    for c in p:
        now = before + 1
        now[1:] = np.minimum(now[1:], before[:-1] + (t != c))
        before = np.minimum.accumulate(now - steps) + steps
    return int(before.min())


def edited(passage, n):
    x = list(passage)
    for _ in range(n):
        k, kind = R.randrange(len(x)), R.random()
        if kind < 0.4:
            x[k] = R.choice("abcxyz ")
        elif kind < 0.7:
            del x[k]
        else:
            x.insert(k, R.choice("abcxyz"))
    return "".join(x)


def test_finds_what_brute_force_finds():
    index = D.Index([i for i in ITEMS if i[0] < 12])
    near = 0
    for n in range(40):
        item, passage = ITEMS[n % 12]
        text = PROSE(40) + ". " + edited(passage, R.randint(0, 24)).upper() + "!  " + PROSE(30)
        found = [f for f in D.find([text], index) if f[1] == item]
        best, most = brute(passage, text), D.budget(len(squeezed(passage)) - 2)
        assert bool(found) == (best <= most) and (not found or found[0][2] == best)
        near += best <= most
    assert 0 < near < 40


def test_matches_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 500)
    rows = [*EDGES, (20, "Ähm 😀 " + ITEMS[3][1] + "."), (21, "this tiny thing"), (22, "destiny"), (23, ITEMS[4][1] + " " + ITEMS[4][1] + ITEMS[5][1]), (24, "x exactly ten y")]
    docs, items = clashing(frame(spark, rows)), spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(D.blocks, "__defaults__", (500,))
    got = {(r.doc_id, r.item_id): r for r in D.matches(docs, items).collect()}
    assert set(got) == {(20, 3), (21, 50), (23, 4), (23, 5), (24, 53)}
    r = got[20, 3]
    assert rows[10][1][r.start : r.end] == ITEMS[3][1] and r.edits == 0
    kept = D.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted((i or -1) for i, _ in rows if i not in (20, 21, 23, 24))


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, EDGES)
    assert D.matches(docs, items.limit(0)).count() == D.matches(docs.limit(0), items).count() == 0
    assert D.without_leaks(docs, items.limit(0)).count() == len(EDGES)


def test_all_findings_are_those_of_brute_force(monkeypatch):
    # passages that share most of their text: long posting lists, slices of a few hits
    monkeypatch.setattr(D, "COMMON", 3)
    monkeypatch.setattr(D, "SLICE", 50)
    monkeypatch.setattr(D, "TOGETHER", 400)
    stem = PROSE(18)
    items = [(i, f"{PROSE(6)} {stem} {PROSE(3)}") for i in range(9)] + [(20 + i, PROSE(25)) for i in range(4)] + [(40, "é" * 30 + " ñandú " + "中文字符" * 6), (41, PROSE(4))]
    index = D.Index(items)
    assert (index.least >= 1).all() and (index.least < index.sizes - D.Q + 1 - index.budgets * D.Q).any()
    texts = [PROSE(40), stem, None, "", items[14][1] * 2]
    for n in range(16):
        planted = [edited(items[R.randrange(15)][1], R.randint(0, 16)) for _ in range(3)]
        texts.append(f" {PROSE(n)}, ".join(planted))
    got = {(d, i): edits for d, i, edits, _, _ in D.find(texts, index)}
    want = {}
    for d, t in enumerate(texts):
        for i, p in items:
            best = brute(p, t or "")
            if best <= D.budget(len(squeezed(p)) - 2):
                want[d, i] = best
    assert got == want and len(want) > 20


def test_edits_count_in_code_points():
    passage = "中文字符测试" * 20
    index = D.Index([(1, passage)])
    k = D.budget(len(squeezed(passage)) - 2)
    for n, found in ((k, True), (k + 1, False)):
        changed = list(passage)
        for j in range(n):
            changed[7 + 12 * j] = "é"
        assert bool(D.find(["x " + "".join(changed)], index)) == found
    (_, _, edits, start, end), = D.find(["😀 İ " + passage + "!"], index)
    assert edits == 0 and ("😀 İ " + passage + "!")[start:end] == passage


def test_bands_aligned_together_or_one_by_one(monkeypatch):
    passage = PROSE(40)
    texts = [" ".join(f"{edited(passage, R.randint(4, 12))} {PROSE(5)}" for _ in range(60)), passage[: len(passage) // 2], edited(passage, 5)]
    index = D.Index([(1, passage), (2, PROSE(30))])
    found = D.find(texts, index)
    monkeypatch.setattr(D, "CELLS", 1)
    assert found == D.find(texts, index)
    assert {d: edits for d, _, edits, _, _ in found} == {d: brute(passage, texts[d]) for d in (0, 2)}
