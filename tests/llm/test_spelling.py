import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import EDGES, clashing, frame
from threadlake.llm import spelling as S


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    words, out = brute_words(rows), {}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def result(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def documents(seed=3, n=60):
    r = np.random.default_rng(seed)
    base = ["".join(r.choice(list("abcdeé×"), r.integers(5, 10))) for _ in range(25)] + ["prefix" + "".join(r.choice(list("abc"), r.integers(1, 5))) for _ in range(40)]
    def slip(w):
        k, c = int(r.integers(len(w))), str(r.choice(list("abcdeéZ")))
        return [w, w, w, w, w, w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]][int(r.integers(8))]
    rows = [(int(k) if r.random() < 0.9 else None, " ".join(slip(base[min(len(base) - 1, int(r.exponential(8)))]) for _ in range(r.integers(1, 300)))) for k in range(n)]
    return rows + [rows[0], rows[0], (7, "AbCdÉf1abcdefĀabcdef " * 6)]


@pytest.mark.parametrize("hot", [500, 1])
def test_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "HELD", 50)
    rows = documents() + [(i, t) for i, t in EDGES]
    expected = brute(rows)
    assert sum(v[0] is not None for v in expected.values()) > 10
    assert result(S.variants(clashing(frame(spark, rows)))) == expected


def test_chains_end_at_the_last_form(spark):
    chain = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("aabbbb", 3125), ("zzzzzz", 9)]
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(chain) if zlib.crc32(f"{k}:{w}".encode()) % 199]
    assert len(rows) == len(chain)
    got = {r.word: r.root for r in S.variants(frame(spark, rows)).collect()}
    assert got == {w: "aabbbb" if w != "zzzzzz" else w for w, _ in chain}


def test_ties_and_empty_tables(spark):
    words = spark.createDataFrame([("abcdef", 5), ("abcdeg", 30), ("abcdea", 30), ("abcdefg", 30)], "word string, n long")
    got = {r.word: (r.n_near, r.form, r.form_n) for r in S.forms(words).collect()}
    assert got["abcdef"] == (3, "abcdea", 30) and got["abcdeg"] == (3, None, None) and got["abcdefg"] == (2, None, None)
    assert S.variants(frame(spark, documents()).limit(0)).count() == 0
    assert S.variants(frame(spark, [(1, None), (None, "")])).count() == 0
