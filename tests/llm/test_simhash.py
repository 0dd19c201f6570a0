import numpy as np
import xxhash

from tests.llm.helpers import EDGES, clashing, frame
from threadlake.llm import simhash as S


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, p) in enumerate(prints):
        for j, q in prints[a + 1 :]:
            if bin(p ^ q).count("1") <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def test_report_matches_brute_force(spark):
    base = " ".join(f"w{k}" for k in range(400)).split()
    near = [(100 + k, " ".join([*base[:k], "CHANGED", *base[k + 1 :]])) for k in range(0, 60, 3)]
    rows = [(i, t) for i, t in [*EDGES, *near, (90, "A  b c\td"), (91, "a b c d")] if i is not None]
    got = S.report(clashing(frame(spark, rows))).collect()
    prints = {i: brute_print(t) for i, t in rows}
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((i, f"{brute_print(t):016x}") for i, t in rows)
    components = brute_components(sorted(prints.items()))
    assert {r.doc_id: r.component_id for r in got} == components and len(set(components.values())) < len(components)


def test_links_of_random_prints_match_brute_force(spark):
    r = np.random.default_rng(4)
    seeds = r.integers(0, 2**63, 40, dtype=np.uint64)
    prints = {int(s) for s in seeds}
    for s in seeds:  # chains of small steps, over many tiles
        x = int(s)
        for _ in range(6):
            for b in r.integers(0, 64, r.integers(1, 4)):
                x ^= 1 << int(b)
            prints.add(x)
    rows = list(enumerate(sorted(prints)))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    edges = S.links(spark.createDataFrame([(signed(p), i) for i, p in rows], "fp long, rep long"))
    got = {x.node: x.component for x in S.components(edges).collect()}
    want = brute_components(rows)
    assert {i: got.get(i, i) for i, _ in rows} == want


def test_small_tiles_and_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 3)
    monkeypatch.setattr(S, "CHUNK", 5)
    rows = [(signed, i) for i, signed in enumerate([0, 1, 3, 7, 1 << 40, (1 << 40) | 1, 2, 4, 8, 16, 32, 64])]
    edges = S.links(spark.createDataFrame(rows, "fp long, rep long"))
    got = {x.node: x.component for x in S.components(edges).collect()}
    assert {i: got.get(i, i) for _, i in rows} == brute_components([(i, p) for p, i in rows])


def test_keep_one(spark):
    docs = clashing(frame(spark, [(3, "a b c d"), (3, "a b c d"), (5, "a b c d"), (7, "other words stand here"), (8, None), (9, ""), (None, "a b c d")]))
    got = S.keep_one(docs)
    assert got.columns == docs.columns and sorted(r.doc_id or -1 for r in got.collect()) == [-1, 3, 7, 8]
    assert S.report(docs.limit(0)).count() == S.keep_one(docs.limit(0)).count() == 0


def test_fingerprints_are_the_nodes(spark):
    # one doc_id with two texts joins no classes; rows without a doc_id link like others
    rows = [(1, "a b c d"), (1, "totally different words here now"), (2, "totally different words here now"), (None, "a b c d"), (None, "nobody else has this text")]
    got = {(r.fingerprint, r.component_id) for r in S.report(frame(spark, rows)).collect()}
    assert got == {(f"{brute_print(t):016x}", c) for (_, t), c in zip(rows, [1, 1, 1, 1, None], strict=True)}
    other = S.report(frame(spark, [(1, "a b c d"), (5, "totally different words here now"), (5, "a b c d"), (6, "totally different words here now")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in other) == [(1, 1), (5, 1), (5, 5), (6, 5)]
