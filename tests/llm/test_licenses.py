import re

from tests.llm.helpers import EDGES, clashing, frame
from threadlake.llm import licenses as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in L.PHRASES.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


MIT = L.TEMPLATES["mit"][0]
ROWS = [
    *EDGES, (20, "Released under the MIT License."), (21, "mit license MIT-LICENSE mit\nlicense"), (22, "mit licence"), (23, "Apache License, Version 2.0. General Public License"), (24, "x " * 5000 + MIT + " y" * 5000),
    (25, MIT.replace("software", "program")), (26, "permission copy restriction"), (27, "GNU General Public License, version 3 This work is licensed under"), (28, "mit license " * 4000),
]


def test_base_matches_brute_force(spark):
    got = sorted((r.doc_id or -1, r.n_words, r.n_base, r.first_word or -1, r.last_word or -1, r.base_labels) for r in L.scan(clashing(frame(spark, ROWS))).collect())
    assert got == sorted((i or -1, b[0], b[1], b[2] or -1, b[3] or -1, b[4]) for i, t in ROWS for b in [brute(t)])


def test_templates_are_aligned_and_verified(spark):
    got = {r.doc_id: r for r in L.scan(frame(spark, ROWS)).collect()}
    assert got[24].labels == "mit" and got[24].score > 0.9 and got[25].labels == "mit"
    assert got[26].labels == "" and got[26].score == 0.0
    assert "apache-2.0" in got[23].labels and all(0 <= r.score <= 1 for r in got.values())


def test_empty(spark):
    assert L.scan(frame(spark, [])).count() == 0


def test_a_later_notice_is_found(spark):
    gpl = "This work is licensed under the GNU General Public License, version "
    rows = [(1, gpl + "2. " + "x " * 60 + gpl + "3."), (2, gpl + "2."), (3, "Licensed under CC BY-NC 4.0.")] + [(10 + k, "3 1 2 version") for k in range(40)]
    got = {r.doc_id: r.labels.split(",") for r in L.scan(frame(spark, rows)).collect()}
    assert "gpl-3.0" in got[1] and "gpl-3.0" not in got[2] and got[3] == ["cc-by-nc"]


def test_fuller_notices_and_ties(spark):
    names = ["mit-full", "apache-2.0-header", "gpl-3.0-or-later", "bsd-2-clause", "bsd-3-clause", "isc-full", "mpl-2.0-header", "epl-2.0", "zlib", "bsl-1.0", "cc0-1.0", "cc-by-sa", "artistic-2.0", "wtfpl"]
    rows = [(k, f"Copyright 2024 Some One. {L.TEMPLATES[n][0]} int main() {{}}") for k, n in enumerate(names)]
    rows += [(100, rows[3][1] + " " + rows[4][1] + " " + rows[8][1]), (101, rows[0][1] * 2), (102, rows[1][1].replace("WITHOUT", "with no"))]
    # common words in every file: they anchor nothing, and files without a notice propose none
    rows += [(1000 + k, "this is the copy of a file that you may use with or without any of the others") for k in range(60)]
    got = {r.doc_id: r for r in L.scan(frame(spark, rows)).collect()}
    for k, n in enumerate(names):
        assert n in got[k].labels.split(",") and got[k].score > 0.95
    assert {"bsd-2-clause", "bsd-3-clause", "zlib"} <= set(got[100].labels.split(","))
    assert "mit-full" in got[101].labels.split(",") and "apache-2.0-header" not in got[102].labels.split(",")
    assert all(got[1000 + k].labels == "" and got[1000 + k].score == 0 for k in range(60))


def test_a_notice_in_every_file_is_still_found(spark):
    got = L.scan(frame(spark, [(k, f"file {k} {MIT}") for k in range(30)])).collect()
    assert len(got) == 30 and all("mit" in r.labels.split(",") for r in got)


def test_alignments_match_brute_force(spark):
    import random

    r = random.Random(2)
    words = L.words_of(MIT)
    rows = []
    for k in range(40):
        text = [w if r.random() > k / 60 else "x" for w in words]
        rows.append((k, " ".join(["x"] * r.randint(0, 9) + text)))
    found = L.hits(frame(spark, rows))
    postings = L.index(found)
    weight = {w: x for t, w, _, x in postings if t == "mit"}
    got = {}
    table = spark.createDataFrame(postings, "template string, w string, position int, weight double")
    ids = {x.rid: x.doc_id for x in found.collect()}
    for x in L.alignments(L.candidates(found, postings, 0.0), table).filter("template = 'mit'").collect():
        got[ids[x.rid]] = max(got.get(ids[x.rid], 0), x.share)
    for k, t in rows:
        ws, best = t.split(), 0
        for band in range(-len(words), len(ws)):
            shifts = {w for w, at in ((w, i) for i, w in enumerate(ws)) for t_, w_, p, _ in postings if t_ == "mit" and w_ == w and (at - p) // L.SLACK in (band, band - 1)}
            best = max(best, sum(weight[w] for w in shifts))
        assert abs(got.get(k, 0) - best / sum(weight.values())) < 1e-9
