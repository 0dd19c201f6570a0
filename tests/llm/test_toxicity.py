import numpy as np

from tests.llm.helpers import EDGES, clashing, frame
from threadlake.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = X.classify(clashing(docs), labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    hit = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert 2 * hit / ((rows.predicted == 1).sum() + (rows.toxic == 1).sum()) >= 0.7
    rank, positive = rows.score.rank(), rows.toxic == 1
    assert (rank[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum()) >= 0.9


def test_edges_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = X.classify(frame(spark, EDGES), none).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got) and X.classify(frame(spark, []), none).count() == 0


def test_equal_texts_score_alike_whatever_the_batch():
    words = X.Words()
    texts = [words.ids(t) for t in ("bad idiot here", "good day", "", "bad idiot here", "x " * 200000)]
    net = X.train(texts[:4] * 5, np.array([1, 0, 0, 1] * 5), words.table())
    z = net.logits(texts, words.table())
    assert z[0] == z[3] and np.isfinite(z).all() and z[0] > z[1]


def test_sample_takes_one_row_of_an_id(spark):
    from threadlake.llm import toxicity

    docs = spark.range(400).selectExpr("id as doc_id", "'some words' as text", "'en' as lang")
    docs = docs.unionByName(spark.range(2000).selectExpr("id % 2 as doc_id", "'other words' as text", "'en' as lang"))
    labels = spark.range(400).selectExpr("id as doc_id", "int(id % 2) as toxic")
    texts, toxic, langs, _ = toxicity.sample(docs, labels, 1000)
    assert len(texts) == len(toxic) == len(langs) == labels.filter(~toxicity.held_out()).count()


def test_the_prior_without_both_labels(spark):
    docs = frame(spark, EDGES + [(k, f"words number {k}") for k in range(20, 60)])
    labels = lambda toxic: spark.createDataFrame([(k, 1, toxic) for k in range(20, 60)], "doc_id long, quality int, toxic int")
    for given, score, predicted in ((labels(0).limit(0), 0.0, 0), (labels(0), 0.0, 0), (labels(1), 1.0, 1), (labels(None), 0.0, 0)):
        assert {(r.score, r.predicted) for r in X.classify(docs, given).collect()} == {(score, predicted)}


def test_a_fitted_model_on_rows_that_may_go_wrong(spark):
    toxic, clean = ["you bad idiot number", "what an idiot you are"], ["a good day number", "we walk in the park"]
    rows = [(100 + k, f"{(toxic if k % 2 else clean)[k // 2 % 2]} {'abcdefgh'[k % 7]}") for k in range(120)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows] + [(101, 1, 1), (None, 1, 1), (8, 1, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, EDGES + rows + rows[:5] + [(None, None), (500, "idiot " * 50000), (501, "idiot")])
    got = X.classify(clashing(docs), labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert score[1] == score[2] == score[3] and score[5] == score[6]
    assert min(score[i] for i, _ in rows if i % 2) >= X.CUT > max(score[i] for i, _ in rows if not i % 2)
    assert all(r.score == score[r.doc_id] for r in got if r.doc_id is not None and r.doc_id >= 100)
    assert X.classify(docs.limit(0), labels).count() == 0
