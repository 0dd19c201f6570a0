import hashlib

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.helpers import EDGES, clashing, frame
from tests.llm.test_near_copies import brute_classes
from threadlake.llm import bpe, decontaminate, pii, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii_redaction", "bpe_encoding"]
    kept = {r.doc_id for r in quality_rules.report(docs).filter("kept").collect()}
    now = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    root = brute_classes([t for _, t in now])
    one = {i for k, (i, _) in enumerate(now) if root[k] == k}
    now = docs.filter(docs.doc_id.isin(sorted(one)))
    index = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    clean = {r.doc_id: r.text for r in now.collect() if not decontaminate.find([r.text], index)}
    redacted = {r.doc_id: r.text for r in pii.redact(now.filter(now.doc_id.isin(sorted(clean)))).collect()}
    library = Tokenizer.from_file(bpe.default_path())
    got = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert set(got) == set(redacted) and any(redacted[i] != clean[i] for i in clean) and len(got) < docs.count()
    for i, text in redacted.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()


def test_stages_on_rows_that_may_go_wrong(spark):
    many = clashing(frame(spark, [*EDGES, (9, "word " * 200 + "a@b.co"), (30, None), (30, "other text of the same id")])).withColumn("a.b", F.lit("dotted"))
    for name, stage in P.STAGES:
        got = stage(spark, many, SF)
        rows = got.collect()
        if name != "bpe_encoding":
            assert got.columns == many.columns and all(r["a.b"] == "dotted" for r in rows)
        empty = stage(spark, many.limit(0), SF)
        assert empty.schema.names == got.schema.names and empty.count() == 0
        count = {"quality_rules": 0, "benchmark_decontamination": many.count(), "pii_redaction": many.count(), "bpe_encoding": many.count()}
        assert name not in count or len(rows) == count[name] or name == "quality_rules"
        if name == "simhash_near_dedup":  # empty texts are one class, equal ones too; rows without an id stay
            assert sorted((r.doc_id or -1, len(r.text or "")) for r in rows) == sorted([(-1, 17), (1, 0), (4, 3), (5, 7), (8, len(EDGES[8][1])), (9, 150000), (9, 1006), (30, 25)])


def test_every_stage_but_the_last_returns_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(5), SF).schema.names == docs.schema.names
