from collections import Counter

from pyspark.sql import functions as F

from tests.compare import assert_equal, connect
from tests.llm.helpers import EDGES, clashing, frame
from threadlake.llm import quality_rules as Q
from threadlake.llm.queries import ORACLES, QUERIES

WHITE = " \t\n\v\f\r"


def brute(text):
    words = [w for w in "".join(" " if c in WHITE else c for c in text or "").split(" ") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(WHITE)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measurements_match_brute_force(spark):
    texts = [*EDGES, (20, "a b c a b c a b\nx\n\nx\n \nx"), (21, "a a a a a"), (22, "# | $ a b c <>"), (23, "a b c d a b c"), (24, "p q r " * 40 + "z\n" * 60)]
    rows = Q.report(frame(spark, texts)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((i, *brute(t)) for i, t in texts)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)


def test_oracle(spark):
    con = connect("/root/testdata/sf0.001")
    assert_equal(Q.report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")), con, ORACLES["op4_quality_rules"])


def test_ablation_oracle(spark):
    assert_equal(QUERIES["quality_ablation"](spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), ORACLES["quality_ablation"])


def test_policies_and_ablation_come_from_the_ledger(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ledger = Q.ledger(docs).select("doc_id", "ledger").cache()
    for policy in Q.POLICIES.values():
        kept = ledger.filter(Q.passes(F.col("ledger.fail_bits"), policy)).count()
        rows = {r.rule: r for r in Q.ablation(ledger, policy).collect()}
        assert set(rows) == set(policy.rules) and all(r.n_kept == kept for r in rows.values())
        for name, r in rows.items():
            rest = Q.Policy("x", tuple(n for n in policy.rules if n != name))
            assert r.n_kept_without == ledger.filter(Q.passes(F.col("ledger.fail_bits"), rest)).count()


def test_keep_leaves_columns_alone(spark):
    good = " ".join(f"word{k}" for k in range(80))
    docs = clashing(frame(spark, [*EDGES, (50, good), (51, good)]))
    kept = Q.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [50, 51] and kept.first().ledger == "kept"
    assert Q.report(docs.limit(0)).count() == Q.keep(docs.limit(0)).count() == 0
    assert Q.ablation(Q.ledger(frame(spark, [])).select("ledger")).first().n_docs == 0


def test_runs_without_python(spark):
    plan = Q.report(frame(spark, EDGES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
