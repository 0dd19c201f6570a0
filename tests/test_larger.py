"""What larger tables brought to light."""

import pytest
from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.operators import dedup, store
from threadlake.plans import registry  # noqa: F401  (before the plans that it imports)
from threadlake.plans import reading


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bytes_as_printf(spark):
    """Halves go to the even digit, as in SQL; Java's format rounded them up."""
    cases = [1280, 1792, 1331, (1 << 20) + (1 << 18), (1 << 20) + 3 * (1 << 18), (1 << 30) - 1, (1 << 30) + (1 << 27)]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in cases], "n long").select(T.format_bytes(F.col("n"))).collect()]
    assert got == ["1.2 KiB", "1.8 KiB", "1.3 KiB", "1.2 MiB", "1.8 MiB", "1024.0 MiB", "1.12 GiB"]


def test_media_text_stays_in_mib(spark):
    class Large:
        def media(self):
            return spark.createDataFrame([("b", 2 << 20)], "brand string, size long")

    assert reading.media_text(Large()).first()["shown"] == f"{(2 << 20) * 1000 / 1048576:.1f} MiB"


def test_lookup_of_hot_keys(spark, monkeypatch):
    """A key of many rows, a listed one or not, and rows without a key; the hot rows take no part in the shuffled join's key."""
    monkeypatch.setattr(store, "HOT", 5)
    rows = [(k, 0, *x) for k, x in enumerate([("d", None, None)] * 7 + [("x", "gone", "src")] * 9 + [("x", "gone", "lost")] * 6 + [(None, "one", "src"), (None, None, "two"), ("e", "one", None)])]
    wanted = spark.createDataFrame(rows, "message_id long, ordinal int, sha256 string, managed_path string, source_path string")
    listing = spark.createDataFrame([("d", "long/d"), ("d", "d"), ("-", "src"), ("f", "one"), ("g", "two")], "sha256 string, path string")
    found = store.locate(wanted, listing)
    assert [r["path"] for r in found.orderBy("message_id").collect()] == ["d"] * 7 + ["src"] * 9 + [None] * 6 + ["one", "two", "one"]
    assert "xxhash64" in plan(found)


@pytest.mark.parametrize("attached", [True, False])
def test_observed_without_sorts(spark, attached):
    seen = spark.range(20).select((F.col("id") % 4).alias("message_id"), F.col("id").alias("place"))
    has = spark.createDataFrame([(1,), (1,), (9,)], "message_id long")
    found = dedup.observed(seen, has, attached)
    assert {r["message_id"] for r in found.collect()} == ({1} if attached else {0, 2, 3}) and found.count() == (5 if attached else 15)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_xml_is_parsed_once(spark):
    from threadlake.functions import payloads as P

    texts = ["<msg username='u'><a/></msg>", "<msg><wcpayinfo><scenetext> s </scenetext><sendertitle>t</sendertitle></wcpayinfo></msg>", "<msg><appmsg><type>8</type></appmsg></msg>", "<msg><finderFeed><nickname>n</nickname></finderFeed></msg>", "<msg><x><appmsg><title>a</title><des>b</des></appmsg></x></msg>", "<msg>"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(P.xml_summary(F.col("t")).alias("x"))
    assert [(r.x.summary, r.x.kind) for r in found.collect()] == [("[微信名片] u", "contact"), ("[s] t", "transfer"), ("[动画表情]", "emoji"), ("[视频号] n", "video"), ("[微信分享] a - b", "link"), (P.UNKNOWN, "other")]
    assert str(P._summary(F.col("t"))).count("xpath_") == 1


def test_fold_streams_versions(spark):
    """Groups of any size pass row by row: a version meets the one before it by its older payload, and none is searched for by a scan."""
    n = 4000
    rows = [("c", "one", None, f"m{k}", f"p{k}", [f"p{k - 1}"] if k % 2 else None, k) for k in range(n)] + [("c", None, None, "m", f"q{k}", None, n + k) for k in range(2)]
    found = dedup.fold_state(spark.createDataFrame(rows, "conversation_id string, native_id string, local_id string, semantic_hash string, payload_hash string, compatible array<string>, seq long"), "qq")
    got = {r.seq: (r.state, r.target) for r in found.collect()}
    wanted = {k: ("duplicate", k - 1) if k % 2 else ("revision", 0) for k in range(1, n)} | {0: ("new", None), n: ("new", None), n + 1: ("revision", n)}
    assert got == wanted
    assert "FlatMapGroups" not in plan(found) and "MapInArrow" in plan(found)
