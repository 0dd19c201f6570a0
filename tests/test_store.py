"""Snapshots, media, streams and nested payloads."""

import json

from pyspark.sql import functions as F

from threadlake.functions import payloads as P
from threadlake.operators import store as Z
from threadlake.streaming import ingest as I


def test_versions(spark, tmp_path):
    a, b = Z.Archive(spark, str(tmp_path / "a")), Z.Archive(spark, str(tmp_path / "b"))
    assert a.version() == 0
    one = spark.createDataFrame([(1, "x")], "id long, t string")
    assert a.commit({"m": one, "n": one}) == 1 and a.commit({"m": a.read("m").unionByName(one)}, carry=("n",)) == 2
    assert a.read("m").count() == 2 and a.read("m", 1).count() == 1 and a.read("n").count() == 1
    (tmp_path / "a" / "v=3" / "m").mkdir(parents=True)  # a job that died before its ledger row
    assert a.version() == 2
    assert a.copy_to(b, ("m", "n")) == {"m": 2, "n": 1}


def test_media_store(spark, tmp_path):
    for name, data in (("a.PNG", b"same"), ("sub/b.png", b"same"), ("c.txt", b"other")):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    objects, root = Z.media_objects(spark, str(tmp_path / "in")), str(tmp_path / "media")
    assert objects.count() == 2 and {r.extension for r in objects.collect()} == {"png", "txt"}
    none = spark.createDataFrame([], "sha256 string")
    Z.store_media(objects, none, root)
    Z.store_media(objects, spark.read.parquet(root), root)
    stored = spark.read.parquet(root)
    assert stored.count() == 2 and stored.filter("sha2(content, 256) = sha256").count() == 2
    assert Z.orphans(stored, stored.limit(1)).count() == 1


def test_stream_is_idempotent(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = lambda k, c: json.dumps({"conversation_id": "c", "native_id": f"n{k}", "timestamp_ms": k, "content": c})
    (source / "1.json").write_text("\n".join([row(1, "a"), row(2, "b"), row(1, "a"), "broken"]))
    archive = Z.Archive(spark, str(tmp_path / "archive"))
    I.stream_into(spark, str(source), archive, str(tmp_path / "cp")).awaitTermination()
    assert archive.read(I.TABLE).count() == 2
    (source / "2.json").write_text("\n".join([row(2, "b"), row(2, "changed"), row(3, "c")]))
    I.stream_into(spark, str(source), archive, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.state for r in I.states(archive).collect()) == ["new", "new", "new", "revision"]


def test_activity_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:04:59", "a"), ("2024-01-01 00:05:00", "b")], "t string, message_type string").select(F.to_timestamp("t").alias("ts"), "message_type")
    assert sorted((str(r.start), r.message_type, r.amount) for r in I.activity(rows).collect()) == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 00:05:00", "b", 1)]


def test_xml_summaries(spark):
    from pyspark.sql import functions as F

    cases = {
        None: None, "plain": None, "<msg": (P.UNKNOWN, "other", ""), "<msg/>": (P.UNKNOWN, "other", ""), "<!DOCTYPE x><msg/>": None, "<?xml version='1.0'?><!DOCTYPE m [<!ENTITY e SYSTEM 'file:///etc/passwd'>]><msg>&e;</msg>": (P.UNKNOWN, "other", ""),
        "<msg><wcpayinfo><receivertitle>T</receivertitle><senderdes>D</senderdes></wcpayinfo></msg>": ("[微信收款] T - D", "transfer", "微信收款\nT\nD"), '<msg username="u@openim"/>': ("[企业微信名片] u@openim", "contact", "u@openim"),
        "<msg><a><finderFeed><nickname>N</nickname><desc>d</desc></finderFeed></a></msg>": ("[视频号] N\nd", "video", "N\nd"), "<msg><appmsg><type>8</type><title>t</title></appmsg></msg>": ("[动画表情]", "emoji", ""),
        "  <msg><appmsg><title>a</title><des>a</des></appmsg></msg>": ("[微信分享] a", "link", "a\na"), "<msg><appmsg><title>a &amp; b</title><des> c </des></appmsg></msg>": ("[微信分享] a & b - c", "link", "a & b\nc"),
    }
    found = spark.createDataFrame([(c,) for c in cases], "c string").select("c", P.xml_summary(F.col("c")).alias("x")).collect()
    assert {r.c: tuple(r.x) if r.x else None for r in found} == cases


def test_nested_texts(spark):
    from pyspark.sql import functions as F

    value = {"text": " a\0 ", "deep": [{"title": True, "x": "no"}, {"content": ["b", 3, None, "https://l", "b"]}], "n": {"text": 'say \\"title\\": "x" \n', "summary": '"'}}
    cases = {json.dumps(value): 'a\nTrue\nb\n3\nsay \\"title\\": "x"\n"', "{broken": "", None: "", '{"text":"' + "x" * 5000 + '"}': "x" * 5000}
    found = spark.createDataFrame([(c,) for c in cases], "c string").select("c", P.json_texts(F.col("c")).alias("t")).collect()
    assert {r.c: r.t for r in found} == cases


def test_a_writer_that_died_blocks_nobody(spark, tmp_path):
    archive = Z.Archive(spark, str(tmp_path / "a"))
    one = spark.createDataFrame([(1, "x")], "id long, t string")
    archive.commit({"m": one})
    (tmp_path / "a" / "_versions" / f"{2:020d}.json").write_text("")
    (tmp_path / "a" / "_versions" / "_half").write_text('{"version": 2, "no')
    assert archive.version() == 1 and archive.commit({"m": one}, append=("m",)) == 2 and archive.read("m").count() == 2


def test_a_changed_cell_is_found(spark, tmp_path):
    import pytest

    rows = spark.createDataFrame([(1, "x", ["a"]), (2, None, None)], "id long, t string, l array<string>")
    mine, other = Z.Archive(spark, str(tmp_path / "a")), Z.Archive(spark, str(tmp_path / "b"))
    mine.commit({"m": rows})
    assert mine.copy_to(other, ("m",)) == {"m": 2}
    prints = lambda data: Z.fingerprint(spark.createDataFrame(data, rows.schema)).first()
    same = prints([(2, None, None), (1, "x", ["a"])])
    assert same == Z.fingerprint(rows).first()
    assert prints([(1, None, ["a"]), (2, "x", None)])["row"] != same["row"] and prints([(1, "y", ["a"]), (2, None, None)])["column t"] != same["column t"]
    other.read = lambda t, version=None: mine.read(t).withColumn("t", F.lit("x"))
    with pytest.raises(ValueError, match="column t"):
        mine.copy_to(other, ("m",))


def test_replayed_rejects_stay_single(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"conversation_id": "c", "native_id": "n", "timestamp_ms": 5, "content": "x"}\n{"conversation_id": null, "native_id": "m", "timestamp_ms": 6, "content": "y"}')
    archive = Z.Archive(spark, str(tmp_path / "archive"))
    for checkpoint in ("one", "two"):
        I.stream_into(spark, str(source), archive, str(tmp_path / checkpoint)).awaitTermination()
        assert (archive.read(I.TABLE).count(), archive.read(I.REJECTED).count()) == (1, 1)


def test_two_writers_lose_nothing(spark, tmp_path):
    import pytest

    a, b = Z.Archive(spark, str(tmp_path / "a")), Z.Archive(spark, str(tmp_path / "a"))
    one = spark.createDataFrame([(1, "x")], "id long, t string")
    a.commit({"m": one})
    b.version = lambda: 1  # has seen version 1 before the other writes version 2
    assert a.commit({"m": one}, append=("m",)) == 2
    with pytest.raises(Z.Conflict):
        b.commit({"m": one.limit(0)})
    del b.version
    assert b.version() == 2 and b.read("m").count() == 2 and sorted(r.version for r in a.ledger().collect()) == [1, 2]
    assert b.commit({"n": one}, carry=("m",)) == 3 and b.read("m").count() == 2 and b.read("m", 1).count() == 1


def test_stream_keeps_order_and_rows_without_ids(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda native, at, c: json.dumps({"conversation_id": "c", "native_id": native, "timestamp_ms": at, "content": c})
    (source / "1.json").write_text("\n".join([line("n", k, f"version {k}") for k in (4, 2, 5, 1, 3)] + [line(None, 9, "free"), line(None, 9, "free"), line("n", None, "no time")]))
    archive = Z.Archive(spark, str(tmp_path / "archive"))
    I.stream_into(spark, str(source), archive, str(tmp_path / "cp")).awaitTermination()
    rows = archive.read(I.TABLE).orderBy("seq").collect()
    assert [r.timestamp_ms for r in rows] == [1, 2, 3, 4, 5, 9] and len({r.seq for r in rows}) == 6
    first = rows[0].seq
    assert sorted((r.state, r.target) for r in I.states(archive).filter("state = 'revision'").collect()) == [("revision", first)] * 4
    assert archive.read(I.REJECTED).count() == 1
