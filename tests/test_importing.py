"""Digests by format, what a folder is found to hold, and the composed import."""

import hashlib
import json

import pytest

from tests.test_sources import HEAD, put, qq_message, rows
from threadlake.functions import hashing as X
from threadlake.operators import media as M
from threadlake.operators.importing import digests, import_into
from threadlake.operators.store import Archive
from threadlake.sources import exports as E


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value):
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def test_numbers_as_canonical_json_writes_them(spark):
    from pyspark.sql import functions as F

    values = [0.0, -0.0, 1.0, 12.5, 1e15, 1e16, 1.5e16, 1e22, 1.2e-4, 1e-5, 1.5e-7, 123456789.25, 0.1, -3.75]
    found = spark.createDataFrame([(v,) for v in values], "x double").select("x", X.number_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in found] == [repr(r.x) for r in found]
    assert spark.range(1).select(X.number_text(F.lit(float("nan"))).alias("t")).first().t == "NaN"


def test_nested_and_escaped(spark):
    from pyspark.sql import functions as F

    text = 'a\u000b\u001f\\u000B"\n\\\u001a é\u007f'
    row = spark.createDataFrame([(text, None)], "b string, a string").select(X.canonical_json({"b": F.col("b"), "z": F.col("a")}, {"c": F.lit('[{"d":1}]'), "A": F.lit(None).cast("string")}).alias("j")).first()
    assert row.j == canonical({"b": text, "z": None, "c": [{"d": 1}], "A": None})


def test_weflow_digests(spark, tmp_path):
    message = {"localId": 1, "createTime": 1700000000, "type": "文本消息", "localType": 1, "content": "<msg><appmsg><title>T</title></appmsg></msg>", "isSend": 1, "senderUsername": "me", "platformMessageId": "9", "quotedContent": "q"}
    doc = {"weflow": {"version": "1"}, "session": {"wxid": "w", "displayName": "D"}, "messages": [message, message | {"createTime": 1700000001, "platformMessageId": "10"}]}
    first, _ = rows(E.weflow_json(spark, put(tmp_path, "w.json", doc)))
    now = {"timestamp_ms": 1700000000000, "sender": "me", "direction": "outgoing", "local_type": "1", "media_type": None, "message_type": "link", "content": "[微信分享] T", "media_name": None, "reply_to_native_id": None, "search_text": "[微信分享] T\nT\nq"}
    before = now | {"message_type": "text", "content": message["content"], "search_text": message["content"] + "\nq"}
    oldest = {k: before[k] for k in ("timestamp_ms", "sender", "direction", "local_type", "media_type", "content", "media_name")}
    assert first.payload_hash == digest(now) and first.compatible == sorted({digest(before), digest(oldest)})
    assert first.semantic_hash == digest({k: now[k] for k in ("timestamp_ms", "sender", "direction", "local_type")})


def test_qq_digests(spark, tmp_path):
    content = {"text": "see", "elements": [{"type": "reply", "data": {"messageId": "7"}}], "resources": [{"type": "image", "filename": "a.png", "size": 9, "md5": "m", "duration": 1.5, "localPath": "x/a.png"}]}
    (r,) = rows(E.qq_json(spark, put(tmp_path, "q.json", HEAD | {"messages": [qq_message(2, type="Mixed", seq="4", content=content)]})))
    attached = [{"kind": "image", "filename": "a.png", "size": 9, "width": None, "height": None, "duration": 1.5, "md5": "m"}]
    old = {"timestamp_ms": r.timestamp_ms, "sender": r.sender_id, "direction": r.direction, "message_type": "mixed", "content": "see", "attachments": attached, "recalled": False, "system": False, "reply_to": "7"}
    assert r.payload_hash == digest(old | {"search_text": "see\na.png", "sequence": "4"}) and r.compatible == [digest(old)]
    assert r.semantic_hash == digest({k: old[k] for k in ("timestamp_ms", "sender", "message_type", "content")})


def test_lab_digests_and_names(spark, tmp_path):
    message = {"sender": "a", "timestamp": 1700000000, "type": 1, "content": "[图片] a/b.png", "senderDisplayName": "Shown", "quote": {"messageId": "q1", "content": "before"}}
    doc = {"chatlab": {"version": "0.0.2"}, "meta": {"name": "Lab", "type": "private", "id": "peer", "ownerId": "me"}, "messages": [message]}
    path = put(tmp_path, "l.json", doc)
    (r,) = rows(E.chatlab_json(spark, path))
    facts = {"timestamp_ms": 1700000000000, "sender": "a", "direction": "incoming", "local_type": "1", "media_type": "image", "message_type": "image", "content": "[图片] a/b.png", "media_name": None, "reply_to_native_id": "q1", "search_text": "[图片] a/b.png\nbefore"}
    assert r.payload_hash == digest(facts) and r.compatible == [] and (r.sender_name, r.kind, r.reply_to) == ("Shown", "private", "q1")
    put(tmp_path, "media/a/b.png", "png")
    found = M.resolve(E.chatlab_json(spark, path), E._paths(spark, str(tmp_path)).select("path"))
    (s,) = E.hashed(found).collect()
    assert s.attachments[0]["source"].endswith("/media/a/b.png") and s.attachments[0]["exists"]
    assert s.payload_hash == digest(facts | {"media_name": "b.png"}) and s.compatible == [digest(facts)]


CSV = ",".join(E.CSV_HEADER) + "\n1,9,text,0,Ann,hi,,2023-11-28T09:30:08.000Z\n"


def test_folders_are_told_apart(spark, tmp_path):
    root = tmp_path / "media"  # a root may be called as it likes
    put(root, "a.csv", CSV)
    put(root, "out/b.csv", CSV)
    put(root, "files/c.csv", CSV)
    put(root, "other.json", {"metadata": {"name": "else"}})
    put(root, "none.json", "plain text")
    put(root, "x.xlsx", "no zip")
    put(root, "late.json", {"pad": "x" * 70000} | HEAD | {"messages": [qq_message(0)]})
    put(root, "chunks/c.csv", CSV)  # no manifest beside it
    put(root, "m/manifest.json", HEAD | {"chunked": {"chunksDir": "parts", "chunks": [{"fileName": "c1.jsonl"}]}})
    put(root, "m/parts/c1.jsonl", json.dumps(qq_message(1)))
    put(root, "m/chunks/c2.jsonl", json.dumps(qq_message(2)))
    told = {r.path.split("/media/", 1)[1]: (r.reader, r.error) for r in E.sniffed(spark, str(root), (str(root / "out"),)).collect()}
    assert told == {"a.csv": ("weflow_csv", None), "chunks/c.csv": ("weflow_csv", None), "none.json": (None, "malformed JSON"), "x.xlsx": (None, "not a zip package"), "late.json": ("qq_json", None), "m/manifest.json": ("qq_chunked", None)}
    got = E.read_all(spark, str(root), (str(root / "out"),))
    assert sorted((r.path.rsplit("/", 1)[1], r.native_id) for r in E.valid(got).collect()) == [("a.csv", "9"), ("c.csv", "9"), ("late.json", "m0"), ("manifest.json", "m1")]
    assert sorted(r.reason for r in E.rejects(got).collect()) == ["malformed JSON", "not a zip package"]


@pytest.mark.parametrize(
    ("chunked", "error"),
    [
        ({"chunks": []}, "manifest lists no chunks"), ({}, "manifest without a list of chunks"), ({"chunks": [{"relativePath": "../c1.jsonl"}]}, "unsafe chunk"), ({"chunks": [{"relativePath": "chunks/c1.txt"}]}, "unsafe chunk"),
        ({"chunks": [{"relativePath": "chunks/c1.jsonl"}, {"fileName": "c1.jsonl"}]}, "chunk listed twice"), ({"chunksDir": "/abs", "chunks": [{"fileName": "c1.jsonl"}]}, "unsafe folder of chunks"), ({"chunks": [{"relativePath": "chunks/c9.jsonl"}]}, "no such chunk"),
    ],
)
def test_manifests_that_fail(spark, tmp_path, chunked, error):
    put(tmp_path, "manifest.json", HEAD | {"chunked": chunked})
    put(tmp_path, "chunks/c1.jsonl", json.dumps(qq_message(1)))
    (r,) = E.qq_chunked(spark, str(tmp_path)).collect()
    assert r.error.startswith(error) and r.timestamp_ms is None and r.native_id is None


def test_manifest_without_a_list_and_its_digest(spark, tmp_path):
    put(tmp_path, "manifest.json", HEAD)
    for name, k in (("chunks/c10.jsonl", 3), ("chunks/c9.jsonl", 2), ("chunk1.jsonl", 4), ("notes.jsonl", 9)):
        put(tmp_path, name, json.dumps(qq_message(k)))
    got = E.qq_chunked(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.position, r.native_id) for r in got] == [(0, "m2"), (1, "m3"), (2, "m4")]
    read = lambda name: (tmp_path / name).read_bytes()
    whole = read("manifest.json") + b"".join(f"\nchunk:{n}:{len(read(n))}:{hashlib.sha256(read(n)).hexdigest()}\n".encode() for n in ("chunks/c9.jsonl", "chunks/c10.jsonl", "chunk1.jsonl"))
    files = E.sniffed(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in digests(spark, files).collect()} == {"manifest.json": hashlib.sha256(whole).hexdigest()}


def test_files_beyond_the_binary_source_fail_alone(spark, tmp_path, monkeypatch):
    put(tmp_path, "a.csv", CSV)
    put(tmp_path, "b.csv", CSV + CSV[len(",".join(E.CSV_HEADER)) + 1 :] * 50)
    monkeypatch.setattr(E, "BIGGEST", 1000)
    assert {r.path.rsplit("/", 1)[1]: (r.reader, r.error) for r in E.sniffed(spark, str(tmp_path)).collect()} == {"a.csv": ("weflow_csv", None), "b.csv": (None, "too large to be told apart")}
    assert [r.path.rsplit("/", 1)[1] for r in digests(spark, E.sniffed(spark, str(tmp_path))).collect()] == ["a.csv"]


def test_own_senders(spark):
    chat = [("f", k, s, True, private, "peer") for private, path in ((True, "f"),) for k, s in enumerate(["a", "b", "b", "a", "peer", "peer", "peer", "x"])]
    chat += [("g", k, "peer", True, True, "peer") for k in range(2)] + [("h", 0, "once", True, False, "c")]
    frame = spark.createDataFrame(chat, "path string, position long, _sender string, _own boolean, _private boolean, _chat string")
    assert {r.path: r.self for r in E.own_senders(frame).collect()} == {"f": "b", "g": "peer"}


def test_import_keeps_media_states(spark, tmp_path):
    from pyspark.sql import functions as F

    message = lambda k, **more: {"localId": k, "createTime": 1700000000 + k, "type": "文本消息", "localType": 1, "content": "hi", "isSend": 0, "senderUsername": "a", "platformMessageId": str(k)} | more
    messages = [message(0), message(1, type="图片消息", content="images/a.png"), message(2, type="图片消息", content="[图片]")]
    put(tmp_path, "in/w.json", {"weflow": {"version": "1"}, "session": {"wxid": "w", "displayName": "D"}, "messages": messages})
    archive = Archive(spark, str(tmp_path / "archive"))
    run = lambda: import_into(archive, str(tmp_path / "in")).select("status", "added", "duplicates", "attachments", "missing_media").first()
    state = lambda: {r.ordinal_of: (r.is_available, (r.source or "").rsplit("/", 1)[1:]) for r in archive.read("attachments").join(archive.read("messages"), F.col("message_id") == F.col("seq")).select(F.col("native_id").alias("ordinal_of"), "is_available", "source").collect()}
    assert tuple(run()) == ("completed", 3, 0, 2, 2)  # one is not there, one has no path at all
    assert state() == {"1": (False, ["a.png"]), "2": (False, [])}
    put(tmp_path, "in/images/a.png", "png")
    assert tuple(run()) == ("completed", 0, 3, 2, 1) and state() == {"1": (True, ["a.png"]), "2": (False, [])}
    assert archive.read("messages").count() == 3 and archive.read("conversations").first().amount == 3
