"""A JSON document cut into blocks gives the objects that it holds as a whole."""

import json

import pytest

from threadlake.sources import jsonblocks as J

NASTY = ["plain", 'quote " brace } bracket ] {[', "back\\slash \\", 'ends with \\"', "", "日本 é", "}{", '"messages":[{"x":1}]']


def document(n=60):
    item = lambda k: {"id": k, "text": NASTY[k % len(NASTY)], "deep": {"list": [{"a": [1, {"b": "}"}]}, []], "none": None}, "tail": [[], {}]}
    return {"metadata": {"name": "x}", "deep": {"of": {"y": [1]}}}, "list": [1, 2], "empty": [], "senders": [{"senderID": 1, "n": "["}, {"senderID": 2}], "session": {"wxid": "w"}, "more": [{"x": [[{}]]}], "messages": [item(k) for k in range(n)], "after": {"z": [{"no": 1}]}}


def read(spark, path):
    return J.elements(spark, str(path)).collect()


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [300, 1000])
def test_objects_of_any_cut(spark, tmp_path, indent, size):
    doc = document()
    (tmp_path / "d.json").write_text(("" if size == 300 else "\ufeff") + json.dumps(doc, ensure_ascii=False, indent=indent) + ("\n" if indent else ""), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read(spark, tmp_path / "d.json")
        if size == 1000:
            assert J.pieces(spark, str(tmp_path / "d.json")).select("block").distinct().count() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name in ("senders", "more", "messages"):
        assert [json.loads(r.element) for r in sorted((r for r in rows if r.section == name), key=lambda r: r.position)] == doc[name]
    (head,) = [r.head for r in rows if r.section == "messages" and r.position == 0]
    assert {k: v for k, v in json.loads(head).items() if k != "messages"} == {k: v for k, v in doc.items() if k not in ("messages", "after")}
    assert {r.section for r in rows} == {"senders", "more", "messages"} and all(r.error is None for r in rows)


@pytest.mark.parametrize(("text", "error"), [('{"messages": [{"a": 1}, {"b": ', "JSON ends early"), ('{"messages": [{"a": 1}]', "JSON ends early"), ('{"messages": [{"a": 1}]} {"x": 1}', "JSON goes on after its root"), ('{"messages": [{"a": "b', "JSON ends early")])
def test_files_that_end_wrongly(spark, tmp_path, text, error):
    (tmp_path / "d.json").write_text(text)
    (r,) = read(spark, tmp_path / "d.json")
    assert (r.error, r.element) == (error, None)


def test_documents_without_objects(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"messages": [], "other": {"x": []}}')
    assert read(spark, tmp_path / "d.json") == []


def test_large_files_read_alike(spark, tmp_path, monkeypatch):
    from tests.test_sources import HEAD, put, qq_message
    from threadlake.sources import exports as E

    put(tmp_path, "q.json", HEAD | {"messages": [qq_message(k, content={"text": NASTY[k % 8]}) for k in range(9)]})
    wechat = [{"localId": k, "createTime": 1700000000 + k, "type": "文本消息", "content": NASTY[k % 8], "isSend": k % 2, "senderID": 1 + k % 2} for k in range(9)]
    put(tmp_path, "w.json", {"weflow": {"version": "1"}, "session": {"wxid": "w"}, "senders": [{"senderID": 1, "wxid": "a"}, {"senderID": 2, "wxid": "b"}], "messages": wechat})
    put(tmp_path, "cut.json", json.dumps(HEAD)[:-1] + ', "messages": [{"id": "1"}')
    told = lambda: sorted((r.path, r.position, r.native_id, r.sender_id, r.content, r.payload_hash, r.timestamp_ms) for r in E.valid(E.read_all(spark, str(tmp_path))).collect())
    whole = told()
    monkeypatch.setattr(E, "LARGE", 0)
    assert len(whole) == 18 and told() == whole
    assert [r.reason for r in E.rejects(E.read_all(spark, str(tmp_path))).collect()] == ["JSON ends early"]


def test_pack_and_files_alike_by_one_exchange(spark, tmp_path):
    """The pieces of a pack were joined to sums of blocks, heads and arrays, each join by exchanges and sorts of its own."""
    texts = [json.dumps(document(), ensure_ascii=False, indent=2), json.dumps(document(9)), '{"messages": [], "x": [1, {"a": 1}]}', '{"x": [1, {"a": 1}], "messages": [{"b": "}"}]}\n', '{"messages": [{"a": "b', '{"a": 1}} ', '{"m": [{"a": 1}]} {"x": 1}', "", "}"]
    for k, text in enumerate(texts):
        (tmp_path / f"d{k}.json").write_text(text, encoding="utf-8")
    pack = J.elements(spark, spark.createDataFrame([(f"file:{tmp_path}/d{k}.json", t) for k, t in enumerate(texts)], "path string, text string"))
    assert pack._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    files = J.elements(spark, f"{tmp_path}/*.json")
    told = lambda found: sorted((tuple(r) for r in found.select("path", "error", "section", "position", "element", "head").collect()), key=str)
    assert told(pack) == told(files) and len({r.path for r in pack.collect()}) == 7
