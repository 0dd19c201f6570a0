"""Each export format on a small file of its shape."""

import json
import zipfile

import pytest

from threadlake.sources import exports as E
from threadlake.sources.workbook import WorkbookError, rows_of


def put(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text if isinstance(text, str) else json.dumps(text, ensure_ascii=False), encoding="utf-8")
    return str(p)


def rows(frame):
    return sorted(frame.collect(), key=lambda r: (r.path, r.position))


def qq_message(k, **more):
    return {"id": f"m{k}", "seq": str(k), "timestamp": 1700000000000 + k, "sender": {"uid": f"u{k % 2}", "uin": str(k % 2), "name": f"N{k % 2}"}, "type": "type_1", "content": {"text": f" hello {k} ", "elements": [], "resources": []}, "recalled": False, "system": False} | more


HEAD = {"metadata": {"name": "QQChatExporter", "version": "1"}, "chatInfo": {"name": "Club", "type": "group", "selfUid": "u0", "peerUid": "p9"}}


def test_qq_json(spark, tmp_path):
    reply = qq_message(2, content={"text": "re", "elements": [{"type": "reply", "data": {"messageId": "0"}}, {"type": "reply", "data": {"referencedMessageId": "m1", "messageId": "m0"}}], "resources": [{"type": "image", "localPath": "a/b.png"}]}, recalled=True)
    got = rows(E.qq_json(spark, put(tmp_path, "q.json", HEAD | {"messages": [qq_message(0), qq_message(1), reply]})))
    assert [(r.position, r.native_id, r.timestamp_ms, r.direction, r.content) for r in got] == [(0, "m0", 1700000000000, "outgoing", "hello 0"), (1, "m1", 1700000000001, "incoming", "hello 1"), (2, "m2", 1700000000002, "outgoing", "re")]
    assert (got[0].conversation_id, got[0].kind, got[0].account_id, got[0].title) == ("p9", "group", "u0", "Club")
    assert (got[2].reply_to, got[2].is_recalled, got[2].message_type, got[2].media_path) == ("m1", True, "type_1", "a/b.png")
    assert len({r.payload_hash for r in got}) == 3


def test_other_exporters_are_left_alone(spark, tmp_path):
    path = put(tmp_path, "q.json", HEAD | {"metadata": {"name": "other"}, "messages": [qq_message(0)]})
    assert E.qq_json(spark, path).count() == E.weflow_json(spark, path).count() == E.chatlab_json(spark, path).count() == 0


def test_qq_chunks_follow_the_manifest(spark, tmp_path):
    chunks = [{"relativePath": "chunks/c2.jsonl", "count": 1}, {"relativePath": "chunks/c1.jsonl", "count": 2}]
    put(tmp_path, "manifest.json", HEAD | {"chunked": {"chunks": chunks}})
    put(tmp_path, "chunks/c1.jsonl", json.dumps(qq_message(1)) + "\n\nnot json\n" + json.dumps(qq_message(2)) + "\n")
    put(tmp_path, "chunks/c2.jsonl", json.dumps(qq_message(3)))
    got = E.qq_chunked(spark, str(tmp_path)).orderBy("position").collect()
    assert [r.native_id for r in got] == ["m3", "m1", "m2"]


def test_natural_order(spark):
    names = spark.createDataFrame([(x,) for x in ("c10.jsonl", "C9.jsonl", "chunk1", "c010.jsonl")], "n string")
    assert [r.n for r in names.orderBy(E.natural_key(names.n), "n").collect()] == ["C9.jsonl", "c010.jsonl", "c10.jsonl", "chunk1"]


def test_weflow_json_both_layouts(spark, tmp_path):
    session = {"wxid": "w1", "remark": " Friend ", "type": "私聊"}
    plain = [{"localId": 1, "createTime": 1700000000, "type": "文本消息", "localType": 1, "content": "hi", "isSend": 0, "senderUsername": "a", "senderDisplayName": "Ann", "platformMessageId": "9"}, {"localId": 2, "createTime": 1700000001, "localType": 3, "content": "[图片]", "isSend": 1, "senderUsername": "me"}]
    got = rows(E.weflow_json(spark, put(tmp_path, "w.json", {"weflow": {"version": "1"}, "session": session, "messages": plain})))
    assert [(r.timestamp_ms, r.direction, r.message_type, r.sender_name, r.native_id) for r in got] == [(1700000000000, "incoming", "text", "Ann", "9"), (1700000001000, "outgoing", "image", "我", None)]
    assert got[0].title == "Friend" and got[0].account_id == "wechat-default"
    listed = {"weflow": {"version": "1"}, "session": {"wxid": "r@chatroom"}, "senders": [{"senderID": 1, "wxid": "a", "displayName": "Old"}, {"senderID": 1, "wxid": "b", "groupNickname": "New"}], "messages": [{"localId": 1, "createTime": 1700000000, "localType": 10000, "content": "x 撤回 y", "senderID": 1}]}
    (r,) = rows(E.weflow_json(spark, put(tmp_path, "l.json", listed)))
    assert (r.kind, r.sender_id, r.sender_name, r.direction, r.is_recalled) == ("group", "b", "New", "system", True)


def test_ciphertalk_json(spark, tmp_path):
    doc = {"exportInfo": {"generator": "CipherTalk"}, "session": {"wxid": "c", "isGroup": True, "ownerId": "o"}, "messages": [{"createTime": 1700000000000, "type": "聊天记录", "content": "log", "isSend": 0, "senderUsername": "s", "quotedContent": "q", "replyToMessageId": "7"}]}
    (r,) = rows(E.ciphertalk_json(spark, put(tmp_path, "c.json", doc)))
    assert (r.account_id, r.kind, r.message_type, r.search_text, r.reply_to, r.timestamp_ms) == ("o", "group", "forward", "log\nq", "7", 1700000000000)


LAB = {"chatlab": {"version": "0.0.2"}, "meta": {"name": "Lab", "platform": "wechat", "type": "group", "groupId": "g@chatroom", "ownerId": "Me"}}


def test_chatlab_json_and_lines(spark, tmp_path):
    members = [{"platformId": "A", "accountName": "First"}, {"platformId": "a", "accountName": "Last"}]
    messages = [{"sender": "a", "timestamp": 1700000000, "type": 4, "content": "f"}, {"sender": "ME", "timestamp": 1700000001, "type": 80, "content": "s"}, {"sender": "me", "timestamp": 1700000002, "type": 0, "content": "t"}]
    one = rows(E.chatlab_json(spark, put(tmp_path, "a.json", LAB | {"members": members, "messages": messages})))
    lines = [{"_type": "header"} | LAB, *({"_type": "member"} | m for m in members), *({"_type": "message"} | m for m in messages)]
    two = rows(E.chatlab_jsonl(spark, put(tmp_path, "b.jsonl", "﻿\n" + "\n".join(map(json.dumps, lines)) + "\nbroken{\n")))
    for got in (one, two):
        assert [(r.sender_name, r.message_type, r.direction) for r in got] == [("Last", "file", "incoming"), ("我", "system", "system"), ("我", "text", "outgoing")]
    assert [r.payload_hash for r in one] == [r.payload_hash for r in two]


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    text = '﻿id,MsgSvrID,type_name,is_sender,talker,msg,src,CreateTime\r\n1,9,text,0,Ann,"a ""b""\nc, d",,2023-11-28T09:30:08.000Z\r\n2,,sticker,1,我,,x/y.gif,2023-11-26T12:00:09.000Z\r\n'
    got = rows(E.weflow_csv(spark, put(tmp_path, "chat.csv", text)))
    assert [(r.content, r.direction, r.message_type, r.native_id, r.media_path, r.timestamp_ms) for r in got] == [('a "b"\nc, d', "incoming", "text", "9", None, 1701163808000), ("", "outgoing", "emoji", None, "x/y.gif", 1701000009000)]
    assert got[0].title == "chat" and got[0].conversation_id.startswith("file:")


def test_markdown_and_text_framing(spark, tmp_path):
    md = "# Title\n\n- 会话ID: `s1`\n- 会话类型: 群聊\n- 导出工具: WeFlow\n\n---\n\n## 2023-11-26 12:00:09 Ann\n\n![图片消息](../a.jpg)\n\n## 2023-11-26 12:00:10 我\n\n> quoted\n## not a header\n\n"
    got = rows(E.weflow_markdown(spark, put(tmp_path, "m.md", md)))
    assert [(r.sender_name, r.direction, r.message_type, r.content, r.search_text) for r in got] == [("Ann", "incoming", "image", "![图片消息](../a.jpg)", "图片消息"), ("我", "outgoing", "text", "> quoted\n## not a header", "quoted\n## not a header")]
    assert (got[0].conversation_id, got[0].kind, got[0].title) == ("s1", "group", "Title")
    txt = "2023-11-26 12:00:10 'Ann'\nline one\n2023-11-26 12:00:11 'no blank line before'\n\n2023-11-26 12:00:12 '我'\n[图片]\n"
    got = rows(E.weflow_text(spark, put(tmp_path, "t.txt", txt)))
    assert [(r.sender_name, r.message_type, r.content) for r in got] == [("Ann", "text", "line one\n2023-11-26 12:00:11 'no blank line before'"), ("我", "image", "[图片]")]


def test_qq_text(spark, tmp_path):
    text = "[QQChatExporter V5 / x]\n\n聊天名称: Club\n聊天类型: 群聊\n\n[1]\nAnn:\n时间: 2023-11-26 12:00:11\n类型: 文本\n内容: first\nsecond\n\n[2]\nBob:\n时间: 2023-11-26 12:00:12\n类型: type_1\n内容: x\n\n=====\n     导出完成\n=====\n总计导出 2 条消息\n"
    got = rows(E.qq_text(spark, put(tmp_path, "q.txt", text)))
    assert [(r.sender_name, r.message_type, r.content, r.kind, r.title) for r in got] == [("Ann", "text", "first\nsecond", "group", "Club"), ("Bob", "unknown", "x", "group", "Club")]


def test_sql_dumps_are_read_not_run(spark, tmp_path):
    columns = ", ".join(E.WEFLOW_COLUMNS)
    sql = f"BEGIN;\nINSERT INTO weflow_messages ({columns}) VALUES ('s@chatroom', '1', NULL, 1700000000, 'a', TRUE, 1, NULL, 'it''s (fine), ok; yes', NULL), ('s@chatroom', '2', 'm2', 1700000001, 'b', FALSE, 3, 'voice', NULL, 'p.amr');\nDROP TABLE x;\nCOMMIT;\n"
    got = rows(E.weflow_sql(spark, put(tmp_path, "w.sql", sql)))
    assert [(r.content, r.direction, r.message_type, r.native_id, r.media_path, r.kind) for r in got] == [("it's (fine), ok; yes", "outgoing", "text", None, None, "group"), ("", "incoming", "audio", "m2", "p.amr", "group")]
    s, m = ", ".join(E.SESSION_COLUMNS), ", ".join(E.CIPHER_COLUMNS)
    sql = f"INSERT INTO sessions ({s}) VALUES ('w', 'Name', 'private', 'own', 1, 1, 1, 1);\nINSERT INTO messages ({m}) VALUES\n('w', 1, 1700000000, 'x', '图片消息', 'c', 0, 'a', 'Ann', NULL, '5'),\n('other', 2, 1700000000, 'x', '文本消息', 'c', 1, 'a', 'Ann', NULL, NULL);\n"
    (r,) = rows(E.ciphertalk_sql(spark, put(tmp_path, "c.sql", sql)))
    assert (r.account_id, r.title, r.message_type, r.reply_to, r.sender_name) == ("own", "Name", "image", "5", "Ann")


def workbook(path, sheets, extra=()):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</R>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>shared</t></si></sst>')
        for k, table in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{i}">' + "".join(f'<c r="{E._letters(j)}{i}" t="s"><v>0</v></c>' if v is None else f'<c r="{E._letters(j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(row)) + "</row>" for i, row in enumerate(table, 1))
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        for name in extra:
            z.writestr(name, "x")
    return str(path)


def test_spreadsheets(spark, tmp_path):
    w = workbook(tmp_path / "w.xlsx", {"聊天记录": [["会话"], E.SHEETS["weflow"][0], ["1", "2023-11-26 12:00:11", "我", "图片消息", None]]})
    (r,) = rows(E.weflow_sheet(spark, w))
    assert (r.direction, r.message_type, r.content, r.timestamp_ms, r.title) == ("outgoing", "image", "shared", 1701000011000, "w")
    q = workbook(tmp_path / "q.xlsx", {"聊天记录": [E.SHEETS["qq"][0], ["1", "2023-11-26 12:00:11", "Ann", "123", "文本", "hi", "是", "0"]]})
    (r,) = rows(E.qq_sheet(spark, q))
    assert (r.sender_id, r.is_recalled, r.direction, r.content) == ("123", True, "incoming", "hi")
    c = workbook(tmp_path / "c.xlsx", {"Chat": [E.SHEETS["ciphertalk"][0], ["1", "x", "x", "x", "x", "Bob", "wx", "文本消息", "yo", "34", "1701000011"]]})
    (r,) = rows(E.ciphertalk_sheet(spark, c))
    assert (r.title, r.sender_id, r.message_type, r.timestamp_ms) == ("Chat", "wx", "audio", 1701000011000)
    assert E.weflow_sheet(spark, c).count() == E.qq_sheet(spark, w).count() == 0


@pytest.mark.parametrize("extra", [["xl/vbaProject.bin"], ["../evil"], ["XL/WORKBOOK.xml"]])
def test_unsafe_workbooks_are_refused(tmp_path, extra):
    path = workbook(tmp_path / "x.xlsx", {"s": [["a"]]}, extra)
    with pytest.raises(WorkbookError):
        list(rows_of(open(path, "rb").read()))


def test_discovery_prunes_and_orders(spark, tmp_path):
    for name in ("B.json", "a.csv", "media/x.json", "x.html", "sub/C.TXT"):
        put(tmp_path, name, "x")
    assert [r.path.rsplit("/", 1)[1] for r in E.discover(spark, str(tmp_path)).collect()] == ["a.csv", "B.json", "C.TXT"]


def test_read_all_and_rejects(spark, tmp_path):
    put(tmp_path, "q.json", HEAD | {"messages": [qq_message(0), qq_message(1, timestamp="never")]})
    put(tmp_path, "c.csv", "id,MsgSvrID,type_name,is_sender,talker,msg,src,CreateTime\n1,9,text,0,Ann,hi,,2023-11-28T09:30:08.000Z\n")
    got = E.read_all(spark, str(tmp_path))
    assert got.count() == 3 and E.valid(got).count() == 2
    assert [r.reason for r in E.rejects(got).collect()] == ["no time"]


def test_read_all_walks_folders(spark, tmp_path):
    csv = "id,MsgSvrID,type_name,is_sender,talker,msg,src,CreateTime\n1,9,text,0,Ann,hi,,2023-11-27T10:20:30.000Z\n"
    put(tmp_path, "deep/er/UPPER.CSV", csv)
    put(tmp_path, "deep/q.JSON", HEAD | {"messages": [qq_message(0)]})
    put(tmp_path, "media/skipped.csv", csv)
    put(tmp_path, "big/manifest.json", HEAD | {"chunked": {"chunks": [{"relativePath": "chunks/c2.jsonl", "count": 1}]}})
    put(tmp_path, "big/chunks/c2.jsonl", json.dumps(qq_message(5)) + "\n" + json.dumps(qq_message(6)))
    put(tmp_path, "big/chunks/c10.jsonl", json.dumps(qq_message(8)))
    put(tmp_path, "big/chunks/c9.jsonl", json.dumps(qq_message(7)))
    got = E.read_all(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.position) for r in got.collect()) == [("UPPER.CSV", 0), ("manifest.json", 0), ("manifest.json", 1), ("q.JSON", 0)]
    (tmp_path / "none").mkdir()
    assert E.read_all(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(("name", "kind"), [("文本", "text"), ("Text", "unknown"), ("image", "image"), ("音频", "audio"), ("表情", "face"), ("系统消息", "system"), ("other", "unknown")])
def test_types_of_the_qq_line_format(spark, name, kind):
    from pyspark.sql import functions as F

    assert spark.range(1).select(E._named_type(E.QQ_TEXT_TYPES, F.lit(name), F.lit("unknown")).alias("k")).first().k == kind
