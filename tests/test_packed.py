"""Exports as rows of a pack are read as the same exports in files, and the round trips write no file for each conversation."""

import glob

import pytest

from tests.compare import canonical
from threadlake.plans import registry
from threadlake.sources import exports as E
from threadlake.sources import textblocks as B

QQ = '{"metadata":{"name":"QQChatExporter"},"chatInfo":{"name":"n","selfUid":"u"},"messages":[{"id":"1","timestamp":"1700000000000","sender":{"uid":"u"},"content":{"text":"a } [b] \\" {"}},{"id":"2","timestamp":"1700000001000","sender":{"uid":"v"},"content":{"text":"\\u4f60"}}]}'
WEFLOW = '{"weflow":{"version":"1"},"session":{"wxid":"w","type":"x"},"messages":[{"localId":1,"createTime":1700000000,"type":"t","content":"a","isSend":1,"senderUsername":"me"},{"localId":2,"createTime":1700000001,"content":"b","isSend":1,"senderUsername":"me"}]}'
CIPHER = WEFLOW.replace('"weflow":{"version":"1"}', '"exportInfo":{"generator":"CipherTalk"}')
LAB = '{"chatlab":{"version":"0.0.2"},"meta":{"name":"n","platform":"qq","ownerId":"ME"},"members":[{"platformId":"A","accountName":"Ann"}],"messages":[{"sender":"a","timestamp":1700000000,"content":"x"},{"sender":"me","timestamp":1700000001,"content":"y"}]}'
LINES = '{"_type":"header","chatlab":{"version":"0.0.2"},"meta":{"name":"n"}}\r\n\n{"_type":"message","sender":"a","timestamp":1700000000,"content":"x"}\nbad\n'
CSV = ",".join(E.CSV_HEADER) + '\r\n1,m1,text,1,"Ann, A","two\r\nlines, ""quoted""\n\nend",,2024-01-01T00:00:00Z\r\n\r\n2,m2,text,0,Bob,plain,,2024-01-01T00:00:01Z'
MARKDOWN = "# Chat\n\n- 会话ID: `c1`\n- 会话类型: 私聊\n- 导出工具: WeFlow\n\n---\n\n## 2024-01-01 00:00:00 Ann\n\nhi\n\n## 2024-01-01 00:00:01 我\n\nthere\n"
TEXT = "2024-01-01 00:00:00 'Ann'\nhi\n\n2024-01-01 00:00:01 'Bob'\nthere\nmore\n"
QQ_TEXT = "[QQChatExporter V5 / x]\r\n\r\n聊天名称: n\r\n聊天类型: 群聊\r\n\r\nAnn:\r\n时间: 2024-01-01 00:00:00\r\n内容: hi\r\n\r\nmore\r\n资源: 1 个文件\r\n  - image: a.png\r\n\r\n[1]\r\nBob:\r\n时间: 2024-01-01 00:00:01\r\n内容: there\r\n\r\n\r\n=====\r\n     导出完成\r\n=====\r\n"
WEFLOW_SQL = f"INSERT INTO weflow_messages ({', '.join(E.WEFLOW_COLUMNS)}) VALUES\n('s', 1, 'm', 1700000000, 'a', TRUE, 1, NULL, 'it''s', NULL);"
CIPHER_SQL = f"INSERT INTO sessions ({', '.join(E.SESSION_COLUMNS)}) VALUES ('w', 'T', 'private', 'o', 0, 0, 0, 0);\nINSERT INTO messages ({', '.join(E.CIPHER_COLUMNS)}) VALUES\n('w', 1, 1700000000, 'f', 't', 'c', 1, 'u', 'n', NULL, NULL);"
CASES = [
    ("qq_json", "json", QQ), ("weflow_json", "json", WEFLOW), ("ciphertalk_json", "json", CIPHER), ("chatlab_json", "json", LAB), ("chatlab_jsonl", "jsonl", LINES), ("weflow_csv", "csv", CSV), ("weflow_markdown", "md", MARKDOWN),
    ("weflow_text", "txt", TEXT), ("qq_text", "txt", QQ_TEXT), ("weflow_sql", "sql", WEFLOW_SQL), ("ciphertalk_sql", "sql", CIPHER_SQL),
]


def same(found, wanted):
    rows = [canonical([tuple(r) for r in f.select(*wanted.columns).collect()], wanted.columns) for f in (found, wanted)]
    assert rows[0] == rows[1] and rows[1]


def both(spark, tmp_path, extension, texts):
    """The texts as files, and as a pack under the same paths."""
    for k, text in enumerate(texts):
        (tmp_path / f"c{k}.{extension}").write_bytes(text.encode())
    return f"{tmp_path}/*.{extension}", spark.createDataFrame([(f"file:{tmp_path}/c{k}.{extension}", t) for k, t in enumerate(texts)], "path string, text string")


@pytest.mark.parametrize(("reader", "extension", "text"), CASES)
def test_reader(spark, tmp_path, reader, extension, text):
    files, pack = both(spark, tmp_path, extension, [text, "﻿" + text, text + "\n"])
    same(E.READERS[reader][1](spark, pack), E.READERS[reader][1](spark, files))


@pytest.mark.parametrize(("reader", "text"), [("qq_json", QQ), ("weflow_json", WEFLOW), ("ciphertalk_json", CIPHER), ("chatlab_json", LAB)])
def test_cut_documents(spark, tmp_path, reader, text):
    files, pack = both(spark, tmp_path, "json", [text, "﻿" + text, text + "\n", text[:-1], text + "{}"])
    same(E.READERS[reader][1](spark, pack, large=True), E.READERS[reader][1](spark, files, large=True))


def test_malformed_and_empty(spark, tmp_path):
    files, pack = both(spark, tmp_path, "json", ["{", "[1", QQ.split('"messages"')[0] + '"messages":[]}', QQ])
    same(E.qq_json(spark, pack), E.qq_json(spark, files))


def test_chunked(spark, tmp_path):
    line = '{"id":"%s","timestamp":"1700000000000","content":{"text":"t"}}\n'
    texts = {"chunks/b.jsonl": line % 1 + "bad\n" + line % 2, "chunks/a.jsonl": line % 3, "chunks/c.jsonl": line % 4, "manifest.json": '{"metadata":{"name":"QQChatExporter"},"chatInfo":{"name":"n"},"chunked":{"chunks":[{"relativePath":"chunks/b.jsonl"},{"fileName":"a.jsonl"}]}}'}
    (tmp_path / "chunks").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    pack = spark.createDataFrame([(f"file:{tmp_path}/{n}", t) for n, t in texts.items()], "path string, text string")
    same(E.qq_chunked(spark, pack), E.qq_chunked(spark, str(tmp_path)))


@pytest.mark.parametrize("name", ["f05_chatlab_json", "f02_qq_chunked"])
def test_files_written(spark, name):
    """100 conversations took 100 files and more."""
    written = lambda: set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/**/*part-*", recursive=True))
    before = written()
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
    assert 0 < len({p for p in written() - before if not p.endswith(".crc")}) < 50


def test_lines_by_one_exchange(spark, tmp_path):
    """The lines of a pack were joined to the sums of their blocks, for which all of them were exchanged once more."""
    free = QQ_TEXT.replace("[1]\r\n", "")
    texts = [QQ_TEXT, free, free.replace("Ann:\r\n", ""), "x\n" + QQ_TEXT, QQ_TEXT.replace("聊天名称: n", "聊天名称: "), QQ_TEXT + "聊天名称: late\n[2]\n内容: y\n", QQ_TEXT.replace("聊天类型: 群聊\r\n", "聊天名称: second\r\n"), QQ_TEXT.split("Ann:")[0], ""]
    files, pack = both(spark, tmp_path, "txt", texts)
    found = B.messages(spark, pack)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    same(found, B.messages(spark, files))
