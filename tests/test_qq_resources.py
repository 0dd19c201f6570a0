"""Counted resources of the line format, its unnumbered messages and block borders; the resource sheet."""

import json

import pytest

from tests.test_sources import put, rows, workbook
from threadlake.sources import exports as E

TOP = "[QQChatExporter V5 / x]\n\n=====\n   QQ聊天记录导出文件\n=====\n\n聊天名称: Club\n聊天类型: 私聊\n\n"
END = "\n=====\n     导出完成\n=====\n总计导出 2 条消息\n时间: 2024-01-01 00:00:00\n内容: not a message\n"
FREE = TOP + "Alice:\n时间: 0\n内容: 第一行\n第二行\n\n[群主] Bob:\n时间: 2023-11-15 06:16:23\n类型: 系统消息\n内容: 系统通知\n资源: 1 个文件\n  - image: remote.jpg\n\n时间: 2023-11-15 06:16:24\n内容: nobody\nnot a sender:\nmore\n"
NUMBERED = TOP + "[1]\nAlice:\n时间: 2023-11-15 06:15:23\n内容: 第一行\n时间: 这不是下一个消息\n第二行\n\n\n[2]\nBob:\n时间: 2023-11-15 06:15:24\n类型: 图片\n内容: \n资源: 2 个文件\n  - image: a: b.jpg\n  - 语音: c.amr\nafter\n"


def read(spark, tmp_path, text, name="q.txt"):
    return rows(E.qq_text(spark, put(tmp_path, name, text)))


@pytest.fixture(params=[None, "97b"])
def split(spark, request):
    """With lines read in blocks of the usual size, and of 97 bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    if request.param:
        for k in keys:
            spark.conf.set(k, request.param)
    yield request.param
    for k, v in zip(keys, old, strict=True):
        spark.conf.set(k, v)


def test_unnumbered_messages(spark, tmp_path, split):
    got = read(spark, tmp_path, FREE + END)
    assert [(r.sender_name, r.content, r.direction, r.local_id) for r in got] == [("Alice", "第一行\n第二行", "incoming", None), ("Bob", "系统通知", "system", None), ("unknown", "nobody\nnot a sender:\nmore", "incoming", None)]
    assert got[0].timestamp_ms == 0 and [len(r.attachments) for r in got] == [0, 1, 0]
    (a,) = got[1].attachments
    assert (a.ordinal, a.kind, a.filename, a.declared, a.candidates, json.loads(a.metadata)) == (0, "image", "remote.jpg", None, [], {"resourceType": "image", "resourceName": "remote.jpg"})


def test_numbered_messages(spark, tmp_path, split):
    got = read(spark, tmp_path, NUMBERED + END)
    assert [(r.position, r.local_id, r.sender_name, r.message_type, r.content) for r in got] == [(0, "1", "Alice", "text", "第一行\n时间: 这不是下一个消息\n第二行"), (1, "2", "Bob", "image", "\nafter")]
    assert [(a.ordinal, a.kind, a.filename) for a in got[1].attachments] == [(0, "image", "a: b.jpg"), (1, "file", "c.amr")]


@pytest.mark.parametrize("lines, content, found", [
    ("资源: 2 个文件\n  - image: one.jpg\n仍是正文", "x\n资源: 2 个文件\n  - image: one.jpg\n仍是正文", 0),
    ("资源: 1 个文件\n  - image: one.jpg\n  - image: two.jpg", "x\n资源: 1 个文件\n  - image: one.jpg\n  - image: two.jpg", 0),
    ("资源: 1 个文件\n  - image: one.jpg\n资源: 3 个文件\n  - file: two\ny", "x\n资源: 3 个文件\n  - file: two\ny", 1),
    ("资源: 0 个文件\ny", "x\ny", 0),
    ("资源: 99999999999999 个文件\n  - image: one.jpg", "x\n资源: 99999999999999 个文件\n  - image: one.jpg", 0),
    ("=====\ny\n=====", "x\n=====\ny\n=====", 0),
])
def test_counts_that_do_not_fit_are_content(spark, tmp_path, lines, content, found):
    (r,) = read(spark, tmp_path, TOP + f"[1]\nA:\n时间: 2023-11-15 06:15:23\n内容: x\n{lines}\n")
    assert (r.content, len(r.attachments)) == (content, found)


def test_message_without_content_and_other_files(spark, tmp_path):
    (r,) = read(spark, tmp_path, TOP + "[1]\nA:\n时间: 2023-11-15 06:15:23\n")
    assert r.error == "a message without content" and E.rejects(E.qq_text(spark, put(tmp_path, "q.txt", TOP + "[1]\nA:\n时间: 2023-11-15 06:15:23\n"))).count() == 1
    assert read(spark, tmp_path, "x\n" + NUMBERED, "o.txt") == [] and read(spark, tmp_path, "", "e.txt") == []


def test_files_stay_apart_and_long_messages_are_read(spark, tmp_path, split):
    for k in range(3):
        put(tmp_path, f"f{k}.txt", (FREE, NUMBERED, TOP)[k])
    body = "\n".join(["资源: 7 个文件", "  - image: x.png", ""] * 2000)
    put(tmp_path, "long.txt", TOP + f"[1]\nA:\n时间: 2023-11-15 06:15:23\n内容: {body}\nend\n")
    got = rows(E.qq_text(spark, str(tmp_path / "*.txt")))
    assert [(r.path[-6:], r.position) for r in got] == [("f0.txt", 0), ("f0.txt", 1), ("f0.txt", 2), ("f1.txt", 0), ("f1.txt", 1), ("ng.txt", 0)]
    assert got[-1].content == body + "\nend"


def sheets(tmp_path, name, messages, resources):
    tables = {"聊天记录": [E.SHEETS["qq"][0], *([str(k), t, s, u, "图片", "m", "否", "1"] for k, (t, s, u) in enumerate(messages, 1))]}
    if resources is not None:
        tables["资源列表"] = [E.RESOURCE_HEADER, *([str(k), *r] for k, r in enumerate(resources, 1))]
    return workbook(tmp_path / name, tables)


T1, T2 = "2023-11-15 06:15:23", "2023-11-15 06:16:23"


def test_resources_join_only_keys_of_one_message(spark, tmp_path):
    sheets(tmp_path, "a.xlsx", [(T1, "Alice", "1"), (T2, "Bob", "2"), (T2, "Bob", "2")], [(T1, " Alice", "1", "Image", "one.jpg", "42.9", "media/one.jpg"), (T2, "Bob", "2", "image", "no", "1", "x"), (T1, "Alice", "1", "emoji", "", "", "media\\two.png"), (T1, "Alice", "9", "file", "", "", "")])
    sheets(tmp_path, "b.xlsx", [(T1, "Alice", "1")], None)
    got = rows(E.qq_sheet(spark, str(tmp_path / "*.xlsx")))
    assert [len(r.attachments or []) for r in got] == [2, 0, 0, 0]
    first, second = got[0].attachments
    assert (first.ordinal, first.kind, first.filename, first.declared, first.candidates, first.size, first.mime) == (0, "image", "one.jpg", "media/one.jpg", ["media/one.jpg"], 42, "image/jpeg")
    assert json.loads(first.metadata) == {"resourceType": "Image", "resourceNumber": "1"}
    assert (second.ordinal, second.kind, second.filename, second.size) == (1, "emoji", "two.png", None)


@pytest.mark.parametrize("url, web", [("http://h/x.jpg", True), ("https://h/x.jpg", True), ("", False), ("/rooted/f", False), ("\\rooted\\f", False), ("C:\\o\\f", False), ("\\\\s\\f", False), ("file:///o/f", False), ("ftp://h/f", False), ("../images/f", False), ("a//f", False), ("a/./f", False)])
def test_places_that_are_no_path_below_the_export(spark, tmp_path, url, web):
    (r,) = rows(E.qq_sheet(spark, sheets(tmp_path, "u.xlsx", [(T1, "A", "1")], [(T1, "A", "1", "file", "o.bin", "123", url)])))
    (a,) = r.attachments
    assert (a.declared, a.candidates, a.filename, a.size, json.loads(a.metadata).get("url")) == (None, [], "o.bin", 123, url if web else None)


@pytest.mark.parametrize("size", ["-1", "many", "1e30"])
def test_a_size_that_is_no_number_fails_the_file(spark, tmp_path, size):
    (r,) = rows(E.qq_sheet(spark, sheets(tmp_path, "s.xlsx", [(T1, "A", "1")], [(T1, "A", "1", "file", "o", size, "")])))
    assert r.error == "a resource whose size is no number"
