"""What looks into a folder of exports sees the same in a pack of them."""

import json

from pyspark.sql import functions as F

from tests.compare import canonical
from tests.test_importing import CSV
from tests.test_importing import CSV
from tests.test_packed import MARKDOWN, QQ, WEFLOW
from tests.test_sources import HEAD, put, qq_message
from threadlake.operators.importing import digests
from threadlake.sources import exports as E


def packed(spark, root):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).select("path", "content")
    return E.Pack(f"file:{root}", spark.createDataFrame(files.collect(), files.schema))


def same(found, wanted):
    rows = [canonical([tuple(r) for r in f.select(*wanted.columns).collect()], wanted.columns) for f in (found, wanted)]
    assert rows[0] == rows[1] and rows[1]


def test_pack_as_its_folder(spark, tmp_path):
    root = tmp_path / "media"  # a root may be called as it likes
    for name, content in {"a.csv": CSV, "files/c.csv": CSV, "other.json": {"metadata": {"name": "else"}}, "none.json": "plain text", "x.xlsx": "no zip", "chunks/c.csv": CSV, "n.md": MARKDOWN, "q.json": QQ, "w.json": WEFLOW}.items():
        put(root, name, content)
    put(root, "out/b.csv", CSV)
    put(root, "late.json", {"pad": "x" * 70000} | HEAD | {"messages": [qq_message(0)]})
    put(root, "m/manifest.json", HEAD | {"chunked": {"chunksDir": "parts", "chunks": [{"fileName": "c1.jsonl"}]}})
    put(root, "m/parts/c1.jsonl", json.dumps(qq_message(1)))
    put(root, "m/chunks/c2.jsonl", json.dumps(qq_message(2)))
    put(root, "m/chunks/deep/x.csv", CSV)
    put(root, "old/manifest.json", HEAD)
    put(root, "old/chunks/c1.jsonl", json.dumps(qq_message(3)))
    put(root, "empty/manifest.json", HEAD | {"chunked": {"chunks": []}})
    pack = packed(spark, root)
    told, files = E.sniffed(spark, pack, (f"file:{root}/out",)), E.sniffed(spark, str(root), (str(root / "out"),))
    same(told, files)
    same(digests(spark, told, pack), digests(spark, files))
    texts = lambda df: df.select(*(F.col(c).cast("string") for c in ("path", "position", "native_id", "content", "payload_hash", "conversation_id", "error")))
    same(texts(E.read_all(spark, pack, files=told)), texts(E.read_all(spark, str(root), files=files)))
