"""Exports of several formats imported as they come."""

from tests.test_qq_resources import END, FREE
from tests.test_sources import HEAD, put, qq_message
from threadlake.operators.importing import import_into
from threadlake.operators.store import Archive
from threadlake.streaming import ingest as I

SEEN = ("platform", "timestamp_ms", "content", "message_type", "sender_name")


def test_exports_as_they_come(spark, tmp_path):
    source, archive, checkpoint = tmp_path / "in", Archive(spark, str(tmp_path / "a")), str(tmp_path / "cp")
    run = lambda: I.stream_exports(spark, str(source), archive, checkpoint).awaitTermination()
    shown = lambda a: sorted(tuple(r[c] for c in SEEN) for r in a.read("messages").collect())
    picture = qq_message(1, content={"text": "see", "elements": [], "resources": [{"type": "image", "localPath": "pics/a.png"}]})
    put(source, "chat.json", HEAD | {"messages": [qq_message(0), picture]})
    put(source, "more/free.txt", FREE + END)
    put(source, "more/broken.json", "[{")
    run()
    first = {r.path.rsplit("/", 1)[1]: r for r in archive.read("runs").collect()}
    assert {k: r.status for k, r in first.items() if r.status == "completed"} == {"chat.json": "completed", "free.txt": "completed"}
    assert (first["chat.json"].missing_media, first["free.txt"].attachments, len(shown(archive))) == (1, 1, 5)
    # The picture comes, and an export that repeats a message; the one that waited for the picture is taken again.
    put(source, "pics/a.png", "x")
    put(source, "next.json", HEAD | {"messages": [qq_message(0), qq_message(5)]})
    run()
    second = {r.path.rsplit("/", 1)[1]: r for r in archive.read("runs").filter("run = 2").collect()}
    assert {k: (r.status, r.added, r.missing_media) for k, r in second.items()} == {"chat.json": ("completed", 0, 0), "next.json": ("completed", 1, 0)}
    version = archive.version()
    run()
    assert archive.version() == version
    whole = Archive(spark, str(tmp_path / "b"))
    import_into(whole, str(source))
    assert shown(archive) == shown(whole) and len(shown(whole)) == 6


def test_what_new_files_complete(spark):
    runs = spark.createDataFrame(
        [(1, "/r/a/x.json", "completed", "qq_json", 2), (1, "/r/b/y.json", "completed", "qq_json", 1), (2, "/r/b/y.json", "completed", "qq_json", 0), (1, "/r/c/manifest.json", "failed", "qq_chunked", 0), (1, "/r/a/z.json", "failed", "qq_json", 0), (3, "/r/a/x.json", "skipped", "qq_json", 0)],
        "run int, path string, status string, reader string, missing_media long",
    )
    found = lambda *came: sorted(r.path for r in I.waiting(runs, spark.createDataFrame([(c,) for c in came], "path string")).collect())
    assert found("/r/a/media/p.png") == ["/r/a/x.json"] and found("/r/c/chunks/1.jsonl", "/r/a/q") == ["/r/a/x.json", "/r/c/manifest.json"]
    assert found("/r/b/p.png") == found("/r/p.png") == found("/q/a/p.png") == []
