"""Chat exports of all formats as one frame of messages.

JSON, JSON lines, CSV and SQL dumps are read by Spark's own readers and
expressions; line formats are cut at their header lines by one split, so a
file's order survives without a sort; spreadsheets are read in tasks, a file at
a time. A file is one conversation, so files spread over tasks.

Every reader returns the columns of ``COLUMNS``; ``position`` is the message's
place in its file. Files that lack a format's markers give no rows; malformed
rows are dropped by ``valid`` and kept by ``rejects``.

Many small exports are better kept as a table than as files: listing, opening
and committing a file costs more than reading it. Each reader therefore takes
paths or a pack, a frame (path, text) with a row for each export; what looks
into a folder (``sniffed``, ``read_all``, an import) also takes a ``Pack``.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as D
from pyspark.sql.utils import AnalysisException

from threadlake.functions import hashing as X
from threadlake.functions import payloads as P
from threadlake.functions import text as T
from threadlake.operators import classify as K
from threadlake.operators import media as M
from threadlake.operators import upsert as U
from threadlake.operators.tables import kept
from threadlake.sources import jsonblocks as J
from threadlake.sources import textblocks as B

COLUMNS = (
    "path", "platform", "account_id", "conversation_id", "kind", "title", "position", "native_id", "local_id", "timestamp_ms", "sender_id", "sender_name",
    "direction", "message_type", "content", "search_text", "reply_to", "is_recalled", "media_path",
)
EXTENSIONS = ("json", "jsonl", "csv", "md", "txt", "sql", "xlsx")
DIGESTS = ("payload_hash", "semantic_hash", "compatible")
#: Directories that hold media rather than exports.
SKIPPED = ("resources", "media", "images", "voices", "videos", "emojis", "files", "avatars", "node_modules", ".git")
S = "string"
TEXT = D.StringType()


def _struct(**fields) -> D.StructType:
    return D.StructType([D.StructField(k, D.StringType() if v == S else v) for k, v in fields.items()])


def _strings(*names: str) -> D.StructType:
    """Text fields; of names that differ in case only, which Spark reads as one, the first."""
    first: dict[str, str] = {}
    for n in names:
        first.setdefault(n.lower(), n)
    return _struct(**dict.fromkeys(first.values(), S))


def _or_null(x: Column) -> Column:
    return F.when(F.length(x) > 0, x)


def _file_title(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


ATTACHMENTS = "array<struct<ordinal:bigint,kind:string,filename:string,declared:string,candidates:array<string>,mime:string,size:bigint,width:int,height:int,duration:double,metadata:string>>"
READ = ", ".join(f"{c} {dict(position='long', timestamp_ms='long', is_recalled='boolean').get(c, 'string')}" for c in COLUMNS) + f", aliases array<string>, attachments {ATTACHMENTS}, facts {X.FACTS}, payload_hash string, semantic_hash string, compatible array<string>, error string"
ATTACHMENT = tuple(f.split(":")[0] for f in ATTACHMENTS[len("array<struct<") : -2].replace("array<string>", "array").split(","))
FACT_NAMES = tuple(f.split(":")[0] for f in X.FACTS[len("struct<") : -1].split(","))


def _messages(frame: DataFrame, family: str = "flat", facts: dict[str, Column] | None = None, attachments: Column | None = None, aliases: Column | None = None, **columns: Column) -> DataFrame:
    """The columns of COLUMNS with defaults, aliases, attachments, the facts that digests are made of, and these digests.

    ``facts`` are those of the family that are no columns. The flat family's searched text is the content.
    """
    none = F.lit(None).cast(S)
    given = {"native_id": none, "local_id": none, "reply_to": none, "media_path": none, "is_recalled": F.lit(False), "search_text": columns["content"]} | columns
    names = F.array(given["sender_name"], given["sender_id"]) if aliases is None else aliases
    extra = facts or {}
    # _messages names come first, so that facts can be columns of the result or of the frame's
    error = F.col("error") if "error" in frame.columns else none
    found = frame.select(
        *((given[c] if c == "path" else F.when(error.isNull(), given[c])).alias(c) for c in COLUMNS), error.alias("error"), F.array_distinct(F.filter(names, lambda n: F.length(n) > 0)).alias("aliases"), (F.lit(None) if attachments is None else attachments).cast(ATTACHMENTS).alias("attachments"),
        *(extra[f].alias(f"_{f}") for f in extra),
    )
    own = {"family": F.lit(family), "sender": F.col("sender_id")} | {f: F.col(f"_{f}") for f in extra} | ({"search_text": F.col("content")} if family == "flat" else {})
    values = [own[f] if f in own else F.col(f) if f in COLUMNS else F.col("is_recalled") if f == "recalled" else none for f in FACT_NAMES]
    found = found.withColumn("facts", F.struct(*(v.alias(f) for f, v in zip(FACT_NAMES, values, strict=True))).cast(X.FACTS)).drop(*(f"_{f}" for f in extra))
    return hashed(found, (family,))


def hashed(messages: DataFrame, families: tuple[str, ...] = X.FAMILIES) -> DataFrame:
    """``messages`` with the digests of their facts; again after facts have changed."""
    return messages.withColumn("_d", X.digests(F.col("facts"), families)).withColumns({"payload_hash": F.col("_d.payload"), "semantic_hash": F.col("_d.semantic"), "compatible": F.col("_d.compatible")}).drop("_d")


def _time(x: Column) -> Column:
    return T.flexible_timestamp(x.cast(S))


#: Paths, or a pack of exports as rows (path, text); readers of spreadsheets take its ``content``.
Source = str | list[str] | DataFrame


@dataclass(frozen=True)
class Pack:
    """A folder of exports kept as a table: ``files`` (path, content), a row for each file below ``root``."""

    root: str
    files: DataFrame

    def of(self, paths: DataFrame) -> DataFrame:
        """(path, text, content) of the files with these paths."""
        return self.files.join(paths.select("path"), "path", "left_semi").select("path", F.col("content").cast(S).alias("text"), "content")

    def chunked(self, manifests: DataFrame) -> DataFrame:
        """``of`` these manifests and whatever may be a chunk."""
        return self.of(manifests.select("path").unionByName(self.files.select("path").filter(F.lower("path").endswith(".jsonl"))))


#: Folders of exports, or a pack in place of one.
Root = str | list[str] | Pack


def whole(spark: SparkSession, path: Source) -> DataFrame:
    """(path, text) of each file, without a byte-order mark."""
    files = path.select("path", "text") if isinstance(path, DataFrame) else spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.withColumn("text", F.regexp_replace("text", "^﻿", ""))


def _json(spark: SparkSession, path: Source, schema: D.StructType) -> DataFrame:
    """(path, error, fields) of JSON files; one that is malformed has an error and no fields."""
    checked = D.StructType([*schema.fields, D.StructField("_corrupt_record", TEXT)])
    if isinstance(path, DataFrame):
        read = whole(spark, path).select("path", F.from_json("text", checked).alias("j"))
        return read.select("path", F.when(F.col("j._corrupt_record").isNotNull() | F.col("j").isNull(), "malformed JSON").alias("error"), *(F.col("j")[n].alias(n) for n in schema.names))
    read = spark.read.schema(checked).json(path, multiLine=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.when(F.col("_corrupt_record").isNotNull(), "malformed JSON").alias("error"), *schema.names)


#: Bytes from which on a JSON document is cut into blocks, so that many tasks read it.
LARGE = 256 << 20


def _exploded(spark: SparkSession, path: Source, fields: D.StructType, message: D.StructType, known: Column, *columns: str, large: bool = False) -> DataFrame:
    """A row (path, error, columns, position, m) for each message of the files with the marks ``known``; a file without any, or malformed, is one row with an error.

    Of a ``large`` file the fields are those that stand before its messages.
    """
    if large:
        found = J.elements(spark, path)
        first = F.when((F.col("section") == "messages") & (F.col("position") == 0), F.from_json("head", fields))
        rows = found.filter("section = 'messages' or error is not null")
        if isinstance(path, DataFrame):  # the rows of a text lie together
            rows = rows.withColumn("h", F.first(first, ignorenulls=True).over(Window.partitionBy("path")))
        else:
            rows = rows.join(F.broadcast(found.select("path", first.alias("h")).filter("h is not null")), "path", "left")  # a row a file
        kept = rows.select("path", "error", "h.*", "position", F.from_json("element", message).alias("m")).filter(known | F.col("error").isNotNull())
        kept = kept.select("path", "error", *columns, "position", "m")
    else:
        files = _json(spark, path, D.StructType([*fields.fields, D.StructField("messages", D.ArrayType(message))]))
        kept = files.filter(known | F.col("error").isNotNull()).select("path", "error", *columns, F.posexplode_outer("messages").alias("position", "m"))
    return kept.withColumn("error", F.coalesce("error", F.when(F.col("m").isNull(), "no messages")))


# JSON formats

#: ``content`` stays JSON text: its fields are read where they are needed.
QQ_MESSAGE = _struct(id=S, seq=S, timestamp=S, sender=_strings("uid", "uin", "name", "nickname", "groupCard", "remark"), type=S, content=S, recalled=S, system=S)
QQ_HEAD = {"metadata": _strings("name", "version"), "chatInfo": _strings("name", "type", "selfUid", "selfUin", "peerUid", "peerUin", "peerName")}


def _truthy(x: Column) -> Column:
    return F.coalesce(~x.isin("", "0", "false"), F.lit(False))


def _qq(frame: DataFrame, m: str = "m") -> DataFrame:
    s, chat, body = F.col(f"{m}.sender"), F.col("chatInfo"), F.col(f"{m}.content")
    # The parts of the content that several columns need are read once.
    part = lambda name: T.clean(F.get_json_object(body, f"$.{name}"))
    read = frame.withColumn("_text", part("text")).withColumn("_kind", part("type")).withColumn("_search", P.json_texts(body)).withColumn("_files", P.qq_attachments(body))
    typed = T.clean(F.col(f"{m}.type"))
    kind = T.pick(F.lower(typed), F.lower(F.col("_kind")), F.lit("unknown"))
    shown = T.pick(F.col("_text"), F.split_part(F.col("_search"), F.lit("\n"), F.lit(1)), F.concat(F.lit("["), T.pick(typed, F.col("_kind"), F.lit("message")), F.lit("]")))
    sender = T.pick(s["uid"], s["uin"], F.lit("unknown"))
    names = F.array_distinct(F.filter(F.array(*(T.clean(s[k]) for k in ("groupCard", "name", "nickname", "remark", "uin"))), lambda n: n != ""))
    account = T.pick(chat["selfUin"], chat["selfUid"], F.lit("qq-default"))
    uid, uin = T.pick(chat["selfUid"], account), T.pick(chat["selfUin"], account)
    own, system = (sender == uid) | (sender == uin) | (T.clean(s["uin"]) == uin), _truthy(F.col(f"{m}.system"))
    elements = F.coalesce(F.from_json(F.get_json_object(body, "$.elements"), "array<struct<type:string,data:map<string,string>>>"), F.array().cast("array<struct<type:string,data:map<string,string>>>"))
    replies = F.transform(F.filter(elements, lambda e: T.clean(e["type"]) == "reply"), lambda e: F.coalesce(e["data"]["referencedMessageId"], e["data"]["messageId"], F.lit("")))
    native = T.pick(T.clean(chat["peerUid"]), T.clean(chat["peerUin"]), T.clean(chat["name"]), _file_title(F.col("path")))
    paths = lambda a: F.array_distinct(F.filter(F.array(F.when(~a["declared"].rlike("^https?://"), a["declared"]), a["local"]), lambda c: F.length(c) > 0))
    files = F.transform("_files", lambda a: F.struct(*(paths(a).alias(c) if c == "candidates" else a[c].alias(c) for c in ATTACHMENT)))
    return _messages(
        read, "qq", {"sequence": _or_null(T.clean(F.col(f"{m}.seq"))), "system": system, "attachments": P.attachments_json(F.col("_files"))}, files, names, path=F.col("path"), platform=F.lit("qq"), account_id=account, conversation_id=native,
        kind=F.when(F.lower(T.clean(chat["type"])) == "group", "group").otherwise("private"), title=T.pick(T.clean(chat["name"]), T.clean(chat["peerName"]), native), position=F.col("position"), native_id=_or_null(T.clean(F.col(f"{m}.id"))),
        timestamp_ms=T.seconds_or_millis(T.as_long(F.col(f"{m}.timestamp"))), sender_id=sender, sender_name=F.coalesce(F.get(names, 0), sender), direction=F.when(system, "system").when(own, "outgoing").otherwise("incoming"), message_type=kind,
        content=shown, search_text=T.pick(F.col("_search"), shown), reply_to=F.get(F.filter(replies, lambda r: ~r.isin("", "0")), 0), is_recalled=_truthy(F.col(f"{m}.recalled")),
        media_path=F.get(F.col("_files.declared"), 0),
    )


def qq_json(spark: SparkSession, path: Source, large: bool = False) -> DataFrame:
    return _qq(_exploded(spark, path, _struct(**QQ_HEAD), QQ_MESSAGE, F.lower("metadata.name") == "qqchatexporter", "chatInfo", large=large))


#: Names of chunks that a manifest without a list has beside it.
OLD_CHUNK = r"(?i)^(?:chunk.*|c[0-9]+)\.jsonl$"


def _unsafe(path: Column) -> Column:
    """Whether a declared path has a root, a drive, a scheme, or a segment of dots."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.coalesce(F.length(F.trim(p)) == 0, F.lit(True)) | p.rlike(r"^/|^[A-Za-z][A-Za-z0-9+.-]*:|(?:^|/)\.\.?(?:/|$)")


def manifests(spark: SparkSession, paths: Source) -> DataFrame:
    """(path, folder, chatInfo, nth, chunk, error): the chunks that a manifest declares, in its order, by their full paths; an error has no chunks.

    A list is authoritative: nothing else is read, an empty one is an error, as is a path that is unsafe, is no JSON lines,
    or occurs twice. A manifest without a list has all chunks of its folder ``chunks`` and those of old names beside it,
    in natural order; these have no ``nth`` yet and no ``chunk``.
    """
    entry = _strings("relativePath", "fileName")
    files = _json(spark, paths, _struct(**QQ_HEAD, chunked=S)).filter(F.contains(F.lower("metadata.name"), F.lit("qqchatexporter")) | F.col("error").isNotNull())
    files = files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).withColumn("c", F.from_json("chunked", _struct(chunksDir=S, chunks=D.ArrayType(entry))))
    given, base = F.col("c.chunksDir"), F.coalesce("c.chunksDir", F.lit("chunks"))
    named = lambda e: F.coalesce(e["relativePath"], F.when(~F.coalesce(e["fileName"], F.lit("/")).rlike(r"[/\\]"), F.concat(base, F.lit("/"), e["fileName"])))
    listed = F.transform("c.chunks", lambda e: F.replace(named(e), F.lit("\\"), F.lit("/")))
    files = files.withColumn("listed", listed)
    bad = F.exists("listed", lambda p: F.coalesce(_unsafe(p) | ~F.lower(p).endswith(".jsonl"), F.lit(True)))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("chunked").isNull(), F.lit(None)).when(F.col("listed").isNull(), "manifest without a list of chunks").when(given.isNotNull() & _unsafe(given), "unsafe folder of chunks")
    error = error.when(F.size("listed") == 0, "manifest lists no chunks").when(bad, "unsafe chunk").when(F.size(F.array_distinct("listed")) < F.size("listed"), "chunk listed twice")
    files = files.withColumn("error", error).withColumn("listed", F.when(F.col("error").isNull(), F.col("listed")))
    return files.select("path", "folder", "chatInfo", "error", F.posexplode_outer("listed").alias("nth", "relative")).select("path", "folder", "chatInfo", "nth", F.concat("folder", F.lit("/"), "relative").alias("chunk"), "error")


#: Rows of a pack that are manifests.
MANIFEST = "lower(path) like '%/manifest.json'"


def chunks(spark: SparkSession, paths: Source) -> DataFrame:
    """``manifests`` with the chunks of manifests without a list, and an error for a declared chunk that is not there."""
    if isinstance(paths, DataFrame):
        declared, names = manifests(spark, paths.filter(MANIFEST)), paths.select("path")
    else:
        paths = [paths] if isinstance(paths, str) else list(paths)
        declared, names = manifests(spark, paths), _paths(spark, [p.rsplit("/", 1)[0] for p in paths])
    there = names.select(F.col("path").alias("file")).filter(F.lower("file").endswith(".jsonl")).distinct()
    old = declared.filter("nth is null and error is null").drop("nth", "chunk")
    name = F.regexp_extract("file", "([^/]+)$", 1)
    beside = there.withColumn("folder", F.regexp_replace("file", "/[^/]*$", "")).withColumn("folder", F.when(F.col("folder").endswith("/chunks"), F.regexp_replace("folder", "/chunks$", "")).when(name.rlike(OLD_CHUNK), F.col("folder")))
    found = old.join(beside.withColumn("key", natural_key(name)), "folder", "left")
    first = Window.partitionBy("path").orderBy("key", "file")  # chunks of one manifest, not their lines
    found = found.withColumn("nth", F.row_number().over(first) - 1).select("path", "folder", "chatInfo", "nth", F.col("file").alias("chunk"), F.coalesce("error", F.when(F.col("file").isNull(), "no chunks")).alias("error"))
    listed = declared.filter("nth is not null or error is not null").join(there.withColumn("chunk", F.col("file")), "chunk", "left")
    listed = listed.withColumn("error", F.coalesce("error", F.when(F.col("file").isNull(), F.concat(F.lit("no such chunk: "), "chunk")))).select("path", "folder", "chatInfo", "nth", "chunk", "error")
    every = listed.unionByName(found)
    # One missing chunk fails its manifest.
    failed = every.groupBy("path").agg(F.max("error").alias("failed"))
    return every.join(failed, "path").withColumn("error", F.col("failed")).drop("failed")


def qq_chunked(spark: SparkSession, root: Source) -> DataFrame:
    """Exports of a manifest and JSON-lines chunks, given by their folders or manifests, or as a pack of both.

    Chunks of any size are split between tasks; a message's position is the number of messages before its block, from
    sums by block, and its place in the block.
    """
    few = J.few(root)
    if isinstance(root, DataFrame):
        every = kept(chunks(spark, root), "chunks")  # several steps read it
        sound = every.filter("error is null").select(F.col("chunk").alias("path")).distinct()
        lines = B.lines(spark, root.join(sound, "path", "left_semi")).select(F.col("path").alias("chunk"), "block", "at", F.col("line").alias("value"))
    else:
        roots = [root] if isinstance(root, str) else list(root)
        every = chunks(spark, [r if r.lower().endswith(".json") else f"{r.rstrip('/')}/manifest.json" for r in roots])
        listed = [r["chunk"] for r in every.filter("error is null").select("chunk").distinct().collect()]  # paths, as Spark itself lists them
        lines = spark.read.text(listed) if listed else spark.createDataFrame([], "value string")
        place = [F.col("_metadata.file_path").alias("chunk"), F.col("_metadata.file_block_start").alias("block")] if listed else [F.lit("").alias("chunk"), F.lit(0).cast("bigint").alias("block")]
        lines = lines.select(*place, F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.select("chunk", "block", "at", F.from_json("value", QQ_MESSAGE).alias("m")).filter("m.id is not null")
    declared = every.filter("error is null").select("path", "chatInfo", "nth", "chunk")
    sizes = lines.groupBy("chunk", "block").agg(F.count(F.lit(1)).alias("n")).join(few(declared.select("path", "nth", "chunk")), "chunk")  # a row a file
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("path").orderBy("nth", "block")) - F.col("n")).select("path", "chunk", "block", "before")
    inside = lines.withColumn("place", F.row_number().over(Window.partitionBy("chunk", "block").orderBy("at")) - 1)
    rows = inside.join(few(before), ["chunk", "block"]).join(F.broadcast(declared.select("path", "chatInfo").distinct()), "path")
    rows = rows.select("path", F.lit(None).cast(S).alias("error"), "chatInfo", (F.col("before") + F.col("place")).alias("position"), "m")
    empty = every.join(rows.select("path").distinct(), "path", "left_anti").groupBy("path").agg(F.coalesce(F.max("error"), F.lit("no messages")).alias("error"), F.first("chatInfo").alias("chatInfo"))
    return _qq(rows.unionByName(empty.select("path", "error", "chatInfo", F.lit(None).cast("bigint").alias("position"), F.lit(None).cast(QQ_MESSAGE).alias("m"))))


def natural_key(name: Column) -> Column:
    """A sort key in which runs of digits compare as numbers (up to 18 digits) and letters without case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.ltrim(p, F.lit("0")), 18, "0")).otherwise(p)), "")


#: Fields that are searched, that hold paths, and that name what a message answers.
WEFLOW_SEARCHED = ("quotedContent", "linkTitle", "linkUrl", "appMsgDesc", "appMsgSourceName", "locationLabel", "locationPoiname", "musicTitle", "finderTitle")
LAB_SEARCHED = (*WEFLOW_SEARCHED, "title", "description", "summary", "address", "poiName")
PATHS = ("mediaPath", "filePath", "imagePath", "voicePath", "videoPath", "resourcePath", "localPath", "path")
MEDIA_PATHS = ("path", "localPath", "filePath", "url")
REPLIES = ("replyToMessageId", "quotedSvrid", "replyToId", "replyTo")
ANSWERED = ("sourceMessageId", "platformMessageId", "messageId", "id", "localId")
EMPTY = "[空消息]"
SESSION = _strings("wxid", "id", "chatId", "sessionId", "nickname", "remark", "displayName", "type", "ownerId", "isGroup")
WECHAT_MESSAGE = _strings("localId", "platformMessageId", "createTime", "type", "localType", "content", "isSend", "senderUsername", "senderDisplayName", "senderID", "senderId", "replyToMessageId", "quotedSvrid", *WEFLOW_SEARCHED)
#: Names under which the other formats keep a message's fields, the first that is not empty counts.
LAB = {
    "sender": ("sender", "senderUsername", "senderWxid", "senderNativeId", "senderId"), "name": ("accountName", "senderDisplayName", "senderNickname", "senderName", "name", "nickname", "displayName", "groupNickname"),
    "time": ("timestamp", "createTime", "time"), "local": ("localId", "localID", "msgLocalId"), "native": ("id", "platformMessageId", "messageId", "msgId", "svrid"), "size": ("fileSize", "size"), "width": ("imageWidth", "width"),
    "height": ("imageHeight", "height"), "duration": ("voiceDuration", "duration"),
}
CIPHER = LAB | {
    "sender": ("senderUsername", "senderWxid", "senderNativeId", "senderId", "sender"), "name": ("senderDisplayName", "senderNickname", "senderName"), "time": ("createTime", "timestamp", "time"),
    "native": ("platformMessageId", "messageId", "msgId", "id", "svrid"),
}
_NAMES = dict.fromkeys(["_type", "type", "localType", "content", "isSend", "is_send", "isOutgoing", "direction", "isSystem", "recalled", "isRecalled", "groupNickname", "url", *(n for names in (*LAB.values(), LAB_SEARCHED, PATHS, REPLIES) for n in names)])
_QUOTED = _strings(*ANSWERED, "content", "text")
LAB_MESSAGE = D.StructType([*_strings(*_NAMES).fields, *_struct(media=_strings(*MEDIA_PATHS), quote=_QUOTED, reply=_QUOTED).fields])
LAB_META = _strings("name", "platform", "type", "groupId", "id", "ownerId")
MEMBER = _strings("platformId", "accountName", "username", "name", "nickname", "groupNickname", "groupCard", "card", "displayName", "remark", "alias")


def _first(of: Column, names: tuple[str, ...]) -> Column:
    return T.pick(*(T.clean(of[n]) for n in names))


def _normalised(frame: DataFrame, raw: Column, sender: Column) -> DataFrame:
    """``frame`` with ``_raw`` (the content, or a word for none), ``_xml`` (what XML says, if it is such) and ``_content`` (as it is shown)."""
    own = frame.withColumn("_raw", T.pick(T.clean(raw), F.lit(EMPTY)))
    own = own.withColumn("_bare", T.pick(T.clean(P.without_sender_prefix(F.col("_raw"), sender)), F.lit(EMPTY)))
    return own.withColumn("_xml", P.xml_summary(F.col("_bare"))).withColumn("_content", F.coalesce("_xml.summary", "_bare"))


def _searched(content: Column, more: Column, fields: list[Column]) -> Column:
    return F.array_join(T.unique_list(content, *fields) if more is None else F.array_distinct(F.filter(F.flatten(F.array(F.array(content), F.split(F.coalesce(more, F.lit("")), "\n"), F.array(*fields))), lambda x: F.length(x) > 0)), "\n")


def own_senders(rows: DataFrame, sender: str = "_sender", own: str = "_own") -> DataFrame:
    """(path, self): who a file's own messages mostly come from, of those seen at least twice; of equals the one first seen twice.

    In a private chat with several such senders the other side's id does not count. Sums by (file, sender), not windows.
    """
    mine = rows.filter(F.col(own) & (F.length(sender) > 0)).select("path", "position", F.col(sender).alias("candidate"), (F.col("_private") & (F.col(sender) == F.col("_chat"))).alias("other"))
    counted = mine.groupBy("path", "candidate").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.max("other").alias("other"))
    again = mine.drop("other").join(counted.select("path", "candidate", "first"), ["path", "candidate"]).filter("position > first").groupBy("path", "candidate").agg(F.min("position").alias("second"))
    many = counted.groupBy("path").agg(F.count(F.lit(1)).alias("senders"))
    kept = counted.join(again, ["path", "candidate"]).join(many, "path").filter(~(F.col("other") & (F.col("senders") > 1)))
    return kept.groupBy("path").agg(F.min_by("candidate", F.struct((-F.col("n")).alias("n"), "second")).alias("self"))


def weflow_json(spark: SparkSession, path: Source, large: bool = False) -> DataFrame:
    """Both layouts: senders named on each message, or numbered and listed once."""
    people = D.ArrayType(_strings("senderID", "wxid", "displayName", "nickname", "groupNickname"))
    fields = _struct(weflow=_strings("version"), session=SESSION, senders=people)
    return _weflow(_exploded(spark, path, fields, WECHAT_MESSAGE, F.col("weflow").isNotNull() & F.col("session.wxid").isNotNull(), "session", "senders", large=large))


def _weflow(rows: DataFrame) -> DataFrame:
    """Rows (path, session, senders, position, m)."""
    m, session, who = F.col("m"), F.col("session"), F.col("who")
    number = F.coalesce(m["senderID"], m["senderId"])
    rows = rows.withColumn("who", F.try_element_at(F.filter(F.coalesce("senders", F.array()), lambda s: s["senderID"] == number), F.lit(-1)))
    wxid = T.clean(session["wxid"])
    group = F.contains(F.coalesce(session["type"], F.lit("")), F.lit("群")) | wxid.endswith("@chatroom")
    rows = rows.withColumns({"_sender": T.pick(T.clean(m["senderUsername"]), T.clean(who["wxid"])), "_own": T.as_bool(m["isSend"]), "_private": ~group, "_chat": wxid})
    rows = _normalised(rows, m["content"], F.col("_sender")).join(own_senders(rows), "path", "left")
    raw, content, own, me = F.col("_raw"), F.col("_content"), F.col("_own"), F.col("self")
    title = T.pick(T.clean(session["remark"]), T.clean(session["displayName"]), T.clean(session["nickname"]), P.title_from_path(F.col("path"), wxid))
    named = T.pick(T.clean(m["senderDisplayName"]), T.clean(who["displayName"]), T.clean(who["groupNickname"]), T.clean(who["nickname"]))
    sender = F.when(own & me.isNotNull(), me).otherwise(T.pick(F.col("_sender"), F.lit("unknown")))
    label, local = T.clean(m["type"]), m["localType"]
    media = K.weflow_media(label)
    first = K.weflow_type(media, local, raw)
    old = F.coalesce(K.weflow_label(label), first)
    kind = F.coalesce(F.col("_xml.kind"), old)
    fields = [F.coalesce(m[f], F.lit("")) for f in WEFLOW_SEARCHED]
    facts = {
        "local_type": T.local_type_text(local), "media_type": media, "raw_content": raw, "old_direction": K.direction(old, own), "old_type": old, "old_search": _searched(raw, None, fields),
        "first_sender": F.when(F.col("_sender") != "", F.col("_sender")).when(own & me.isNotNull(), me).otherwise("unknown"), "first_direction": K.direction(first, own),
    }
    name = F.when(own, K.SELF_NAME).otherwise(T.pick(named, F.when(~group, title), sender))
    aliases = F.array(name, named, T.clean(who["displayName"]), T.clean(who["groupNickname"]), T.clean(who["nickname"]), sender)
    return _messages(
        rows, "wechat", facts, M.weflow_attachment(label, media, content, kind), F.when(own, F.array(name, sender)).otherwise(aliases), path=F.col("path"), platform=F.lit("wechat"), account_id=F.lit("wechat-default"), conversation_id=wxid,
        kind=F.when(group, "group").otherwise("private"), title=title, position=F.col("position"), native_id=_or_null(T.clean(m["platformMessageId"])), local_id=_or_null(T.clean(m["localId"])),
        timestamp_ms=T.seconds_or_millis(T.as_long(m["createTime"])), sender_id=sender, sender_name=name, direction=K.direction(kind, own), message_type=kind, content=content,
        search_text=_searched(content, F.col("_xml.search"), fields), reply_to=_or_null(_first(m, ("replyToMessageId", "quotedSvrid"))), is_recalled=K.recalled(kind, content),
    )


def _lab(rows: DataFrame, names: dict[str, tuple[str, ...]], me: Column, platform: Column, account: Column, chat: Column, group: Column, title: Column, who: Column | None, by_integer: bool) -> DataFrame:
    """Messages of the two formats that keep their fields under several names: rows (path, position, m, ...)."""
    m, own_name = F.col("m"), F.lower(T.clean(me))
    exported = _first(m, names["sender"])
    own = T.as_bool(m["isSend"])
    if by_integer:
        own = own | T.as_bool(m["is_send"]) | T.as_bool(m["isOutgoing"]) | (F.lower(T.clean(m["direction"])) == "outgoing") | ((own_name != "") & (F.lower(exported) == own_name))
    rows = _normalised(rows.withColumn("_own", F.coalesce(own, F.lit(False))), m["content"], exported)
    raw, content, own = F.col("_raw"), F.col("_content"), F.col("_own")
    kind = F.coalesce(F.col("_xml.kind"), K.message_type(m["type"] if by_integer else None, m["localType"], m["type"], raw))
    system = (kind == "system") | (T.as_bool(m["isSystem"]) if by_integer else F.lit(False))
    recalled = system & (F.contains(content, F.lit(K.RECALL)) | F.contains(raw, F.lit(K.RECALL)))
    recalled = recalled | T.as_bool(m["recalled"]) | T.as_bool(m["isRecalled"]) if by_integer else recalled
    sender = F.when(own & (T.clean(me) != ""), T.clean(me)).otherwise(T.pick(exported, F.lit("unknown")))
    named, none = _first(m, names["name"]), F.lit("")
    in_group, shown, member = (_first(who, k) if who is not None else none for k in (("groupNickname", "groupCard", "card"), ("displayName", "remark", "alias"), ("accountName", "username", "name", "nickname")))
    name = F.when(own, T.pick(named, shown, in_group, member, F.lit(K.SELF_NAME))).otherwise(T.pick(in_group, T.clean(m["groupNickname"]) if by_integer else none, shown, member, named, F.when(~group, title), sender))
    reply = T.pick(_first(m, REPLIES), _first(m["quote"], ANSWERED), _first(m["reply"], ANSWERED))
    fields = [F.coalesce(x, none) for x in (*(m[f] for f in LAB_SEARCHED), m["quote"]["content"], m["quote"]["text"], m["reply"]["content"], m["reply"]["text"])]
    candidates = M.candidates(kind, content, raw, [*(m[p] for p in ((*PATHS, "url") if by_integer else PATHS)), *(m["media"][p] for p in MEDIA_PATHS)])
    attachment = M.lab_attachment(kind, candidates, T.as_long(_first(m, names["size"])), T.clamp_int(_first(m, names["width"])), T.clamp_int(_first(m, names["height"])), T.as_double(_first(m, names["duration"])))
    media = F.when(kind.isin("image", "audio", "video", "file", "emoji"), kind) if by_integer else F.lit(None).cast(S)
    local = F.coalesce(m["localType"], m["type"]) if by_integer else m["localType"]
    return _messages(
        rows, "lab", {"local_type": T.local_type_text(local), "media_type": media}, attachment, F.array(name, named, shown, in_group, member, sender), path=F.col("path"), platform=platform, account_id=account, conversation_id=chat,
        kind=F.when(group, "group").otherwise("private"), title=title, position=F.col("position"), native_id=_or_null(_first(m, names["native"])), local_id=_or_null(_first(m, names["local"])),
        timestamp_ms=T.seconds_or_millis(F.coalesce(*(T.as_long(m[n]) for n in names["time"]))), sender_id=sender, sender_name=name, direction=F.when(system, "system").otherwise(K.direction(kind, own)), message_type=kind, content=content,
        search_text=_searched(content, F.col("_xml.search"), fields), reply_to=_or_null(reply), is_recalled=recalled,
    )


def ciphertalk_json(spark: SparkSession, path: Source, large: bool = False) -> DataFrame:
    known = (F.col("exportInfo.generator") == "CipherTalk") | (F.col("exportInfo.format") == "detailed-json")
    return _ciphertalk(_exploded(spark, path, _struct(exportInfo=_strings("version", "generator", "format"), session=SESSION), LAB_MESSAGE, F.coalesce(known, F.lit(False)), "session", large=large))


def _ciphertalk(rows: DataFrame) -> DataFrame:
    s = F.col("session")
    chat = _first(s, ("wxid", "id", "chatId", "sessionId"))
    group = T.as_bool(s["isGroup"]) | F.contains(chat, F.lit("@chatroom")) | F.contains(F.coalesce(s["type"], F.lit("")), F.lit("群"))
    rows = rows.withColumns({"_sender": _first(F.col("m"), CIPHER["sender"]), "_own": T.as_bool(F.col("m.isSend")), "_private": ~group, "_chat": chat})
    rows = rows.join(own_senders(rows), "path", "left").drop("_own")
    title = T.pick(T.clean(s["remark"]), T.clean(s["displayName"]), T.clean(s["nickname"]), P.title_from_path(F.col("path"), chat))
    return _lab(rows, CIPHER, F.col("self"), F.lit("wechat"), T.pick(T.clean(s["ownerId"]), F.lit("wechat-default")), chat, group, title, None, False)


def _chatlab(rows: DataFrame) -> DataFrame:
    """Rows (path, meta, members, position, m); senders are looked up without case, the last member counts."""
    meta = F.col("meta")
    sender = F.lower(_first(F.col("m"), LAB["sender"]))
    rows = rows.withColumn("who", F.try_element_at(F.filter(F.coalesce("members", F.array()), lambda p: F.lower(p["platformId"]) == sender), F.lit(-1)))
    platform = F.when(F.lower(T.clean(meta["platform"])) == "qq", "qq").otherwise("wechat")
    owner, chat = T.clean(meta["ownerId"]), T.pick(T.clean(meta["groupId"]), T.clean(meta["id"]), T.clean(meta["name"]))
    group = (F.lower(T.clean(meta["type"])) == "group") | F.contains(F.coalesce(meta["type"], F.lit("")), F.lit("群")) | chat.endswith("@chatroom") | ((T.clean(meta["groupId"]) != "") & (F.lower(T.clean(meta["type"])) != "private"))
    return _lab(rows, LAB, owner, platform, T.pick(owner, F.concat(platform, F.lit("-default"))), chat, F.coalesce(group, F.lit(False)), T.pick(T.clean(meta["name"]), chat), F.col("who"), True)


def chatlab_json(spark: SparkSession, path: Source, large: bool = False) -> DataFrame:
    return _chatlab(_exploded(spark, path, _struct(chatlab=_strings("version"), meta=LAB_META, members=D.ArrayType(MEMBER)), LAB_MESSAGE, F.col("chatlab.version") == "0.0.2", "meta", "members", large=large))


def chatlab_jsonl(spark: SparkSession, path: Source) -> DataFrame:
    """Lines tagged header, member or message; blank and malformed lines are skipped."""
    head = _struct(_type=S, chatlab=_strings("version"), meta=LAB_META)
    lines = F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != "")
    files = whole(spark, path).withColumn("lines", lines).withColumn("head", F.from_json(F.try_element_at("lines", F.lit(1)), head)).filter("head._type = 'header' and head.chatlab.version = '0.0.2'")
    tagged = lambda tag, of: F.filter(F.transform("lines", lambda x: F.from_json(x, of)), lambda x: x["_type"] == tag)
    rows = files.select("path", F.col("head.meta").alias("meta"), tagged("member", D.StructType([*MEMBER.fields, D.StructField("_type", TEXT)])).alias("members"), F.posexplode(tagged("message", LAB_MESSAGE)).alias("position", "m"))
    return _chatlab(rows)


# Flat formats

CSV_HEADER = ["id", "MsgSvrID", "type_name", "is_sender", "talker", "msg", "src", "CreateTime"]


def weflow_csv(spark: SparkSession, path: Source) -> DataFrame:
    """RFC 4180 with embedded line breaks; a file is one private conversation."""
    if isinstance(path, DataFrame):
        return _csv_messages(_packed_csv(whole(spark, path)))
    reader = spark.read.option("columnPruning", "false")  # whatever is asked of a file, its header is checked as a whole
    rows = reader.csv(path, schema=_strings(*CSV_HEADER), header=True, multiLine=True, quote='"', escape='"', enforceSchema=False, mode="PERMISSIVE")
    # A file lies in one task as a whole, so its rows have consecutive numbers there.
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), "*")
    return _csv_messages(rows.join(rows.groupBy("path").agg(F.min("at").alias("first")), "path").withColumn("position", F.col("at") - F.col("first")))


#: A record of a CSV text: line breaks between quotes do not end it.
CSV_RECORD = r'[^"\r\n]*+(?:"[^"]*+(?:"|\z)[^"\r\n]*+)*+'


def _packed_csv(files: DataFrame) -> DataFrame:
    """(path, position, fields) of the records of CSV texts (path, text) with the known header."""
    # As in a file, the first line break says what ends a line, and such breaks within quotes are plain ones.
    text = F.when(F.col("text").rlike(r"\A[^\r\n]*\r\n"), F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    records = F.filter(F.regexp_extract_all(text, F.lit(CSV_RECORD), F.lit(0)), lambda r: F.length(r) > 0)
    files = files.withColumn("records", records).filter(F.replace(F.try_element_at("records", F.lit(1)), F.lit('"'), F.lit("")) == ",".join(CSV_HEADER))
    rows = files.select("path", F.posexplode(F.slice("records", F.lit(2), F.size("records"))).alias("position", "record"))
    read = F.from_csv("record", ", ".join(f"{c} string" for c in CSV_HEADER), {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n"})
    return rows.select("path", F.col("position").cast("long").alias("position"), read.alias("r")).select("path", "position", "r.*")


def _csv_messages(rows: DataFrame) -> DataFrame:
    native = X.file_native_id(F.col("path"))
    kind = K.csv_type(F.coalesce("type_name", F.lit("")))
    return _messages(
        rows, path=F.col("path"), platform=F.lit("wechat"), account_id=F.lit("wechat-default"), conversation_id=native, kind=F.lit("private"), title=_file_title(F.col("path")), position=F.col("position"),
        native_id=_or_null(F.col("MsgSvrID")), local_id=_or_null(F.col("id")), timestamp_ms=_time(F.col("CreateTime")), sender_id=X.synthetic_sender(native, F.col("talker")), sender_name=F.coalesce("talker", F.lit("")),
        direction=F.when(F.trim("is_sender") == "1", "outgoing").otherwise("incoming"), message_type=kind, content=F.coalesce("msg", F.lit("")), media_path=_or_null(F.trim("src")),
    )


STAMP = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"


def _framed(files: DataFrame, header: str) -> DataFrame:
    """Messages of a text as (position, piece): a piece runs from a header line to the next."""
    pieces = F.filter(F.split("text", f"(?m)(?={header})"), lambda p: p.rlike(f"^{header}"))
    return files.select("*", F.posexplode(pieces).alias("position", "piece"))


def _flat(rows: DataFrame, native: Column, title: Column, header: str, kind: Column, message_type: Column, body: Column, search: Column, account: str = "wechat-default", platform: str = "wechat") -> DataFrame:
    name = T.clean(F.regexp_extract("piece", header, 2))
    return _messages(
        rows, path=F.col("path"), platform=F.lit(platform), account_id=F.lit(account), conversation_id=native, kind=kind, title=title, position=F.col("position"), timestamp_ms=_time(F.regexp_extract("piece", header, 1)),
        sender_id=X.synthetic_sender(native, name), sender_name=name, direction=F.when(name == K.SELF_NAME, "outgoing").otherwise("incoming"), message_type=message_type, content=body, search_text=search,
    )


def weflow_markdown(spark: SparkSession, path: Source) -> DataFrame:
    header = rf"## ({STAMP}) (.*)"
    files = whole(spark, path).filter(F.col("text").rlike(r"(?m)^- 导出工具: WeFlow\s*$") & F.col("text").rlike(r"(?m)^- 会话ID: "))
    rows = _framed(files, header)
    native = T.clean(F.regexp_replace(F.regexp_extract("text", r"(?m)^- 会话ID: (.*)$", 1), "`", ""))
    group = F.regexp_extract("text", r"(?m)^- 会话类型: (.*)$", 1).startswith("群")
    body = T.clean(F.regexp_replace("piece", f"^{header}", ""))
    label = F.regexp_extract(body, r"^!?\[([^\]]+)\]\(", 1)
    kind = K.message_type(None, None, label, body)
    return _flat(rows, native, T.clean(F.regexp_extract("text", r"(?m)^# (.*)$", 1)), header, F.when(group, "group").otherwise("private"), F.when(kind == "other", "text").otherwise(kind), body, T.markdown_text(body))


def weflow_text(spark: SparkSession, path: Source) -> DataFrame:
    """A header of time and quoted sender opens a message; all but the first follow a blank line."""
    header = rf"({STAMP}) '(.*)'"
    files = whole(spark, path).filter(F.col("text").rlike(f"^{header}\r?\n"))
    pieces = F.split("text", rf"(?:\r?\n){{2,}}(?={header}\r?\n)")
    rows = files.select("*", F.posexplode(pieces).alias("position", "piece"))
    body = T.clean(F.regexp_replace("piece", f"^{header}", ""))
    kind = F.coalesce(K.bracket_type(body), F.lit("text"))
    return _flat(rows, X.file_native_id(F.col("path")), _file_title(F.col("path")), header, F.lit("private"), kind, body, body)


#: Type names of the line format, and of the spreadsheet.
QQ_TEXT_TYPES = {
    "text": "text", "文本": "text", "image": "image", "图片": "image", "video": "video", "视频": "video", "audio": "audio", "音频": "audio",
    "file": "file", "文件": "file", "face": "face", "表情": "face", "reply": "reply", "回复": "reply", "system": "system", "系统消息": "system",
}
QQ_SHEET_TYPES = {"文本": "text", "图片": "image", "视频": "video", "音频": "audio", "文件": "file", "表情": "face", "@提及": "at", "回复": "reply", "系统消息": "system", "": "unknown"}


def _named_type(names: dict[str, str], value: Column, other: Column) -> Column:
    known = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))
    return F.coalesce(F.try_element_at(known, F.trim(F.coalesce(value, F.lit("")))), other)


def _listed(ordinal: Column, kind: Column, filename: Column, declared: Column, paths: Column, size: Column, metadata: Column) -> Column:
    """An attachment that an export lists without dimensions."""
    none = F.lit(None)
    return F.struct(ordinal.cast("bigint").alias("ordinal"), kind.alias("kind"), filename.alias("filename"), declared.alias("declared"), paths.alias("candidates"), T.guess_mime(F.coalesce(filename, declared)).alias("mime"), size.cast("bigint").alias("size"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("duration"), metadata.alias("metadata"))


def qq_text(spark: SparkSession, path: Source) -> DataFrame:
    """Numbered and unnumbered messages; resources counted right are attachments without a path."""
    rows = B.messages(spark, path).withColumn("error", F.when(~F.col("whole"), "a message without content"))
    native, name = X.file_native_id(F.col("path")), F.col("sender")
    kind = F.when(F.length("type") > 0, _named_type(QQ_TEXT_TYPES, F.col("type"), F.lit("unknown"))).otherwise("text")

    def attachment(r: Column, k: Column) -> Column:
        named = _named_type(QQ_TEXT_TYPES, r["type"], F.lit("file"))
        facts = F.to_json(F.struct(r["type"].alias("resourceType"), r["name"].alias("resourceName")))
        return _listed(k, F.when(named.isin("image", "video", "audio", "file"), named).otherwise("file"), _or_null(r["name"]), F.lit(None).cast(S), F.array().cast("array<string>"), F.lit(None), facts)

    return _messages(
        rows, path=F.col("path"), platform=F.lit("qq"), account_id=F.lit("qq-default"), conversation_id=native, kind=F.when(F.col("chat").startswith("群"), "group").otherwise("private"), title=F.col("title"), position=F.col("position"),
        local_id=_or_null(F.col("number")), timestamp_ms=_time(F.col("time")), sender_id=X.synthetic_sender(native, name), sender_name=name, direction=K.direction(kind, F.lit(False)), message_type=kind, content=F.col("content"),
        is_recalled=K.recalled(kind, F.col("content")), attachments=F.transform("resources", attachment),
    )


# SQL dumps: only INSERT rows of the known tables are taken, as text; nothing is executed.

SQL_VALUE = r"'(?:[^']|'')*+'|[^\s,()']+"
WEFLOW_COLUMNS = ["session_id", "local_id", "message_id", "create_time", "sender", "is_send", "local_type", "media_type", "content", "media_path"]
SESSION_COLUMNS = ["wxid", "display_name", "session_type", "owner_id", "message_count", "first_message_time", "last_message_time", "exported_at"]
CIPHER_COLUMNS = ["session_wxid", "local_id", "create_time", "formatted_time", "msg_type", "content", "is_send", "sender_username", "sender_display_name", "group_nickname", "reply_to_message_id"]


def insert_rows(files: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(path, text, position, row): the value lists of a table's INSERT statements with exactly these columns.

    A quoted quote is one quote; NULL is null; other values stay text.
    """
    value = F.lit(SQL_VALUE)
    head = rf"(?is)INSERT\s+INTO\s+{table}\s*\(\s*" + r"\s*,\s*".join(columns) + r"\s*\)\s*VALUES\s*"
    tuple_ = rf"\(\s*(?:{SQL_VALUE})(?:\s*,\s*(?:{SQL_VALUE}))*+\s*\)"
    statements = F.regexp_extract_all("text", F.lit(rf"{head}({tuple_}(?:\s*,\s*{tuple_})*+)\s*;"), F.lit(1))
    tuples = F.flatten(F.transform(statements, lambda s: F.regexp_extract_all(s, F.lit(rf"({tuple_})"), F.lit(1))))
    rows = files.select("path", "text", F.posexplode(tuples).alias("position", "t"))
    values = F.regexp_extract_all(F.substring("t", F.lit(2), F.length("t") - 2), value, F.lit(0))
    plain = F.transform(values, lambda v: F.when(F.upper(v) == "NULL", F.lit(None)).when(v.startswith("'"), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'"))).otherwise(v))
    cut = rows.select("path", "text", "position", plain.alias("v")).filter(F.size("v") == len(columns))
    return cut.select("path", "text", "position", F.struct(*(F.get("v", k).alias(c) for k, c in enumerate(columns))).alias("row"))


def weflow_sql(spark: SparkSession, path: Source) -> DataFrame:
    rows = insert_rows(whole(spark, path), "weflow_messages", WEFLOW_COLUMNS)
    r = F.col("row")
    content = F.coalesce(r["content"], F.lit(""))
    kind = F.coalesce(_or_null(K.media_kind(r["media_type"])), F.try_element_at(F.create_map(*(F.lit(v) for p in K.LOCAL_TYPES.items() for v in p)), r["local_type"].try_cast("int")), F.lit("other"))
    own = F.upper(r["is_send"]) == "TRUE"
    return _messages(
        rows, path=F.col("path"), platform=F.lit("wechat"), account_id=F.lit("wechat-default"), conversation_id=r["session_id"], kind=F.when(r["session_id"].endswith("@chatroom"), "group").otherwise("private"), title=r["session_id"],
        position=F.col("position"), native_id=_or_null(r["message_id"]), local_id=_or_null(r["local_id"]), timestamp_ms=T.seconds_or_millis(T.as_long(r["create_time"])), sender_id=T.first_non_empty(r["sender"]),
        sender_name=T.first_non_empty(r["sender"]), direction=K.direction(kind, own), message_type=kind, content=content, is_recalled=K.recalled(kind, content), media_path=_or_null(r["media_path"]),
    )


def ciphertalk_sql(spark: SparkSession, path: Source) -> DataFrame:
    """Messages joined to the one session row of their file."""
    files = whole(spark, path)
    sessions = insert_rows(files, "sessions", SESSION_COLUMNS).groupBy("path").agg(F.first("row").alias("s"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    rows = insert_rows(files, "messages", CIPHER_COLUMNS).join(sessions, "path").filter("row.session_wxid = s.wxid")
    r, s = F.col("row"), F.col("s")
    content = F.coalesce(r["content"], F.lit(""))
    kind = K.message_type(None, None, r["msg_type"], content)
    own = r["is_send"] == "1"
    return _messages(
        rows, path=F.col("path"), platform=F.lit("wechat"), account_id=T.first_non_empty(s["owner_id"], F.lit("wechat-default")), conversation_id=s["wxid"], kind=F.when(s["session_type"] == "group", "group").otherwise("private"),
        title=T.first_non_empty(s["display_name"], s["wxid"]), position=F.col("position"), local_id=_or_null(r["local_id"]), timestamp_ms=T.seconds_or_millis(T.as_long(r["create_time"])), sender_id=T.first_non_empty(r["sender_username"]),
        sender_name=T.first_non_empty(r["group_nickname"], r["sender_display_name"], r["sender_username"]), direction=K.direction(kind, own), message_type=kind, content=content, reply_to=_or_null(r["reply_to_message_id"]),
        is_recalled=K.recalled(kind, content),
    )


# Spreadsheets

SHEET_ROWS = "path string, sheet string, row int, cells map<string,string>, error string"


def sheet_rows(spark: SparkSession, path: Source) -> DataFrame:
    """(path, sheet, row, cells by column letters, error) of every workbook, a file at a time in tasks; a bad workbook is one row with an error."""
    from threadlake.sources.workbook import WorkbookError, rows_of

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    found = [(name, *r, None) for r in rows_of(bytes(content))]
                except WorkbookError as e:
                    found = [(name, None, None, None, str(e))]
                yield pd.DataFrame(found, columns=["path", "sheet", "row", "cells", "error"]).astype({"row": "Int32"})

    files = path if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(run, SHEET_ROWS)


#: Titles and headers of sheets.
MESSAGE_SHEET, RESOURCE_SHEET = "聊天记录", "资源列表"
RESOURCE_HEADER = ["序号", "时间", "发送者", "发送者QQ号", "资源类型", "文件名", "大小(字节)", "URL"]
SHEETS = {
    "weflow": [["序号", "时间", "发送者身份", "消息类型", "内容"], ["序号", "时间", "发送者昵称", "发送者微信ID", "发送者备注", "发送者身份", "消息类型", "内容"], ["序号", "时间", "发送者昵称", "发送者微信ID", "发送者备注", "群昵称", "发送者身份", "消息类型", "内容"]],
    "ciphertalk": [["序号", "时间", "日期", "时刻", "星期", "发送者", "微信ID", "消息类型", "消息内容", "原始类型代码", "时间戳"]],
    "qq": [["序号", "时间", "发送者", "发送者QQ号", "消息类型", "消息内容", "是否撤回", "资源数量"], ["序号", "时间", "发送者", "发送者QQ号", "群头衔", "消息类型", "消息内容", "是否撤回", "资源数量"]],
}


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _named(rows: DataFrame, layouts: list[list[str]], most: int = 20) -> DataFrame:
    """(path, sheet, row, v): rows below a known header, their cells by the header's names."""
    found = []
    for layout in layouts:
        at = F.lit(True)
        for k, name in enumerate(layout):
            at = at & (F.col("cells")[_letters(k)] == name)
        at = at & ((F.size("cells") == len(layout)) | F.lit(layout is layouts[-1]))
        heads = rows.filter(at & (F.col("row") <= most)).groupBy("path", "sheet").agg(F.min("row").alias("head"))
        below = rows.join(heads, ["path", "sheet"]).filter("row > head")
        names = F.map_from_arrays(F.lit(layout), F.array(*(F.coalesce(F.col("cells")[_letters(k)], F.lit("")) for k in range(len(layout)))))
        found.append(below.select("path", "sheet", "row", names.alias("v")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _sheet_messages(rows: DataFrame, platform: str, sender: str, body: str, title: Column, kind: Column, own: Column, ids: list[str], recalled: Column | None = None, attachments: Column | None = None) -> DataFrame:
    v = lambda name: F.coalesce(F.try_element_at("v", F.lit(name)), F.lit(""))
    native = X.file_native_id(F.col("path"))
    name = T.clean(v(sender))
    stamp = F.coalesce(_time(_or_null(v("时间戳"))), _time(_or_null(v("时间"))))
    return _messages(
        rows, path=F.col("path"), platform=F.lit(platform), account_id=F.lit(f"{platform}-default"), conversation_id=native, kind=F.lit("private"), title=title, position=F.col("row"), timestamp_ms=stamp,
        sender_id=T.first_non_empty(*(v(i) for i in ids), X.synthetic_sender(native, name)), sender_name=name, direction=K.direction(kind, own), message_type=kind, content=T.clean(v(body)),
        is_recalled=recalled if recalled is not None else K.recalled(kind, v(body)), attachments=attachments,
    ).filter("timestamp_ms is not null or error is not null")


def weflow_sheet(spark: SparkSession, path: Source) -> DataFrame:
    rows = _named(sheet_rows(spark, path).filter(F.col("sheet") == MESSAGE_SHEET), SHEETS["weflow"])
    name = F.coalesce(F.try_element_at("v", F.lit("发送者昵称")), F.try_element_at("v", F.lit("发送者身份")))
    rows = rows.withColumn("v", F.map_concat(F.map_filter("v", lambda k, _: k != "sender"), F.create_map(F.lit("sender"), name)))
    kind = K.sheet_type(F.col("v")["消息类型"])
    return _sheet_messages(rows, "wechat", "sender", "内容", _file_title(F.col("path")), kind, F.trim(F.col("v")["发送者身份"]) == K.SELF_NAME, ["发送者微信ID"])


def ciphertalk_sheet(spark: SparkSession, path: Source) -> DataFrame:
    rows = _named(sheet_rows(spark, path), SHEETS["ciphertalk"], most=1)
    kind = K.message_type(None, F.col("v")["原始类型代码"], F.col("v")["消息类型"], F.col("v")["消息内容"])
    return _sheet_messages(rows, "wechat", "发送者", "消息内容", F.col("sheet"), kind, F.trim(F.col("v")["发送者"]) == K.SELF_NAME, ["微信ID"])


#: Kinds of listed resources by their lower-case names.
RESOURCE_KINDS = {"image": "image", "图片": "image", "video": "video", "视频": "video", "audio": "audio", "音频": "audio", "voice": "audio", "file": "file", "文件": "file", "face": "emoji", "emoji": "emoji", "表情": "emoji"}
SHEET_KEY = ["path", "time", "uin", "sender"]


def sheet_resources(messages: DataFrame, resources: DataFrame) -> DataFrame:
    """(path, row, attachments, bad): the resources of each message (path, row, time, uin, sender) whose key no other message of its file has.

    A resource (path, row, time, uin, sender, number, kind, name, size, url) is declared by a path below the export; a
    web address is kept as a fact, any other place (rooted, with a drive or scheme, climbing, with empty steps) is left
    out. ``bad`` if a size is no number from 0 on.
    """
    of = U.unique_key_join(messages.select(F.struct("path", "row").alias("message_id"), *SHEET_KEY), resources, SHEET_KEY).select(F.col("message_id.path").alias("path"), F.col("message_id.row").alias("message"), "ordinal", "row")
    url, size = F.replace(F.coalesce("url", F.lit("")), F.lit("\\"), F.lit("/")), F.col("size").try_cast("decimal(38,6)")
    web = F.lower("url").rlike("^https?://")
    safe = (F.length(url) > 0) & ~url.rlike(r"^/|^[A-Za-z][A-Za-z0-9+.-]*:|\x00") & ~F.exists(F.split(url, "/"), lambda p: p.isin("", ".", ".."))
    declared = F.when(safe, F.col("url"))
    filename = F.coalesce(_or_null(F.col("name")), F.when(safe, F.regexp_extract(url, "([^/]*)$", 1)))
    facts = F.to_json(F.struct(F.coalesce("kind", F.lit("")).alias("resourceType"), F.coalesce("number", F.lit("")).alias("resourceNumber"), F.when(web, F.col("url")).alias("url")))
    paths = F.filter(F.array(declared), lambda p: p.isNotNull())
    wrong = (F.length(F.col("size")) > 0) & (size.isNull() | (size < 0) | (size > (1 << 63) - 1))
    each = of.join(resources.select("path", "row", "number", "kind", "name", "size", "url"), ["path", "row"])
    kind = _named_type(RESOURCE_KINDS, F.lower("kind"), F.lit("file"))
    each = each.select("path", F.col("message").alias("row"), _listed(F.col("ordinal"), kind, filename, declared, paths, F.when(~wrong, F.floor(size)), facts).alias("a"), F.coalesce(wrong, F.lit(False)).alias("wrong"))
    return each.groupBy("path", "row").agg(F.array_sort(F.collect_list("a")).alias("attachments"), F.max("wrong").alias("bad"))


def qq_sheet(spark: SparkSession, path: Source) -> DataFrame:
    """Messages of one sheet and, where their time, number and sender are theirs alone, the resources of the other; a workbook is unpacked once."""
    cells = kept(sheet_rows(spark, path).filter(F.col("sheet").isin(MESSAGE_SHEET, RESOURCE_SHEET)), "sheets")
    rows = _named(cells.filter(F.col("sheet") == MESSAGE_SHEET), SHEETS["qq"])
    listed = _named(cells.filter(F.col("sheet") == RESOURCE_SHEET), [RESOURCE_HEADER], most=1)
    v = lambda name: F.col("v")[name]
    key = [T.clean(v("时间")).alias("time"), T.clean(v("发送者QQ号")).alias("uin"), T.clean(v("发送者")).alias("sender")]
    found = sheet_resources(rows.select("path", "row", *key), listed.select("path", "row", *key, v("序号").alias("number"), v("资源类型").alias("kind"), v("文件名").alias("name"), v("大小(字节)").alias("size"), v("URL").alias("url")))
    rows = rows.join(found, ["path", "row"], "left").withColumn("error", F.when(F.col("bad"), "a resource whose size is no number"))
    kind = _named_type(QQ_SHEET_TYPES, v("消息类型"), F.lower(F.trim(v("消息类型"))))
    return _sheet_messages(rows, "qq", "发送者", "消息内容", _file_title(F.col("path")), kind, F.lit(False), ["发送者QQ号"], F.trim(v("是否撤回")) == "是", F.col("attachments"))


#: The registry: readers in the order in which a file is tried, with the extension they take.
READERS = {
    "qq_json": ("json", qq_json), "weflow_json": ("json", weflow_json), "ciphertalk_json": ("json", ciphertalk_json), "chatlab_json": ("json", chatlab_json), "chatlab_jsonl": ("jsonl", chatlab_jsonl), "weflow_csv": ("csv", weflow_csv),
    "weflow_markdown": ("md", weflow_markdown), "qq_text": ("txt", qq_text), "weflow_text": ("txt", weflow_text), "weflow_sql": ("sql", weflow_sql), "ciphertalk_sql": ("sql", ciphertalk_sql),
    "weflow_sheet": ("xlsx", weflow_sheet), "ciphertalk_sheet": ("xlsx", ciphertalk_sheet), "qq_sheet": ("xlsx", qq_sheet),
}


#: Readers that can cut a document.
CUT = ("qq_json", "weflow_json", "ciphertalk_json", "chatlab_json")


def register(name: str, extension: str, reader) -> None:
    """Adds a format of one's own, tried after the others."""
    READERS[name] = (extension, reader)


#: Bytes of a file's head by which its format is known.
HEAD_BYTES = 65536
#: Bytes of the largest file that Spark's binary source gives as one value.
BIGGEST = (1 << 31) - 1024
FILES = "path string, size long, extension string, reader string, error string"
#: What a file's head must show for each reader (all of it), beside its extension.
MARKS = {
    "qq_json": (r"(?is)\"name\"\s*:\s*\"[^\"]*QQChatExporter", r"\"chatInfo\""), "weflow_json": (r"\"weflow\"\s*:\s*\{", r"\"session\"\s*:\s*\{"),
    "ciphertalk_json": (r"\"exportInfo\"\s*:\s*\{", r"\"generator\"\s*:\s*\"CipherTalk\"|\"format\"\s*:\s*\"detailed-json\""), "chatlab_json": (r"\"chatlab\"\s*:\s*\{[^}]*\"version\"\s*:\s*\"0\.0\.2\"", r"\"meta\"\s*:\s*\{"),
    "chatlab_jsonl": (r"^\s*\{[^\n]*\"_type\"\s*:\s*\"header\"", r"^[^\n]*\"version\"\s*:\s*\"0\.0\.2\""), "weflow_csv": ("^\"?" + "\"?,\"?".join(CSV_HEADER) + "\"?\\s*(?:\\r?\\n|$)",),
    "weflow_markdown": (r"(?m)^- 导出工具: WeFlow\s*$", r"(?m)^- 会话ID: "), "qq_text": (r"^\[QQChatExporter V5 ", r"(?m)^聊天名称: "), "weflow_text": (rf"^{STAMP} '.*'\r?\n",), "weflow_sql": (r"(?is)INSERT\s+INTO\s+weflow_messages|CREATE\s+TABLE[^;]*weflow_messages",),
    "ciphertalk_sql": (r"(?is)(?:INSERT\s+INTO|CREATE\s+TABLE(?:\s+IF\s+NOT\s+EXISTS)?)\s+sessions\b",),
}


def _paths(spark: SparkSession, root: Root, among: list[str] | None = None) -> DataFrame:
    """(path, size, content) of every file below the roots (a root that is not there gives none), or of those ``among`` them, which then alone are listed."""
    if isinstance(root, Pack):
        files = root.files.select("path", F.octet_length("content").cast("long").alias("size"), "content")
        return files if among is None else files.filter(F.col("path").isin(*among))
    roots = [root] if isinstance(root, str) else list(root)
    found = spark.createDataFrame([], "path string, size long, content binary")
    if among is not None:
        return spark.read.format("binaryFile").load(among).select("path", F.col("length").alias("size"), "content") if among else found
    for r in roots:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(r)
        except AnalysisException:
            continue
        found = found.unionByName(files.select("path", F.col("length").alias("size"), "content"))
    return found


def _qualified(spark: SparkSession, path: str) -> str:
    """A root as Spark names the files below it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")


def _below(path: Column, roots: list[str]) -> Column:
    """The part of a path below the root that it lies in."""
    out = path
    for r in sorted(roots, key=len):
        out = F.when(path.startswith(r + "/"), F.substr(path, F.lit(len(r) + 2))).otherwise(out)
    return out


def discover(spark: SparkSession, root: Root, excluded: tuple[str, ...] = (), among: list[str] | None = None) -> DataFrame:
    """(path, size, extension) of the files below the folders that may be exports, in order of their lower-case path.

    Folders of media below a root are left out (the root itself may have any name), as are the excluded ones; an empty
    folder gives no rows.
    """
    full = (lambda p: p.rstrip("/")) if isinstance(root, Pack) else (lambda p: _qualified(spark, p))
    roots = [root.root] if isinstance(root, Pack) else [root] if isinstance(root, str) else list(root)
    files = _paths(spark, root, among).select("path", "size").dropDuplicates(["path"])
    parts = F.split(F.lower(_below(F.col("path"), [full(r) for r in roots])), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = F.lit(False)
    for e in excluded:
        out = out | F.col("path").startswith(full(e) + "/") | (F.col("path") == full(e))
    kept = files.withColumn("extension", extension).filter(F.col("extension").isin(*EXTENSIONS) & ~F.exists(folders, lambda p: p.isin(*SKIPPED)) & ~out)
    return kept.select("path", "size", "extension").orderBy(F.lower("path"))


def _workbook_readers(files: DataFrame) -> DataFrame:
    """(path, reader, error) of workbooks (path, content), by the headers of their sheets."""
    from threadlake.sources.workbook import WorkbookError, rows_of

    def one(content: bytes) -> tuple[str | None, str | None]:
        try:
            for sheet, row, cells in rows_of(content):
                values = [cells.get(_letters(k), "") for k in range(len(cells))]
                for name, layouts in SHEETS.items():
                    if row <= (1 if name == "ciphertalk" else 20) and (name == "ciphertalk" or sheet == MESSAGE_SHEET) and any(values[: len(x)] == x for x in layouts):
                        return f"{name}_sheet", None
        except WorkbookError as e:
            return None, str(e)
        return None, None

    def run(frames):
        for frame in frames:
            found = [one(bytes(c)) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "reader": [f[0] for f in found], "error": [f[1] for f in found]})

    return files.mapInPandas(run, "path string, reader string, error string")


def sniffed(spark: SparkSession, root: Root, excluded: tuple[str, ...] = (), among: list[str] | None = None) -> DataFrame:
    """(path, size, extension, reader, error) of the exports below the folders: the first reader in the registry whose marks a file bears in its first or last 64 KiB.

    Files that bear none are left out, those that cannot be told (no workbook, no JSON) have an error and no reader. What
    a chunked export's manifest declares, and its folder ``chunks``, belongs to the manifest. Each file is looked at once.
    """
    files = discover(spark, root, excluded, among)
    contents = _paths(spark, root, among).filter(F.col("size") < BIGGEST).join(files.select("path", "extension"), "path")
    # cast, not decode: the cut may lie within a letter
    text = lambda raw: F.make_valid_utf8(raw.cast(S))
    head = F.regexp_replace(text(F.substring("content", 1, HEAD_BYTES)), "^\ufeff", "")
    tail = F.when(F.col("size") > HEAD_BYTES, text(F.substring("content", -HEAD_BYTES, HEAD_BYTES))).otherwise("")
    plain = contents.filter("extension <> 'xlsx'").select("path", "extension", head.alias("head"), F.concat(head, tail).alias("ends"))
    reader = F.lit(None).cast(S)
    for name, (extension, _) in reversed(READERS.items()):
        marks = MARKS.get(name, (("(?s)",) if extension != "xlsx" else ()))
        if marks:
            fits = F.col("extension") == extension
            for k, mark in enumerate(marks):
                fits = fits & F.col("ends" if extension == "json" else "head").rlike(mark)
            reader = F.when(fits, name).otherwise(reader)
    reader = F.when((F.lower(F.regexp_extract("path", "([^/]+)$", 1)) == "manifest.json") & F.col("ends").rlike(MARKS["qq_json"][0]) & F.col("ends").rlike(MARKS["qq_json"][1]), "qq_chunked").otherwise(reader)
    told = plain.select("path", reader.alias("reader"), F.when((F.col("extension") == "json") & ~F.col("head").rlike(r"^\s*[\[{]"), "malformed JSON").alias("error"))
    told = told.unionByName(_workbook_readers(contents.filter("extension = 'xlsx'").select("path", "content"))).filter("reader is not null or error is not null")
    told = told.unionByName(files.filter(F.col("size") >= BIGGEST).select("path", F.lit(None).cast(S).alias("reader"), F.lit("too large to be told apart").alias("error")))
    found = files.join(told, "path").select(*(c.split()[0] for c in FILES.split(", ")))
    if isinstance(root, Pack):
        return _without_chunks(spark, root, kept(found, "sniffed"))
    rows = found.collect()  # the driver lists files, as Spark itself does
    chunked = [r["path"] for r in rows if r["reader"] == "qq_chunked"]
    own = {r["chunk"] for r in manifests(spark, chunked).filter("chunk is not null").select("chunk").distinct().collect()} if chunked else set()
    folders = tuple(p.rsplit("/", 1)[0] + "/chunks/" for p in chunked)
    left = [r for r in rows if r["path"] not in own and not r["path"].startswith(folders or ("\0",))]
    return spark.createDataFrame(sorted(left, key=lambda r: r["path"].lower()), FILES)


def _without_chunks(spark: SparkSession, pack: Pack, told: DataFrame) -> DataFrame:
    """The files of a pack but for those that its chunked exports declare or keep in their folder ``chunks``."""
    chunked = told.filter("reader = 'qq_chunked'").select("path")
    own = manifests(spark, pack.of(chunked)).select(F.col("chunk").alias("path"))
    parts = F.split("path", "/")
    above = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda n: (n < F.size(parts)) & (F.get(parts, n - 1) == "chunks")), lambda n: F.array_join(F.slice(parts, F.lit(1), n - 1), "/"))
    beside = told.select("path", F.explode(above).alias("folder")).join(chunked.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")), "folder", "left_semi")
    return told.join(own.unionByName(beside.select("path")), "path", "left_anti")


def read_all(spark: SparkSession, root: Root, excluded: tuple[str, ...] = (), files: DataFrame | None = None) -> DataFrame:
    """All messages below the folders (or of ``files``, as ``sniffed`` gives them): each file goes to its one reader. Files that cannot be read are rows with an error."""
    files = sniffed(spark, root, excluded) if files is None else files
    by_reader: dict[tuple[str, bool], Source] = {}
    cut = F.coalesce((F.col("extension") == "json") & F.col("reader").isin(*CUT) & (F.col("size") >= LARGE), F.lit(False))
    told = files.filter("error is null and reader is not null").select("path", "reader", cut.alias("large"))
    if isinstance(root, Pack):
        for r in told.select("reader", "large").distinct().collect():
            own = told.filter((F.col("reader") == r["reader"]) & (F.col("large") == r["large"]))
            by_reader[r["reader"], r["large"]] = root.chunked(own) if r["reader"] == "qq_chunked" else root.of(own)
    else:
        for r in told.collect():
            by_reader.setdefault((r["reader"], r["large"]), []).append(r["path"])
    out = spark.createDataFrame([], READ)
    for (name, large), source in by_reader.items():
        found = (qq_chunked if name == "qq_chunked" else READERS[name][1])(spark, source, **({"large": True} if large else {}))
        out = out.unionByName(found.withColumn("position", F.col("position").cast("long")), allowMissingColumns=True)
    bad = files.filter("error is not null").select("path", "error")
    return out.unionByName(bad, allowMissingColumns=True)


def valid(messages: DataFrame) -> DataFrame:
    """Rows that can be stored: a time, a conversation and a known direction."""
    return messages.filter("timestamp_ms is not null and length(conversation_id) > 0 and direction in ('incoming', 'outgoing', 'system')")


def rejects(messages: DataFrame) -> DataFrame:
    """(path, position, reason) of rows that cannot."""
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("timestamp_ms").isNull(), "no time").when(F.coalesce(F.length("conversation_id"), F.lit(0)) == 0, "no conversation").when(~F.col("direction").isin("incoming", "outgoing", "system"), "unknown direction")
    return messages.select("path", "position", reason.alias("reason")).filter("reason is not null")
