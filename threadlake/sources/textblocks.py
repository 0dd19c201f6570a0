"""Messages of a line format, read by many tasks: which message each line belongs to, by prefix sums over blocks.

A numbered message runs from its line ``[n]`` to the next one. Messages before
the first number have none: each begins at its line of time, or at the line
before it if that names a sender. The export ends where a rule is followed by
the closing words. All of this is known from a line, its two neighbours, and
sums over the lines before it; sums of blocks come first (a row a block), then
places within a block, so no task sees more than a block or one message. A text
of a pack is one block: nothing comes before it, and its lines pass by one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.functions import text as T

#: Shapes of lines.
NUMBER, TIME, CONTENT, TYPE, TITLE, CHAT = r"^\[(\d+)\]$", r"^时间:\s*(.+)$", r"^内容:\s*(.*)$", r"^类型:\s*(.+)$", r"^聊天名称:\s*(.+)$", r"^聊天类型:\s*(.+)$"
RESOURCE, RULE, CLOSING, SIGNATURE = r"^\h{2}-\h+([^:：]+)[:：]\s*(.*)$", "^=+$", "导出完成", "[QQChatExporter V5 "
#: Where lines of a message are cut: before a line that counts resources.
COUNTED = r"\n(?=资源:\h*\d+\h+个文件\h*(?:\n|\z))"


def sender_of(line: Column) -> Column:
    """The sender that a line names, without a title in brackets before it, else null."""
    name = T.clean(F.regexp_extract(line, "^(.+):$", 1))
    bare = F.when(name.rlike(r"^\[[^\]]+\]\s+.+$"), T.clean(F.regexp_replace(name, r"^\[[^\]]+\]\s+", ""))).otherwise(name)
    return F.when(line.rlike("^.+:$") & ~line.rlike("^(?:时间|类型|内容|资源):") & (F.length(bare) > 0), bare)


def lines(spark: SparkSession, paths: str | list[str] | DataFrame) -> DataFrame:
    """(path, block, at, line): lines of the files, or of the texts of a pack (path, text), in the order of block and at."""
    if isinstance(paths, DataFrame):
        split = F.when(F.length("text") > 0, F.split(F.regexp_replace("text", r"(?:\r\n|\r|\n)\z", ""), "\r\n|\r|\n"))
        rows = paths.select("path", F.posexplode(split).alias("at", "line"))
        return rows.select("path", F.lit(0).cast("bigint").alias("block"), F.col("at").cast("bigint").alias("at"), F.regexp_replace("line", "^\ufeff", "").alias("line"))
    meta = F.col("_metadata")
    return spark.read.text(paths).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^﻿", "").alias("line"))


def _last(value: Column, where: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull() & where, F.col("at")))


def _inside(pack: bool) -> Window:
    return (Window.partitionBy("path") if pack else Window.partitionBy("path", "block")).orderBy("at")


def _flagged(rows: DataFrame, inside: Window) -> DataFrame:
    """``rows`` with what a line is, and the numbers up to it in its block (``k``)."""
    flags = rows.withColumns({"number": F.col("line").rlike(NUMBER), "time": F.col("line").rlike(TIME)})
    return flags.withColumn("k", F.sum(F.col("number").cast("int")).over(inside)).withColumn("next", F.lead("line").over(inside)).withColumn("previous", F.lag("line").over(inside))


def _closing(line: Column, following: Column) -> Column:
    return line.rlike(RULE) & F.coalesce(T.clean(following) == CLOSING, F.lit(False))


def _part(shape: str) -> Column:
    return F.when(F.col("line").rlike(shape), T.clean(F.regexp_extract("line", shape, 1)))


def _one_block(flagged: DataFrame) -> DataFrame:
    """``flagged`` lines of texts, each a block without others beside it, with what ``_blocks`` tells of it."""
    text = Window.partitionBy("path")
    none, null = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    head = F.sum((F.col("number") | F.col("time")).cast("int")).over(_inside(True)) == 0
    said = flagged.withColumn("head", head).withColumns({n: F.when(F.col("head"), c) for n, c in (("title", _part(TITLE)), ("chat", _part(CHAT)), ("opener", sender_of(F.col("line"))))})
    last = {n: F.max_by(n, F.when(F.col(n).isNotNull(), F.col("at"))).over(text) for n in ("title", "chat", "opener")}
    facts = said.withColumns(last | {"signature": F.min_by("line", F.when(F.col("at") == 0, F.col("at"))).over(text)})
    return facts.withColumns({"numbers_before": none, "messages_before": none, "closed_before": none, "before_line": null, "after_line": null}).drop("head")


def _blocks(flagged: DataFrame) -> DataFrame:
    """A row for each (path, block): what came before it, the lines beside it, and the facts of the file's head."""
    inside = _inside(False)
    opened = flagged.withColumn("head", F.sum((F.col("number") | F.col("time")).cast("int")).over(inside) == 0)
    sums = opened.groupBy("path", "block").agg(
        F.count_if("number").alias("numbers"), F.count_if(F.col("time") & (F.col("k") == 0)).alias("times"), F.min_by("line", "at").alias("first"), F.max_by("line", "at").alias("last"), F.count_if(_closing(F.col("line"), F.col("next"))).alias("closings"),
        _last(_part(TITLE), F.col("head")).alias("title"), _last(_part(CHAT), F.col("head")).alias("chat"), _last(sender_of(F.col("line")), F.col("head")).alias("opener"),
    )
    order, whole = Window.partitionBy("path").orderBy("block"), Window.partitionBy("path")
    before = sums.withColumn("numbers_before", F.sum("numbers").over(order) - F.col("numbers")).withColumn("after_line", F.lead("first").over(order)).withColumn("before_line", F.lag("last").over(order))
    starts = F.col("numbers") + F.when(F.col("numbers_before") == 0, F.col("times")).otherwise(0)
    before = before.withColumn("starts", starts).withColumn("messages_before", F.sum("starts").over(order) - F.col("starts"))
    closed = F.col("closings") + _closing(F.col("last"), F.col("after_line")).cast("int")
    before = before.withColumn("closed", closed).withColumn("closed_before", F.sum("closed").over(order) - F.col("closed"))
    of_head = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col("messages_before") == 0), F.col("block"))).over(whole)
    facts = before.withColumns({"title_": of_head("title"), "chat_": of_head("chat"), "opener_": of_head("opener"), "signature": F.min_by("first", "block").over(whole)})
    return facts.select("path", "block", "numbers_before", "messages_before", "closed_before", "before_line", "after_line", "signature", F.col("title_").alias("title"), F.col("chat_").alias("chat"), F.col("opener_").alias("opener"))


def messages(spark: SparkSession, paths: str | list[str] | DataFrame) -> DataFrame:
    """(path, title, chat, position, number, sender, time, type, content, resources, whole) of the messages of the exports.

    ``resources`` (type, name) are lines listed after a line that counts them, if they are as many as it says; else
    they and the count are content, as written. Blank lines at the end of a content are no part of it. A message without
    a content is not ``whole``. Files without signature or title give no rows.
    """
    pack = isinstance(paths, DataFrame)
    inside = _inside(pack)
    flagged = _flagged(lines(spark, paths), inside)
    placed = (_one_block(flagged) if pack else flagged.join(_blocks(flagged), ["path", "block"])).filter(F.col("signature").startswith(SIGNATURE) & (F.length("title") > 0))
    placed = placed.withColumns({"next": F.coalesce("next", "after_line"), "previous": F.coalesce("previous", "before_line")}).drop("after_line", "before_line")
    placed = placed.withColumn("free", (F.col("numbers_before") == 0) & (F.col("k") == 0)).withColumn("start", F.col("number") | (F.col("time") & F.col("free")))
    placed = placed.withColumn("message", F.col("messages_before") + F.sum(F.col("start").cast("int")).over(inside))
    placed = placed.withColumn("over", F.col("closed_before") + F.sum(_closing(F.col("line"), F.col("next")).cast("int")).over(inside) > 0)
    named_next = F.col("free") & sender_of(F.col("line")).isNotNull() & F.coalesce(F.col("next").rlike(TIME), F.lit(False))
    handed = F.when(F.col("start") & ~F.col("number"), F.coalesce(sender_of(F.col("previous")), F.when(F.col("message") == 1, F.col("opener"))))
    own = placed.filter((F.col("message") > 0) & ~F.col("over") & ~named_next).withColumn("handed", handed)
    grouped = own.groupBy("path", "message").agg(F.first("title").alias("title"), F.first("chat").alias("chat"), F.max("handed").alias("handed"), F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("found"))
    return _read(grouped.withColumn("lines", F.col("found.line")).drop("found"))


def _at(lines_: Column, shape: str) -> Column:
    """The place (from 1) of the first line of a shape, 0 if there is none."""
    return F.array_position(F.transform(lines_, lambda x: x.rlike(shape)), True)


def _read(grouped: DataFrame) -> DataFrame:
    """The fields of messages (path, message, handed, lines)."""
    said = grouped.withColumn("c", _at(F.col("lines"), CONTENT).cast("int")).withColumn("t", _at(F.col("lines"), TIME).cast("int"))
    head = F.when(F.col("c") > 0, F.slice("lines", F.lit(1), F.col("c") - 1)).otherwise(F.col("lines"))
    first, last = lambda a: F.try_element_at(a, F.lit(1)), lambda a: F.try_element_at(a, F.lit(-1))
    senders = F.filter(F.transform(head, sender_of), lambda s: s.isNotNull())
    types = F.filter(head, lambda x: x.rlike(TYPE))
    # From the content on, but for the line of time, should it come that late.
    body = F.filter(F.transform("lines", lambda x, i: F.when(i + 1 == F.col("c"), F.regexp_extract(x, CONTENT, 1)).when((i >= F.col("c")) & (i + 1 != F.col("t")), x)), lambda x: x.isNotNull())
    said = said.withColumns({"sender": F.coalesce(last(senders), "handed", F.lit("unknown")), "type": T.clean(F.regexp_extract(last(types), TYPE, 1)), "time": T.clean(F.regexp_extract(F.get("lines", F.col("t") - 1), TIME, 1)), "body": body})
    said = said.withColumn("parts", F.split(F.array_join("body", "\n"), COUNTED))
    # Of each part after the first: its lines, how many are declared, and how many resources follow at once.
    cut = F.transform(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), lambda p: F.struct(F.split(p, "\n").alias("lines"), F.regexp_extract(p, r"^资源:\h*(\d+)", 1).try_cast("int").alias("declared")))
    said = said.withColumn("cut", cut)
    other = lambda x: F.array_position(F.transform(F.slice(x["lines"], 2, F.size(x["lines"])), lambda y: y.rlike(RESOURCE)), False).cast("int")
    said = said.withColumn("cut", F.transform("cut", lambda x: F.struct(x["lines"].alias("lines"), x["declared"].alias("declared"), T.let(other(x), lambda n: F.when(n > 0, n - 1).otherwise(F.size(x["lines"]) - 1)).alias("run"))))
    right = lambda x: F.coalesce(x["declared"] == x["run"], F.lit(False))
    rest = F.flatten(F.transform("cut", lambda x: F.when(right(x), F.slice(x["lines"], x["run"] + 2, F.size(x["lines"]))).otherwise(x["lines"])))
    listed = F.flatten(F.transform(F.filter("cut", right), lambda x: F.slice(x["lines"], F.lit(2), x["run"])))
    said = said.withColumn("kept", F.concat(F.split(F.coalesce(first(F.col("parts")), F.lit("")), "\n"), rest))
    size = F.coalesce(F.array_max(F.transform("kept", lambda x, i: F.when(F.length(T.clean(x)) > 0, i + 1))), F.lit(0))
    return said.select(
        "path", "title", "chat", (F.col("message") - 1).alias("position"), F.regexp_extract(F.get("lines", F.lit(0)), NUMBER, 1).alias("number"), "sender", "time", "type", F.array_join(F.slice("kept", F.lit(1), size), "\n").alias("content"),
        F.transform(listed, lambda x: F.struct(T.clean(F.regexp_extract(x, RESOURCE, 1)).alias("type"), T.clean(F.regexp_extract(x, RESOURCE, 2)).alias("name"))).alias("resources"), (F.col("c") > 0).alias("whole"),
    )
