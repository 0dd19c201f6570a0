"""Conversation lists, timelines and message contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.operators.paging import clamp, newest, older


def last_messages(messages: DataFrame) -> DataFrame:
    """(conversation_id, last_message_at, preview, message_count): the content of the newest message by (time, id)."""
    at = F.struct("timestamp_ms", "id")
    return messages.groupBy("conversation_id").agg(F.max("timestamp_ms").alias("last_message_at"), F.max_by("content", at).alias("preview"), F.count(F.lit(1)).alias("message_count"))


def windows(messages: DataFrame) -> DataFrame:
    """(conversation_id, message_count, first_message_at, last_message_at)."""
    return messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("message_count"), F.min("timestamp_ms").alias("first_message_at"), F.max("timestamp_ms").alias("last_message_at"))


def conversation_list(conversations: DataFrame, messages: DataFrame, aliases: DataFrame | None = None, platform: str | None = None, kind: str | None = None, keyword: str | None = None, limit: int | None = None) -> DataFrame:
    """Conversations, the most recently active first (those without messages last), with a preview."""
    rows = conversations
    if platform is not None:
        rows = rows.filter(F.col("platform") == platform)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if keyword:
        titled = T.like(F.col("title"), keyword)
        if aliases is not None:
            named = aliases.filter(T.like(F.col("alias"), keyword)).select(F.col("conversation_id").alias("id")).distinct().withColumn("by_alias", F.lit(True))
            rows = rows.join(named, "id", "left").filter(titled | F.col("by_alias")).drop("by_alias")
        else:
            rows = rows.filter(titled)
    last = last_messages(messages.select("conversation_id", "timestamp_ms", "id", "content"))
    joined = rows.join(last, rows["id"] == last["conversation_id"], "left")
    return joined.select("id", "platform", "kind", "title", "last_message_at", "preview").orderBy(F.col("last_message_at").desc_nulls_last(), F.col("id").desc()).limit(clamp(limit, 300, 1000))


MESSAGE = ("id", "sender_id", "timestamp_ms", "direction", "message_type", "content")


def timeline_page(messages: DataFrame, conversation_id: int, cursor: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
    """The newest rows of a conversation before a cursor, oldest first; one more than the page holds."""
    size = clamp(limit, 80, 200)
    rows = messages.filter((F.col("conversation_id") == conversation_id) & older(cursor)).select(*MESSAGE)
    return newest(rows, size + 1).orderBy("timestamp_ms", "id")


def context(messages: DataFrame, message_id: int, radius: int | None = None) -> DataFrame:
    """The focus row and up to ``radius`` rows on each side of it, with their place; no rows for an unknown id."""
    n = clamp(radius, 24, 100)
    focus = messages.filter(F.col("id") == message_id).select("conversation_id", F.col("timestamp_ms").alias("t"), F.col("id").alias("i"))
    near = messages.select("conversation_id", "id", "timestamp_ms").join(F.broadcast(focus), "conversation_id")  # the focus is one row

    def side(before: bool) -> DataFrame:
        past = (F.col("timestamp_ms") < F.col("t")) | ((F.col("timestamp_ms") == F.col("t")) & (F.col("id") < F.col("i")))
        rows = near.filter(past if before else ~past & (F.col("id") != F.col("i")))
        order = [F.col(c).desc() if before else F.col(c).asc() for c in ("timestamp_ms", "id")]
        return rows.orderBy(*order).limit(n)

    found = side(True).unionByName(near.filter(F.col("id") == F.col("i"))).unionByName(side(False))
    # At most 2 * n + 1 rows, so placing them in one partition is cheap.
    rows = found.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("timestamp_ms", "id"))).alias("rows"), F.first("t").alias("t"), F.first("i").alias("i"))
    at = F.array_position("rows", F.struct(F.col("t").alias("timestamp_ms"), F.col("i").alias("id")))
    return rows.select(at.alias("at"), F.posexplode("rows").alias("pos", "row")).select(F.col("row.id").alias("id"), (F.col("pos") + 1 - F.col("at")).cast("bigint").alias("rel_pos"), F.col("row.timestamp_ms").alias("timestamp_ms"))


def hydrate(messages: DataFrame, bindings: DataFrame, contacts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Messages with the display name to show: the bound contact's, else the resolved alias, else the snapshot.

    Small sides join after the page is cut; ``names`` is (sender_id, conversation_id, alias).
    """
    bound = bindings.join(contacts.select(F.col("id").alias("contact_id"), F.col("display_name").alias("contact_name")), "contact_id").select("sender_id", "contact_name", "account_label")
    rows = messages.join(bound, "sender_id", "left")
    resolved: Column = F.lit(None).cast("string")
    if names is not None:
        rows = rows.join(names, ["sender_id", "conversation_id"], "left")
        resolved = F.col("alias")
    return rows.select(F.col("id").alias("message_id"), F.coalesce("contact_name", resolved, "sender_name").alias("display_name"), "account_label")


def hydrate_attachments(attachments: DataFrame, media: DataFrame) -> DataFrame:
    """Attachments with the size of their media object, where there is one."""
    sized = media.select(F.col("id").alias("media_id"), "size")
    return attachments.join(sized, "media_id", "left").select("message_id", "ordinal", "kind", "is_available", "size")
