"""What a timeline shows: separators, noise, labels and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import text as T

#: The latest time a timeline shows, group notices without content, and labels that only name a medium.
LATEST_MS = 253402300799000
NOISE = "群聊更新"
TECHNICAL = (
    "[图片]", "[图片:", "[文件]", "[文件:", "[视频]", "[视频:",
    "[语音]", "[语音:", "[表情包]", "[表情包:", "[动画表情]", "[动画表情:",
    "[image]", "[image:", "[file]", "[file:", "[video]", "[video:",
    "[audio]", "[audio:", "[voice]", "[voice:", "[emoji]", "[emoji:",
)
MEDIA_TYPES = ("image", "file", "video", "audio", "voice", "emoji", "sticker")


def local_date(ms: Column) -> Column:
    """The calendar day of a time, held within what can be shown."""
    return F.timestamp_millis(F.least(F.greatest(ms, F.lit(0)), F.lit(LATEST_MS))).cast("date")


def date_separators(messages: DataFrame) -> DataFrame:
    """(conversation_id, id, date): the first message of each day of a conversation.

    The first is the least (time, id) of the day, which an aggregation finds without sorting conversations.
    """
    day = messages.select("conversation_id", "id", "timestamp_ms", local_date(F.col("timestamp_ms")).alias("date"))
    return day.groupBy("conversation_id", "date").agg(F.min_by("id", F.struct("timestamp_ms", "id")).alias("id")).select("conversation_id", "id", F.col("date").cast("string").alias("date"))


def without_noise(messages: DataFrame) -> DataFrame:
    """Messages but for group notices that say nothing."""
    noise = (F.col("direction") == "system") & (T.clean(F.col("content")) == NOISE)
    return messages.filter(~F.coalesce(noise, F.lit(False)))


def is_media(message_type: Column, media_type: Column, attachments: Column) -> Column:
    return (attachments > 0) | F.coalesce(F.length(F.trim(media_type)) > 0, F.lit(False)) | message_type.isin(*MEDIA_TYPES)


def normal_path(x: Column) -> Column:
    return F.lower(F.replace(F.trim(F.coalesce(x, F.lit(""))), F.lit("\\"), F.lit("/")))


def display_content(content: Column, paths: Column, media: Column) -> Column:
    """The text to show: none where a media message only repeats a label or the path of an attachment."""
    text = F.trim(F.coalesce(content, F.lit("")))
    label = F.lit(False)
    for prefix in TECHNICAL:
        label = label | F.lower(text).startswith(prefix)
    same = F.exists(paths, lambda p: (F.length(F.trim(F.coalesce(p, F.lit("")))) > 0) & (normal_path(p) == normal_path(text)))
    return F.when(media & (F.length(text) > 0) & (label | F.coalesce(same, F.lit(False))), F.lit("")).otherwise(content)


def display_kind(kind: Column) -> Column:
    """A kind in lower case; voice is audio, nothing is unknown."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(k == "", "unknown").when(k == "voice", "audio").otherwise(k)


def attachment_flags(attachments: DataFrame) -> DataFrame:
    """(message_id, ordinal, kind, is_image, is_missing)."""
    kind = display_kind(F.col("kind"))
    return attachments.select("message_id", "ordinal", kind.alias("kind"), kind.isin("image", "sticker", "emoji").alias("is_image"), (~F.coalesce("is_available", F.lit(False))).alias("is_missing"))


def merge_attachments_order(attachments: DataFrame) -> DataFrame:
    """Attachments of a message as one ordered list."""
    return attachments.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "kind"))).alias("attachments"))


def with_separators(messages: DataFrame) -> DataFrame:
    """Timeline entries: a separator row before the first message of each day, then the message rows."""
    order = Window.partitionBy("conversation_id").orderBy("timestamp_ms", "id")
    rows = messages.withColumn("date", local_date(F.col("timestamp_ms")).cast("string"))
    new = F.coalesce(F.lag("date").over(order) != F.col("date"), F.lit(True))
    entries = F.when(F.col("opens"), F.array(F.lit("separator"), F.lit("message"))).otherwise(F.array(F.lit("message")))
    return rows.withColumn("opens", new).withColumn("entry", F.explode(entries)).drop("opens")
