"""Archive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def archive_stats(messages: DataFrame, conversations: DataFrame, senders: DataFrame, attachments: DataFrame, media: DataFrame) -> DataFrame:
    """Eleven totals in one row: each table is aggregated alone, then the single rows stand side by side."""
    one = F.lit(1)
    m = messages.agg(F.count(one).alias("messages"), F.count_if(F.col("platform") == "qq").alias("qq_messages"), F.count_if(F.col("platform") == "wechat").alias("wechat_messages"))
    c = conversations.agg(F.count(one).alias("conversations"), F.count_if(F.col("kind") == "private").alias("private_conversations"), F.count_if(F.col("kind") == "group").alias("group_conversations"))
    s = senders.agg(F.count(one).alias("senders"))
    a = attachments.agg(F.count(one).alias("attachments"), F.count_if(~F.col("is_available")).alias("missing_attachments"))
    f = media.agg(F.count(one).alias("media_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("media_bytes"))
    out = m
    for part in (c, s, a, f):  # one row each
        out = out.join(part)
    return out


def run_counters(files: DataFrame) -> DataFrame:
    """(status, n_files, added, duplicates, revisions) of an import run's files."""
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"), *(F.sum(c).alias(c) for c in ("added", "duplicates", "revisions")))
