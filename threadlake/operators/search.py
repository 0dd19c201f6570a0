"""Message search: filters, match mode, page and snippet, and the option counts of the filter lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.operators.paging import clamp, decode_cursor, newest, older


@dataclass(frozen=True)
class SearchFilter:
    """Optional conditions; absent ones add no predicate."""

    platform: str | None = None
    kind: str | None = None
    conversation_id: int | None = None
    sender: str | None = None
    message_type: str | None = None
    from_ms: int | None = None
    to_ms: int | None = None

    def on_messages(self) -> Column:
        """The conditions that reach the message scan."""
        tests = [
            (self.conversation_id, lambda v: F.col("conversation_id") == v),
            (self.message_type, lambda v: F.col("message_type") == v),
            (self.from_ms, lambda v: F.col("timestamp_ms") >= v),
            (self.to_ms, lambda v: F.col("timestamp_ms") < v),
        ]
        out = F.lit(True)
        for value, test in tests:
            if value is not None:
                out = out & test(value)
        return out


def whole_words(query: str) -> bool:
    """Whether every token has three characters, so that the full-text mode (all letters folded) applies."""
    tokens = query.split()
    return bool(tokens) and all(len(t) >= 3 for t in tokens)


def matches(query: str, column: str = "search_text") -> Column:
    """Full-text mode folds all letters; the substring mode for short tokens folds ASCII only."""
    return T.contains_folded(F.col(column), query) if whole_words(query) else T.like(F.col(column), query)


def filtered(messages: DataFrame, conversations: DataFrame, aliases: DataFrame | None, where: SearchFilter) -> DataFrame:
    """Messages with their conversation's title, platform and kind, under all conditions.

    Conversations are filtered before the join; a sender matches by name or by any alias.
    """
    rows = messages.filter(where.on_messages())
    if where.sender is not None:
        named = T.like(F.col("sender_name"), where.sender)
        if aliases is not None:
            known = aliases.filter(T.like(F.col("alias"), where.sender)).select("sender_id").distinct().withColumn("by_alias", F.lit(True))
            rows = rows.join(known, "sender_id", "left").filter(named | F.col("by_alias")).drop("by_alias")
        else:
            rows = rows.filter(named)
    convs = conversations.select(F.col("id").alias("conversation_id"), "title", F.col("platform").alias("conversation_platform"), "kind")
    if where.platform is not None:
        convs = convs.filter(F.col("conversation_platform") == where.platform)
    if where.kind is not None:
        convs = convs.filter(F.col("kind") == where.kind)
    return rows.join(convs, "conversation_id")


def search(messages: DataFrame, conversations: DataFrame, query: str, where: SearchFilter = SearchFilter(), cursor: str | None = None, limit: int | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """One page (and one row more, to tell whether there are others), newest first; an empty query finds nothing."""
    query = query.strip()
    size = clamp(limit, 60, 200)
    rows = filtered(messages.filter(matches(query) if query else F.lit(False)), conversations, aliases, where)
    page = newest(rows.filter(older(decode_cursor(cursor))), size + 1)
    return page.select("id", "conversation_id", "title", F.col("conversation_platform").alias("platform"), "sender_name", T.snippet(F.col("content"), F.col("search_text"), query).alias("snippet"), "timestamp_ms")


def option_counts(messages: DataFrame, column: str, conversation_id: int | None = None, most: int | None = None) -> DataFrame:
    """(value, amount) of a filter list, the most frequent first; ``most`` is the list's length."""
    rows = messages if conversation_id is None else messages.filter(F.col("conversation_id") == conversation_id)
    counts = rows.filter(F.coalesce(F.length(column) > 0, F.lit(False))).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("amount"))
    ordered = counts.orderBy(F.desc("amount"), "value")
    return ordered.limit(most) if most else ordered
