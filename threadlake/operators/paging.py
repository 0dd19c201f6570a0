"""Cursors and keyset pages: a page is one bounded top-k, never an offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode_cursor(timestamp_ms: int, row_id: int) -> str:
    return f"{timestamp_ms}_{row_id}"


def decode_cursor(text: str | None) -> tuple[int, int] | None:
    """The cursor's two numbers; None for anything else."""
    left, found, right = (text or "").partition("_")
    try:
        return (int(left), int(right)) if found else None
    except ValueError:
        return None


def clamp(limit: int | None, default: int, most: int) -> int:
    return max(1, min(most, default if limit is None else limit))


def older(cursor: tuple[int, int] | None, ts: str = "timestamp_ms", key: str = "id") -> Column:
    """Rows strictly before a cursor in (time, id); everything without one."""
    if cursor is None:
        return F.lit(True)
    t, i = cursor
    return (F.col(ts) < t) | ((F.col(ts) == t) & (F.col(key) < i))


def newest(frame: DataFrame, n: int, ts: str = "timestamp_ms", key: str = "id") -> DataFrame:
    """The n newest rows by (time, id)."""
    return frame.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def next_cursor(page: list, size: int) -> str | None:
    """From the (size + 1) newest rows of a collected page: where the next one starts."""
    return encode_cursor(page[size - 1]["timestamp_ms"], page[size - 1]["id"]) if len(page) > size else None
