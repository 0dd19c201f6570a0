"""What lists and timelines print: names of platforms and types, identities, badges, local times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.operators.present import LATEST_MS

# The names shown.
PLATFORMS = {"qq": "QQ", "wechat": "微信", "text": "文本", "html": "网页", "sql": "SQL"}
TYPES = {"text": "文本", "image": "图片", "file": "文件", "video": "视频", "audio": "语音", "voice": "语音", "emoji": "表情", "sticker": "表情", "reply": "引用", "system": "系统消息"}
WEEKDAYS = ("周日", "周一", "周二", "周三", "周四", "周五", "周六")


def _named(table: dict[str, str], key: Column, other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), other)


def _filled(x: Column) -> Column:
    """Trimmed; null where nothing is left."""
    t = F.trim(x)
    return F.when(F.length(t) > 0, t)


def platform_label(platform: Column) -> Column:
    return _named(PLATFORMS, F.lower(platform), F.coalesce(platform, F.lit("")))


def type_option(value: Column, amount: Column) -> Column:
    """A type's name with how often it occurs, thousands apart."""
    return F.concat(_named(TYPES, value, value), F.lit("（"), F.format_number(amount, 0), F.lit("）"))


def identity_line(platform: Column, number: Column, native_id: Column, label: Column) -> Column:
    """Platform, account label and id; the number stands for the id on the platform that has numbers."""
    shown = F.when(platform == "qq", F.coalesce(number, native_id)).otherwise(native_id)
    named = F.concat(platform_label(platform), F.lit(" "), label, F.lit(" ("), shown, F.lit(")"))
    return F.when(_filled(label).isNotNull(), named).otherwise(F.concat(platform_label(platform), F.lit(" "), shown))


def initials(name: Column) -> Column:
    """The first character of a name; a question mark without one."""
    return F.coalesce(F.left(_filled(name), F.lit(1)), F.lit("?"))


def sender_line(name: Column, badge: Column) -> Column:
    """A name with its account badge behind it; empty without a name."""
    return F.coalesce(F.concat(_filled(name), F.coalesce(F.concat(F.lit(" · "), _filled(badge)), F.lit(""))), F.lit(""))


def _shown(ms: Column) -> Column:
    return F.timestamp_millis(F.least(F.greatest(ms, F.lit(0)), F.lit(LATEST_MS)))


def date_text(ms: Column) -> Column:
    """Year, month, day and weekday of a time in the session's zone."""
    at = _shown(ms)
    weekday = F.element_at(F.lit(list(WEEKDAYS)), F.dayofweek(at))
    return F.concat(F.year(at).cast("string"), F.lit("年"), F.month(at).cast("string"), F.lit("月"), F.dayofmonth(at).cast("string"), F.lit("日 "), weekday)


def clock_text(ms: Column) -> Column:
    return F.date_format(_shown(ms), "HH:mm:ss")


def parse_filter_tag(tag: str | None) -> tuple[str | None, str | None]:
    """(platform, kind) of a ``platform|kind`` tag; nothing for any other shape."""
    parts = [p.strip().lower() for p in (tag or "").split("|")]
    return (parts[0], parts[1]) if len(parts) == 2 and all(parts) else (None, None)
