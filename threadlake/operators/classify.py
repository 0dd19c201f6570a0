"""Message types, directions and sender names of the export formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions import text as T

# The codes and labels of the formats.
INTEGER_TYPES = {0: "text", 1: "image", 2: "audio", 3: "video", 4: "file", 5: "emoji", 7: "link", 8: "location", 23: "call", 24: "mini_program", 25: "reply", 27: "contact", 80: "system", 99: "other"}
LOCAL_TYPES = {1: "text", 3: "image", 34: "audio", 43: "video", 47: "emoji", 48: "location", 2000: "transfer", 2001: "transfer", 419430449: "transfer", 10000: "system", 10002: "system"}
LABELS = {
    "文本消息": "text", "text": "text", "图片消息": "image", "image": "image", "文件消息": "file", "file": "file", "视频消息": "video", "video": "video", "语音消息": "audio", "audio": "audio", "voice": "audio",
    "动画表情": "emoji", "表情消息": "emoji", "emoji": "emoji", "引用消息": "reply", "reply": "reply", "系统消息": "system", "system": "system", "小程序消息": "mini_program", "mini_program": "mini_program",
    "聊天记录": "forward", "forward": "forward", "转账消息": "transfer", "微信转账": "transfer", "微信红包": "transfer", "红包消息": "transfer", "transfer": "transfer", "链接消息": "link", "link": "link",
    "通话消息": "call", "call": "call", "位置消息": "location", "location": "location", "名片消息": "contact", "contact": "contact", "群公告": "system", "其他消息": "other", "other": "other",
}
BRACKETS = {
    "[图片]": "image", "[文件]": "file", "[视频]": "video", "[语音]": "audio", "[表情包]": "emoji", "[动画表情]": "emoji", "[转账]": "transfer", "[微信转账]": "transfer", "[微信红包]": "transfer",
    "[位置]": "location", "[名片]": "contact", "[链接]": "link", "[小程序]": "mini_program", "[通话]": "call",
}
#: Of one format's labels those it maps, its media labels, and the codes and prefixes that its first version knew.
WEFLOW_LABELS = {
    "文本消息": "text", "图片消息": "image", "文件消息": "file", "视频消息": "video", "语音消息": "audio", "动画表情": "emoji", "引用消息": "reply", "系统消息": "system", "小程序消息": "mini_program", "聊天记录": "forward",
    "转账消息": "transfer", "链接消息": "link", "通话消息": "call", "位置消息": "location", "名片消息": "contact", "群公告": "system", "其他消息": "other",
}
WEFLOW_MEDIA = {"图片消息": "image", "文件消息": "file", "视频消息": "video", "语音消息": "voice", "动画表情": "emoji"}
WEFLOW_CODES = {1: "text", 3: "image", 34: "audio", 43: "video", 47: "emoji", 48: "location", 10000: "system"}
WEFLOW_BRACKETS = {"[图片]": "image", "[文件]": "file", "[视频]": "video", "[语音]": "audio", "[表情包]": "emoji", "[转账]": "transfer", "[位置]": "location"}
CSV_TYPES = {"image": "image", "sticker": "emoji", "video": "video", "voice": "audio", "location": "location", "file": "file"}
SHEET_WORDS = {"图片": "image", "语音": "audio", "视频": "video", "表情": "emoji", "文件": "file", "位置": "location", "系统": "system"}
SELF_NAME, RECALL = "我", "撤回"


def _look_up(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def bracket_type(content: Column, brackets: dict[str, str] = BRACKETS) -> Column:
    """The type that a bracketed label at the start of the text names, else null."""
    out = F.lit(None).cast("string")
    for prefix, kind in reversed(brackets.items()):
        out = F.when(content.startswith(prefix), kind).otherwise(out)
    return out


def message_type(integer: Column | None, local: Column | None, label: Column | None, content: Column) -> Column:
    """By integer code, then local code, then label, then bracketed prefix, else other."""
    known = []
    if integer is not None:
        known.append(_look_up(INTEGER_TYPES, T.as_long(integer).cast("int")))
    if local is not None:
        known.append(_look_up(LOCAL_TYPES, T.as_long(local).cast("int")))
    if label is not None:
        known.append(_look_up(LABELS, F.lower(T.clean(label))))
    return F.coalesce(*known, bracket_type(content), F.lit("other"))


def media_first_type(media: Column, local: Column, label: Column, content: Column) -> Column:
    """By label, then media type (voice is audio), then local code, then bracketed prefix, else other."""
    m = F.lower(T.clean(media))
    by_media = F.when(m == "voice", "audio").when(F.length(m) > 0, m)
    return F.coalesce(_look_up(LABELS, F.lower(T.clean(label))), by_media, _look_up(LOCAL_TYPES, T.as_long(local).cast("int")), bracket_type(content), F.lit("other"))


def weflow_media(label: Column) -> Column:
    return _look_up(WEFLOW_MEDIA, label)


def weflow_label(label: Column) -> Column:
    return _look_up(WEFLOW_LABELS, label)


def weflow_type(media: Column, local: Column, content: Column) -> Column:
    """By media type (voice is audio), then local code, then bracketed prefix, else other."""
    return F.coalesce(F.when(media == "voice", "audio").otherwise(media), _look_up(WEFLOW_CODES, T.as_long(local).cast("int")), bracket_type(content, WEFLOW_BRACKETS), F.lit("other"))


def csv_type(name: Column) -> Column:
    return F.coalesce(_look_up(CSV_TYPES, F.lower(F.trim(name))), F.lit("text"))


def sheet_type(name: Column) -> Column:
    """By the first of the known words that a sheet's type cell contains, else text."""
    out = F.lit("text")
    for word, kind in reversed(SHEET_WORDS.items()):
        out = F.when(F.contains(name, F.lit(word)), kind).otherwise(out)
    return out


def direction(kind: Column, is_self: Column) -> Column:
    """System messages are nobody's; others go out if they are one's own."""
    return F.when(kind == "system", "system").when(F.coalesce(is_self, F.lit(False)), "outgoing").otherwise("incoming")


def recalled(kind: Column, content: Column, flag: Column | None = None) -> Column:
    by_text = (kind == "system") & F.contains(F.coalesce(content, F.lit("")), F.lit(RECALL))
    return by_text if flag is None else by_text | F.coalesce(flag, F.lit(False))


def media_kind(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(k == "voice", "audio").when(k == "sticker", "emoji").otherwise(k)
