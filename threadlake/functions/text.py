"""Column helpers for text, numbers and times; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\s\p{Z}\x{85}\x1c-\x1f]+"


def clean(x: Column) -> Column:
    """Without NUL and outer white space (of any script); null becomes empty."""
    return F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\u0000"), F.lit("")), f"^{SPACES}|{SPACES}$", "")


def ascii_fold(x: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.translate(x, ASCII_UPPER, ASCII_LOWER)


def like_escape(text: str | None) -> str:
    """Wildcards of a LIKE pattern taken literally, with ``/`` as the escape."""
    return (text or "").replace("/", "//").replace("%", "/%").replace("_", "/_")


def like(x: Column, needle: str) -> Column:
    """ASCII case-insensitive substring test by LIKE, wildcards taken literally."""
    lower = str.maketrans(ASCII_UPPER, ASCII_LOWER)
    return F.like(ascii_fold(x), F.lit(f"%{like_escape(needle).translate(lower)}%"), F.lit("/"))


def contains_folded(x: Column, needle: str) -> Column:
    """Case-insensitive substring test over all letters."""
    return F.contains(F.lower(x), F.lit(needle.lower()))


def first_non_empty(*xs: Column) -> Column:
    """The first value that is neither null nor empty, else empty."""
    return F.coalesce(*(F.when(F.length(x) > 0, x) for x in xs), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` written once in the plan, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def pick(*xs: Column) -> Column:
    """As ``first_non_empty``, for values that are long expressions: each is written once."""
    return F.coalesce(F.get(F.filter(F.array(*xs), lambda x: F.length(x) > 0), 0), F.lit(""))


def unique_list(*xs: Column) -> Column:
    """Values in order, each once, without null and empty ones."""
    return F.array_distinct(F.filter(F.array(*xs), lambda x: F.coalesce(F.length(x) > 0, F.lit(False))))


def snippet(content: Column, search_text: Column, query: str, width: int = 80, before: int = 20) -> Column:
    """At most ``width`` characters from shortly before the hit; the head of the content without one."""
    q = F.lit(query.lower())
    in_content = F.instr(F.lower(F.coalesce(content, F.lit(""))), q)
    in_search = F.instr(F.lower(F.coalesce(search_text, F.lit(""))), q)
    source = F.when(in_content > 0, content).when(in_search > 0, search_text).otherwise(F.coalesce(content, F.lit("")))
    start = F.greatest(F.lit(0), F.greatest(in_content, F.when(in_content > 0, 0).otherwise(in_search)) - 1 - before)
    cut = F.trim(F.replace(F.substring(source, start + 1, F.lit(width)), F.lit("\n"), F.lit(" ")))
    return F.concat(F.when(start > 0, "…").otherwise(""), cut)


def as_long(x: Column) -> Column:
    """Whole numbers, or numbers cut to whole ones; null for other text."""
    return F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint"))


def as_double(x: Column) -> Column:
    """A number, else null."""
    return x.try_cast("double")


def clamp_int(x: Column) -> Column:
    """Whole numbers held within 32 bits."""
    n = as_long(x)
    return F.when(n.isNotNull(), F.greatest(F.least(n, F.lit(2**31 - 1)), F.lit(-(2**31)))).cast("int")


def sheet_seconds(x: Column) -> Column:
    """Milliseconds of a spreadsheet's decimal seconds, cut to whole ones; other text is read as a time."""
    return F.coalesce((clean(x).try_cast("decimal(28,9)") * 1000).try_cast("bigint"), flexible_timestamp(x))


def sheet_size(x: Column) -> Column:
    """struct(size, bad): a spreadsheet's size cell as whole bytes; an empty one is null, one that is no size is bad."""
    text = clean(x)
    size = F.when(text.try_cast("decimal(38,6)") >= 0, text.try_cast("decimal(38,6)").try_cast("bigint"))
    return F.struct(size.alias("size"), ((text != "") & size.isNull()).alias("bad"))


def raw_text(json: Column, name: str) -> Column:
    """A field of a JSON text: a string without its quotes, other values as JSON, empty if there is none."""
    return F.coalesce(F.get_json_object(json, f"$.{name}"), F.lit(""))


def local_type_text(token: Column) -> Column:
    """A JSON value as a type code: null, true and false by name, strings without quotes."""
    plain = F.when(token.rlike('^".*"$'), F.substr(token, F.lit(2), F.length(token) - 2)).otherwise(token)
    return F.when(token.isNull() | (token == "null"), "None").when(token == "true", "True").when(token == "false", "False").otherwise(plain)


def as_bool(x: Column) -> Column:
    """1, true and yes in any case."""
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes"), F.lit(False))


def seconds_or_millis(t: Column) -> Column:
    """Epoch numbers from 10 000 000 000 on are milliseconds, smaller ones (and all negative ones) seconds; null beyond what a long holds."""
    return F.when(t >= 10_000_000_000, t).otherwise(F.try_multiply(t, F.lit(1000)))


#: The date formats read, years first with one kind of separator; one shape covers each line.
#: yyyy-MM-dd HH:mm:ss[.fff], yyyy-MM-dd HH:mm, yyyy-M-d HH:mm:ss[.fff], yyyy-M-d HH:mm
#: yyyy/MM/dd HH:mm:ss[.fff], yyyy/MM/dd HH:mm, yyyy/M/d HH:mm:ss, yyyy/M/d HH:mm
#: yyyy.MM.dd HH:mm:ss[.fff], yyyy.MM.dd HH:mm, yyyy.M.d HH:mm:ss, yyyy.M.d HH:mm
#: yyyy-MM-ddTHH:mm:ss[.fff] with an offset, with Z or with neither
#: yyyy-MM-dd, yyyy-M-d, yyyy/MM/dd, yyyy/M/d, yyyy.MM.dd, yyyy.M.d, and years, months and days in ideographs
DATE_PARTS = r"^([0-9]{4})(?:-|年)([0-9]{1,2})(?:-|月)([0-9]{1,2})日?|^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})|^([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})"
DATE_SHAPE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?: ?(?:Z|[+-][0-9]{2}:[0-9]{2}))?)?$"
NUMBER_SHAPE = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def flexible_timestamp(x: Column) -> Column:
    """Epoch milliseconds of a date, a time or an epoch number in text; null if it is none of them.

    Eight digits from 19700101 to 20991231 are a day where there is such a day. Other numbers are cut to whole ones
    before they are scaled. The shape decides what a text is read as, so each is parsed once; nothing here can raise.
    """
    t = clean(x)
    number = F.when(t.rlike(NUMBER_SHAPE), as_long(t))
    day = F.when(t.rlike("^[0-9]{8}$") & number.between(19700101, 20991231), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
    plain = F.regexp_replace(t, DATE_PARTS, "$1$4$7-$2$5$8-$3$6$9")
    date = F.when(plain.rlike(DATE_SHAPE), plain.try_cast("timestamp"))
    return F.coalesce(F.unix_millis(day), seconds_or_millis(number), F.unix_millis(date))


def day_bounds(day: Column) -> tuple[Column, Column]:
    """The first millisecond of a day, and of the next one."""
    start = F.to_timestamp(day, "yyyy-MM-dd")
    return F.unix_millis(start), F.unix_millis(F.date_add(start, 1).cast("timestamp"))


#: Media types by file extension.
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "mp4": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo", "mkv": "video/x-matroska",
    "mp3": "audio/mpeg", "wav": "audio/x-wav", "amr": "audio/amr", "pdf": "application/pdf", "txt": "text/plain", "zip": "application/zip",
}


def guess_mime(name: Column) -> Column:
    """The media type of a file name, else null."""
    table = F.create_map(*(F.lit(v) for pair in MIME.items() for v in pair))
    return F.try_element_at(table, F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./\\]+)$", 1)))


def format_bytes(n: Column, gib: bool = True) -> Column:
    """Bytes for people: B, KiB and MiB with one digit, GiB (if wanted) with two."""
    n = n.cast("bigint")

    def shown(unit: int, digits: int) -> Column:
        # C's printf, SQL's too, rounds the exact value, halves to even; Java's rounds halves up. A unit is a power of two, so whole numbers do it.
        bits, scale = unit.bit_length() - 1, 10**digits
        rest = n.bitwiseAND(F.lit(unit - 1)) * scale
        parts, over = F.shiftright(n, bits) * scale + F.shiftright(rest, bits), rest.bitwiseAND(F.lit(unit - 1))
        rounded = parts + F.when((over > unit // 2) | ((over == unit // 2) & (parts % 2 == 1)), 1).otherwise(0)
        return F.concat(F.floor(rounded / scale).cast("string"), F.lit("."), F.lpad((rounded % scale).cast("string"), digits, "0"))

    return (
        F.when(F.lit(gib) & (n >= 1 << 30), F.concat(shown(1 << 30, 2), F.lit(" GiB")))
        .when(n >= 1 << 20, F.concat(shown(1 << 20, 1), F.lit(" MiB")))
        .when(n >= 1 << 10, F.concat(shown(1 << 10, 1), F.lit(" KiB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def markdown_text(x: Column) -> Column:
    """Links become their label (or target), quote marks at line starts go."""
    labels = F.regexp_replace(F.regexp_replace(x, r"!?\[([^\]]+)\]\([^)]*\)", "$1"), r"!?\[\]\(([^)]*)\)", "$1")
    return F.regexp_replace(labels, r"(?m)^>[ ]?", "")


def safe_title(x: Column) -> Column:
    """A title that can name a file; empty for the two directory names."""
    named = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r'[\x00-\x1F<>:"/\\|?*]', ""))
    return F.when(named.isin(".", ".."), "").otherwise(named)
