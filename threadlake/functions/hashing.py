"""Digests of canonical JSON: keys in order at every depth, nulls kept, no spaces.

A message has one digest of its payload, one of its meaning, and those that
older versions of a reader would have written for it. They are built from one
struct of facts (``FACTS``), each version being the struct with some fields
replaced or left out, so they cost no second reading.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions.text import let

#: What the digests of a message are made of. ``attachments`` is canonical JSON already; ``old_*`` and ``first_*`` are as the two versions before wrote them.
FACTS = (
    "struct<family:string,timestamp_ms:bigint,sender:string,direction:string,local_type:string,media_type:string,message_type:string,content:string,media_name:string,reply_to:string,search_text:string,sequence:string,"
    "recalled:boolean,system:boolean,attachments:string,raw_content:string,old_direction:string,old_type:string,old_search:string,first_sender:string,first_direction:string>"
)
#: Control characters whose escapes Spark writes with capital digits.
CAPITALS = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def json_text(value: Column) -> Column:
    """A value as JSON; escapes of control characters have small digits. Fractions are written by Spark: give those as ``number_text``."""

    def lowered(text: Column) -> Column:
        for digits in CAPITALS:
            # an even number of backslashes before it: the escape is not itself escaped
            text = F.regexp_replace(text, rf"((?:^|[^\\])(?:\\\\)*+)\\u00{digits}", rf"$1\\u00{digits.lower()}")
        return text

    text = F.to_json(value, {"ignoreNullFields": "false"})
    return let(text, lambda t: F.when(t.rlike(r"\\u00[01][A-F]"), lowered(t)).otherwise(t))


def number_text(x: Column) -> Column:
    """A double as the shortest decimal that reads back: whole numbers end in .0, exponents have two digits at least."""
    size, plain = F.abs(x), x.cast("string")
    fixed = F.regexp_replace(plain.cast("decimal(38,18)").cast("string"), "0+$", "")
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\.0E", "E"), r"E(-?)(\d)$", "E$10$2"), r"E(\d)", "E+$1")
    return (
        F.when(F.isnan(x), "NaN").when(size == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity")).when((x == 0) & plain.startswith("-"), "-0.0").when((x == F.floor(x)) & (size < 1e16), F.concat(x.cast("bigint").cast("string"), F.lit(".0")))
        .when((size >= 1e-3) & (size < 1e7), plain).when((size >= 1e-4) & (size < 1e15), fixed).otherwise(F.lower(short))
    )


def canonical_json(fields: dict[str, Column], raw: dict[str, Column] | None = None) -> Column:
    """The fields as one JSON object, keys sorted, nulls kept; those in ``raw`` are JSON already (null: null)."""
    raw = raw or {}
    if not raw:
        return json_text(F.struct(*(fields[k].alias(k) for k in sorted(fields))))
    pieces, now = [], []
    for key in [*sorted({*fields, *raw}), None]:
        if (key is None or key in raw) and now:
            pieces.append(F.regexp_replace(json_text(F.struct(*(fields[k].alias(k) for k in now))), r"^\{|\}$", ""))
            now = []
        if key in raw:
            pieces.append(F.concat(F.lit(f'"{key}":'), F.coalesce(raw[key], F.lit("null"))))
        elif key is not None:
            now.append(key)
    return F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))


def payload_hash(fields: dict[str, Column], raw: dict[str, Column] | None = None) -> Column:
    """SHA-256 in hex of the canonical JSON."""
    return F.sha2(canonical_json(fields, raw), 256)


def _family(facts: Column, family: str) -> tuple[Column, Column, list[Column]]:
    """Payload, meaning and older payloads of one family."""
    f = lambda *names: {n: facts[n] for n in names}
    base, bare = f("timestamp_ms", "sender", "direction"), {"media_name": F.lit(None).cast("string")}
    wechat = base | f("local_type", "media_type", "message_type", "content", "media_name", "search_text") | {"reply_to_native_id": facts["reply_to"]}
    if family == "wechat":
        before = wechat | {"direction": facts["old_direction"], "message_type": facts["old_type"], "content": facts["raw_content"], "search_text": facts["old_search"]}
        first = base | f("local_type", "media_type", "media_name") | {"sender": facts["first_sender"], "direction": facts["first_direction"], "content": facts["raw_content"]}
        return payload_hash(wechat), payload_hash(base | f("local_type")), [payload_hash(x) for x in (first, before, wechat | bare, first | bare)]
    if family == "lab":
        return payload_hash(wechat), payload_hash(base | f("local_type")), [payload_hash(wechat | bare)]
    if family == "qq":
        listed, attached = base | f("message_type", "content", "recalled", "system", "reply_to"), {"attachments": F.coalesce(facts["attachments"], F.lit("[]"))}
        return payload_hash(listed | f("search_text", "sequence"), attached), payload_hash(f("timestamp_ms", "sender", "message_type", "content")), [payload_hash(listed, attached)]
    return payload_hash(base | f("message_type", "content", "search_text")), payload_hash(base), []


FAMILIES = ("wechat", "lab", "qq", "flat")


def digests(facts: Column, families: tuple[str, ...] = FAMILIES) -> Column:
    """struct<payload, semantic, compatible> of a struct of ``FACTS``, by its family: wechat, lab, qq or flat (of which only those in ``families`` occur)."""

    def one(family: str) -> Column:
        payload, meaning, older = _family(facts, family)
        older = F.array(*older) if older else F.array().cast("array<string>")
        plain = F.struct(payload.alias("payload"), meaning.alias("semantic"), older.alias("older"))
        return let(plain, lambda d: F.struct(d["payload"].alias("payload"), d["semantic"].alias("semantic"), F.array_sort(F.array_distinct(F.array_remove(d["older"], d["payload"]))).alias("compatible")))

    out = one(families[-1])
    for family in families[:-1]:
        out = F.when(facts["family"] == family, one(family)).otherwise(out)
    return out


def synthetic_sender(conversation: Column, name: Column) -> Column:
    """A stable id for a sender that an export names but does not number."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    known = F.when(F.length(trimmed) > 0, trimmed).otherwise(F.lit("unknown"))
    return F.concat(F.lit("synthetic:"), F.sha2(F.concat(conversation, F.lit("\u0000"), known), 256))


def file_native_id(path: Column) -> Column:
    """A stable conversation id for a file that carries none."""
    return F.concat(F.lit("file:"), F.sha2(path, 256))
