"""Readings of nested payloads as column expressions: XML summaries, texts within JSON of any depth, attachments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions import hashing as X
from threadlake.functions import text as T

#: What a summary shows for each kind of message.
UNKNOWN = "[微信 XML 消息]"
#: The fields whose texts are searched.
SEARCHED = ("text", "content", "summary", "title", "filename", "fileName", "senderName")


#: Where the texts of a summary stand in an XML message.
XML_FIELDS = {
    **{k: f"(/*//wcpayinfo)[1]/{k}[1]" for k in ("scenetext", "receivertitle", "sendertitle", "receiverdes", "senderdes")}, **{k: f"/*/@{k}" for k in ("username", "nickname", "openimdesc")},
    "who": "(/*//finderFeed)[1]/nickname[1]", "about": "(/*//finderFeed)[1]/desc[1]", "type": "(/*//appmsg)[1]/type[1]", "title": "(/*//appmsg)[1]/title[1]", "des": "(/*//appmsg)[1]/des[1]",
}


def xml_summary(content: Column) -> Column:
    """struct<summary, kind, search> of a message that is XML: payments, cards, channel videos, shares; null where the content is no XML.

    Texts that are not well-formed, or declare a document type, are XML of an unknown kind; XPath only sees the others.
    """
    return T.let(F.regexp_replace(content, r"^\s+", ""), lambda text: F.when(text.startswith("<?xml") | text.startswith("<msg"), _summary(text)))


def _result(summary: Column, kind: str, *search: Column) -> Column:
    return F.struct(summary.alias("summary"), F.lit(kind).alias("kind"), F.array_join(F.filter(F.array(F.lit(""), *search), lambda x: x != ""), "\n").alias("search"))


def _summary(text: Column) -> Column:
    broken = F.from_xml(text, "x string, _corrupt_record string", {"mode": "PERMISSIVE"})["_corrupt_record"].isNotNull() | F.contains(text, F.lit("<!DOCTYPE"))
    # One XPath gives all fields, so that a text is parsed once; no XML has the letter between them.
    names = ("wcpayinfo", "finderFeed", "appmsg")
    whole = F.xpath_string(text, F.lit("concat(" + ", '\u0001', ".join([*XML_FIELDS.values(), *(f"boolean(/*//{name})" for name in names)]) + ")"))
    fields = lambda v: F.struct(*(T.clean(F.get(v, k)).alias(name) for k, name in enumerate(XML_FIELDS)), *((F.get(v, len(XML_FIELDS) + k) == "true").alias(name) for k, name in enumerate(names)))
    return F.when(broken, _result(F.lit(UNKNOWN), "other")).otherwise(T.let(T.let(F.split(whole, "\u0001"), fields), _told))


def _told(x: Column) -> Column:
    lead = lambda mark, v: F.when(v != "", F.concat(F.lit(mark), v)).otherwise("")
    scene, title, detail = T.pick(x["scenetext"], F.lit("微信收款")), T.pick(x["receivertitle"], x["sendertitle"]), T.pick(x["receiverdes"], x["senderdes"])
    payment = _result(F.concat(F.lit("["), scene, F.lit("]"), lead(" ", title), lead(" - ", detail)), "transfer", scene, title, detail)
    user, name, company = x["username"], x["nickname"], x["openimdesc"]
    label = F.when((company != "") | user.endswith("@openim"), "企业微信名片").otherwise("微信名片")
    shown = F.concat(T.pick(name, user, F.lit("未命名联系人")), F.when(company != "", F.concat(F.lit("（"), company, F.lit("）"))).otherwise(""))
    card = _result(F.concat(F.lit("["), label, F.lit("] "), shown), "contact", name, company, user)
    video = _result(F.concat(F.lit("[视频号]"), lead(" ", x["who"]), lead("\n", x["about"])), "video", x["who"], x["about"])
    head, des = x["title"], x["des"]
    share = _result(F.concat(F.lit("[微信分享] "), T.pick(head, des), F.when((head != "") & (des != "") & (des != head), F.concat(F.lit(" - "), des)).otherwise("")), "link", head, des)
    sticker = x["appmsg"] & (x["type"] == "8")
    return (
        F.when(x["wcpayinfo"], payment).when((user != "") | (name != "") | (company != ""), card).when(x["finderFeed"], video).when(sticker, _result(F.lit("[动画表情]"), "emoji")).when((head != "") | (des != ""), share)
        .otherwise(_result(F.lit(UNKNOWN), "other"))
    )


#: A JSON string; a scalar; and a member of a searched field with a scalar or a list of scalars. Within a string no quote stands without a backslash, so only keys match.
STRING = r'"(?:[^"\\]|\\.)*+"'
SCALAR = rf"(?:{STRING}|-?[0-9][-+.eE0-9]*|true|false|null)"
MEMBER = rf'(?s)"(?:{"|".join(SEARCHED)})"\s*+:\s*+(?:{SCALAR}|\[\s*+(?:{SCALAR}\s*+,?\s*+)++\])'


def json_texts(payload: Column) -> Column:
    """The texts under searched fields of a JSON payload of any depth, in its order, each once, in lines; empty for broken JSON.

    Links and inline images are left out; numbers count as they are written, true and false by name.
    """
    members = F.regexp_extract_all(F.when(F.try_parse_json(payload).isNotNull(), payload), F.lit(MEMBER), F.lit(0))
    values = F.flatten(F.transform(members, lambda m: F.regexp_extract_all(F.regexp_replace(m, rf"(?s)^{STRING}\s*+:", ""), F.lit(rf"(?s){SCALAR}"), F.lit(0))))

    def plain(v: Column) -> Column:
        quoted = F.get(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), 0)
        return T.clean(F.when(v.startswith('"'), quoted).when(v == "true", "True").when(v == "false", "False").when(v == "null", "").otherwise(v))

    kept = F.filter(F.transform(values, plain), lambda t: (t != "") & ~t.rlike("^(?:https?://|data:image/)"))
    return F.coalesce(F.array_join(F.array_distinct(kept), "\n"), F.lit(""))


def title_from_path(path: Column, fallback: Column) -> Column:
    """A conversation's title from its export's folder: prefixes and date suffixes removed."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")
    bare = F.regexp_replace(F.regexp_replace(F.when(folder != "", folder).otherwise(stem), "^(?:私聊|群聊)[_-]", ""), r"_(?:全部时间|\d{4}.*)$", "")
    return T.first_non_empty(bare, fallback)


def without_sender_prefix(content: Column, sender: Column) -> Column:
    """The text without the ``sender:`` that some gateways put before it."""
    prefix = F.concat(sender, F.lit(":"))
    return F.when(sender.endswith("@openim") & content.startswith(prefix), F.ltrim(F.substr(content, F.length(prefix) + 1))).otherwise(content)


MEDIA_ELEMENTS = ("image", "video", "audio", "file", "voice")
#: Fields of a resource that are columns of their own.
OWN_FIELDS = ("url", "localPath", "filename", "name", "type")


def qq_attachments(content: Column) -> Column:
    """array<struct<ordinal, kind, filename, declared, local, mime, size, width, height, duration, metadata>> of a message's content in JSON.

    Its resources, or without any the media elements. The kind is the resource's, else the content's, else that of the
    media type, else file.
    """
    field = lambda name, of: F.from_json(F.get_json_object(content, f"$.{name}"), of)
    given = F.coalesce(field("resources", "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    elements = F.coalesce(field("elements", "array<struct<type:string,data:map<string,string>>>"), F.array().cast("array<struct<type:string,data:map<string,string>>>"))
    kind_of = lambda x: F.lower(T.clean(x))
    audio = lambda k: F.when(k == "voice", "audio").otherwise(k)

    def with_type(e: Column) -> Column:
        data = F.coalesce(e["data"], F.create_map().cast("map<string,string>"))
        return F.when(F.try_element_at(data, F.lit("type")).isNotNull(), data).otherwise(F.map_concat(F.map_filter(data, lambda k, _: k != "type"), F.create_map(F.lit("type"), kind_of(e["type"]))))

    media = F.transform(F.filter(elements, lambda e: kind_of(e["type"]).isin(*MEDIA_ELEMENTS)), with_type)
    whole = kind_of(F.get_json_object(content, "$.type"))
    whole = F.when(whole.isin(*MEDIA_ELEMENTS), audio(whole)).otherwise("")

    def one(r: Column, k: Column) -> Column:
        get = lambda *names: T.first_non_empty(*(T.clean(F.try_element_at(r, F.lit(n))) for n in names))
        some = lambda x: F.when(F.length(x) > 0, x)
        filename, declared = some(get("filename", "name")), some(get("url", "localPath"))
        mime = F.coalesce(some(get("mimeType")), T.guess_mime(F.coalesce(filename, declared)))
        by_mime = F.when(mime.rlike("^(image|video|audio)/"), F.regexp_extract(mime, "^([a-z]+)/", 1))
        number = lambda name: F.try_element_at(r, F.lit(name))
        return F.struct(
            k.cast("long").alias("ordinal"), F.coalesce(some(audio(kind_of(F.coalesce(F.try_element_at(r, F.lit("type")), F.try_element_at(r, F.lit("mediaType")))))), some(whole), by_mime, F.lit("file")).alias("kind"),
            filename.alias("filename"), declared.alias("declared"), some(get("localPath")).alias("local"), mime.alias("mime"), T.as_long(number("size")).alias("size"), T.clamp_int(number("width")).alias("width"), T.clamp_int(number("height")).alias("height"),
            T.as_double(number("duration")).alias("duration"), F.to_json(F.map_filter(r, lambda n, _: ~n.isin(*OWN_FIELDS))).alias("metadata"),
        )

    return F.transform(F.when(F.size(given) > 0, given).otherwise(media), one)


def attachments_json(attachments: Column) -> Column:
    """Canonical JSON of attachments (as ``qq_attachments`` gives them) as far as a message's digest sees them."""
    one = lambda a: X.canonical_json(
        {"kind": a["kind"], "filename": a["filename"], "size": a["size"], "width": a["width"], "height": a["height"], "md5": F.when(F.length(md5 := T.clean(F.get_json_object(a["metadata"], "$.md5"))) > 0, md5)},
        {"duration": X.number_text(a["duration"])},
    )
    return F.concat(F.lit("["), F.array_join(F.transform(attachments, one), ","), F.lit("]"))
