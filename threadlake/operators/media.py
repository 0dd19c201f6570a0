"""Media of messages: the paths that may name them, and the files that do.

Each message's candidate paths are kept in order. Resolving explodes them, with
every folder in which an export keeps media, into (candidate, place) pairs,
joins these to a listing of files, and keeps the first hit by ``min_by``: one
shuffle of the media messages only, and no look at the file system by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.operators.classify import BRACKETS

#: Folders beside an export that its paths may climb to, where a format allows it.
SHARED = ("images", "voices", "videos", "emojis", "file")
#: Types of messages that are media.
MEDIA = ("image", "file", "video", "audio", "voice", "emoji", "sticker")
FILE_LABEL = "[文件]"
WEB = "(?i)^https?://"


def _slashes(x: Column) -> Column:
    return F.replace(x, F.lit("\\"), F.lit("/"))


def _name(path: Column) -> Column:
    return F.regexp_extract(_slashes(path), "([^/]*)$", 1)


def named_file(content: Column) -> Column:
    """The bare name of a file that a message names after its label, else null: no folders, drives or dots only, and an extension of letters and digits."""
    named = F.trim(F.regexp_replace(unescaped(F.regexp_replace(content, rf"^\Q{FILE_LABEL}\E", "")), "^\\s+|\\s+$", ""))
    return F.when(named.rlike(r"^[^/\\:]*\.[A-Za-z0-9]+$") & ~named.isin(".", ".."), named)


#: Entities that file names are escaped with.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescaped(x: Column) -> Column:
    for entity, plain in ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return x


def in_files(name: Column) -> Column:
    """Where exports keep a file of this name: by its extension."""
    return F.concat(F.lit("media/files/"), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)), F.lit("/"), name)


#: Any of the labels at the start of a text.
LABELLED = "^(?:" + "|".join(rf"\Q{label}\E" for label in BRACKETS) + ")"


def candidates(kind: Column, content: Column, raw: Column, given: list[Column]) -> Column:
    """The paths that may name a message's medium, in order: its path fields, what follows a bracketed label, a content that is a path; a file's own place comes first."""
    after = [F.when(text.rlike(LABELLED), F.regexp_replace(text, LABELLED, "")) for text in (content, raw)]
    pathlike = [F.when(kind.isin("image", "audio", "video", "file", "emoji") & text.rlike(r"[/\\]"), text) for text in (content, raw)]
    own = F.when(kind == "file", in_files(named_file(content)))
    cleaned = F.transform(F.array(own, *given, *after, *pathlike), T.clean)
    return F.array_distinct(F.filter(cleaned, lambda x: (x != "") & ~x.rlike(WEB)))


def _attachment(kind: Column, filename: Column, declared: Column, paths: Column, size=None, width=None, height=None, duration=None) -> Column:
    none = lambda x, t: F.lit(None).cast(t) if x is None else x
    return F.struct(
        F.lit(0).cast("bigint").alias("ordinal"), kind.alias("kind"), filename.alias("filename"), declared.alias("declared"), paths.alias("candidates"), T.guess_mime(F.coalesce(filename, declared)).alias("mime"),
        none(size, "bigint").alias("size"), none(width, "int").alias("width"), none(height, "int").alias("height"), none(duration, "double").alias("duration"), F.lit("{}").alias("metadata"),
    )


def weflow_attachment(label: Column, media: Column, content: Column, kind: Column) -> Column:
    """The one attachment of a message that names a file or holds a media path, else an empty array."""
    labelled = (label == "文件消息") & content.startswith(FILE_LABEL)
    name = named_file(content)
    path = media.isNotNull() & content.rlike(r"[/\\]") & ~content.rlike(WEB)
    declared = F.when(labelled, F.coalesce(in_files(name), content)).otherwise(content)
    filename = F.when(labelled, name).otherwise(F.when(F.length(_name(content)) > 0, _name(content)))
    paths = F.when(labelled & name.isNull(), F.array().cast("array<string>")).otherwise(F.array(declared))
    one = F.array(_attachment(F.when(kind != "other", kind).otherwise("file"), filename, declared, paths))
    return F.when(F.coalesce(labelled | path, F.lit(False)), one).otherwise(F.slice(one, 1, 0))


def lab_attachment(kind: Column, paths: Column, size: Column, width: Column, height: Column, duration: Column) -> Column:
    """One attachment that stands only if one of its candidates is found."""
    first = _slashes(F.get(paths, 0))
    one = F.array(_attachment(F.when(kind.isin("other", "text"), "file").otherwise(kind), _name(first), first, paths, size, width, height, duration))
    return F.when(F.size(paths) > 0, one).otherwise(F.slice(one, 1, 0))


def _joined(segments: Column) -> Column:
    return F.array_join(segments, "/")


def places(candidate: Column, folder: Column, title: Column, climbs: Column) -> Column:
    """Full paths at which a declared path of an export in ``folder`` may lie, in order; none for what is unsafe.

    Below the export, its ``resources`` and its ``media``; then in the shared media of the session, beside the export.
    Paths with a root, a drive or a scheme are refused, as are those that climb, but for one step into a shared media
    folder where ``climbs``.
    """
    path = _slashes(candidate)
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    unsafe = F.coalesce(F.length(F.trim(path)) == 0, F.lit(True)) | path.rlike(r"^/|^[A-Za-z][A-Za-z0-9+.-]*:|\x00")
    above = F.regexp_replace(folder, "/[^/]*$", "")
    session = T.safe_title(title)
    below = _joined(parts)
    usual = F.array(*(F.concat(folder, F.lit(sub), below) for sub in ("/", "/resources/", "/media/")), F.when(F.length(session) > 0, F.concat(above, F.lit("/media/"), session, F.lit("/"), below)))
    raw_parts = F.split(path, "/")
    step = climbs & (F.size(raw_parts) >= 3) & (F.get(raw_parts, 0) == "..") & F.lower(F.get(raw_parts, 1)).isin(*SHARED) & ~F.exists(F.slice(raw_parts, 3, F.greatest(F.size(raw_parts), F.lit(3))), lambda p: p.isin("", ".", ".."))
    none = F.array().cast("array<string>")
    found = F.when(unsafe, none).when(F.startswith(path, F.lit("../")), F.when(step, F.array(F.concat(above, F.substr(path, F.lit(3))))).otherwise(none)).when(F.array_contains(raw_parts, ".."), none).otherwise(usual)
    return F.filter(found, lambda p: p.isNotNull())


def resolve(messages: DataFrame, listing: DataFrame, key: tuple[str, ...] = ("path", "position")) -> DataFrame:
    """``messages`` whose attachments also say ``source`` (a full path) and ``exists``, by a ``listing`` of files (path).

    The first candidate that lies in a listed place is taken. Where none does, the export's own place for the first safe
    candidate is the source, for formats that declare attachments; of the others (family lab) the attachment goes. The
    facts take the name of the first attachment's source; digests are not made again here.
    """
    folder = F.regexp_replace(F.col("path"), "/[^/]*$", "")
    each = messages.select(*key, folder.alias("folder"), "title", (F.col("facts.family") == "wechat").alias("climbs"), F.explode("attachments").alias("a")).select(*key, "folder", "title", "climbs", "a.ordinal", F.posexplode("a.candidates").alias("nth", "candidate"))
    each = each.select(*key, "ordinal", "nth", "candidate", F.posexplode(places(F.col("candidate"), F.col("folder"), F.col("title"), F.col("climbs"))).alias("at", "place"))
    files = listing.select(F.col("path").alias("place"), F.lit(True).alias("there")).distinct()
    tried = each.join(files, "place", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    found = tried.groupBy(*key, "ordinal").agg(F.min_by(F.struct("there", "place", "candidate"), F.struct((~F.col("there")).alias("missing"), "nth", "at")).alias("hit"))
    by_message = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "hit"))).alias("_hits"))

    def placed(a: Column) -> Column:
        hit = F.try_element_at(F.col("_hits"), a["ordinal"])
        there = F.coalesce(hit["there"], F.lit(False))
        return F.struct(*(a[c].alias(c) for c in ("ordinal", "kind", "filename", "declared", "mime", "size", "width", "height", "duration", "metadata")), hit["place"].alias("source"), there.alias("exists"), hit["candidate"].alias("candidate"))

    joined = messages.join(by_message, list(key), "left")
    lab = F.col("facts.family") == "lab"
    kept = F.filter(F.transform("attachments", placed), lambda a: ~lab | a["exists"])
    named = F.transform(kept, lambda a: F.when(lab, a.withField("declared", _slashes(a["candidate"])).withField("filename", _name(a["candidate"])).withField("mime", T.guess_mime(a["source"]))).otherwise(a).dropFields("candidate"))
    out = joined.withColumn("attachments", F.coalesce(named, F.slice(named, 1, 0)))
    first = F.get(F.col("attachments"), 0)
    name = F.when(F.length(_name(first["source"])) > 0, _name(first["source"]))
    media = F.when(lab & first.isNotNull(), F.when(F.col("message_type").isin("other", "text"), "file").otherwise(F.col("message_type"))).otherwise(F.col("facts.media_type"))
    facts = F.when(F.col("facts.family").isin("wechat", "lab"), F.col("facts").withField("media_name", name).withField("media_type", media)).otherwise(F.col("facts"))
    return out.withColumn("facts", facts).drop("_hits")


def with_missing(messages: DataFrame) -> DataFrame:
    """A media message without any attachment gets one that is not there, so that it shows as missing and is looked for again."""
    kind = F.lower(T.clean(F.col("message_type")))
    kind = F.when(kind.isin("audio", "voice"), "audio").when(kind.isin("emoji", "sticker"), "emoji").when(kind.isin("image", "file", "video"), kind)
    empty = F.coalesce(F.size("attachments"), F.lit(0)) <= 0
    none = lambda t: F.lit(None).cast(t)
    one = F.array(F.struct(
        F.lit(0).cast("bigint").alias("ordinal"), kind.alias("kind"), *(none("string").alias(c) for c in ("filename", "declared", "mime")), none("bigint").alias("size"), none("int").alias("width"), none("int").alias("height"), none("double").alias("duration"),
        F.lit("{}").alias("metadata"), none("string").alias("source"), F.lit(False).alias("exists"),
    ))
    return messages.withColumn("attachments", F.when(empty & kind.isNotNull(), one).otherwise(F.col("attachments")))
