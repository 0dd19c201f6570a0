"""Values, type names and import conditions as registered queries: every branch has rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import payloads as P
from threadlake.functions import text as T
from threadlake.operators import classify as K
from threadlake.operators import dedup as D
from threadlake.plans.registry import query
from threadlake.sources.lens import Lens


def _events(x: Lens, *values: str | None) -> DataFrame:
    """Events with a column ``v`` that takes the values in turn."""
    shown = F.lit(None).cast("string")
    for k, v in enumerate(values):
        shown = F.when(F.col("event_id") % len(values) == k, F.lit(v)).otherwise(shown)
    return x.raw("events").select(F.col("event_id").alias("id"), "props", "value", "user_id", shown.alias("v"))


def _case(*results: str) -> str:
    return f"CASE event_id % {len(results)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(results)) + " END"


@query("t02_raw_text", "SELECT event_id AS id, coalesce(json_extract_string(props, '$.k'), '') AS k, '' AS none FROM events")
def raw_text(x: Lens) -> DataFrame:
    return x.raw("events").select(F.col("event_id").alias("id"), T.raw_text(F.col("props"), "k").alias("k"), T.raw_text(F.col("props"), "missing").alias("none"))


@query("t03_first_non_empty", f"SELECT event_id AS id, {_case("'a'", "'user'", "'user'")} AS first FROM events")
def first_non_empty(x: Lens) -> DataFrame:
    return _events(x, "a", "", None).select("id", T.first_non_empty(F.col("v"), F.lit(None).cast("string"), F.lit("user")).alias("first"))


@query("t05_local_type", f"SELECT event_id AS id, {_case("'None'", "'True'", "'False'", "'12'", "'x y'", "'None'")} AS code FROM events")
def local_type(x: Lens) -> DataFrame:
    return _events(x, "null", "true", "false", "12", '"x y"', None).select("id", T.local_type_text(F.col("v")).alias("code"))


@query("t07_safe_title", "SELECT p_partkey AS id, trim(regexp_replace(p_name || ' a/b:c?' || p_brand, '[:/?#]', '', 'g')) AS title FROM part".replace("[:/?#]", "[:/?]"))
def safe_title(x: Lens) -> DataFrame:
    return x.raw("part").select(F.col("p_partkey").alias("id"), T.safe_title(F.concat("p_name", F.lit(" a/b:c?"), "p_brand")).alias("title"))


@query("t12_markdown_text", "SELECT conv_id, turn, 'see label p.png' || chr(10) || text AS shown FROM conversations")
def markdown_text(x: Lens) -> DataFrame:
    quoted = F.concat(F.lit("> see [label](http://x) ![](p.png)\n> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))
    return x.raw("conversations").select("conv_id", "turn", T.markdown_text(quoted).alias("shown"))


@query("d04_sheet_seconds", f"SELECT event_id AS id, {_case('1704153600500', '1704153600000', '1704153600000', 'NULL', '1')}::BIGINT AS ms FROM events")
def sheet_seconds(x: Lens) -> DataFrame:
    return _events(x, "1704153600.5009", "1704153600", "2024-01-02", "soon", "0.0019").select("id", T.sheet_seconds(F.col("v")).alias("ms"))


@query("n02_as_double", f"SELECT event_id AS id, {_case('1.5', '-2', 'NULL', '1000')}::DOUBLE AS number FROM events")
def as_double(x: Lens) -> DataFrame:
    return _events(x, "1.5", "-2", "x", "1e3").select("id", T.as_double(F.col("v")).alias("number"))


@query("n04_clamp_int", f"SELECT event_id AS id, {_case('5', '2147483647', '-2147483648', 'NULL')}::INTEGER AS width FROM events")
def clamp_int(x: Lens) -> DataFrame:
    return _events(x, "5.9", "99999999999", "-99999999999", "wide").select("id", T.clamp_int(F.col("v")).alias("width"))


@query("n06_sheet_size", f"SELECT event_id AS id, {_case('12', '0', 'NULL', 'NULL', 'NULL', 'NULL')}::BIGINT AS size, event_id % 6 IN (2, 3, 4) AS bad FROM events")
def sheet_size(x: Lens) -> DataFrame:
    return _events(x, "12.9", " 0 ", "-1", "9223372036854775808", "big", "").select("id", T.sheet_size(F.col("v")).alias("s")).select("id", "s.size", "s.bad")


@query("c02_local_types", f"SELECT event_id AS id, {_case("'image'", "'transfer'", "'system'", "'forward'", "'location'", "'other'")} AS kind FROM events")
def local_types(x: Lens) -> DataFrame:
    rows = _events(x, "3||", "419430449||", "10000|聊天记录|", "77|聊天记录|[位置] x", "||[位置] x", "77|no|plain").withColumn("p", F.split("v", r"\|"))
    return rows.select("id", K.message_type(None, F.col("p")[0], F.col("p")[1], F.col("p")[2]).alias("kind"))


@query("c06_sheet_words", f"SELECT event_id AS id, {_case("'image'", "'audio'", "'video'", "'emoji'", "'file'", "'location'", "'system'", "'text'")} AS kind FROM events")
def sheet_words(x: Lens) -> DataFrame:
    return _events(x, "图片消息", "语音消息", "视频消息", "动画表情", "文件消息", "位置消息", "系统消息", "文本消息").select("id", K.sheet_type(F.col("v")).alias("kind"))


@query("c09_media_kind", f"SELECT event_id AS id, {_case("'audio'", "'emoji'", "'image'", "''")} AS kind FROM events")
def media_kind(x: Lens) -> DataFrame:
    return _events(x, "Voice", "sticker", "IMAGE", None).select("id", K.media_kind(F.col("v")).alias("kind"))


@query("c11_recalled", "SELECT event_id AS id, event_id % 4 IN (0, 3) AS recalled FROM events")
def recalled(x: Lens) -> DataFrame:
    rows = _events(x, "system", "system", "text", "text")
    content, flag = F.when(F.col("id") % 4 == 1, "joined").otherwise("x 撤回了一条消息"), F.col("id") % 4 == 3
    return rows.select("id", K.recalled(F.col("v"), content, flag).alias("recalled"))


@query(
    "u10_reimport_conditions",
    """SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 8 NOT IN (1, 2) OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND o_orderkey % 8 = 2 AND (l_linenumber = 3 OR l_quantity > 45 OR l_returnflag = 'A'))""",
)
def reimport_conditions(x: Lens) -> DataFrame:
    # By the id modulo 8: known and whole; known, with attachments that may lack something; unknown; unfinished; an older parser; missing media; others unknown.
    k = F.col("o_orderkey") % 8
    files = x.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("sha256"))
    ledger = x.raw("orders").filter(k.isin(1, 2, 4, 5, 6)).select(
        F.col("o_orderkey").cast("string").alias("sha256"), F.when(k == 4, "running").otherwise("completed").alias("status"), F.when(k == 5, 4).otherwise(5).alias("parser_version"), F.when(k == 6, 1).otherwise(0).alias("missing_media")
    )
    lines = x.raw("lineitem").filter("l_orderkey % 8 = 2").select(
        F.col("l_orderkey").cast("string").alias("sha256"), (F.col("l_linenumber") != 3).alias("is_available"), F.when(F.col("l_quantity") <= 45, "a.jpg").alias("source_path"), (F.col("l_returnflag") != "A").alias("resolves")
    )
    return D.reimport_needed(files, ledger, attachments=lines).select("id")


@query("j14_observed", "SELECT l_orderkey AS message_id, l_linenumber AS place, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') AS attached FROM lineitem")
def observed(x: Lens) -> DataFrame:
    seen = x.raw("lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("place"))
    has = x.raw("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("message_id"))
    return D.observed(seen, has, True).withColumn("attached", F.lit(True)).unionByName(D.observed(seen, has, False).withColumn("attached", F.lit(False)))


CONTENTS = (
    '{"resources":[{"type":"voice","filename":"a.amr","localPath":"x/a.amr","duration":"1.5"},{"mediaType":"Video","url":"u.mp4","size":9}]}',
    '{"type":"voice","resources":[{"name":"b.png","width":99999999999,"md5":"m"}]}',
    '{"resources":[{"filename":"c.PNG"},{"filename":"d.bin"}]}',
    '{"resources":[],"elements":[{"type":"text","data":{"t":"x"}},{"type":"Image","data":{"url":"e.gif"}}]}',
    '{"text":"none"}',
)


@query(
    "h10_attachments",
    """SELECT event_id AS id, a.* FROM events JOIN (VALUES (0, 0::BIGINT, 'audio', 'a.amr', 'x/a.amr', 'audio/amr', NULL::BIGINT, NULL::INTEGER, 1.5::DOUBLE, '{"duration":"1.5"}'), (0, 1, 'video', NULL, 'u.mp4', 'video/mp4', 9, NULL, NULL, '{"mediaType":"Video","size":"9"}'),
 (1, 0, 'audio', 'b.png', NULL, 'image/png', NULL, 2147483647, NULL, '{"width":"99999999999","md5":"m"}'), (2, 0, 'image', 'c.PNG', NULL, 'image/png', NULL, NULL, NULL, '{}'), (2, 1, 'file', 'd.bin', NULL, NULL, NULL, NULL, NULL, '{}'),
 (3, 0, 'image', NULL, 'e.gif', 'image/gif', NULL, NULL, NULL, '{}')) v(k, ordinal, kind, filename, declared, mime, size, width, duration, metadata) ON event_id % 5 = k CROSS JOIN LATERAL (SELECT ordinal, kind, filename, declared, mime, size, width, duration, metadata) a""",
)
def attachments(x: Lens) -> DataFrame:
    found = _events(x, *CONTENTS).select("id", F.explode(P.qq_attachments(F.col("v"))).alias("a"))
    return found.select("id", *(f"a.{c}" for c in ("ordinal", "kind", "filename", "declared", "mime", "size", "width", "duration", "metadata")))
