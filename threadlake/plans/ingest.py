"""Normalisation, hashing, deduplication, upserts and repair as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import hashing as X
from threadlake.functions import payloads as P
from threadlake.functions import text as T
from threadlake.operators import classify as K
from threadlake.operators import dedup as D
from threadlake.operators import store as Z
from threadlake.operators import upsert as U
from threadlake.operators.stats import run_counters as count_runs
from threadlake.plans.registry import query
from threadlake.sources.lens import Lens


@query(
    "u01_dedup_state",
    """SELECT seq, CASE WHEN seq > same THEN 'duplicate' WHEN seq > first THEN 'revision' ELSE 'new' END AS state, CASE WHEN seq > same THEN same WHEN seq > first THEN first END AS target
 FROM (SELECT seq, min(seq) OVER (PARTITION BY conversation_id, native_id, payload_hash) AS same, min(seq) OVER (PARTITION BY conversation_id, native_id) AS first FROM docs)""",
    "docs",
)
def dedup_state(x: Lens) -> DataFrame:
    return D.dedup_state(x.documents())


@query(
    "u01_fold_state",
    """SELECT seq, CASE WHEN seq > same THEN 'duplicate' WHEN seq > first THEN 'revision' ELSE 'new' END AS state, CASE WHEN seq > same THEN same WHEN seq > first THEN first END AS target
 FROM (SELECT seq, min(seq) OVER (PARTITION BY conversation_id, native_id, payload_hash) AS same, min(seq) OVER (PARTITION BY conversation_id, native_id) AS first FROM docs)""",
    "docs",
)
def fold_same_meaning(x: Lens) -> DataFrame:
    rows = x.documents().withColumns({"local_id": F.lit(None).cast("string"), "semantic_hash": F.col("payload_hash"), "compatible": F.lit(None).cast("array<string>")})
    return D.fold_state(rows, platform="qq")


@query(
    "u01_fold_platforms",
    """, r AS (SELECT *, CASE WHEN conversation_id IN ('en', 'fr') THEN 'wechat' ELSE 'qq' END AS platform, substring(payload_hash, 1, 1) AS semantic_hash FROM docs),
 w AS (SELECT *, min(seq) OVER (PARTITION BY conversation_id, native_id, payload_hash) AS same, min(seq) OVER (PARTITION BY conversation_id, native_id) AS first,
  min(seq) OVER (PARTITION BY conversation_id, native_id, semantic_hash) AS meant FROM r)
SELECT seq, CASE WHEN seq > same THEN 'duplicate' WHEN seq = first THEN 'new' WHEN platform = 'qq' OR meant < seq THEN 'revision' ELSE 'variant' END AS state,
 CASE WHEN seq > same THEN same WHEN seq = first THEN NULL WHEN platform = 'qq' THEN first WHEN meant < seq THEN meant END AS target FROM w""".replace(", r AS", "+r AS", 1),
    "docs",
)
def fold_platforms(x: Lens) -> DataFrame:
    platform = F.when(F.col("conversation_id").isin("en", "fr"), "wechat").otherwise("qq")
    rows = x.documents().withColumns({"local_id": F.lit(None).cast("string"), "semantic_hash": F.substring("payload_hash", 1, 1), "compatible": F.lit(None).cast("array<string>"), "platform": platform})
    return D.fold_state(rows)


@query(
    "u01_fold_compatible",
    """, r AS (SELECT seq, conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY seq) - 1 AS k FROM docs),
 g AS (SELECT seq, k % 4 AS step, min(seq) OVER (PARTITION BY conversation_id, k // 4) AS first FROM r)
SELECT seq, CASE step WHEN 0 THEN 'new' WHEN 3 THEN 'revision' ELSE 'duplicate' END AS state, CASE WHEN step > 0 THEN first END AS target FROM g""".replace(", r AS", "+r AS", 1),
    "docs",
)
def fold_compatible(x: Lens) -> DataFrame:
    # Groups of four: a payload, two later ones that name the one before them as compatible, and the first payload again; every other group without a native id.
    k = F.row_number().over(Window.partitionBy("conversation_id").orderBy("seq")) - 1
    rows = x.documents().select("seq", "conversation_id", k.alias("k")).withColumn("g", F.floor(F.col("k") / 4).cast("string"))
    step = F.col("k") % 4
    payload = F.concat("g", F.when(step == 3, "-0").otherwise(F.concat(F.lit("-"), step.cast("string"))))
    older = F.when(step.isin(1, 2), F.array(F.concat("g", F.lit("-"), (step - 1).cast("string"))))
    native = F.when(F.floor(F.col("k") / 4) % 2 == 0, F.col("g"))
    # Without an id the fourth row meets the others by its meaning.
    return D.fold_state(rows.select("seq", "conversation_id", native.alias("native_id"), F.lit(None).cast("string").alias("local_id"), F.concat(F.lit("m"), "g").alias("semantic_hash"), payload.alias("payload_hash"), older.alias("compatible")))


@query("u02_refreshed_rows", "SELECT conversation_id, native_id, min(seq) AS id, arg_min(payload_hash, seq) AS first_payload, arg_max(payload_hash, seq) AS payload_hash FROM docs GROUP BY 1, 2", "docs")
def refreshed_rows(x: Lens) -> DataFrame:
    rows = x.documents().withColumn("first_payload", F.col("payload_hash"))
    return D.refreshed(rows, ["first_payload"], ["payload_hash"], ["conversation_id", "native_id"])


@query("u09_observations", "SELECT DISTINCT l_orderkey::BIGINT AS message_id, l_suppkey::BIGINT AS import_file_id, l_linenumber::VARCHAR AS source_locator FROM lineitem WHERE l_suppkey % 3 <> 0")
def observations(x: Lens) -> DataFrame:
    found = x.raw("lineitem").select(F.col("l_orderkey").cast("bigint").alias("message_id"), F.col("l_suppkey").cast("bigint").alias("import_file_id"), F.col("l_linenumber").cast("string").alias("source_locator"))
    return D.new_observations(found, found.filter("import_file_id % 3 = 0"))


@query(
    "u10_reimport",
    """SELECT seq FROM docs WHERE payload_hash NOT IN (SELECT payload_hash FROM docs WHERE seq % 2 = 0 AND seq % 10 <> 0)""",
    "docs",
)
def reimport(x: Lens) -> DataFrame:
    files = x.documents().select("seq", F.col("payload_hash").alias("sha256"))
    ledger = files.filter("seq % 2 = 0 and seq % 10 <> 0").select("sha256", F.lit("completed").alias("status"), F.lit(5).alias("parser_version"), F.lit(0).alias("missing_media"))
    stale = files.filter("seq % 10 = 0").select("sha256", F.lit("failed").alias("status"), F.lit(5).alias("parser_version"), F.lit(0).alias("missing_media"))
    return D.reimport_needed(files, ledger.unionByName(stale)).select("seq")


@query(
    "u04_sender_upsert",
    """+o AS (SELECT CASE WHEN sender_id % 2 = 0 THEN 'wechat' ELSE 'qq' END AS platform, CASE WHEN sender_id % 5 = 0 THEN 'wechat-default' ELSE 'me' END AS account_id, sender_id::VARCHAR AS native_id,
  CASE WHEN id % 3 = 0 THEN sender_id::VARCHAR WHEN id % 7 = 0 THEN '' ELSE 'n' || id END AS name, id AS seq, timestamp_ms, direction = 'outgoing' AS is_self FROM messages WHERE sender_id % 4 <> 0),
 n AS (SELECT platform, account_id, native_id, min(seq) AS seq, arg_max(name, seq) FILTER (WHERE name <> '' AND NOT (platform = 'wechat' AND name = native_id)) AS new_name,
  max(CASE WHEN platform = 'wechat' AND name = native_id THEN name END) AS shown, bool_or(is_self) AS new_self, min(timestamp_ms) AS new_first, max(timestamp_ms) AS new_last FROM o GROUP BY 1, 2, 3),
 s AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'wechat' ELSE 'qq' END AS platform, CASE WHEN id % 6 < 3 THEN 'x-Default' ELSE 'me' END AS account_id, native_id, current_name, is_self, 900000000000 AS first_seen, 900000000000 AS last_seen FROM senders WHERE id % 3 = 0),
 j AS (SELECT n.*, CASE WHEN s.account_id = n.account_id OR n.account_id = 'me' THEN s.id END AS old FROM n LEFT JOIN s ON s.platform = n.platform AND s.native_id = n.native_id),
 i AS (SELECT *, coalesce(old, (SELECT max(id) FROM s) + row_number() OVER (PARTITION BY old IS NULL ORDER BY seq, platform, account_id, native_id)) AS nid FROM j)
SELECT coalesce(s.id, i.nid)::BIGINT AS id, coalesce(i.platform, s.platform) AS platform, coalesce(i.account_id, s.account_id) AS account_id, coalesce(i.native_id, s.native_id) AS native_id,
 coalesce(new_name, current_name, shown, '') AS current_name, coalesce(is_self, false) OR coalesce(new_self, false) AS is_self, least(first_seen, new_first)::BIGINT AS first_seen, greatest(last_seen, new_last)::BIGINT AS last_seen
 FROM s FULL JOIN i ON s.id = i.nid""",
    "messages senders",
)
def sender_upsert(x: Lens) -> DataFrame:
    # Both platforms; stored senders of this account and of a default one, imports of this account and of another default one.
    native = F.col("sender_id").cast("string")
    seen = x.messages().filter("sender_id % 4 <> 0").select(
        F.when(F.col("sender_id") % 2 == 0, "wechat").otherwise("qq").alias("platform"), F.when(F.col("sender_id") % 5 == 0, "wechat-default").otherwise("me").alias("account_id"), native.alias("native_id"),
        F.when(F.col("id") % 3 == 0, native).when(F.col("id") % 7 == 0, "").otherwise(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("name"),
        F.col("id").alias("seq"), "timestamp_ms", (F.col("direction") == "outgoing").alias("is_self"),
    )
    at = F.lit(900000000000)
    platform, account = F.when(F.col("id") % 2 == 0, "wechat").otherwise("qq"), F.when(F.col("id") % 6 < 3, "x-Default").otherwise("me")
    stored = x.senders().filter("id % 3 = 0").select("id", platform.alias("platform"), account.alias("account_id"), "native_id", "current_name", "is_self", at.alias("first_seen"), at.alias("last_seen"))
    return U.sender_upsert(stored, seen)


@query(
    "u03_conversation_upsert",
    """+b AS (SELECT *, id % 2 = 0 AS there, max(CASE WHEN id % 2 = 0 THEN id END) OVER () AS top FROM convs),
 i AS (SELECT platform, title AS native_id, id, kind, there, top, unnest(CASE WHEN id % 4 = 0 THEN ['real', 'second'] ELSE ['x-default'] END) AS account_id FROM b),
 n AS (SELECT *, CASE WHEN there AND account_id <> 'second' THEN id END AS old FROM i)
SELECT platform, native_id, account_id, coalesce(old, top + row_number() OVER (PARTITION BY old IS NULL ORDER BY id, platform, account_id, native_id))::BIGINT AS id, kind,
 CASE WHEN old IS NOT NULL AND id % 6 = 0 THEN CASE WHEN id % 4 = 0 THEN native_id || '!' ELSE 'kept' END ELSE native_id || '!' END AS title,
 CASE WHEN old IS NULL THEN 'new' WHEN id % 4 = 0 THEN 'upgraded' ELSE 'known' END AS state FROM n""",
    "convs",
)
def conversation_upsert(x: Lens) -> DataFrame:
    # Every fourth conversation comes from two accounts, of which one adopts the default row; every sixth has a title of its own.
    native = F.col("title")
    own = F.when(F.col("id") % 6 == 0, "kept").otherwise(native)
    stored = x.conversations().filter("id % 2 = 0").select("id", "platform", native.alias("native_id"), F.lit("x-default").alias("account_id"), own.alias("title"))
    accounts = F.when(F.col("id") % 4 == 0, F.array(F.lit("real"), F.lit("second"))).otherwise(F.array(F.lit("x-default")))
    incoming = x.conversations().withColumn("account_id", F.explode(accounts))
    seq = F.col("id") * 2 + (F.col("account_id") == "second").cast("int")
    return U.conversation_upsert(stored, incoming.select("platform", native.alias("native_id"), "account_id", "kind", F.concat(native, F.lit("!")).alias("title"), seq.alias("seq")))


@query(
    "u06_attachment_merge",
    """, b AS (SELECT *, true AS is_target FROM attachments WHERE message_id % 2 = 0 UNION ALL SELECT message_id, ordinal, kind, NOT is_available, media_id + 1, false FROM attachments WHERE ordinal % 2 = 0)
SELECT message_id, ordinal, kind, is_available, media_id FROM (SELECT *, row_number() OVER (PARTITION BY message_id, ordinal ORDER BY is_available DESC, is_target DESC, media_id DESC) AS n FROM b) WHERE n = 1""".replace(", b AS", "+b AS", 1),
    "attachments",
)
def attachment_merge(x: Lens) -> DataFrame:
    a = x.attachments()
    other = a.filter("ordinal % 2 = 0").withColumns({"is_available": ~F.col("is_available"), "media_id": F.col("media_id") + 1})
    return U.attachment_merge(a.filter("message_id % 2 = 0"), other)


@query(
    "u07_attachment_upsert",
    """SELECT message_id, ordinal, CASE WHEN ordinal % 2 = 0 THEN 'new' ELSE 'old' END AS source_path, CASE WHEN ordinal % 2 = 0 THEN message_id % 3 = 0 ELSE is_available END AS is_available, media_id FROM attachments""",
    "attachments",
)
def attachment_upsert(x: Lens) -> DataFrame:
    stored = x.attachments().withColumn("source_path", F.lit("old"))
    incoming = x.attachments().filter("ordinal % 2 = 0").select("message_id", "ordinal", F.lit("new").alias("source_path"), (F.col("message_id") % 3 == 0).alias("exists"), F.lit(None).cast("bigint").alias("media_id"))
    return U.attachment_upsert(stored, incoming)


@query(
    "u08_media_upsert",
    """SELECT coalesce(s.brand, i.brand) AS sha256, coalesce(s.name, i.name) AS managed_path, coalesce(s.mime, 'new') AS mime_type, coalesce(s.size, i.size) AS size
 FROM (SELECT DISTINCT brand, 'stored' AS name, 'old' AS mime, 1::BIGINT AS size FROM media WHERE brand < 'Brand#3') s
 FULL JOIN (SELECT brand, arg_min(name, id) AS name, arg_min(size, id) AS size FROM media GROUP BY 1) i ON i.brand = s.brand""",
    "media",
)
def media_upsert(x: Lens) -> DataFrame:
    incoming = x.media().select(F.col("brand").alias("sha256"), F.col("name").alias("managed_path"), F.lit("new").alias("mime_type"), "size", F.col("id").alias("seq"))
    stored = x.media().filter("brand < 'Brand#3'").select(F.col("brand").alias("sha256")).distinct().select("sha256", F.lit("stored").alias("managed_path"), F.lit("old").alias("mime_type"), F.lit(1).cast("bigint").alias("size"))
    return U.media_upsert(stored, incoming)


@query("u18_empty_conversations", "SELECT id FROM convs c WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.conversation_id = c.id AND m.id % 500 = 0)", "messages convs")
def empty_conversations(x: Lens) -> DataFrame:
    return U.without_messages(x.conversations().select("id"), x.messages().filter("id % 500 = 0"))


@query("a09_duplicate_groups", "SELECT platform, sender_name, message_type, count(*) AS amount FROM messages GROUP BY 1, 2, 3 HAVING count(*) > 1", "messages")
def duplicate_groups(x: Lens) -> DataFrame:
    return U.duplicate_groups(x.messages(), ["platform", "sender_name", "message_type"])


ACCOUNTS = "a AS (SELECT id, platform, (id // 4)::BIGINT AS native, CASE WHEN id % 4 IN (0, 3) THEN 'x-default' ELSE 'real' || (id % 4) END AS account_id FROM senders WHERE id % 7 <> 1)"


def _accounts(x: Lens) -> DataFrame:
    account = F.when((F.col("id") % 4).isin(0, 3), "x-default").otherwise(F.concat(F.lit("real"), (F.col("id") % 4).cast("string")))
    return x.senders().filter("id % 7 <> 1").select("id", "platform", F.floor(F.col("id") / 4).cast("bigint").alias("native"), account.alias("account_id"))


@query("w06_canonical_sender", f"+{ACCOUNTS} SELECT id, native, first_value(id) OVER (PARTITION BY native ORDER BY account_id LIKE '%-default', id) AS canonical_id FROM a", "senders")
def canonical_sender(x: Lens) -> DataFrame:
    return U.canonical(_accounts(x), ["native"], [U.is_default(F.col("account_id")).cast("int").alias("d"), F.col("id").alias("i")]).select("id", "native", "canonical_id")


@query(
    "w07_canonical_conversation",
    """SELECT c.id, kind, first_value(c.id) OVER (PARTITION BY kind ORDER BY n DESC, c.id) AS canonical_id FROM convs c JOIN (SELECT conversation_id, count(*) AS n FROM messages GROUP BY 1) m ON m.conversation_id = c.id""",
    "messages convs",
)
def canonical_conversation(x: Lens) -> DataFrame:
    counts = x.messages().groupBy(F.col("conversation_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return U.canonical(x.conversations().join(counts, "id"), ["kind"], [(-F.col("n")).alias("n"), F.col("id").alias("i")]).select("id", "kind", "canonical_id")


@query("w08_default_account", f"+{ACCOUNTS} SELECT native, min(id) AS id FROM a WHERE account_id LIKE '%-default' GROUP BY 1", "senders")
def default_account(x: Lens) -> DataFrame:
    return _accounts(x).filter(U.is_default(F.col("account_id"))).groupBy("native").agg(F.min("id").alias("id"))


FOLDED = f"""{ACCOUNTS}, z AS (SELECT *, count(*) FILTER (WHERE account_id NOT LIKE '%-default') OVER (PARTITION BY native) AS reals, count(*) FILTER (WHERE account_id LIKE '%-default') OVER (PARTITION BY native) AS defaults FROM a),
 p AS (SELECT * FROM z WHERE CASE WHEN reals >= 2 THEN account_id LIKE '%-default' AND defaults > 1 WHEN reals = 1 THEN defaults >= 1 ELSE defaults > 1 END),
 f AS (SELECT id, first_value(id) OVER (PARTITION BY native ORDER BY account_id LIKE '%-default', id) AS canonical_id FROM p)"""


@query("u05_fold_map", f"+{FOLDED} SELECT id, canonical_id FROM f", "senders")
def fold_map(x: Lens) -> DataFrame:
    return U.fold_map(_accounts(x), ["native"])


@query("u05_fold_messages", f"+{FOLDED} SELECT m.id, conversation_id, coalesce(canonical_id, sender_id) AS sender_id FROM messages m LEFT JOIN f ON f.id = sender_id", "messages senders")
def fold_messages(x: Lens) -> DataFrame:
    none = x.conversations().limit(0).select("id", F.col("id").alias("canonical_id"))
    return U.reassigned(x.messages().select("id", "conversation_id", "sender_id"), U.fold_map(_accounts(x), ["native"]), none)


@query("u05_merge_messages", "SELECT seq AS id FROM (SELECT seq, row_number() OVER (PARTITION BY conversation_id, native_id, payload_hash ORDER BY seq) AS n FROM docs) WHERE n = 1", "docs")
def merge_messages(x: Lens) -> DataFrame:
    return U.merged_messages(x.documents().select(F.col("seq").alias("id"), "conversation_id", "native_id", "payload_hash", F.col("payload_hash").alias("semantic_hash"))).select("id")


@query("u05_merge_aliases", "SELECT sender_id, alias, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM sender_aliases GROUP BY 1, 2", "messages sender_aliases")
def merge_aliases(x: Lens) -> DataFrame:
    return U.merged_aliases(x.sender_aliases(), ["sender_id"])


@query("j11_cascade", "SELECT id FROM messages WHERE conversation_id NOT IN (SELECT id FROM convs WHERE kind = 'private')", "messages convs")
def cascade(x: Lens) -> DataFrame:
    return U.cascade(x.messages(), "conversation_id", x.conversations().filter("kind = 'private'")).select("id")


@query("j11_set_null", "SELECT id, CASE WHEN sender_id % 3 = 0 THEN NULL ELSE sender_id END AS sender_id FROM messages", "messages")
def set_null(x: Lens) -> DataFrame:
    return U.set_null(x.messages().select("id", "sender_id"), "sender_id", x.senders().filter("id % 3 = 0"))


@query(
    "j12_unique_key_join",
    """, k AS (SELECT sender_id, message_type, min(id) AS message_id FROM messages GROUP BY 1, 2 HAVING count(*) = 1)
SELECT message_id, (row_number() OVER (PARTITION BY message_id ORDER BY m.id) - 1)::BIGINT AS ordinal, m.id AS row FROM messages m JOIN k ON k.sender_id = m.sender_id + 1 AND k.message_type = m.message_type""".replace(", k AS", "+k AS", 1),
    "messages",
)
def unique_key_join(x: Lens) -> DataFrame:
    m = x.messages()
    resources = m.select(F.col("id").alias("row"), (F.col("sender_id") + 1).alias("sender_id"), F.concat(F.lit(" "), "message_type").alias("message_type"))
    return U.unique_key_join(m.withColumnRenamed("id", "message_id"), resources, ["sender_id", "message_type"])


@query(
    "h02_payload_hash",
    """SELECT id, sha256('{"content":' || to_json(content) || ',"direction":"' || direction || '","message_type":"' || message_type || '","reply_to":null,"sender":"' || sender_id || '","timestamp_ms":' || timestamp_ms || '}') AS hash FROM messages""",
    "messages",
)
def payload_hash(x: Lens) -> DataFrame:
    f = {c: F.col(c) for c in ("timestamp_ms", "direction", "message_type", "content")} | {"sender": F.col("sender_id").cast("string"), "reply_to": F.lit(None).cast("string")}
    return x.messages().select("id", X.payload_hash(f).alias("hash"))


@query("h06_semantic_hash", """SELECT id, sha256('{"direction":"' || direction || '","sender":"' || sender_id || '","timestamp_ms":' || timestamp_ms || '}') AS hash FROM chat""", "chat")
def semantic_hash(x: Lens) -> DataFrame:
    f = {"timestamp_ms": F.col("timestamp_ms"), "direction": F.col("direction"), "sender": F.col("sender_id").cast("string")}
    return x.chat().select("id", X.payload_hash(f).alias("hash"))


@query("t16_synthetic_sender", "SELECT id, 'synthetic:' || sha256(conversation_id::VARCHAR || chr(0) || trim(sender_name)) AS native_id FROM chat", "chat")
def synthetic_sender(x: Lens) -> DataFrame:
    return x.chat().select("id", X.synthetic_sender(F.col("conversation_id").cast("string"), F.col("sender_name")).alias("native_id"))


@query("t15_file_native_id", "SELECT url, 'file:' || sha256(url) AS native_id FROM pages")
def file_native_id(x: Lens) -> DataFrame:
    return x.raw("pages").select("url", X.file_native_id(F.col("url")).alias("native_id"))


@query("s19_text_digest", "SELECT doc_id::BIGINT AS id, sha256(text) AS digest FROM documents")
def text_digest(x: Lens) -> DataFrame:
    return x.raw("documents").select(F.col("doc_id").cast("bigint").alias("id"), F.sha2("text", 256).alias("digest"))


@query(
    "d01_timestamp_parse",
    "SELECT id, CASE id % 6 WHEN 0 THEN timestamp_ms // 1000 * 1000 WHEN 1 THEN timestamp_ms WHEN 2 THEN timestamp_ms // 1000 * 1000 WHEN 3 THEN timestamp_ms // 86400000 * 86400000 WHEN 4 THEN timestamp_ms // 86400000 * 86400000 END AS ms FROM evts",
    "evts",
)
def timestamp_parse(x: Lens) -> DataFrame:
    at = F.timestamp_millis("timestamp_ms")
    forms = [(F.col("timestamp_ms") / 1000).cast("bigint").cast("string"), F.col("timestamp_ms").cast("string"), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.date_format(at, "yyyyMMdd"), F.date_format(at, "yyyy年MM月dd日"), F.lit("soon")]
    shown = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        shown = F.when(F.col("id") % 6 == k, form).otherwise(shown)
    return x.events().select("id", T.flexible_timestamp(shown).alias("ms"))


@query("d02_seconds_or_ms", "SELECT id, CASE WHEN id % 2 = 0 THEN timestamp_ms ELSE timestamp_ms // 1000 * 1000 END AS ms FROM evts", "evts")
def seconds_or_ms(x: Lens) -> DataFrame:
    raw = F.when(F.col("id") % 2 == 0, F.col("timestamp_ms")).otherwise(F.floor(F.col("timestamp_ms") / 1000))
    return x.events().select("id", T.seconds_or_millis(raw).cast("bigint").alias("ms"))


@query("p12_day_bounds", "SELECT DISTINCT day, epoch_ms(day::TIMESTAMP)::BIGINT AS from_ms, epoch_ms(day::TIMESTAMP + INTERVAL 1 DAY)::BIGINT AS to_ms FROM (SELECT strftime(ts, '%Y-%m-%d') AS day FROM events)")
def day_bounds(x: Lens) -> DataFrame:
    start, end = T.day_bounds(F.col("day"))
    return x.raw("events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct().select("day", start.alias("from_ms"), end.alias("to_ms"))


@query("n01_as_long", "SELECT l_orderkey::BIGINT AS id, l_linenumber::BIGINT AS line, trunc(l_extendedprice)::BIGINT AS whole, NULL::BIGINT AS none FROM lineitem")
def as_long(x: Lens) -> DataFrame:
    return x.raw("lineitem").select(F.col("l_orderkey").cast("bigint").alias("id"), F.col("l_linenumber").cast("bigint").alias("line"), T.as_long(F.col("l_extendedprice").cast("string")).alias("whole"), T.as_long(F.lit("x1")).alias("none"))


@query("n03_as_bool", "SELECT id, id % 4 IN (0, 1) AS flag FROM evts", "evts")
def as_bool(x: Lens) -> DataFrame:
    shown = F.when(F.col("id") % 4 == 0, " Yes ").when(F.col("id") % 4 == 1, "1").when(F.col("id") % 4 == 2, "0")
    return x.events().select("id", T.as_bool(shown).alias("flag"))


@query("t09_mime", "SELECT p_partkey::BIGINT AS id, CASE p_size % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'audio/amr' END AS mime FROM part")
def mime(x: Lens) -> DataFrame:
    ending = F.when(F.col("p_size") % 4 == 0, ".JPG").when(F.col("p_size") % 4 == 1, ".pdf").when(F.col("p_size") % 4 == 2, ".x.amr").otherwise(".exe")
    return x.raw("part").select(F.col("p_partkey").cast("bigint").alias("id"), T.guess_mime(F.concat("p_name", ending)).alias("mime"))


@query("t01_clean", "SELECT id, regexp_replace(content, '^[\\s]+|[\\s]+$', '', 'g') AS content FROM chat", "chat")
def clean(x: Lens) -> DataFrame:
    return x.chat().select("id", T.clean(F.concat(F.lit("\t　 \u0000"), "content", F.lit(" \n"))).alias("content"))


@query("t04_unique_aliases", "SELECT id, CASE WHEN id % 2 = 0 THEN current_name ELSE current_name || ',' || native_id END AS aliases FROM senders", "senders")
def unique_aliases(x: Lens) -> DataFrame:
    listed = T.unique_list(F.col("current_name"), F.lit(""), F.when(F.col("id") % 2 == 1, F.col("native_id")), F.col("current_name"))
    return x.senders().select("id", F.array_join(listed, ",").alias("aliases"))


@query(
    "c01_message_type",
    "SELECT id, CASE id % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'audio' WHEN 2 THEN 'forward' WHEN 3 THEN 'location' ELSE 'other' END AS kind FROM evts",
    "evts",
)
def message_type(x: Lens) -> DataFrame:
    pick = lambda k, v: F.when(F.col("id") % 5 == k, v)
    kind = K.message_type(pick(0, "4"), pick(1, "34"), pick(2, " 聊天记录 "), F.coalesce(pick(3, "[位置] here"), F.lit("text")))
    return x.events().select("id", kind.alias("kind"))


@query("c03_media_first_type", "SELECT id, CASE id % 4 WHEN 0 THEN 'audio' WHEN 1 THEN 'emoji' WHEN 2 THEN 'reply' ELSE 'other' END AS kind FROM evts", "evts")
def media_first(x: Lens) -> DataFrame:
    pick = lambda k, v: F.when(F.col("id") % 4 == k, v)
    return x.events().select("id", K.media_first_type(pick(0, "Voice"), pick(1, "47"), pick(2, "引用消息"), F.lit("x")).alias("kind"))


@query("c05_csv_type", "SELECT id, CASE message_type WHEN 'view' THEN 'emoji' WHEN 'click' THEN 'audio' ELSE 'text' END AS kind FROM evts", "evts")
def csv_type(x: Lens) -> DataFrame:
    shown = F.when(F.col("message_type") == "view", "Sticker").when(F.col("message_type") == "click", " voice").otherwise("error")
    return x.events().select("id", K.csv_type(shown).alias("kind"))


@query("c10_direction", "SELECT id, direction, direction = 'system' AND id % 2 = 0 AS recalled FROM evts", "evts")
def direction(x: Lens) -> DataFrame:
    kind = F.when(F.col("message_type") == "error", "system").otherwise("text")
    content = F.when(F.col("id") % 2 == 0, "对方撤回了一条消息").otherwise("x")
    return x.events().select("id", K.direction(kind, F.col("message_type") == "purchase").alias("direction"), K.recalled(kind, content).alias("recalled"))


@query("a13_run_counters", "SELECT message_type AS status, count(*) AS n_files, sum(id % 3)::BIGINT AS added, sum(id % 5)::BIGINT AS duplicates, sum(id % 7)::BIGINT AS revisions FROM evts GROUP BY 1", "evts")
def run_counters(x: Lens) -> DataFrame:
    files = x.events().select(F.col("message_type").alias("status"), (F.col("id") % 3).alias("added"), (F.col("id") % 5).alias("duplicates"), (F.col("id") % 7).alias("revisions"))
    return count_runs(files)


@query("a14_distinct", "SELECT DISTINCT sender_id, conversation_id FROM messages", "messages")
def distinct(x: Lens) -> DataFrame:
    return x.messages().select("sender_id", "conversation_id").distinct()


@query("k06_trigram_search", "SELECT id FROM chat WHERE contains(lower(content), 'then')", "chat")
def trigram_search(x: Lens) -> DataFrame:
    return Z.indexed_search(Z.trigram_index(x.chat()), x.chat(), "THEN").select("id")


@query("k07_run_status", "SELECT message_type AS run_id, CASE WHEN message_type = 'click' THEN 'completed' ELSE 'interrupted' END AS status FROM evts GROUP BY 1 HAVING message_type <> 'view'", "evts")
def run_status(x: Lens) -> DataFrame:
    began = x.events().filter("message_type <> 'view'").groupBy(F.col("message_type").alias("run_id")).agg(F.min("id").alias("seq")).withColumn("status", F.lit("running"))
    ended = began.filter("run_id = 'click'").withColumns({"seq": F.col("seq") + 10_000_000, "status": F.lit("completed")})
    last = x.spark.createDataFrame([("zz", 999_999_999, "running")], "run_id string, seq long, status string")
    return Z.run_status(began.unionByName(ended).unionByName(last)).filter("run_id <> 'zz'")


@query(
    "c15_media_locate",
    """SELECT message_id, ordinal, CASE WHEN media_id % 3 = 0 THEN 'm/' || media_id WHEN media_id % 3 = 1 THEN 'src' END AS path FROM attachments""",
    "attachments",
)
def media_locate(x: Lens) -> DataFrame:
    wanted = x.attachments().select("message_id", "ordinal", F.col("media_id").cast("string").alias("sha256"), F.lit("gone").alias("managed_path"), F.when(F.col("media_id") % 3 == 1, "src").otherwise("lost").alias("source_path"))
    ids = x.media().filter("id % 3 = 0").select(F.col("id").cast("string").alias("sha256"))
    short, long = (ids.select("sha256", F.concat(F.lit(p), "sha256").alias("path")) for p in ("m/", "much/longer/"))
    src = x.spark.createDataFrame([("-", "src")], "sha256 string, path string")
    return Z.locate(wanted, short.unionByName(long).unionByName(src))


@query("c13_safe_paths", "SELECT id, CASE WHEN id % 5 = 0 THEN 'a/b' || id END AS path FROM evts", "evts")
def safe_paths(x: Lens) -> DataFrame:
    shown = F.concat(F.when(F.col("id") % 5 == 0, "./a\\b").when(F.col("id") % 5 == 1, "/a").when(F.col("id") % 5 == 2, "C:\\").when(F.col("id") % 5 == 3, "a/../b/").otherwise("file://"), F.col("id").cast("string"))
    return x.events().select("id", Z.safe_relative(shown).alias("path"))


@query("h08_xml_summary", "SELECT id, CASE WHEN id % 3 = 0 THEN '[微信分享] ' || message_type || ' - more' WHEN id % 3 = 1 THEN '[微信 XML 消息]' END AS summary, CASE WHEN id % 3 = 0 THEN 'link' WHEN id % 3 = 1 THEN 'other' END AS kind FROM evts", "evts")
def xml_summary(x: Lens) -> DataFrame:
    share = F.concat(F.lit("<msg><appmsg><type>5</type><title>"), "message_type", F.lit("</title><des>more</des></appmsg></msg>"))
    content = F.when(F.col("id") % 3 == 0, share).when(F.col("id") % 3 == 1, "<msg><broken>").otherwise("plain")
    found = x.events().select("id", P.xml_summary(content).alias("x"))
    return found.select("id", "x.summary", "x.kind")


@query("t11_recursive_text", "SELECT id, message_type || chr(10) || 'True' AS texts FROM evts", "evts")
def recursive_text(x: Lens) -> DataFrame:
    payload = F.concat(F.lit('{"a":[{"title":"'), "message_type", F.lit('","url":"x"},{"text":"http://no"},{"content":[true,"'), "message_type", F.lit('"]}]}'))
    return x.events().select("id", P.json_texts(payload).alias("texts"))


@query("t08_path_title", "SELECT id, 'room' || id AS title FROM convs", "convs")
def path_title(x: Lens) -> DataFrame:
    name = F.concat(F.lit("room"), F.col("id").cast("string"))
    path = F.when(F.col("id") % 2 == 0, F.concat(F.lit("/x/群聊_"), name, F.lit("_全部时间/a.json"))).otherwise(F.concat(F.lit("/x/私聊-"), name, F.lit("_2024-01/a.json")))
    return x.conversations().select("id", P.title_from_path(path, F.lit("?")).alias("title"))


@query("t13_sender_prefix", "SELECT id, CASE WHEN id % 2 = 0 THEN content ELSE 'a:' || content END AS content FROM chat", "chat")
def sender_prefix(x: Lens) -> DataFrame:
    sender = F.when(F.col("id") % 2 == 0, "w@openim").otherwise("a")
    return x.chat().select("id", P.without_sender_prefix(F.concat(sender, F.lit(":"), "content"), sender).alias("content"))
