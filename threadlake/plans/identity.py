"""Senders, aliases, contacts and bindings as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators import people as H
from threadlake.plans.reading import FOLD
from threadlake.plans.registry import query
from threadlake.sources.lens import Lens


@query("a03_aliases", "SELECT sender_id, alias, max(last_seen) AS last_seen FROM sender_aliases GROUP BY 1, 2", "messages sender_aliases")
def aliases(x: Lens) -> DataFrame:
    return H.alias_rollup(x.sender_aliases())


@query(
    "a04_sender_conversations",
    "SELECT sender_id, conversation_id, title, count(*) AS amount, max(timestamp_ms) AS last_ts FROM messages m JOIN convs c ON c.id = conversation_id GROUP BY 1, 2, 3",
    "messages convs",
)
def sender_conversations(x: Lens) -> DataFrame:
    return H.sender_conversations(x.messages(), x.conversations())


@query(
    "a05_contact_conversations",
    """SELECT contact_id, conversation_id, title, count(*) AS amount, max(timestamp_ms) AS last_ts FROM messages m JOIN bindings b ON b.sender_id = m.sender_id
 JOIN convs c ON c.id = conversation_id GROUP BY 1, 2, 3""",
    "messages convs bindings",
)
def contact_conversations(x: Lens) -> DataFrame:
    return H.contact_conversations(x.messages(), x.conversations(), x.bindings())


@query("a06_sender_counts", "SELECT s.id, (SELECT count(*) FROM messages m WHERE m.sender_id = s.id) AS amount FROM senders s", "messages senders")
def sender_counts(x: Lens) -> DataFrame:
    counts = H.sender_counts(x.messages())
    return x.senders().join(counts, F.col("id") == F.col("sender_id"), "left").select("id", F.coalesce("amount", F.lit(0)).alias("amount"))


@query("a07_contact_counts", "SELECT contact_id, sum((SELECT count(*) FROM messages m WHERE m.sender_id = b.sender_id))::BIGINT AS amount FROM bindings b GROUP BY 1", "messages bindings")
def contact_counts(x: Lens) -> DataFrame:
    return H.contact_counts(x.messages(), x.bindings())


@query(
    "w03_display_name",
    """SELECT DISTINCT ON (t.sender_id, t.conversation_id) t.sender_id, t.conversation_id, a.alias
 FROM (SELECT DISTINCT sender_id, conversation_id FROM messages) t JOIN senders s ON s.id = t.sender_id AND s.platform = 'wechat'
 JOIN sender_aliases a ON a.sender_id = t.sender_id LEFT JOIN convs c ON c.id = a.conversation_id
 ORDER BY t.sender_id, t.conversation_id, CASE WHEN a.conversation_id = t.conversation_id THEN 0 WHEN c.kind = 'private' THEN 1 ELSE 2 END, a.last_seen DESC, a.alias""",
    "messages convs senders sender_aliases",
)
def display_name(x: Lens) -> DataFrame:
    targets = x.messages().select("sender_id", "conversation_id").distinct()
    return H.display_names(x.sender_aliases(), x.senders(), x.conversations(), targets)


@query(
    "w04_payload_number",
    """SELECT sender_id, arg_min(number, nth) AS number FROM (SELECT sender_id, json_extract_string(payload, '$.k') AS number,
 row_number() OVER (PARTITION BY sender_id ORDER BY timestamp_ms DESC, id DESC) AS nth FROM evts) WHERE nth <= 25 AND regexp_matches(number, '^[0-9]{2,}$') GROUP BY 1""",
    "evts",
)
def payload_number(x: Lens) -> DataFrame:
    return H.payload_numbers(x.events(), "$.k", valid="^[0-9]{2,}$")


@query(
    "w05_private_title",
    """SELECT sender_id, arg_max(title, t * 1000 + conversation_id) AS title FROM (SELECT DISTINCT sender_id, conversation_id FROM messages) p
 JOIN (SELECT conversation_id, max(timestamp_ms) AS t FROM messages GROUP BY 1) l USING (conversation_id) JOIN convs c ON c.id = conversation_id WHERE kind = 'private' GROUP BY 1""",
    "messages convs",
)
def private_title(x: Lens) -> DataFrame:
    return H.private_titles(x.messages(), x.conversations())


@query(
    "u17_auto_contacts",
    """SELECT s.id AS sender_id, arg_max(title, t * 1000 + conversation_id) AS display_name FROM senders s JOIN (SELECT DISTINCT sender_id, conversation_id FROM messages) p ON p.sender_id = s.id
 JOIN (SELECT conversation_id, max(timestamp_ms) AS t FROM messages GROUP BY 1) l USING (conversation_id) JOIN convs c ON c.id = conversation_id
 WHERE kind = 'private' AND NOT is_self AND NOT EXISTS (SELECT 1 FROM bindings b WHERE b.sender_id = s.id) GROUP BY 1""",
    "messages convs senders bindings",
)
def auto_contacts(x: Lens) -> DataFrame:
    return H.auto_contacts(x.senders(), x.bindings(), x.messages(), x.conversations())


DETAIL = """SELECT b.contact_id, c.display_name, b.sender_id, s.platform, s.native_id, s.current_name, b.account_label, b.is_primary,
 (SELECT count(*) FROM messages m WHERE m.sender_id = b.sender_id) AS amount FROM contacts c JOIN bindings b ON b.contact_id = c.id JOIN senders s ON s.id = b.sender_id"""


@query("r04_contact_detail", DETAIL, "messages senders contacts bindings")
def contact_detail(x: Lens) -> DataFrame:
    return H.contact_detail(x.contacts(), x.bindings(), x.senders(), x.messages())


@query("r05_contact_by_sender", DETAIL + " WHERE b.sender_id = 5", "messages senders contacts bindings")
def contact_by_sender(x: Lens) -> DataFrame:
    return H.contact_detail(x.contacts(), x.bindings().filter("sender_id = 5"), x.senders(), x.messages())


CONTACTS = """SELECT c.id, c.display_name, c.touched, coalesce((SELECT sum((SELECT count(*) FROM messages m WHERE m.sender_id = b.sender_id)) FROM bindings b WHERE b.contact_id = c.id), 0)::BIGINT AS amount
 FROM contacts c {0} ORDER BY touched DESC, c.id DESC"""


@query("r06_contact_list", CONTACTS.format(""), "messages contacts bindings")
def contact_list(x: Lens) -> DataFrame:
    return H.contact_list(x.contacts(), x.bindings(), x.senders(), x.messages())


@query(
    "p09_contact_keyword",
    CONTACTS.format("WHERE " + FOLD.format("display_name") + " LIKE '%build%' OR EXISTS (SELECT 1 FROM bindings b JOIN senders s ON s.id = b.sender_id WHERE b.contact_id = c.id AND (" + FOLD.format("account_label") + " LIKE '%build%' OR " + FOLD.format("current_name") + " LIKE '%build%' OR native_id LIKE '%build%'))"),
    "messages senders contacts bindings",
)
def contact_keyword(x: Lens) -> DataFrame:
    return H.contact_list(x.contacts(), x.bindings(), x.senders(), x.messages(), x.sender_aliases().filter("alias like '%none%'"), "BUILD")


@query(
    "r07_bindable_senders",
    """SELECT s.id, s.platform, s.current_name, c.display_name AS bound_to, b.account_label, (SELECT count(*) FROM messages m WHERE m.sender_id = s.id) AS amount
 FROM senders s LEFT JOIN bindings b ON b.sender_id = s.id LEFT JOIN contacts c ON c.id = b.contact_id WHERE NOT is_self AND coalesce(b.contact_id, -1) <> 5""",
    "messages senders contacts bindings",
)
def bindable(x: Lens) -> DataFrame:
    return H.bindable_senders(x.senders(), x.bindings(), x.contacts(), x.messages(), 5)


@query(
    "p10_bindable_keyword",
    """SELECT s.id, s.platform, s.current_name, c.display_name AS bound_to, b.account_label, (SELECT count(*) FROM messages m WHERE m.sender_id = s.id) AS amount
 FROM senders s LEFT JOIN bindings b ON b.sender_id = s.id LEFT JOIN contacts c ON c.id = b.contact_id WHERE NOT is_self AND coalesce(b.contact_id, -1) <> 5
 AND (s.current_name LIKE '%0012%' OR coalesce(c.display_name, '') LIKE '%0012%' OR coalesce(b.account_label, '') LIKE '%0012%')""",
    "messages senders contacts bindings",
)
def bindable_keyword(x: Lens) -> DataFrame:
    return H.bindable_senders(x.senders(), x.bindings(), x.contacts(), x.messages(), 5, "0012")


@query(
    "a11_self_sender",
    """SELECT conversation_id, sender_id FROM (SELECT conversation_id, sender_id, row_number() OVER (PARTITION BY conversation_id ORDER BY count(*) DESC, min(id)) AS n
 FROM messages WHERE direction = 'outgoing' GROUP BY 1, 2) WHERE n = 1""",
    "messages",
)
def self_sender(x: Lens) -> DataFrame:
    return H.self_sender(x.messages())


GROUPED = "g AS (SELECT sender_id % 10 AS contact_id, sender_id, account_label, is_primary AND sender_id % 10 < 5 AS is_primary FROM bindings)"


def _grouped(x: Lens) -> DataFrame:
    """Bindings of ten contacts, half of them without a primary sender."""
    return x.bindings().select((F.col("sender_id") % 10).alias("contact_id"), "sender_id", "account_label", (F.col("is_primary") & (F.col("sender_id") % 10 < 5)).alias("is_primary"))


@query(
    "w09_promote_primary",
    f"""+{GROUPED} SELECT contact_id, sender_id, account_label, is_primary OR (NOT bool_or(is_primary) OVER (PARTITION BY contact_id) AND sender_id = min(sender_id) OVER (PARTITION BY contact_id)) AS is_primary FROM g""",
    "bindings",
)
def promote(x: Lens) -> DataFrame:
    return H.promote_primary(_grouped(x))


@query(
    "u15_unbind",
    f"""+{GROUPED}, k AS (SELECT * FROM g WHERE sender_id % 7 <> 0)
 SELECT contact_id, sender_id, account_label, is_primary OR (NOT bool_or(is_primary) OVER (PARTITION BY contact_id) AND sender_id = min(sender_id) OVER (PARTITION BY contact_id)) AS is_primary FROM k""",
    "bindings",
)
def unbind(x: Lens) -> DataFrame:
    rows = _grouped(x)
    return H.unbind(rows, rows.filter("sender_id % 7 = 0"))


@query(
    "u14_rebind",
    f"""+{GROUPED}, m AS (SELECT CASE WHEN sender_id IN (11, 12) THEN 3 ELSE contact_id END AS contact_id, sender_id, CASE WHEN sender_id IN (11, 12) THEN 'moved' ELSE account_label END AS account_label,
 CASE WHEN sender_id = 12 THEN true WHEN sender_id = 11 THEN false ELSE is_primary END AS is_primary FROM g),
 p AS (SELECT contact_id, sender_id, account_label, CASE WHEN contact_id = 3 THEN sender_id = 12 ELSE is_primary END AS is_primary FROM m)
 SELECT contact_id, sender_id, account_label, is_primary OR (NOT bool_or(is_primary) OVER (PARTITION BY contact_id) AND sender_id = min(sender_id) OVER (PARTITION BY contact_id)) AS is_primary FROM p""",
    "bindings",
)
def rebind(x: Lens) -> DataFrame:
    rows = _grouped(x)
    moves = rows.filter("sender_id in (11, 12)").select("sender_id", F.lit(3).cast("bigint").alias("contact_id"), F.lit("moved").alias("account_label"), (F.col("sender_id") == 12).alias("is_primary"))
    return H.rebind(rows, moves, force=True)


@query("u15_prune", "SELECT c.id, c.display_name, c.touched FROM contacts c WHERE EXISTS (SELECT 1 FROM bindings b WHERE b.contact_id = c.id AND b.sender_id % 2 = 0)", "contacts bindings")
def prune(x: Lens) -> DataFrame:
    return H.prune(x.contacts(), x.bindings().filter("sender_id % 2 = 0"))


@query(
    "j15_private_senders",
    "SELECT s.id FROM senders s WHERE NOT is_self AND EXISTS (SELECT 1 FROM messages m JOIN convs c ON c.id = m.conversation_id WHERE m.sender_id = s.id AND c.kind = 'private')",
    "messages convs senders",
)
def private_senders(x: Lens) -> DataFrame:
    private = x.messages().join(x.conversations().filter("kind = 'private'").select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    return x.senders().filter("not is_self").join(private.select(F.col("sender_id").alias("id")).distinct(), "id", "left_semi").select("id")


PROFILE = """+u AS (SELECT s.id, s.platform, s.native_id, s.current_name, a.alias, a.last_seen, coalesce(c.kind = 'private', false) AS private FROM senders s JOIN sender_aliases a ON a.sender_id = s.id LEFT JOIN convs c ON c.id = a.conversation_id
   WHERE s.platform = 'wechat' AND a.alias <> '' AND a.alias <> s.native_id AND a.alias <> 'unknown' AND NOT starts_with(a.alias, 'wxid_') AND NOT ends_with(a.alias, '@chatroom')),
 n AS (SELECT DISTINCT ON (id) id, alias FROM u ORDER BY id, private DESC, last_seen DESC, alias),
 p AS (SELECT s.id AS sender_id, s.platform, s.native_id, coalesce(n.alias, s.current_name) AS original_name FROM senders s LEFT JOIN n ON n.id = s.id)"""


@query(
    "r02_sender_profile",
    PROFILE + """, al AS (SELECT sender_id, alias, max(last_seen) AS t FROM sender_aliases GROUP BY 1, 2), la AS (SELECT sender_id, string_agg(alias, ',' ORDER BY coalesce(t, 0) DESC, alias) AS aliases FROM al GROUP BY 1),
 cv AS (SELECT sender_id, conversation_id, count(*) AS n FROM messages m JOIN convs c ON c.id = conversation_id GROUP BY 1, 2), lc AS (SELECT sender_id, string_agg(conversation_id || ':' || n, ',' ORDER BY n DESC, conversation_id) AS conversations FROM cv GROUP BY 1)
SELECT p.*, aliases, conversations FROM p LEFT JOIN la USING (sender_id) LEFT JOIN lc USING (sender_id)""",
    "messages convs senders sender_aliases",
)
def sender_profile(x: Lens) -> DataFrame:
    messages = x.messages().withColumn("payload", F.lit("{}"))
    rows = H.sender_profiles(x.senders(), x.sender_aliases(), x.conversations(), messages)
    talks = F.transform("conversations", lambda c: F.concat_ws(":", c["conversation_id"].cast("string"), (-c["most"]).cast("string")))
    return rows.select("sender_id", "platform", "native_id", "original_name", F.array_join("aliases.alias", ",").alias("aliases"), F.array_join(talks, ",").alias("conversations"))


@query("r03_bound_senders", PROFILE + " SELECT b.contact_id, b.sender_id, b.account_label, b.is_primary, p.platform, p.native_id, p.original_name FROM bindings b JOIN p USING (sender_id)", "messages convs senders sender_aliases bindings")
def bound_senders(x: Lens) -> DataFrame:
    rows = H.bound_senders(x.bindings(), x.senders(), x.sender_aliases(), x.conversations(), x.messages().withColumn("payload", F.lit("{}")))
    return rows.select("contact_id", "sender_id", "account_label", "is_primary", "platform", "native_id", "original_name")


@query(
    "l05_bound_order",
    "SELECT contact_id, sender_id, row_number() OVER (PARTITION BY contact_id ORDER BY is_primary DESC, sender_id) AS nth FROM bindings",
    "bindings",
)
def bound_order(x: Lens) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("contact_id").orderBy(F.col("is_primary").desc(), "sender_id")
    return x.bindings().select("contact_id", "sender_id", F.row_number().over(order).cast("bigint").alias("nth"))


@query(
    "u13_contact_life",
    """+c AS (SELECT id, CASE id WHEN 7 THEN 'Renamed' ELSE display_name END AS display_name, CASE id WHEN 6 THEN 'keep' WHEN 7 THEN 'n' END AS note, CASE id WHEN 2 THEN 'at 5' WHEN 6 THEN 'at 3' WHEN 7 THEN 'at 6' ELSE 'at 0' END AS updated_at FROM contacts WHERE id NOT IN (5, 8)
  UNION ALL SELECT 0, 'New', NULL, 'at 1'),
 b AS (SELECT CASE WHEN sender_id IN (5, 6) THEN 2 ELSE contact_id END AS contact_id, sender_id, CASE sender_id WHEN 5 THEN 'moved' WHEN 6 THEN 'six' ELSE account_label END AS account_label,
  CASE WHEN sender_id IN (2, 5) THEN false WHEN sender_id = 6 THEN true ELSE is_primary END AS is_primary FROM bindings WHERE contact_id <> 8)
SELECT id, display_name, note, updated_at, sender_id, account_label, is_primary FROM c LEFT JOIN b ON contact_id = id""",
    "contacts bindings",
)
def contact_life(x: Lens) -> DataFrame:
    """Create, transfer with tokens (the source loses its last sender and goes), take over by force (its owner stays, for its note), label, choose the primary one, rename, delete."""
    text = lambda v: F.lit(v).cast("string")
    contacts = x.contacts().select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("identity_token"), "display_name", text(None).alias("custom_avatar_path"), F.when(F.col("id") == 6, "keep").alias("note"), text("at 0").alias("updated_at"))
    bindings, senders = x.bindings(), x.senders().select(F.col("id"))
    contacts = H.create_contact(contacts, 0, "t0", " New ", "at 1")
    contacts, bindings = H.bind(contacts, bindings, senders, 2, 5, "at 2", label="moved", primary=True, source=5, token="t2", source_token="t5")
    contacts, bindings = H.bind(contacts, bindings, senders, 2, 6, "at 3", force=True)
    contacts, bindings = H.set_label(contacts, bindings, 2, 6, "six", "at 4")
    contacts, bindings = H.set_primary(contacts, bindings, 2, 6, "at 5")
    contacts = H.update_contact(contacts, 7, "Renamed", "at 6", note="n")
    contacts, bindings = H.delete_contact(contacts, bindings, 8)
    return contacts.join(bindings, contacts["id"] == bindings["contact_id"], "left").select("id", "display_name", "note", "updated_at", "sender_id", "account_label", "is_primary")
