"""Senders and contacts: aliases, display names, numbers, bindings, automatic contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import text as T


def alias_rollup(aliases: DataFrame, sender_id: int | None = None) -> DataFrame:
    """(sender_id, alias, last_seen): each alias of a sender once, over all conversations."""
    rows = aliases if sender_id is None else aliases.filter(F.col("sender_id") == sender_id)
    return rows.groupBy("sender_id", "alias").agg(F.max("last_seen").alias("last_seen"))


def sender_conversations(messages: DataFrame, conversations: DataFrame, senders: DataFrame | None = None) -> DataFrame:
    """(sender_id, conversation_id, title, amount, last_ts) of all senders, or of those given."""
    rows = messages.select("sender_id", "conversation_id", "timestamp_ms")
    if senders is not None:
        rows = rows.join(senders, "sender_id", "left_semi")
    counts = rows.groupBy("sender_id", "conversation_id").agg(F.count(F.lit(1)).alias("amount"), F.max("timestamp_ms").alias("last_ts"))
    return counts.join(conversations.select(F.col("id").alias("conversation_id"), "title"), "conversation_id")


def contact_conversations(messages: DataFrame, conversations: DataFrame, bindings: DataFrame) -> DataFrame:
    """(contact_id, conversation_id, title, amount, last_ts) over all senders bound to a contact."""
    # Counting before the joins leaves one row for each sender and conversation.
    counts = messages.groupBy("sender_id", "conversation_id").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp_ms").alias("t"))
    bound = counts.join(bindings.select("contact_id", "sender_id"), "sender_id")
    summed = bound.groupBy("contact_id", "conversation_id").agg(F.sum("n").alias("amount"), F.max("t").alias("last_ts"))
    return summed.join(conversations.select(F.col("id").alias("conversation_id"), "title"), "conversation_id")


def sender_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("sender_id").agg(F.count(F.lit(1)).alias("amount"))


def contact_counts(messages: DataFrame, bindings: DataFrame) -> DataFrame:
    """(contact_id, amount): messages of all bound senders; contacts without messages count 0."""
    joined = bindings.select("contact_id", "sender_id").join(sender_counts(messages), "sender_id", "left")
    return joined.groupBy("contact_id").agg(F.sum(F.coalesce("amount", F.lit(0))).alias("amount"))


def usable_alias(alias: Column, native_id: Column) -> Column:
    """Whether an alias is a name rather than an identifier or a placeholder."""
    return (F.length(alias) > 0) & (alias != native_id) & (alias != "unknown") & ~alias.startswith("wxid_") & ~alias.endswith("@chatroom")


def display_names(aliases: DataFrame, senders: DataFrame, conversations: DataFrame, targets: DataFrame, platform: str = "wechat") -> DataFrame:
    """(sender_id, conversation_id, alias): the name to show for a sender within a conversation.

    Aliases seen in the conversation itself come first, then those of private
    conversations, then others; the latest seen wins, then the alias in order.
    Three aggregations, of a sender's aliases by conversation, of private ones
    and of all, and joins by keys that are unique on their side, so a sender in
    many rooms costs rows in proportion.
    """
    own = senders.filter(F.col("platform") == platform).select(F.col("id").alias("sender_id"), "native_id")
    kinds = conversations.select(F.col("id").alias("conversation_id"), (F.col("kind") == "private").alias("private"))
    seen = aliases.join(own, "sender_id").filter(usable_alias(F.col("alias"), F.col("native_id"))).join(kinds, "conversation_id", "left")
    best = F.min(F.struct((-F.col("last_seen")).alias("late"), "alias"))
    here = seen.groupBy("sender_id", "conversation_id").agg(best.alias("here"), F.max(F.coalesce("private", F.lit(False))).alias("private"))
    anywhere = here.groupBy("sender_id").agg(F.min(F.when(F.col("private"), F.col("here"))).alias("in_private"), F.min("here").alias("anywhere"), F.max("private").alias("any_private"))
    found = targets.select("sender_id", "conversation_id").distinct().join(anywhere, "sender_id").join(here.select("sender_id", "conversation_id", "here"), ["sender_id", "conversation_id"], "left")
    alias = F.coalesce(F.col("here.alias"), F.when(F.col("any_private"), F.col("in_private.alias")).otherwise(F.col("anywhere.alias")))
    return found.select("sender_id", "conversation_id", alias.alias("alias"))


def sender_numbers(senders: DataFrame, messages: DataFrame, aliases: DataFrame, path: str = "$.sender.uin") -> DataFrame:
    """(sender_id, number) of qq senders: the newest payload's, else the latest seen alias of 5 to 12 digits."""
    own = senders.filter("platform = 'qq'").select(F.col("id").alias("sender_id"))
    paid = payload_numbers(messages.join(own, "sender_id", "left_semi"), path)
    spoken = aliases.join(own, "sender_id", "left_semi").filter(F.col("alias").rlike("^[0-9]{5,12}$"))
    spoken = spoken.groupBy("sender_id").agg(F.max_by("alias", F.struct(F.coalesce("last_seen", F.lit(0)), "alias")).alias("spoken"))
    return own.join(paid, "sender_id", "left").join(spoken, "sender_id", "left").select("sender_id", F.coalesce("number", "spoken").alias("number")).filter("number is not null")


def bound_senders(rows: DataFrame, senders: DataFrame, aliases: DataFrame, conversations: DataFrame, messages: DataFrame, path: str = "$.sender.uin") -> DataFrame:
    """``rows`` (with a sender_id) and their senders' platform, native id, number and original name: the name that aliases give, else the current one."""
    of = senders.select(F.col("id").alias("sender_id"), "platform", "native_id", "current_name")
    targets = senders.select(F.col("id").alias("sender_id"), F.lit(None).cast("bigint").alias("conversation_id"))
    named = display_names(aliases, senders, conversations, targets).select("sender_id", "alias")
    joined = rows.join(of, "sender_id").join(named, "sender_id", "left").join(sender_numbers(senders, messages, aliases, path), "sender_id", "left")
    return joined.withColumn("original_name", F.coalesce("alias", "current_name")).drop("alias", "current_name")


def sender_profiles(senders: DataFrame, aliases: DataFrame, conversations: DataFrame, messages: DataFrame, path: str = "$.sender.uin") -> DataFrame:
    """A row for each sender: who it is, its aliases (latest seen first) and its conversations (most messages first)."""
    who = bound_senders(senders.select(F.col("id").alias("sender_id")), senders, aliases, conversations, messages, path)
    rolled = alias_rollup(aliases).groupBy("sender_id").agg(F.sort_array(F.collect_list(F.struct((-F.coalesce("last_seen", F.lit(0))).alias("late"), "alias"))).alias("aliases"))
    talks = sender_conversations(messages, conversations).groupBy("sender_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("amount")).alias("most"), "conversation_id", "title"))).alias("conversations"))
    return who.join(rolled, "sender_id", "left").join(talks, "sender_id", "left")


def payload_numbers(messages: DataFrame, path: str, newest: int = 25, valid: str = "^[0-9]+$") -> DataFrame:
    """(sender_id, number): the first number among the newest payloads of a sender that hold one."""
    order = Window.partitionBy("sender_id").orderBy(F.col("timestamp_ms").desc(), F.col("id").desc())
    recent = messages.select("sender_id", "id", "timestamp_ms", "payload").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= newest)
    number = recent.withColumn("number", F.get_json_object("payload", path)).filter(F.col("number").rlike(valid))
    return number.groupBy("sender_id").agg(F.min_by("number", "nth").alias("number"))


def private_titles(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(sender_id, title): of the private conversations a sender writes in, the most recently active one's."""
    last = messages.groupBy("conversation_id").agg(F.max("timestamp_ms").alias("t"))
    private = conversations.filter((F.col("kind") == "private") & (F.col("title") != "")).select(F.col("id").alias("conversation_id"), "title").join(last, "conversation_id")
    pairs = messages.select("sender_id", "conversation_id").distinct().join(private, "conversation_id")
    return pairs.groupBy("sender_id").agg(F.max_by("title", F.struct("t", "conversation_id")).alias("title"))


def auto_contacts(senders: DataFrame, bindings: DataFrame, messages: DataFrame, conversations: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(sender_id, display_name): unbound senders, not oneself, with a private message, and the name their contact gets."""
    free = senders.filter(~F.col("is_self")).join(bindings.select(F.col("sender_id").alias("id")), "id", "left_anti")
    titled = free.join(private_titles(messages, conversations).withColumnRenamed("sender_id", "id"), "id")
    resolved: Column = F.lit(None).cast("string")
    if names is not None:
        titled, resolved = titled.join(names.withColumnRenamed("sender_id", "id"), "id", "left"), F.col("alias")
    fallback = F.concat(F.when(F.col("platform") == "qq", "QQ_").otherwise("微信_"), F.col("native_id"))
    name = T.first_non_empty(F.col("title"), resolved, F.col("current_name"), fallback)
    return titled.select(F.col("id").alias("sender_id"), name.alias("display_name"))


def contact_detail(contacts: DataFrame, bindings: DataFrame, senders: DataFrame, messages: DataFrame) -> DataFrame:
    """A row for each bound sender of each contact: primary ones first, with counts."""
    bound = bindings.join(senders.select(F.col("id").alias("sender_id"), "platform", "native_id", "current_name"), "sender_id").join(sender_counts(messages), "sender_id", "left")
    rows = contacts.select(F.col("id").alias("contact_id"), "display_name").join(bound, "contact_id")
    rows = rows.select("contact_id", "display_name", "sender_id", "platform", "native_id", "current_name", "account_label", "is_primary", F.coalesce("amount", F.lit(0)).alias("amount"))
    return rows.orderBy("contact_id", F.col("is_primary").desc(), "sender_id")


def contact_list(contacts: DataFrame, bindings: DataFrame, senders: DataFrame, messages: DataFrame, aliases: DataFrame | None = None, keyword: str | None = None) -> DataFrame:
    """Contacts with message totals; a keyword matches the contact, or any bound sender's name, id, label or alias."""
    rows = contacts
    if keyword:
        like = lambda c: T.like(F.col(c), keyword)
        people = bindings.join(senders.select(F.col("id").alias("sender_id"), "current_name", "native_id"), "sender_id")
        hit = people.filter(like("current_name") | like("native_id") | like("account_label")).select("contact_id")
        if aliases is not None:
            hit = hit.unionByName(bindings.join(aliases.filter(like("alias")).select("sender_id").distinct(), "sender_id", "left_semi").select("contact_id"))
        hit = hit.distinct().withColumn("by_sender", F.lit(True))
        rows = rows.join(hit, rows["id"] == hit["contact_id"], "left").filter(like("display_name") | F.col("by_sender")).drop("contact_id", "by_sender")
    totals = contact_counts(messages, bindings)
    joined = rows.join(totals, rows["id"] == totals["contact_id"], "left")
    return joined.select("id", "display_name", "touched", F.coalesce("amount", F.lit(0)).alias("amount")).orderBy(F.col("touched").desc(), F.col("id").desc())


def bindable_senders(senders: DataFrame, bindings: DataFrame, contacts: DataFrame, messages: DataFrame, contact_id: int, keyword: str | None = None) -> DataFrame:
    """Senders that a contact may bind: not oneself, not its own already; with their present owner and counts."""
    mine = bindings.filter(F.col("contact_id") == contact_id).select(F.col("sender_id").alias("id"))
    rows = senders.filter(~F.col("is_self")).join(mine, "id", "left_anti")
    owner = bindings.select(F.col("sender_id").alias("id"), "contact_id", "account_label").join(contacts.select(F.col("id").alias("contact_id"), F.col("display_name").alias("bound_to")), "contact_id", "left")
    rows = rows.join(owner, "id", "left").join(sender_counts(messages).withColumnRenamed("sender_id", "id"), "id", "left")
    if keyword:
        rows = rows.filter(F.coalesce(T.like(F.col("current_name"), keyword), F.lit(False)) | F.coalesce(T.like(F.col("bound_to"), keyword), F.lit(False)) | F.coalesce(T.like(F.col("account_label"), keyword), F.lit(False)))
    rows = rows.select("id", "platform", "current_name", "bound_to", "account_label", F.coalesce("amount", F.lit(0)).alias("amount"))
    return rows.orderBy(F.col("amount").desc(), F.col("id").desc())


def self_sender(messages: DataFrame) -> DataFrame:
    """(conversation_id, sender_id): the most frequent sender of outgoing rows, ties to the first seen."""
    counts = messages.filter(F.col("direction") == "outgoing").groupBy("conversation_id", "sender_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return counts.groupBy("conversation_id").agg(F.min_by("sender_id", F.struct((-F.col("n")).alias("n"), "first")).alias("sender_id"))


# Bindings as copy-on-write frames.


def promote_primary(bindings: DataFrame) -> DataFrame:
    """Contacts without a primary sender get the least sender id as theirs."""
    least = bindings.groupBy("contact_id").agg(F.min("sender_id").alias("least"), F.max(F.col("is_primary").cast("int")).alias("has"))
    return bindings.join(least, "contact_id").select("contact_id", "sender_id", "account_label", (F.col("is_primary") | ((F.col("has") == 0) & (F.col("sender_id") == F.col("least")))).alias("is_primary"))


def rebind(bindings: DataFrame, moves: DataFrame, force: bool = False) -> DataFrame:
    """Bindings after ``moves`` (sender_id, contact_id, account_label, is_primary).

    A sender has one owner: a move to another contact fails unless forced. A
    new primary sender takes the place of the old one.
    """
    moves = moves.select("sender_id", F.col("contact_id").alias("to"), F.col("account_label").alias("label"), F.col("is_primary").alias("first"))
    joined = bindings.join(moves, "sender_id", "full")
    if not force:
        clash = F.col("to").isNotNull() & F.col("contact_id").isNotNull() & (F.col("to") != F.col("contact_id"))
        joined = joined.withColumn("to", F.when(clash, F.raise_error(F.lit("the sender belongs to another contact"))).otherwise(F.col("to")))
    moved = joined.select(F.coalesce("to", "contact_id").alias("contact_id"), "sender_id", F.coalesce("label", "account_label").alias("account_label"), F.coalesce("first", "is_primary").alias("is_primary"), F.coalesce("first", F.lit(False)).alias("new_first"))
    taken = moved.filter("new_first").groupBy("contact_id").agg(F.max("sender_id").alias("chosen"))
    rows = moved.join(taken, "contact_id", "left")
    primary = F.when(F.col("chosen").isNotNull(), F.col("sender_id") == F.col("chosen")).otherwise(F.col("is_primary"))
    return promote_primary(rows.select("contact_id", "sender_id", "account_label", primary.alias("is_primary")))


def unbind(bindings: DataFrame, senders: DataFrame) -> DataFrame:
    """Bindings without the given senders; a contact that loses its primary one gets another."""
    return promote_primary(bindings.join(senders.select("sender_id"), "sender_id", "left_anti"))


def prune(contacts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Contacts that have a binding, a note or a picture of their own."""
    bound = bindings.select(F.col("contact_id").alias("id")).distinct().withColumn("bound", F.lit(True))
    extras = [F.coalesce(F.length(c) > 0, F.lit(False)) for c in ("note", "custom_avatar_path") if c in contacts.columns]
    keep = F.coalesce("bound", F.lit(False))
    for e in extras:
        keep = keep | e
    return contacts.join(bound, "id", "left").filter(keep).drop("bound")


# The life cycle of a contact: (contacts, bindings) in, (contacts, bindings) out. Each call is about one contact.


def _touched(contacts: DataFrame, contact_id: int, at: str) -> DataFrame:
    return contacts.withColumn("updated_at", F.when(F.col("id") == contact_id, F.lit(at)).otherwise(F.col("updated_at")))


def _name(display_name: str | None) -> str:
    if not (display_name or "").strip():
        raise ValueError("a contact needs a name")
    return display_name.strip()


def create_contact(contacts: DataFrame, contact_id: int, token: str, display_name: str, at: str, custom_avatar_path: str | None = None, note: str | None = None) -> DataFrame:
    """``contacts`` (id, identity_token, display_name, custom_avatar_path, note, updated_at) and a new one; a blank name is an error."""
    row = [(contact_id, token, _name(display_name), custom_avatar_path, note, at)]
    return contacts.unionByName(contacts.sparkSession.createDataFrame(row, "id long, identity_token string, display_name string, custom_avatar_path string, note string, updated_at string"))


def update_contact(contacts: DataFrame, contact_id: int, display_name: str, at: str, custom_avatar_path: str | None = None, note: str | None = None) -> DataFrame:
    new = {"display_name": _name(display_name), "custom_avatar_path": custom_avatar_path, "note": note, "updated_at": at}
    return contacts.withColumns({c: F.when(F.col("id") == contact_id, F.lit(v)).otherwise(F.col(c)) for c, v in new.items()})


def delete_contact(contacts: DataFrame, bindings: DataFrame, contact_id: int) -> tuple[DataFrame, DataFrame]:
    """Without the contact and its bindings; senders and messages stay."""
    return contacts.filter(F.col("id") != contact_id), bindings.filter(F.col("contact_id") != contact_id)


def bind(
    contacts: DataFrame, bindings: DataFrame, senders: DataFrame, contact_id: int, sender_id: int, at: str, label: str | None = None, primary: bool = False,
    force: bool = False, unbound: bool = False, source: int | None = None, token: str | None = None, source_token: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Binds a sender to a contact.

    A sender has one owner: another contact's sender is an error unless ``force`` is set, or ``source`` names that contact
    (a transfer). With ``unbound`` any owner is an error. Given tokens must still be those of the target and the source.
    Binding to the same contact sets label and flag. A contact that loses its primary sender gets another, and one that
    loses its last stays only with a note or a picture.
    """
    target = contacts.filter(F.col("id") == contact_id).select("identity_token").first()
    if target is None:
        raise KeyError(f"no contact {contact_id}")
    if token is not None and target[0] != token:
        raise ValueError("the target contact has changed")
    if senders.filter(F.col("id") == sender_id).limit(1).count() == 0:
        raise KeyError(f"no sender {sender_id}")
    owner = bindings.filter(F.col("sender_id") == sender_id).join(contacts.select(F.col("id").alias("contact_id"), "identity_token"), "contact_id").select("contact_id", "identity_token").first()
    if unbound and owner is not None:
        raise ValueError("the sender has an owner by now")
    if source is not None and (owner is None or owner[0] != source or owner[0] == contact_id or (source_token is not None and owner[1] != source_token)):
        raise ValueError("the source contact has changed")
    if source is None and owner is not None and owner[0] != contact_id and not force:
        raise ValueError(f"the sender belongs to contact {owner[0]}")
    row = bindings.sparkSession.createDataFrame([(contact_id, sender_id, label, primary)], "contact_id long, sender_id long, account_label string, is_primary boolean")
    rest = bindings.filter(F.col("sender_id") != sender_id)
    if primary:
        rest = rest.withColumn("is_primary", F.col("is_primary") & (F.col("contact_id") != contact_id))
    if owner is not None and owner[0] != contact_id:
        left = rest.filter(F.col("contact_id") == owner[0])
        rest = rest.filter(F.col("contact_id") != owner[0]).unionByName(promote_primary(left))
        gone = F.col("id") == owner[0]
        bare = ~F.coalesce(F.length("note") > 0, F.lit(False)) & ~F.coalesce(F.length("custom_avatar_path") > 0, F.lit(False))
        if left.limit(1).count() == 0:
            contacts = contacts.filter(~(gone & bare))
        contacts = _touched(contacts, owner[0], at)
    return _touched(contacts, contact_id, at), rest.unionByName(row)


def set_label(contacts: DataFrame, bindings: DataFrame, contact_id: int, sender_id: int, label: str | None, at: str) -> tuple[DataFrame, DataFrame]:
    here = (F.col("contact_id") == contact_id) & (F.col("sender_id") == sender_id)
    return _touched(contacts, contact_id, at), bindings.withColumn("account_label", F.when(here, F.lit(label)).otherwise(F.col("account_label")))


def set_primary(contacts: DataFrame, bindings: DataFrame, contact_id: int, sender_id: int, at: str) -> tuple[DataFrame, DataFrame]:
    here = F.col("contact_id") == contact_id
    return _touched(contacts, contact_id, at), bindings.withColumn("is_primary", F.when(here, F.col("sender_id") == sender_id).otherwise(F.col("is_primary")))
