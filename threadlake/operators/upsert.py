"""Upserts and repair as frames in, frames out: read version v, compute v + 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.operators.tables import kept


def is_default(account: Column) -> Column:
    return F.lower(account).endswith("-default")


ACCOUNT = ["platform", "account_id", "native_id"]


def numbered(rows: DataFrame, order: list[str], after: Column) -> DataFrame:
    """``rows`` with a column ``new_id`` that counts on from ``after`` in order: a sort, and one count for each partition."""
    placed = kept(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = {r["p"]: r["count"] for r in placed.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()}
    before, done = {}, 0
    for p in sorted(sizes):
        before[p], done = done, done + sizes[p]
    base = F.try_element_at(F.create_map(*(F.lit(x) for pair in (before or {0: 0}).items() for x in pair)), F.shiftright("_at", 33))
    return placed.withColumn("new_id", (after + base + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("bigint")).drop("_at")


def _owned(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` (one row a key of ``ACCOUNT``, with ``seq``) and the id that it goes on with: its own, that of the least default row, which one account may adopt, or a new one.

    ``state`` is known, upgraded or new.
    """
    key = ["platform", "native_id"]
    exact = stored.select(*ACCOUNT, F.col("id").alias("exact_id"))
    default = stored.filter(is_default(F.col("account_id"))).groupBy(*key).agg(F.min("id").alias("default_id"))
    joined = incoming.join(exact, ACCOUNT, "left").join(default, key, "left")
    may = F.col("exact_id").isNull() & ~is_default(F.col("account_id")) & F.col("default_id").isNotNull()
    adopter = joined.filter(may).groupBy(*key).agg(F.min_by("account_id", "seq").alias("adopter"))
    joined = joined.join(adopter, key, "left").withColumn("adopts", may & F.coalesce(F.col("account_id") == F.col("adopter"), F.lit(False)))
    found = joined.withColumn("id", F.coalesce("exact_id", F.when(F.col("adopts"), F.col("default_id"))))
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    new = numbered(found.filter("id is null").select(*ACCOUNT, "seq"), ["seq", *ACCOUNT], F.lit(top).cast("bigint"))
    state = F.when(F.col("exact_id").isNotNull(), "known").when(F.col("adopts"), "upgraded").otherwise("new")
    placed = found.join(new.select(*ACCOUNT, "new_id"), ACCOUNT, "left").withColumn("state", state).withColumn("id", F.coalesce("id", "new_id"))
    return placed.drop("exact_id", "default_id", "adopter", "adopts", "new_id")


def sender_upsert(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Senders (id, platform, account_id, native_id, current_name, is_self, first_seen, last_seen) after the rows of an import.

    A sender is one account's native id; an account's first import adopts the least default row of the id. The latest
    name that is not empty wins, but on wechat a placeholder (equal to the native id) never replaces a real one; is_self
    stays once set, and the span of sightings grows. New senders count on from the largest id, by first sighting.
    """
    placeholder = (F.col("platform") == "wechat") & (F.col("name") == F.col("native_id"))
    real = F.when((F.col("name") != "") & ~placeholder, F.col("name"))
    news = seen.withColumn("real", real).groupBy(*ACCOUNT).agg(
        F.min("seq").alias("seq"), F.max_by("real", F.when(F.col("real").isNotNull(), F.col("seq"))).alias("new_name"), F.max(F.when(placeholder, F.col("name"))).alias("shown"),
        F.max("is_self").alias("new_self"), F.min("timestamp_ms").alias("new_first"), F.max("timestamp_ms").alias("new_last"),
    )
    placed = _owned(stored, news).withColumnsRenamed({"platform": "p", "account_id": "a", "native_id": "n"}).drop("seq", "state")
    joined = stored.join(placed, "id", "full")
    return joined.select(
        "id", F.coalesce("p", "platform").alias("platform"), F.coalesce("a", "account_id").alias("account_id"), F.coalesce("n", "native_id").alias("native_id"),
        F.coalesce("new_name", "current_name", "shown", F.lit("")).alias("current_name"),
        F.coalesce(F.greatest("is_self", "new_self"), F.lit(False)).alias("is_self"),
        F.least("first_seen", "new_first").alias("first_seen"),
        F.greatest("last_seen", "new_last").alias("last_seen"),
    )


def conversation_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(platform, native_id, account_id, id, kind, title, state) of the imported conversations (one row an account and native id, in order of ``seq``).

    Exact account first, else the least default row is adopted and upgraded, by one account. A known title stays unless
    it is the native id; an upgrade takes the new one; an empty title replaces none.
    """
    placed = _owned(stored, incoming)
    old = placed.join(stored.select("id", F.col("title").alias("old")), "id", "left")
    takes = (F.col("title") != "") & ((F.col("old") == F.col("native_id")) | (F.col("state") == "upgraded"))
    title = F.when(F.col("old").isNull() | takes, F.col("title")).otherwise(F.col("old"))
    return old.select("platform", "native_id", "account_id", "id", "kind", title.alias("title"), "state")


def attachment_merge(target: DataFrame, source: DataFrame) -> DataFrame:
    """One attachment for each (message_id, ordinal): an available one, then one with media, then the target's."""
    both = target.withColumn("is_target", F.lit(True)).unionByName(source.withColumn("is_target", F.lit(False)))
    best = F.struct(F.col("is_available"), F.col("media_id").isNotNull().alias("has_media"), F.col("is_target"), F.coalesce("media_id", F.lit(0)).alias("media_tie"))
    rest = [c for c in target.columns if c not in ("message_id", "ordinal")]
    return both.groupBy("message_id", "ordinal").agg(F.max_by(F.struct(*rest), best).alias("row")).select("message_id", "ordinal", "row.*")


def attachment_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Attachments after an import: found files become available, lost ones lose the flag but keep their paths."""
    new = incoming.select("message_id", "ordinal", F.col("source_path").alias("new_path"), F.col("exists").alias("found"), F.col("media_id").alias("new_media"))
    joined = stored.join(new, ["message_id", "ordinal"], "full")
    available = F.when(F.col("found").isNull(), F.col("is_available")).otherwise(F.col("found"))
    return joined.select("message_id", "ordinal", F.coalesce("new_path", "source_path").alias("source_path"), F.coalesce(available, F.lit(False)).alias("is_available"), F.coalesce("new_media", "media_id").alias("media_id"))


def media_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Media by digest: the first path and type stay, unknown digests are added once."""
    first = incoming.groupBy("sha256").agg(F.min_by(F.struct("managed_path", "mime_type", "size"), "seq").alias("f"))
    joined = stored.join(first, "sha256", "full")
    return joined.select("sha256", *(F.coalesce(c, F.col(f"f.{c}")).alias(c) for c in ("managed_path", "mime_type", "size")))


def duplicate_groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("amount")).filter("amount > 1")


def canonical(rows: DataFrame, key: list[str], order: list[Column], id_: str = "id") -> DataFrame:
    """(key..., id, canonical_id): each row's group is led by its first row in order."""
    first = rows.groupBy(*key).agg(F.min_by(id_, F.struct(*order)).alias("canonical_id"))
    return rows.select(*key, id_).join(first, key)


def fold_map(rows: DataFrame, key: list[str], account: str = "account_id", first: list[Column] | None = None) -> DataFrame:
    """(id, canonical_id) of the rows that a repair folds.

    Two real accounts under one key stay apart (only their defaults fold, if
    there are several); one real account takes in the defaults; without a real
    one, all fold.
    """
    real = ~is_default(F.col(account))
    sizes = rows.groupBy(*key).agg(F.count_if(real).alias("reals"), F.count_if(~real).alias("defaults"))
    joined = rows.join(sizes, key)
    takes_part = F.when(F.col("reals") >= 2, ~real & (F.col("defaults") > 1)).when(F.col("reals") == 1, F.col("defaults") >= 1).otherwise(F.col("defaults") > 1)
    part = joined.filter(takes_part)
    order = [*(first or []), is_default(F.col(account)).cast("int").alias("d"), F.col("id").alias("i")]
    return canonical(part, key, order).select("id", "canonical_id")


def reassigned(messages: DataFrame, senders: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages with the senders and conversations of the fold maps put in place."""
    s = senders.select(F.col("id").alias("sender_id"), F.col("canonical_id").alias("new_sender"))
    c = conversations.select(F.col("id").alias("conversation_id"), F.col("canonical_id").alias("new_conversation"))
    joined = messages.join(s, "sender_id", "left").join(c, "conversation_id", "left")
    return joined.withColumns({"sender_id": F.coalesce("new_sender", "sender_id"), "conversation_id": F.coalesce("new_conversation", "conversation_id")}).drop("new_sender", "new_conversation")


def merged_messages(messages: DataFrame) -> DataFrame:
    """Of equal messages (native id or meaning, and payload) the one with the least id."""
    key = ["conversation_id", F.coalesce(F.concat(F.lit("n:"), F.col("native_id")), F.concat(F.lit("s:"), F.col("semantic_hash"))).alias("meet"), "payload_hash"]
    keep = messages.groupBy(*key).agg(F.min("id").alias("id")).select("id")
    return messages.join(keep, "id", "left_semi")


def merged_aliases(aliases: DataFrame, key: list[str]) -> DataFrame:
    """Aliases once each, with the earliest and latest sighting (nulls aside)."""
    return aliases.groupBy(*key, "alias").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def without_messages(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations that no message belongs to."""
    return conversations.join(messages.select(F.col("conversation_id").alias("id")).distinct(), "id", "left_anti")


def cascade(rows: DataFrame, parent: str, deleted: DataFrame) -> DataFrame:
    """Rows whose parent was not deleted."""
    return rows.join(deleted.select(F.col("id").alias(parent)), parent, "left_anti")


def set_null(rows: DataFrame, reference: str, deleted: DataFrame) -> DataFrame:
    """Rows with references to deleted rows emptied."""
    gone = deleted.select(F.col("id").alias(reference)).distinct().withColumn("gone", F.lit(True))
    return rows.join(gone, reference, "left").withColumn(reference, F.when(F.col("gone").isNull(), F.col(reference))).drop("gone").select(*rows.columns)


def unique_key_join(messages: DataFrame, resources: DataFrame, key: list[str]) -> DataFrame:
    """Resources attached to messages by a key that exactly one message has; ordinals in row order."""
    trimmed = [F.trim(F.col(k).cast("string")).alias(k) for k in key]
    single = messages.select("message_id", *trimmed).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("message_id").alias("message_id")).filter("n = 1").drop("n")
    joined = resources.select("row", *trimmed).join(single, key)
    return joined.withColumn("ordinal", (F.row_number().over(Window.partitionBy("message_id").orderBy("row")) - 1).cast("bigint")).select("message_id", "ordinal", "row")
