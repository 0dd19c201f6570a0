"""The import of a folder of exports into an archive, as one incremental merge and one commit.

Files are told apart and read once, each by its one reader; what they hold is
kept as a table, so that every later step starts from the same rows. A file
counts as a whole: one that is malformed, or has no message that can be stored,
is failed and leaves nothing behind; the others go on. Files whose content was
imported before are skipped unless their media were missing or their reader has
changed. Conversations and senders are upserted by account; messages meet what
the archive holds of the same conversations by the version rule, in the order
of files and places in them; attachments merge by state. The result of a run is
a row for each file.

Only the touched conversations' messages are read back. New messages are
appended; stored ones are written again only if duplicates refresh them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators import media as M
from threadlake.operators.dedup import fold_state, reimport_needed
from threadlake.operators.store import Archive
from threadlake.operators.tables import kept
from threadlake.operators.upsert import ACCOUNT, conversation_upsert, numbered, sender_upsert
from threadlake.sources import exports as E

PARSER_VERSION = 5
CONVERSATIONS = "id bigint, platform string, account_id string, native_id string, kind string, title string, first_at bigint, last_at bigint, amount bigint"
SENDERS = "id bigint, platform string, account_id string, native_id string, current_name string, is_self boolean, first_seen bigint, last_seen bigint"
ALIASES = "sender_id bigint, conversation_id bigint, alias string, first_seen bigint, last_seen bigint"
REFRESHED = ("sender_id", "direction", "message_type", "content", "search_text", "sender_name", "is_recalled", "reply_to", "payload_hash", "semantic_hash")
MESSAGES = (
    "seq bigint, conversation_id bigint, sender_id bigint, platform string, native_id string, local_id string, timestamp_ms bigint, direction string, message_type string, content string, search_text string, sender_name string, "
    "is_recalled boolean, reply_to string, payload_hash string, semantic_hash string, revision_of bigint"
)
OBSERVATIONS = "message_id bigint, sha256 string, source_locator string, payload_hash string"
ATTACHMENTS = "message_id bigint, ordinal bigint, kind string, filename string, declared string, source string, is_available boolean, mime string, size bigint, width int, height int, duration double, metadata string"
RUNS = "run int, path string, sha256 string, reader string, platform string, status string, error string, parser_version int, messages_seen bigint, added bigint, duplicates bigint, revised bigint, variants bigint, attachments bigint, missing_media bigint"
TABLES = {"conversations": CONVERSATIONS, "senders": SENDERS, "aliases": ALIASES, "messages": MESSAGES, "observations": OBSERVATIONS, "attachments": ATTACHMENTS, "runs": RUNS}
#: Room for messages of one file in the order of a run.
PLACES = 1 << 40


def stored(archive: Archive, table: str) -> DataFrame:
    """A table of the archive; empty before its first commit."""
    if archive.version():
        return archive.read(table)
    return archive.spark.createDataFrame([], TABLES[table])


def _like(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the columns and types of a table."""
    fields = [f.rsplit(" ", 1) for f in TABLES[table].split(", ")]
    return df.select(*(F.col(name).cast(kind).alias(name) for name, kind in fields))


def digests(spark: SparkSession, files: DataFrame, pack: E.Pack | None = None) -> DataFrame:
    """(path, sha256) of sniffed files (of a ``pack``): of the bytes, for a chunked export of its manifest and of all its chunks in order.

    Chunks are hashed by themselves, in parallel; only their digests come together.
    """
    if pack is not None:
        listed = E.chunks(spark, pack.chunked(files.filter("reader = 'qq_chunked'"))).filter("chunk is not null")
        wanted = listed.filter("error is null").select(F.col("chunk").alias("path")).distinct()
        return _digests(files, pack.files, listed, pack.files.join(wanted, "path", "left_semi").withColumn("length", F.octet_length("content").cast("long")))
    paths = [r["path"] for r in files.filter(F.col("size") < E.BIGGEST).select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "path string, sha256 string")
    manifests = [r["path"] for r in files.filter("reader = 'qq_chunked'").select("path").collect()]
    whole = spark.read.format("binaryFile").load(paths).select("path", "content")
    if not manifests:
        return _plain(files, whole)
    listed = E.chunks(spark, manifests).filter("chunk is not null")
    return _digests(files, whole, listed, spark.read.format("binaryFile").load([r["chunk"] for r in listed.filter("error is null").select("chunk").distinct().collect()] or manifests))


def _plain(files: DataFrame, whole: DataFrame) -> DataFrame:
    return whole.join(files.filter("reader is null or reader <> 'qq_chunked'").select("path"), "path", "left_semi").select("path", F.sha2("content", 256).alias("sha256"))


def _digests(files: DataFrame, whole: DataFrame, listed: DataFrame, chunks: DataFrame) -> DataFrame:
    """``digests`` of files with the contents ``whole`` (path, content) and ``listed`` chunks with theirs (path, content, length)."""
    hashed = chunks.select(F.col("path").alias("chunk"), F.sha2("content", 256).alias("digest"), "length")
    relative = F.substr(F.col("chunk"), F.length("folder") + 2)
    lines = listed.join(hashed, "chunk").withColumn("line", F.concat(F.lit("\nchunk:"), relative, F.lit(":"), F.col("length").cast("string"), F.lit(":"), "digest", F.lit("\n")))
    rest = lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "").alias("rest"))
    chunked = whole.join(files.filter("reader = 'qq_chunked'").select("path"), "path", "left_semi").join(rest, "path", "left")
    return _plain(files, whole).unionByName(chunked.select("path", F.sha2(F.concat("content", F.encode(F.coalesce("rest", F.lit("")), "UTF-8")), 256).alias("sha256")))


def _ledger(archive: Archive) -> DataFrame:
    """(sha256, status, parser_version, missing_media) of the last time a content was imported."""
    runs = stored(archive, "runs").filter("status = 'completed'")
    return runs.groupBy("sha256").agg(F.max_by(F.struct("status", "parser_version", "missing_media"), "run").alias("r")).select("sha256", "r.*")


def _with_ids(rows: DataFrame, upserted: DataFrame, key: list[str], name: str) -> DataFrame:
    return rows.join(upserted.select(*key, F.col("id").alias(name)), key)


def import_into(archive: Archive, root: E.Root, excluded: tuple[str, ...] = (), among: list[str] | None = None) -> DataFrame:
    """Imports what lies below the folders, or in a pack (only the files ``among`` them, if given) and commits it as one version; returns the run's rows of ``RUNS``, one for each file.

    An empty folder commits nothing but an empty run. Of two imports at once one gets a ``Conflict`` and changes nothing.
    """
    spark = archive.spark
    run = (stored(archive, "runs").agg(F.max("run")).first()[0] or 0) + 1
    told = E.sniffed(spark, root, excluded, among)
    files = kept(told.join(digests(spark, told, root if isinstance(root, E.Pack) else None), "path", "left"), "import-files")
    # Of files with the same content one is read: the first of them.
    first = files.groupBy("sha256").agg(F.min(F.lower("path")).alias("least"))
    once = files.join(first, "sha256").withColumn("again", F.lower("path") != F.col("least")).drop("least")
    needed = reimport_needed(once.filter("error is null and not again"), _ledger(archive), PARSER_VERSION).select("path", F.lit(True).alias("reads"))
    files = kept(once.join(needed, "path", "left").withColumn("reads", F.coalesce("reads", F.lit(False))), "import-files")
    reading = files.filter("reads")
    numbers = numbered(reading.select("path", F.lower("path").alias("least")), ["least", "path"], F.lit(-1)).select("path", F.col("new_id").alias("number"))
    listing = E._paths(spark, root).select("path")
    messages = E.read_all(spark, root, files=reading.select(*(c.split()[0] for c in E.FILES.split(", "))))
    # Each step starts from a table: their expressions are long, and are planned (and compiled) by themselves.
    messages = kept(messages.drop(*E.DIGESTS), "import-read")
    messages = kept(M.resolve(messages, listing), "import-resolved")
    messages = M.with_missing(E.hashed(messages))
    base = stored(archive, "messages").agg(F.max("seq")).first()[0] or 0
    base = (base // PLACES + 1) * PLACES
    messages = messages.join(numbers, "path", "left").withColumn("seq", F.lit(base) + F.col("number") * PLACES + F.col("position"))
    messages = kept(messages.drop("number"), "import-messages")
    # A file counts as a whole.
    sound = E.valid(messages)
    seen = sound.groupBy("path").agg(F.count(F.lit(1)).alias("messages_seen"), F.max("platform").alias("platform"))
    broken = messages.filter("error is not null").groupBy("path").agg(F.max("error").alias("broken"))
    states = kept(files.join(seen, "path", "left").join(broken, "path", "left"), "import-states")
    failed = F.coalesce("error", "broken", F.when(F.col("reads") & F.col("messages_seen").isNull(), "no message that can be stored"))
    states = states.withColumn("why", failed).withColumn("status", F.when(F.col("why").isNotNull(), "failed").when(F.col("reads"), "completed").otherwise("skipped"))
    rows = sound.join(states.filter("status = 'completed'").select("path", "sha256"), "path")
    # Conversations, then senders, by account.
    key = ["platform", "account_id", "conversation_id"]
    chats = rows.groupBy(*key).agg(F.min_by("kind", "seq").alias("kind"), F.min_by("title", "seq").alias("title"), F.min("seq").alias("seq")).withColumnRenamed("conversation_id", "native_id")
    old_chats, old_senders = stored(archive, "conversations"), stored(archive, "senders")
    upserted = kept(conversation_upsert(old_chats.select("id", *ACCOUNT, "title"), chats), "import-conversations")
    rows = _with_ids(rows.withColumnRenamed("conversation_id", "chat"), upserted.withColumnRenamed("native_id", "chat"), ["platform", "account_id", "chat"], "conversation_id")
    sightings = rows.select("platform", "account_id", F.col("sender_id").alias("native_id"), F.col("sender_name").alias("name"), "seq", (F.col("direction") == "outgoing").alias("is_self"), "timestamp_ms")
    senders = kept(_like(sender_upsert(old_senders, sightings), "senders"), "import-senders")
    rows = _with_ids(rows.withColumnRenamed("sender_id", "who"), senders.withColumnRenamed("native_id", "who"), ["platform", "account_id", "who"], "sender_id")
    rows = kept(rows, "import-rows")
    # The version rule, among the stored messages of the same conversations and the new ones.
    old_messages = stored(archive, "messages")
    touched = old_messages.join(rows.select("conversation_id").distinct(), "conversation_id", "left_semi")
    met = ["conversation_id", "native_id", "local_id", "semantic_hash", "payload_hash", "compatible", "seq", "platform", "known"]
    known = touched.withColumn("compatible", F.array().cast("array<string>")).withColumn("known", F.lit(True)).select(*met)
    state = kept(fold_state(known.unionByName(rows.withColumn("known", F.lit(False)).select(*met))), "import-state")
    judged = kept(rows.join(state.withColumnRenamed("state", "verdict"), "seq"), "import-judged")
    new = _like(judged.filter("verdict <> 'duplicate'").withColumn("revision_of", F.when(F.col("verdict") == "revision", F.col("target"))), "messages")
    fresh = judged.filter("verdict = 'duplicate'").groupBy("target").agg(F.max_by(F.struct(*REFRESHED), "seq").alias("f"))
    every = old_messages.unionByName(new)
    refreshed = every.join(fresh, every["seq"] == fresh["target"], "left").select(*(F.coalesce(F.col(f"f.{c}"), F.col(c)).alias(c) if c in REFRESHED else F.col(c) for c in every.columns))
    # What hangs on messages goes by the message that they became.
    placed = judged.withColumn("message_id", F.when(F.col("verdict") == "duplicate", F.col("target")).otherwise(F.col("seq")))
    locator = F.concat(F.lit("message:"), F.col("position").cast("string"))
    observations = placed.select("message_id", "sha256", locator.alias("source_locator"), "payload_hash").dropDuplicates(["message_id", "sha256", "source_locator"])
    observations = observations.join(stored(archive, "observations").select("message_id", "sha256", "source_locator"), ["message_id", "sha256", "source_locator"], "left_anti")
    given = placed.select("message_id", "seq", "path", F.explode("attachments").alias("a")).select("message_id", "seq", "path", "a.*").withColumn("is_available", F.col("exists"))
    attachments = merged_attachments(stored(archive, "attachments"), given)
    named = placed.select("sender_id", "conversation_id", "timestamp_ms", F.explode(F.array_union(F.array("sender_name"), "aliases")).alias("alias")).filter("length(alias) > 0")
    aliases = stored(archive, "aliases").unionByName(named.select("sender_id", "conversation_id", "alias", F.col("timestamp_ms").alias("first_seen"), F.col("timestamp_ms").alias("last_seen")))
    aliases = aliases.groupBy("sender_id", "conversation_id", "alias").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    # Conversations with the span and number of their messages.
    added = new.groupBy("conversation_id").agg(F.min("timestamp_ms").alias("new_first"), F.max("timestamp_ms").alias("new_last"), F.count(F.lit(1)).alias("new_amount"))
    now = upserted.select("id", *(F.col(c).alias(f"new_{c}") for c in (*ACCOUNT, "kind", "title")))
    chats = old_chats.join(now, "id", "full").join(added, F.col("id") == F.col("conversation_id"), "left")
    conversations = chats.select(
        "id", *(F.coalesce(f"new_{c}", c).alias(c) for c in ACCOUNT), F.coalesce("kind", "new_kind").alias("kind"), F.coalesce("new_title", "title").alias("title"), F.least("first_at", "new_first").alias("first_at"),
        F.greatest("last_at", "new_last").alias("last_at"), (F.coalesce("amount", F.lit(0)) + F.coalesce("new_amount", F.lit(0))).alias("amount"),
    )
    # The run's row of each file.
    count = lambda verdict: F.count_if(F.col("verdict") == verdict)
    missing = F.count_if(~F.coalesce("is_available", F.lit(False)))
    media = given.join(attachments.select("message_id", "ordinal", F.col("is_available").alias("available")), ["message_id", "ordinal"], "left").withColumn("is_available", F.col("available")).groupBy("path").agg(F.count(F.lit(1)).alias("attachments"), missing.alias("missing_media"))
    counted = judged.groupBy("path").agg((F.count(F.lit(1)) - count("duplicate")).alias("added"), count("duplicate").alias("duplicates"), count("revision").alias("revised"), count("variant").alias("variants")).join(media, "path", "left")
    zero = lambda c: F.when(F.col("status") == "completed", F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    result = states.join(counted, "path", "left").select(
        F.lit(run).alias("run"), "path", "sha256", "reader", "platform", "status", F.col("why").alias("error"), F.lit(PARSER_VERSION).alias("parser_version"), *(zero(c) for c in ("messages_seen", "added", "duplicates", "revised", "variants", "attachments", "missing_media")),
    )
    result = kept(_like(result, "runs"), "import-run")
    refreshes = archive.version() > 0 and fresh.limit(1).count() > 0 or judged.filter("verdict = 'duplicate'").limit(1).count() > 0
    tables = {"conversations": conversations, "senders": senders, "aliases": aliases, "observations": observations, "attachments": attachments, "runs": result, "messages": refreshed if refreshes else new}
    grows = ("observations", "runs") if refreshes else ("observations", "runs", "messages")
    archive.commit({t: _like(df, t) for t, df in tables.items()}, f"import {run}", append=grows)
    return result


def merged_attachments(old: DataFrame, given: DataFrame) -> DataFrame:
    """Attachments after an import: a found file takes the place of what was stored; one that is not found leaves a stored one that is there as it is, and only fills in its missing paths; new ones that are not there stay as missing.

    Of several rows for one place the last found one counts, else the last.
    """
    fields = ["kind", "filename", "declared", "source", "is_available", "mime", "size", "width", "height", "duration", "metadata"]
    last = given.groupBy("message_id", "ordinal").agg(F.max_by(F.struct(*fields), F.struct("is_available", "seq")).alias("n"))
    before = old.select("message_id", "ordinal", F.struct(*fields).alias("o"))
    both = before.join(last, ["message_id", "ordinal"], "full")
    taken = F.when(F.col("o").isNull() | F.coalesce(F.col("n.is_available"), F.lit(False)), F.col("n")).otherwise(
        F.col("o").withField("source", F.coalesce("o.source", "n.source")).withField("declared", F.coalesce("o.declared", "n.declared"))
    )
    return both.select("message_id", "ordinal", taken.alias("t")).select("message_id", "ordinal", "t.*")
