"""Continuous import, of export files of every format or of JSON-lines messages: each batch runs the same deduplication as a full import.

The archive decides by payload (of files: by content), so a batch that is
delivered twice changes no message: with checkpoints the effect is exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadlake.operators.dedup import dedup_state
from threadlake.operators.importing import import_into, stored
from threadlake.operators.store import Archive

SCHEMA = "conversation_id string, native_id string, timestamp_ms long, content string"
TABLE, REJECTED = "messages", "rejected"
FILES = "path string, modificationTime timestamp, length long, content binary"


def new_rows(stored: DataFrame | None, batch: DataFrame, start: int) -> DataFrame:
    """The batch's new messages and revisions, numbered from ``start`` in the order of their times; rows without a native id count by their payload."""
    rows = batch.withColumn("payload_hash", F.sha2(F.to_json(F.struct("conversation_id", "native_id", "timestamp_ms", "content")), 256))
    once = rows.dropDuplicates(["conversation_id", "payload_hash"])
    if stored is not None:
        once = once.join(stored.select("conversation_id", "payload_hash"), ["conversation_id", "payload_hash"], "left_anti")
    # Numbers of sorted partitions rise in their order, without a gathering of all rows.
    numbered = once.orderBy("timestamp_ms", "payload_hash").withColumn("seq", F.lit(start) + F.monotonically_increasing_id())
    return numbered.select("seq", "conversation_id", "native_id", "timestamp_ms", "content", "payload_hash")


def stream_into(spark: SparkSession, source: str, archive: Archive, checkpoint: str) -> StreamingQuery:
    """Imports what lies in ``source`` and what comes; stops when it has seen all (for tests and scheduled runs).

    A batch appends its own rows; rows without a conversation or a time go to the table ``rejected``, each once.
    """

    def import_batch(batch: DataFrame, number: int) -> None:
        fits = F.col("conversation_id").isNotNull() & F.col("timestamp_ms").isNotNull()
        stored = archive.read(TABLE) if archive.version() else None
        refused = batch.filter(~fits).dropDuplicates()
        if archive.version():  # a replay refuses the same rows
            known = archive.read(REJECTED)
            refused = refused.alias("new").join(known.alias("known"), F.expr(" and ".join(f"known.{c} <=> new.{c}" for c in refused.columns)), "left_anti")
        tables = {TABLE: new_rows(stored, batch.filter(fits), (number + 1) << 46), REJECTED: refused}
        archive.commit(tables, f"batch {number}", append=(TABLE, REJECTED))

    stream = spark.readStream.schema(SCHEMA).json(source)
    return stream.writeStream.foreachBatch(import_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def waiting(runs: DataFrame, came: DataFrame) -> DataFrame:
    """(path) of exports imported before that new files (path) may complete: in a folder above these, and last seen without some of their media, or without a chunk that their manifest names."""
    last = runs.filter("status <> 'skipped'").groupBy("path").agg(F.max_by(F.struct("status", "reader", "missing_media"), "run").alias("r"))
    lacks = last.filter("r.missing_media > 0 or (r.status = 'failed' and r.reader = 'qq_chunked')").select("path", _folder(F.col("path")).alias("folder"))
    parts = F.split(_folder(F.col("path")), "/")
    above = came.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder")).distinct()
    return lacks.join(above, "folder", "left_semi").select("path")


def stream_exports(spark: SparkSession, source: str, archive: Archive, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Imports the exports that lie below ``source`` and those that come, of all formats; stops when it has seen all.

    A batch is an import of its own files, and of exports that lacked what now came (``waiting``). Only names of files
    reach the driver, ``files_a_batch`` of new ones at most. Files that are no exports change nothing; broken ones are
    failed in the table ``runs`` and hold up no others.
    """

    def import_batch(batch: DataFrame, number: int) -> None:
        came = batch.select("path").distinct()
        again = waiting(stored(archive, "runs"), came)
        paths = sorted(r["path"] for r in came.union(again).distinct().collect())
        if paths:
            import_into(archive, source, among=paths)

    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(source).select("path")
    return stream.writeStream.foreachBatch(import_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(archive: Archive) -> DataFrame:
    """(seq, state, target) of the archive's messages."""
    return dedup_state(archive.read(TABLE))


def activity(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(start, message_type, amount) of a stream of messages with a time ``ts``; rows later than ``late`` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "message_type").agg(F.count(F.lit(1)).alias("amount")).select(F.col("window.start").alias("start"), "message_type", "amount")
