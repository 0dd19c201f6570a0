"""Message deduplication: new rows, duplicates, revisions and variants.

Order is explicit (``seq``: run, file, row), so the outcome does not depend on
how Spark schedules anything. Firsts are found by aggregation and joined back:
partial sums shrink hot keys before the shuffle, and the joins can be split.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators.tables import kept


def dedup_state(rows: DataFrame, conversation: str = "conversation_id", native: str = "native_id", payload: str = "payload_hash", seq: str = "seq") -> DataFrame:
    """(seq, state, target) of every row.

    A payload seen before under the same native id is a duplicate of its first
    row; another payload is a revision of the first row of the native id. Rows
    without a native id meet by payload alone.
    """
    met = F.coalesce(F.concat(F.lit("n:"), F.col(native)), F.concat(F.lit("p:"), F.col(payload)))
    keyed = rows.select(seq, conversation, payload, met.alias("met"))
    key = [conversation, "met"]
    by_payload = keyed.groupBy(*key, payload).agg(F.min(seq).alias("first_same"))
    by_native = by_payload.groupBy(*key).agg(F.min("first_same").alias("first_any"))
    joined = keyed.join(by_payload, [*key, payload]).join(by_native, key)
    state = F.when(F.col(seq) > F.col("first_same"), "duplicate").when(F.col(seq) > F.col("first_any"), "revision").otherwise("new")
    target = F.when(F.col(seq) > F.col("first_same"), F.col("first_same")).when(F.col(seq) > F.col("first_any"), F.col("first_any"))
    return joined.select(seq, state.alias("state"), target.alias("target"))


def refreshed(rows: DataFrame, keep: list[str], refresh: list[str], key: list[str], seq: str = "seq") -> DataFrame:
    """One row for each key: ``keep`` columns of its first row, ``refresh`` columns of its last."""
    aggs = [F.min_by(c, seq).alias(c) for c in keep] + [F.max_by(c, seq).alias(c) for c in refresh]
    return rows.groupBy(*key).agg(F.min(seq).alias("id"), *aggs)


STATE = "seq long, state string, target long"


def _meeting(rows: DataFrame) -> DataFrame:
    """(seq, meet): for rows without a native id the least seq that they reach over equal meanings and payloads (their own or compatible ones).

    Each round is two aggregations over (row, hash) links; it ends when no row's label falls.
    """
    tokens = F.array(F.concat(F.lit("s:"), F.col("semantic_hash")), F.concat(F.lit("p:"), F.col("payload_hash")))
    older = F.transform(F.coalesce("compatible", F.array().cast("array<string>")), lambda h: F.concat(F.lit("p:"), h))
    links = rows.filter("native_id is null").select("conversation_id", "seq", F.explode(F.array_distinct(F.concat(tokens, older))).alias("token"))
    links = kept(links, "meeting-links")
    label = links.select("conversation_id", "seq").distinct().withColumn("meet", F.col("seq"))
    while True:
        by_token = links.join(label, ["conversation_id", "seq"]).groupBy("conversation_id", "token").agg(F.min("meet").alias("meet"))
        new = links.join(by_token, ["conversation_id", "token"]).groupBy("conversation_id", "seq").agg(F.min("meet").alias("meet"))
        new = kept(new, "meeting")
        moved = new.join(label.withColumnRenamed("meet", "old"), ["conversation_id", "seq"]).filter("meet < old").limit(1).count()
        label = new
        if not moved:
            return label.select("seq", F.concat(F.lit("m:"), F.col("meet").cast("string")).alias("meet"))


def _versions() -> type:
    """A class that goes to tasks with the function that uses it."""

    class Versions:
        """The stored versions of one message: the first of a payload, meaning or local id is found by a look-up, not a scan.

        Entries of the heaps are places in ``stored``; one that no longer has the payload or meaning is dropped when it comes up.
        """

        def __init__(self) -> None:
            self.stored: list[dict] = []
            self.by = {"payload": {}, "semantic": {}}
            self.by_local: dict[str, int] = {}

        def _first(self, what: str, value) -> int | None:
            heap = self.by[what].get(value)
            while heap and self.stored[heap[0]][what] != value:
                heapq.heappop(heap)
            return heap[0] if heap else None

        def _set(self, place: int, what: str, value) -> None:
            self.stored[place][what] = value
            heapq.heappush(self.by[what].setdefault(value, []), place)

        def _store(self, r: dict) -> None:
            place = len(self.stored)
            self.stored.append({"seq": r["seq"]})
            self._set(place, "payload", r["payload_hash"])
            self._set(place, "semantic", r["semantic_hash"])
            if r["local_id"]:
                self.by_local.setdefault(r["local_id"], place)

        def take(self, r: dict) -> tuple[int, str, int | None] | None:
            """(seq, state, target) of the next row; none of a known one."""
            if r["known"]:
                self._store(r)
                return None
            same = self._first("payload", r["payload_hash"])
            if same is None:
                same = min((p for h in set(r["compatible"] or ()) if (p := self._first("payload", h)) is not None), default=None)
            if same is not None:
                for what, value in (("payload", r["payload_hash"]), ("semantic", r["semantic_hash"])):
                    if self.stored[same][what] != value:
                        self._set(same, what, value)
                return r["seq"], "duplicate", self.stored[same]["seq"]
            # No payload is the same, so a row without a native id meets those of its meaning.
            meant = self._first("semantic", r["semantic_hash"])
            first = meant if r["native_id"] is None else 0 if self.stored else None
            target = None
            if first is not None:
                places = [p for p in (meant, self.by_local.get(r["local_id"]) if r["native_id"] is not None else None) if p is not None]
                target = first if r["platform"] == "qq" else min(places, default=None)
            state = "new" if first is None else "variant" if target is None else "revision"
            found = r["seq"], state, None if target is None else self.stored[target]["seq"]
            self._store(r)
            return found

    return Versions


def fold_state(rows: DataFrame, platform: str | None = None) -> DataFrame:
    """(seq, state, target) by the full rule, for rows (conversation_id, native_id, local_id, semantic_hash, payload_hash, compatible, seq, platform).

    Rows meet by native id, or without one by meaning or payload. Equal payloads, and payloads that an older parser would
    have written, are duplicates, and the stored row takes over the hashes of its duplicate; other rows are revisions
    where the platform or a shared local id or meaning says so, else variants. Sorted rows pass in a stream, of which a
    task holds the distinct versions of one message at a time. ``platform`` stands in where the rows have no such column. Rows marked ``known`` (a column that may be
    missing) are stored already: they are met, but get no state.
    """

    start = _versions()

    def fold(batches):
        key, versions = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if versions is None or (r["conversation_id"], r["meet"]) != key:
                    key, versions = (r["conversation_id"], r["meet"]), start()
                found = versions.take(r)
                if found:
                    out.append(found)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["seq", "state", "target"])

    if platform is not None or "platform" not in rows.columns:
        rows = rows.withColumn("platform", F.lit(platform or "wechat"))
    if "known" not in rows.columns:
        rows = rows.withColumn("known", F.lit(False))
    met = rows.join(_meeting(rows), "seq", "left").withColumn("meet", F.coalesce(F.concat(F.lit("n:"), F.col("native_id")), "meet"))
    met = met.select("conversation_id", "meet", "seq", "native_id", "local_id", "semantic_hash", "payload_hash", "compatible", "platform", "known")
    return met.repartition("conversation_id", "meet").sortWithinPartitions("conversation_id", "meet", "seq").mapInArrow(fold, STATE)


def new_observations(found: DataFrame, known: DataFrame) -> DataFrame:
    """Observations not recorded yet, each (message, file, place) once."""
    key = ["message_id", "import_file_id", "source_locator"]
    return found.dropDuplicates(key).join(known.select(*key), key, "left_anti")


def reimport_needed(files: DataFrame, ledger: DataFrame, parser_version: int = 5, attachments: DataFrame | None = None) -> DataFrame:
    """Files to import: unknown digests, and completed ones that an older parser read or that lack media.

    ``attachments`` (sha256, is_available, source_path, resolves) of the files' messages: an unavailable one, a medium
    without a path and one whose file is not found each ask for the file again.
    """
    done = ledger.filter("status = 'completed'").groupBy("sha256").agg(F.max("parser_version").alias("version"), F.max("missing_media").alias("missing"))
    joined = files.join(done, "sha256", "left")
    again = F.col("version").isNull() | (F.col("version") < parser_version) | (F.col("missing") > 0)
    if attachments is not None:
        lacking = ~F.col("is_available") | (F.coalesce(F.length("source_path"), F.lit(0)) == 0) | ~F.coalesce("resolves", F.lit(False))
        joined = joined.join(attachments.groupBy("sha256").agg(F.max(F.coalesce(lacking, F.lit(True))).alias("lacking")), "sha256", "left")
        again = again | F.coalesce("lacking", F.lit(False))
    return joined.filter(again).drop("version", "missing", "lacking")


def observed(observations: DataFrame, attachments: DataFrame, with_attachments: bool) -> DataFrame:
    """Observations of messages that have attachments, or of those that have none.

    The messages' ids are held in a hash table in each partition; the observations are neither sorted nor gathered.
    """
    return observations.join(attachments.select("message_id").distinct().hint("shuffle_hash"), "message_id", "left_semi" if with_attachments else "left_anti")
