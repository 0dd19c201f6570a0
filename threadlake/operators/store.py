"""The archive as versioned Parquet snapshots, its run ledger, media and search index.

A change reads version v and makes v + 1. Its tables go to folders of their own
and the version counts once its line is in the ledger: a file named after the
version that is created only if there is none, so of two writers that saw the
same version one gets a ``Conflict`` and neither loses what is committed. A
table may also grow by folders, so an append writes no more than its rows.
Everything goes through Spark and its file systems, so any shared store serves.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LEDGER = "version long, note string, committed_at timestamp, folders map<string,array<string>>"


class Conflict(RuntimeError):
    """Another writer has made the version first; read again and retry."""


class Archive:
    """Named tables below one folder of a shared store."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def ledger(self) -> DataFrame:
        """All commits; none before the first."""
        try:
            return self.spark.read.schema(LEDGER).json(f"{self.root}/_versions", mode="DROPMALFORMED").filter("version is not null")
        except AnalysisException:
            return self.spark.createDataFrame([], LEDGER)

    def version(self) -> int:
        return self.ledger().agg(F.max("version")).first()[0] or 0

    def _folders(self, version: int) -> dict[str, list[str]]:
        row = self.ledger().filter(F.col("version") == version).select("folders").first()
        return dict(row["folders"]) if row else {}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/{f}" for f in self._folders(version or self.version())[table]))

    def commit(self, tables: dict[str, DataFrame], note: str = "", carry: tuple[str, ...] = (), append: tuple[str, ...] = ()) -> int:
        """Makes the next version: the given tables (added to what there is, for those named in ``append``), and those named in ``carry`` as they are."""
        now = self.version()
        before = self._folders(now)
        folders = {t: before[t] for t in carry if t not in tables}
        for name, frame in tables.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            frame.write.parquet(f"{self.root}/{folder}")
            folders[name] = [*(before.get(name, []) if name in append else []), folder]
        at = self.spark.range(1).select(F.current_timestamp().cast("string")).first()[0]
        self._claim(now + 1, json.dumps({"version": now + 1, "note": note, "committed_at": at, "folders": folders}))
        return now + 1

    def _claim(self, version: int, line: str) -> None:
        """The version's line, whole or not at all: it is written beside its place and renamed there, which only one writer can.

        A writer that dies leaves at most a file that nobody reads.
        """
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        target = path(f"{self.root}/_versions/{version:020d}.json")
        draft = path(f"{self.root}/_versions/_{uuid.uuid4().hex}")  # names with _ are not read
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(draft, False)
        out.write(bytearray((line + "\n").encode()))
        out.close()
        # An empty claim is what a writer of an earlier release left when it died between making and filling it.
        if fs.exists(target) and fs.getFileStatus(target).getLen() == 0:
            fs.delete(target, False)
        files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # without OVERWRITE
        try:
            files.rename(draft, target, options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} is there already") from None
            raise

    def copy_to(self, other: Archive, tables: tuple[str, ...]) -> dict[str, int]:
        """Copies tables and compares their fingerprints; a difference is an error that names the columns."""
        other.commit({t: self.read(t) for t in tables}, "copy")
        counts = {}
        for t in tables:
            mine, theirs = (fingerprint(a.read(t)).first().asDict() for a in (self, other))
            if bad := sorted(c for c in mine if mine[c] != theirs[c]):
                raise ValueError(f"copied table {t} differs in {bad}")
            counts[t] = mine["rows"]
        return counts


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: the number of rows, and for each column (with ``row``, for the rows as a whole) a sum of 64-bit hashes of its values.

    Sums do not depend on order, have partial results, and tell tables apart that have as many rows; the hash of whole
    rows also sees values that changed places.
    """
    total = lambda *cols: F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    plain = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in df.schema]
    shown = df.select(*plain)
    each = [total(F.col(f"`{c}`"), F.col(f"`{c}`").isNull()).alias(f"column {c}") for c in shown.columns]
    return shown.agg(F.count(F.lit(1)).alias("rows"), *each, total(*(x for c in shown.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull()))).alias("row"))


def run_status(events: DataFrame) -> DataFrame:
    """(run_id, status): the last state of each run; a run still open when another began was interrupted."""
    last = events.groupBy("run_id").agg(F.max_by("status", "seq").alias("status"), F.min("seq").alias("began"))
    newest = last.agg(F.max("began").alias("newest"))
    return last.join(F.broadcast(newest)).select("run_id", F.when((F.col("status") == "running") & (F.col("began") < F.col("newest")), "interrupted").otherwise(F.col("status")).alias("status"))  # one row


def media_objects(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, size, extension, source_path, content) of files, each content once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,10})$", 1)).alias("extension"), F.col("path").alias("source_path"))
    first = named.groupBy("sha256").agg(F.min_by(F.struct("size", "extension", "source_path"), "source_path").alias("f")).select("sha256", "f.*")
    return first.join(files.select(F.col("path").alias("source_path"), "content"), "source_path")


def store_media(objects: DataFrame, known: DataFrame, root: str) -> None:
    """Appends unknown objects, laid out by the first two digits of their digest."""
    new = objects.join(known.select("sha256"), "sha256", "left_anti")
    new.withColumn("prefix", F.left("sha256", F.lit(2))).write.mode("append").partitionBy("prefix").parquet(root)


def orphans(objects: DataFrame, references: DataFrame) -> DataFrame:
    """Objects that no row refers to."""
    return objects.join(references.select("sha256").filter("sha256 is not null"), "sha256", "left_anti")


#: Rows from which on a key is too frequent for one task.
HOT = 100_000


def looked_up(rows: DataFrame, key: str, table: DataFrame, value: str) -> DataFrame:
    """``rows`` with the ``value`` that a table of unique keys (key, value) has for theirs, else null.

    Keys that ``HOT`` rows or more share are few (at most one in ``HOT`` rows) and are broadcast with their values. The
    other keys are shuffled, and rows without such a key are spread by their own hash: no task gets all rows of a key.
    """
    table = table.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    hot = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT)
    hot = hot.join(table, F.col("_hot") == F.col("_key"), "left").select("_hot", F.col("_value").alias("_given"))
    rest = F.when(F.col("_hot").isNull(), F.col(key))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_rest", rest).withColumn("_salt", F.when(rest.isNull(), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(key)))
    found = marked.join(table.withColumn("_hash", F.xxhash64("_key")).hint("shuffle_hash"), (F.col("_rest") == F.col("_key")) & (F.col("_salt") == F.col("_hash")), "left")
    return found.select(*rows.columns, F.coalesce("_given", "_value").alias(value))


def locate(attachments: DataFrame, listing: DataFrame) -> DataFrame:
    """(message_id, ordinal, path): by digest (of several files the shortest name), then managed, then source path."""
    by_digest = listing.groupBy(F.col("sha256").alias("key")).agg(F.min_by("path", F.struct(F.length("path").alias("n"), "path")).alias("value"))
    there = listing.select(F.col("path").alias("key"), F.col("path").alias("value")).distinct()
    found = looked_up(attachments, "sha256", by_digest, "by_digest")
    for column in ("managed_path", "source_path"):
        found = looked_up(found, column, there, f"at_{column}")
    return found.select("message_id", "ordinal", F.coalesce("by_digest", "at_managed_path", "at_source_path").alias("path"))


def safe_relative(path: Column) -> Column:
    """A declared path that stays below its export, else null: no roots, drives, schemes or parents."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    bad = p.rlike(r"^/|^[A-Za-z][A-Za-z0-9+.-]*:|(^|/)\.\.(/|$)|\x00") | (F.length(p) == 0)
    return F.when(~bad, F.regexp_replace(p, r"^(\./)+", ""))


def trigrams(text: Column) -> Column:
    """The distinct three-letter pieces of a text, without case."""
    t = F.lower(text)
    n = F.length(t)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def trigram_index(messages: DataFrame) -> DataFrame:
    """(trigram, id): an inverted index for substring search."""
    return messages.select("id", F.explode(trigrams(F.col("content"))).alias("trigram"))


def indexed_search(index: DataFrame, messages: DataFrame, query: str) -> DataFrame:
    """Messages that contain a query of three letters or more: candidates hold all its pieces, then the text decides."""
    q = query.lower()
    pieces = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    hits = index.filter(F.col("trigram").isin(pieces)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(pieces))
    return messages.join(hits.select("id"), "id", "left_semi").filter(F.contains(F.lower("content"), F.lit(q)))
